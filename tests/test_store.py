import glob

import pytest
from pyspark.sql import functions as F

from gridloom import NDArray
from gridloom.operators import store

SHAPE, TILE = (30, 8, 6), (4, 3, 5)


@pytest.fixture(scope="module")
def tiles(spark):
    return NDArray.from_range(spark, SHAPE, lambda i: (i * 37 % 101).cast("int")).tile(TILE)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("operator", ["average", "max", "median"])
def test_bucketed_tiles_need_no_shuffle(spark, tiles, operator, tmp_path):
    kept = store.save_bucketed(tiles, store.table_name(), 5, str(tmp_path / "t"))
    out = kept.run(operator, details=True)
    assert "Exchange" not in plan_of(out) and "Exchange" in plan_of(tiles.run(operator, details=True))
    assert rows(out) == rows(tiles.run(operator, details=True))
    assert len(glob.glob(str(tmp_path / "t" / "part-*"))) <= 5


def test_ordered_tiles_read_the_files_that_have_them(spark, tiles, tmp_path):
    kept = store.save_ordered(tiles, str(tmp_path / "o"), files=12)
    assert kept.index.count() == 12 and kept.index.agg(F.sum("n_cells")).first()[0] == 30 * 8 * 6
    part = kept.tiles((2, 0, 0), (4, 3, 2))
    read = part.array.df.inputFiles()
    assert 2 <= len(read) <= 5
    assert rows(part.median()) == [r for r in rows(tiles.median()) if 2 <= r[0] < 4]
    cells = kept.slice((9, 2, 1), (3, 4, 5))
    assert len(cells.df.inputFiles()) <= 4
    assert rows(cells.df) == rows(tiles.array.slice((9, 2, 1), (3, 4, 5)).df)
    assert kept.tiles((90, 0, 0), (95, 1, 1)).max().count() == 0
    assert rows(kept.tiles().max()) == rows(tiles.max())


def test_order_over_all_files(spark, tiles, tmp_path):
    kept = store.save_ordered(tiles, str(tmp_path / "o"), files=7)
    index = sorted(kept.index.collect(), key=lambda r: r["file"])
    ends = [tuple(r[f"{n}_g0"] for n in ("low", "high")) for r in index]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    for f in sorted(glob.glob(str(tmp_path / "o" / "cells" / "part-*"))):
        own = [tuple(r[:6]) for r in spark.read.parquet(f).collect()]
        assert own == sorted(own)


def test_a_tile_larger_than_a_file(spark, tmp_path):
    one = NDArray.from_range(spark, (1000, 2)).tile((1000, 2))
    kept = store.save_ordered(one, str(tmp_path / "o"), files=8)
    assert kept.index.count() == 8
    assert rows(kept.tiles().median()) == rows(one.median())
