import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridloom import NDArray, TileQuery
from gridloom.functions import shape as sh
from gridloom.operators import chunks, multifile
from gridloom.operators.tile import run_query

SHAPE = (8, 6, 10, 4)


@pytest.fixture(scope="module")
def w(spark):
    return NDArray.from_range(spark, SHAPE)


def by_tile(df):
    return {tuple(r[f"g{i}"] for i in range(len([c for c in df.columns if c[0] == "g"]))): r for r in df.collect()}


def brute(values, extraction, rule):
    out = {}
    for at in np.ndindex(*values.shape):
        out.setdefault(tuple(a // e for a, e in zip(at, extraction, strict=True)), []).append(int(values[at]))
    return {k: rule(sorted(v)) for k, v in out.items()}


@pytest.mark.parametrize("extraction", [(2, 3, 5, 2), (3, 4, 4, 3), (1, 1, 1, 1), (9, 9, 11, 5)])
def test_dense_array_against_numpy(w, extraction):
    values = np.arange(sh.size(SHAPE)).reshape(SHAPE)
    tiles = w.tile(extraction)
    for operator, rule in (("average", lambda v: sum(v) // len(v)), ("max", max), ("median", lambda v: v[len(v) // 2])):
        assert {k: r["value"] for k, r in by_tile(tiles.run(operator)).items()} == brute(values, extraction, rule)
    full = {k: r["is_full"] for k, r in by_tile(tiles.completeness()).items()}
    assert full == brute(values, extraction, lambda v: len(v) == sh.size(extraction))


def test_golden_values(w):
    # Tile -> n_cells, is_full, average, mean, max, upper median.
    golden = {
        (2, 3, 5, 2): {(0, 0, 0, 0): (60, True, 168, 168.5, 337, 240), (1, 1, 1, 1): (60, True, 790, 790.5, 959, 862), (3, 1, 1, 1): (60, True, 1750, 1750.5, 1919, 1822)},
        (3, 4, 4, 3): {(0, 0, 0, 0): (144, True, 307, 307.0, 614, 320), (1, 1, 1, 1): (24, False, 1165, 1165.0, 1431, 1179), (2, 1, 2, 1): (8, False, 1777, 1777.0, 1919, 1875)},
    }
    for extraction, expected in golden.items():
        t = w.tile(extraction)
        found = [by_tile(x) for x in (t.average(details=True), t.average_double(), t.max(), t.median())]
        for tile, (n, full, average, mean, top, middle) in expected.items():
            r = found[0][tile]
            assert (r["n_cells"], r["is_full"], r["value"], *(f[tile]["value"] for f in found[1:])) == (n, full, average, mean, top, middle)
    ids = {r["gid"]: r["value"] for r in w.tile().max_by_flat_id().collect()}
    assert ids == {i: i for i in range(1920)}


def test_negative_values_drop_the_fraction(spark):
    a = NDArray.from_table(spark.createDataFrame([(0, 0, -5), (0, 1, -2), (0, 2, None)], "x int, y int, v int"), ["x", "y"], "v")
    t = a.tile((1, 5))
    assert t.average().collect()[0]["value"] == -3
    for plan in ("percentile", "collect", "histogram"):
        assert t.median(plan=plan).collect()[0]["value"] == -2
    with pytest.raises(ValueError):
        t.median(plan="other")
    with pytest.raises(ValueError):
        t.run("other")
    with pytest.raises(ValueError):
        a.tile((1, 2, 3))


def test_empty_array(spark):
    a = NDArray.from_table(spark.createDataFrame([], "x int, y int, v int"), ["x", "y"], "v")
    assert a.tile((2, 2)).null_scan().count() == 0
    assert a.tile((2, 2)).median().count() == 0
    assert a.measured_shape() == (0, 0)


def test_results_do_not_depend_on_partitions(w):
    other = NDArray(w.df.repartition(13, "c3"), 4, SHAPE)
    for operator in ("average", "max", "median"):
        assert by_tile(other.tile((3, 4, 4, 3)).run(operator)) == by_tile(w.tile((3, 4, 4, 3)).run(operator))


def test_run_query_filters_records(w):
    got = run_query(w, TileQuery(operator="max", low=3, high=7, extraction_shape=(2, 6, 10, 4), num_partitions=3))
    assert {k[0]: r["value"] for k, r in by_tile(got).items()} == {1: 4 * 240 - 1, 2: 6 * 240 - 1, 3: 7 * 240 - 1}
    plan = w.tile((2, 6, 10, 4)).where_tile(1, 3).max()
    assert {k[0] for k in by_tile(plan)} == {1, 2}


def test_pushed_down_to_parquet(spark, w, tmp_path):
    w.df.write.parquet(str(tmp_path / "w"))
    stored = NDArray(spark.read.parquet(str(tmp_path / "w")), 4, SHAPE)
    plan = stored.tile((2, 3, 5, 2)).where_tile(1, 2).max()._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(c0,2)" in plan and "LessThan(c0,4)" in plan


def test_several_files(spark):
    a, b = NDArray.from_range(spark, (8, 2)), NDArray.from_range(spark, (6, 2), lambda i: (i + 100).cast("int"))
    assert multifile.combine([a, b]).shape == (8, 2)
    both = multifile.concat([a, b])
    assert both.shape == (14, 2)
    # A tile of three records spans the end of the first file at record 8.
    spans = by_tile(both.tile((3, 2)).average(details=True))
    assert spans[(2, 0)]["n_cells"] == 6 and spans[(2, 0)]["value"] == (12 + 13 + 14 + 15 + 100 + 101) // 6
    overlaid = by_tile(multifile.combine([a, b]).tile((1, 2)).max(details=True))
    assert overlaid[(0, 0)]["value"] == 101 and overlaid[(0, 0)]["n_cells"] == 4
    with pytest.raises(ValueError):
        multifile.combine([a, NDArray.from_range(spark, (2, 2, 2))])


def test_chunks_round_trip_and_local_tiles(w):
    stored = chunks.to_chunks(w, (3, 4, 10, 4))
    back = chunks.to_cells(stored, 4)
    assert sorted(map(tuple, back.df.collect())) == sorted(map(tuple, w.df.collect()))
    for operator in ("average", "max", "median"):
        local = chunks.local_tiles(chunks.to_chunks(w, (3, 4, 10, 4)), (3, 4, 4, 3), operator)
        assert {k: r["value"] for k, r in by_tile(local).items()} == {k: r["value"] for k, r in by_tile(w.tile((3, 4, 4, 3)).run(operator)).items()}
        assert "Exchange" not in chunks.local_tiles(stored.sparkSession.createDataFrame([], stored.schema), (3, 4, 4, 3), operator)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="aligned"):
        chunks.local_tiles(stored, (2, 4, 4, 3), "max").collect()
    with pytest.raises(ValueError):
        chunks.local_tiles(stored, (3, 4, 4, 3), "other")


def test_bounding_tiles_clip(spark):
    r = spark.createDataFrame([([1, 5], [4, 2])], "corner array<int>, shape array<int>")
    got = {(x["g0"], x["g1"]): (x["low0"], x["low1"], x["width0"], x["width1"]) for x in chunks.bounding_tiles(r, (2, 6)).collect()}
    assert got == {(0, 0): (1, 5, 1, 1), (0, 1): (1, 6, 1, 1), (1, 0): (2, 5, 2, 1), (1, 1): (2, 6, 2, 1), (2, 0): (4, 5, 1, 1), (2, 1): (4, 6, 1, 1)}


def test_slice_and_flat_id(w):
    part = w.slice((1, 2, 3, 0), (2, 1, 2, 4))
    assert part.df.count() == 16
    assert part.with_flat_id().where(F.col("gid") != F.col("value")).count() == 0


def test_ordered_results(spark):
    array = NDArray.from_range(spark, (40, 7), partitions=5)
    got = run_query(array, TileQuery(operator="max", extraction_shape=(3, 2), ordered=True)).collect()
    keys = [(r["g0"], r["g1"]) for r in got]
    assert keys == sorted(keys) and len(set(keys)) == 14 * 4


def test_cells_outside_the_range_are_counted(spark):
    array, seen = NDArray.from_range(spark, (40, 7)), Observation("cells")
    out = run_query(array, TileQuery(operator="average", low=10, high=25, extraction_shape=(5, 7)), seen)
    assert len(out.collect()) == 3
    assert seen.get == {"n_cells": 280, "n_invalid": 175}


def test_tile_counts(spark):
    array = NDArray.from_range(spark, (10, 7))
    assert tuple(array.tile((3, 7)).tile_counts().first()) == (70, 3, 1)
    assert tuple(array.where_records(90).tile((3, 7)).tile_counts().first()) == (0, 0, 0)
