import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import NDArray, TileQuery
from gridloom.operators.blocks import BlockArray
from gridloom.sources import netcdf3

SHAPE = (23, 7, 11)


def values():
    return np.random.default_rng(5).integers(-50, 50, SHAPE).astype(np.int32)


def cut_up(spark, array, steps):
    """Blocks of an array between the given cuts of each dimension."""
    rows = []
    axes = [list(zip([0, *c], [*c, d], strict=True)) for c, d in zip(steps, array.shape, strict=True)]
    for at in np.ndindex(*map(len, axes)):
        box = [axis[k] for axis, k in zip(axes, at, strict=True)]
        part = array[tuple(slice(a, b) for a, b in box)]
        rows.append(([a for a, _ in box], list(part.shape), part.ravel().tolist()))
    return spark.createDataFrame(rows, "corner array<int>, shape array<int>, values array<int>").repartition(3)


def plain(array, tile, operator):
    out = {}
    for at in np.ndindex(*(-(-d // e) for d, e in zip(array.shape, tile, strict=True))):
        cells = np.sort(array[tuple(slice(g * e, (g + 1) * e) for g, e in zip(at, tile, strict=True))].ravel())
        total = int(cells.sum())
        mean = abs(total) // len(cells) * (1 if total >= 0 else -1)
        out[at] = {"average": mean, "max": int(cells[-1]), "median": int(cells[len(cells) // 2])}[operator], len(cells)
    return out


def found(df, rank=3):
    rows = df.collect()
    assert len({tuple(r[:rank]) for r in rows}) == len(rows)
    return {tuple(r[:rank]): (r["value"], r["n_cells"]) for r in rows}


@pytest.mark.parametrize("operator", ["average", "max", "median"])
@pytest.mark.parametrize("tile", [(4, 3, 5), (1, 7, 11), (30, 30, 30)], ids=str)
@pytest.mark.parametrize("known", [True, False], ids=["shape", "no shape"])
def test_blocks_that_cut_tiles(spark, operator, tile, known):
    array = values()
    blocks = cut_up(spark, array, [[5, 8, 9], [3], [1, 10]])
    tiles = BlockArray(blocks, SHAPE if known else None).tile(tile)
    assert found(tiles.run(operator, details=True)) == plain(array, tile, operator)


def test_only_edge_tiles_are_states(spark):
    """Blocks of eight records and tiles of three: those with records on both sides of 8 and 16 are states, once for each block."""
    blocks = cut_up(spark, values(), [[8, 16], [], []])
    tiles = BlockArray(blocks, SHAPE).tile((3, 7, 2))
    states = tiles.states("median").collect()
    edges = [(g, h) for g in range(8) for h in range(6) if g in (2, 5)]
    assert sorted((r["g0"], r["g2"]) for r in states if not r["whole"]) == sorted(edges * 2)
    assert len(states) == 8 * 6 + len(edges)
    out = tiles.run("median")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NOT whole" in plan and "Exchange" in plan
    assert BlockArray(blocks, SHAPE).tile((8, 7, 2)).states("max").where("NOT whole").count() == 0


def test_overlaid_blocks_and_nulls(spark):
    rows = [([0, 0], [2, 2], [1, 2, None, 4]), ([0, 0], [2, 3], [9, None, None, 8, 7, None]), ([4, 4], [1, 1], [None])]
    blocks = spark.createDataFrame(rows, "corner array<int>, shape array<int>, values array<int>")
    tiles = BlockArray(blocks, None, overlaid=True).tile((2, 2))
    assert found(tiles.run("average", details=True), 2) == {(0, 0): (31 // 6, 6)}
    assert found(tiles.run("max", details=True), 2) == {(0, 0): (9, 6)}
    assert found(tiles.run("median", details=True), 2) == {(0, 0): (7, 6)}
    assert BlockArray(blocks.where("false")).tile((2, 2)).run("max").count() == 0


def test_floats(spark):
    blocks = spark.createDataFrame([([0], [5], [1.5, -2.5, 0.0, 7.25, 3.0]), ([5], [2], [-1.0, -1.5])], "corner array<int>, shape array<int>, values array<double>")
    tiles = BlockArray(blocks, (7,)).tile((3,))
    assert found(tiles.run("max", details=True), 1) == {(0,): (1.5, 3), (1,): (7.25, 3), (2,): (-1.5, 1)}
    assert found(tiles.run("median", details=True), 1) == {(0,): (0.0, 3), (1,): (3.0, 3), (2,): (-1.5, 1)}
    assert found(tiles.run("average", details=True), 1) == {(0,): (0, 3), (1,): (3, 3), (2,): (-1, 1)}


def test_one_distinct_value_in_each_row_of_a_state(spark, monkeypatch):
    from gridloom.operators import blocks as module

    array = values()
    monkeypatch.setattr(module, "STATE_VALUES", 3)
    rows = list(module._state("median", array.ravel(), False, True))
    assert len(rows) == -(-len(np.unique(array)) // 3) and sum(r[1] for r in rows) == array.size


@pytest.mark.parametrize("records", [True, False])
@pytest.mark.parametrize("mode", ["record", "proportional", "calculated"])
def test_files_without_a_row_for_each_cell(spark, tmp_path, records, mode):
    out = str(tmp_path / "n")
    array = np.arange(23 * 7 * 11).reshape(SHAPE)
    netcdf3.write(NDArray.from_range(spark, SHAPE), out, "w", records_per_file=9, record_dimension=records)
    query = TileQuery(extraction_shape=(4, 3, 5), partition_mode=mode)
    tiles = BlockArray.read(spark, out, query, {"block_size": "2000"}).tile((4, 3, 5))
    assert found(tiles.run("median", details=True)) == plain(array, (4, 3, 5), "median")
    scan = tiles.array.blocks
    assert scan.columns == ["corner", "shape", "values"] and scan.count() < 60
    part = BlockArray.read(spark, out, query.with_(slice_corner=(3, 2, 1), slice_shape=(9, 4, 8))).tile((4, 3, 5)).run("max", details=True)
    want = NDArray.read(spark, out, query).slice((3, 2, 1), (9, 4, 8)).tile((4, 3, 5)).max(details=True)
    assert found(part) == found(want)


def test_refining_median_of_a_very_large_tile(spark):
    """10**8 cells in one tile: a task holds its counters alone, and shuffles these."""
    cells = spark.range(10**8).select(sh_zero := F.lit(0).alias("c0"), F.lit(0).alias("c1"), ((F.col("id") * 7919) % 1_000_003 - 500_000).cast("int").alias("value"))
    assert sh_zero is not None
    got = NDArray(cells, 2).tile((1, 1)).median(details=True, plan="refine").collect()
    all_ = np.sort((np.arange(10**8, dtype=np.int64) * 7919) % 1_000_003 - 500_000)
    assert [tuple(r) for r in got] == [(0, 0, int(all_[len(all_) // 2]), 10**8, False)]


@pytest.mark.parametrize("kind", ["tinyint", "int", "bigint"])
def test_refining_equals_sorting(spark, kind):
    low, high = {"tinyint": (-128, 127), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}[kind]
    rng = np.random.default_rng(1)
    rows = [(g, int(v)) for g in range(6) for v in rng.integers(low, high, 5 + 9 * g, endpoint=True)] + [(9, low), (9, high), (10, high), (11, low)]
    array = NDArray(spark.createDataFrame(rows, "c0 int, v bigint").select("c0", F.lit(0).alias("c1"), F.col("v").cast(kind).alias("value")), 2)
    get = lambda **o: sorted(map(tuple, array.tile((1, 1)).median(details=True, **o).collect()))
    assert get(plan="refine", counters=16) == get(plan="collect") == get(plan="refine")
    with pytest.raises(ValueError, match="whole numbers"):
        NDArray(array.df.withColumn("value", F.lit(1.5)), 2).tile((1, 1)).median(plan="refine")
