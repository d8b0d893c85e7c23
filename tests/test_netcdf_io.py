"""Slices, offsets, the manifest and the sink of the NetCDF source."""

import glob
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import NDArray, TileQuery
from gridloom.sources import cdf, netcdf3

SHAPE = (20, 6, 10, 4)


@pytest.fixture(scope="module", params=[True, False], ids=["records", "fixed"])
def folder(request, spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("nc"))
    netcdf3.write(NDArray.from_range(spark, SHAPE), out, "wind", records_per_file=8, record_dimension=request.param)
    return out


class Counting:
    """A file that notes what is read of it."""

    def __init__(self, path):
        self.file, self.read = open(path, "rb"), []

    def read_at(self, n, at):
        self.read.append((at, n))
        self.file.seek(at)
        return self.file.read(n)


def test_only_the_bytes_of_a_slice_are_read(folder):
    path = sorted(glob.glob(f"{folder}/*.nc"))[1]  # records 8 to 15
    (v,) = netcdf3.read_header(path)
    whole = np.arange(8 * 240, 16 * 240).reshape(8, 6, 10, 4)
    for corner, shape, runs in [((2, 1, 3, 1), (3, 2, 4, 2), 3 * 2 * 4), ((0, 2, 0, 0), (8, 3, 10, 4), 8), ((5, 0, 0, 0), (1, 6, 10, 4), 1), ((0, 0, 9, 3), (8, 6, 1, 1), 48)]:
        f = Counting(path)
        got = cdf.read_rectangle(f, v, corner, shape, gap=0)
        assert got.tolist() == whole[tuple(slice(c, c + s) for c, s in zip(corner, shape, strict=True))].ravel().tolist()
        assert sum(n for _, n in f.read) == 4 * got.size and len(f.read) == runs  # not a byte besides
        f = Counting(path)
        assert cdf.read_rectangle(f, v, corner, shape).tolist() == got.tolist()
        assert len(f.read) == 1 and sum(n for _, n in f.read) <= 4 * whole.size  # short gaps are read along


def test_runs_are_joined_up_to_a_gap_and_a_size():
    at = np.array([0, 10, 20, 1000, 1010, 5000])
    assert list(cdf.reads(at, 4, gap=6)) == [(0, 3), (3, 5), (5, 6)]
    assert list(cdf.reads(at, 4, gap=5)) == [(i, i + 1) for i in range(6)]
    assert list(cdf.reads(at, 4, gap=10**6, most=24)) == [(0, 3), (3, 5), (5, 6)]
    assert list(cdf.reads(at, 4, gap=10**6)) == [(0, 6)]
    assert list(cdf.reads(np.array([], np.int64), 4)) == []


def test_pieces_hold_a_slice_alone(spark, folder):
    query = TileQuery(variable="wind", slice_corner=(6, 1, 2, 0), slice_shape=(5, 2, 3, 4), low=7, partition_mode="record")
    cells = 0
    for p in netcdf3.pieces(netcdf3.located(folder, query), query, 1 << 20):
        for corner, shape in p.rectangles:
            assert corner[1:] == (1, 2, 0) and shape[1:] == (2, 3, 4) and 7 <= corner[0] + p.offset < 11
            cells += np.prod(shape)
    assert cells == 4 * 24
    got = {tuple(r[:4]): r["value"] for r in NDArray.read(spark, folder, query).df.collect()}
    assert got == {(a, b, c, d): ((a * 6 + b) * 10 + c) * 4 + d for a in range(7, 11) for b in (1, 2) for c in (2, 3, 4) for d in range(4)}
    with pytest.raises(ValueError, match="slice"):
        TileQuery(slice_corner=(1,))


@pytest.mark.parametrize("most", [1, 7, 40, 500, 10**6])
@pytest.mark.parametrize("tile", [None, (3, 4, 4, 3)])
def test_split_covers_a_rectangle_once(most, tile):
    corner, shape = (2, 1, 3, 0), (7, 5, 6, 4)
    seen = np.zeros((12, 8, 10, 5), int)
    for c, s in cdf.split(corner, shape, most, tile):
        assert np.prod(s) <= most
        seen[tuple(slice(a, a + n) for a, n in zip(c, s, strict=True))] += 1
    inside = tuple(slice(a, a + n) for a, n in zip(corner, shape, strict=True))
    assert (seen[inside] == 1).all() and seen.sum() == np.prod(shape)


def test_manifest_is_read_in_place_of_headers(spark, folder, tmp_path):
    query = TileQuery(variable="wind")
    rows = netcdf3.manifest(spark, folder, query).orderBy("number").collect()
    assert [(r["number"], r["records"], r["start"], tuple(r["shape"])) for r in rows] == [(0, 8, 0, (8, 6, 10, 4)), (1, 8, 8, (8, 6, 10, 4)), (2, 4, 16, (4, 6, 10, 4))]
    copy = tmp_path / "copy"
    copy.mkdir()
    for f in glob.glob(f"{folder}/*.nc"):
        (copy / os.path.basename(f)).write_bytes(open(f, "rb").read())
    saved = str(tmp_path / "manifest")
    netcdf3.manifest(spark, str(copy), query).write.parquet(saved)
    for f in glob.glob(f"{copy}/*.nc"):  # headers that can't be parsed any more
        with open(f, "r+b") as out:
            out.write(b"XXXX")
    array = NDArray.read(spark, str(copy), query, {"manifest": saved})
    assert array.shape == SHAPE and array.df.count() == 4800
    assert array.with_flat_id().where(F.col("gid") != F.col("value")).count() == 0


def test_prefix_sums_over_stretches(spark, folder, monkeypatch):
    monkeypatch.setattr(netcdf3, "STRETCH", 2)
    assert sorted((r["number"], r["start"]) for r in netcdf3.manifest(spark, folder).collect()) == [(0, 0), (1, 8), (2, 16)]
    overlaid = netcdf3.manifest(spark, folder, TileQuery(multi_file_mode="combine"))
    assert [r["start"] for r in overlaid.collect()] == [0, 0, 0]


def test_offsets_lead_to_the_values(spark, folder):
    cells = netcdf3.cells_with_offsets(spark, folder, TileQuery(variable="wind", slice_corner=(5, 0, 2, 1), slice_shape=(9, 6, 3, 2)))
    rows = netcdf3.values_at(cells, "int").collect()
    assert len(rows) == 9 * 6 * 3 * 2 and all(r["found"] == r["value"] for r in rows)
    for r in rows[::17]:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert struct.unpack(">i", f.read(4))[0] == r["value"]


def test_header_without_a_record_count(tmp_path, spark):
    head, (a, b), step = netcdf3.header([("t", 0), ("x", 3)], [("a", (0, 1), 3), ("b", (0, 1), 4)], records=cdf.STREAMING)
    body = b"".join(np.array([r] * 3, ">i2").tobytes() + b"\0\0" + np.array([10 * r + i for i in range(3)], ">i4").tobytes() for r in range(5))
    assert len(body) == 5 * step and a == len(head)
    path = tmp_path / "stream.nc"
    path.write_bytes(head + body + b"\0" * 7)  # and a record that was never finished
    assert [v.shape for v in netcdf3.read_header(str(path))] == [(5, 3), (5, 3)]
    assert sorted(r["value"] for r in NDArray.read(spark, str(path)).df.collect()) == sorted(10 * r + i for r in range(5) for i in range(3))
    with pytest.raises(netcdf3.HeaderError, match="record count"):
        netcdf3.parse_header(head)
    fixed, _, _ = netcdf3.header([("x", 3)], [("a", (0,), 4)], records=cdf.STREAMING)
    assert netcdf3.parse_header(fixed)[0].shape == (3,)


# --- The sink


@pytest.mark.parametrize("records", ["true", "false"])
@pytest.mark.parametrize("kind,number", [("tinyint", 1), ("smallint", 3), ("int", 4), ("float", 5), ("double", 6)])
def test_round_trip_of_each_type(spark, tmp_path, kind, number, records):
    spark.dataSource.register(netcdf3.NetCDF3)
    cells = NDArray.from_range(spark, (7, 3, 3), lambda i: (i % 100).cast(kind)).df.coalesce(1).sortWithinPartitions("c0")
    out = str(tmp_path / "o")
    cells.write.format("netcdf3").options(shape="7,3,3", variable="v", records_per_file=3, record_dimension=records).mode("append").save(out)
    assert sorted(os.listdir(out)) == [f"part-{i:09d}.nc" for i in range(3)]
    array = NDArray.read(spark, out)
    assert array.name == "v" and array.shape == (7, 3, 3) and array.df.schema["value"].dataType.simpleString() == kind
    assert sorted(map(tuple, array.df.collect())) == sorted(map(tuple, cells.collect()))
    assert netcdf3.read_header(f"{out}/part-000000002.nc")[0].kind == number


def test_records_are_streamed(spark, tmp_path, monkeypatch):
    """However many records a file has, a task holds HELD_BYTES of them."""
    monkeypatch.setattr(netcdf3, "HELD_BYTES", 100)
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("c0 int, c1 int, value int")
    w = netcdf3.NetCDF3Writer(schema, {"path": str(tmp_path), "shape": "1000,5", "records_per_file": "1000"}, False)
    file = netcdf3._File(w, 0)
    assert len(file.blocks[0]) == 5
    file.add(np.array([3, 700]), [np.array([1, 4])], [np.array([8, 9])])
    assert file.at == 700
    file.close()
    assert os.path.getsize(file.name) == 1000 * 20 + len(w._head(0)[0])


def test_missing_cells_and_whole_missing_files(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 5), (25, 1, 6)], "c0 int, c1 int, value int")
    out = str(tmp_path / "m")
    files = netcdf3.write(NDArray(cells, 2, (30, 2)), out, "v", records_per_file=10, fill=-9)
    assert [r["records"] for r in files.orderBy("file").collect()] == [10, 10, 10] and all(os.path.exists(r["file"]) for r in files.collect())
    got = {(r["c0"], r["c1"]): r["value"] for r in NDArray.read(spark, out).df.collect()}
    assert got == {(i, j): {(1, 0): 5, (25, 1): 6}.get((i, j), -9) for i in range(30) for j in range(2)}


def test_no_file_is_left_by_a_failed_write(spark, tmp_path):
    out = str(tmp_path / "f")
    spark.dataSource.register(netcdf3.NetCDF3)
    bad = NDArray.from_range(spark, (40, 3), lambda i: F.when(i == 100, F.raise_error(F.lit("broken"))).otherwise(i).cast("int")).df
    with pytest.raises(Exception, match="broken"):
        bad.coalesce(1).write.format("netcdf3").options(shape="40,3", records_per_file=4).mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
    good = NDArray.from_range(spark, (40, 3)).df
    for df, shape, what in ((good.where("c0 < 8 OR c0 > 20").coalesce(1), "40,3", "expected"), (good.coalesce(1).sortWithinPartitions(F.col("c0") % 4), "40,3", "sorted by record"), (good.coalesce(1), "20,3", "outside")):
        with pytest.raises(Exception, match=what):
            df.write.format("netcdf3").options(shape=shape, records_per_file=4).mode("append").save(out)
        assert not os.path.exists(out) or os.listdir(out) == []


def test_overwrite_replaces_files(spark, tmp_path):
    out = str(tmp_path / "w")
    netcdf3.write(NDArray.from_range(spark, (9, 2)), out, "v", records_per_file=2)
    df = NDArray.from_range(spark, (4, 2)).df.coalesce(1)
    df.write.format("netcdf3").options(shape="4,2", records_per_file=4, variable="u").mode("overwrite").save(out)
    assert os.listdir(out) == ["part-000000000.nc"] and NDArray.read(spark, out).shape == (4, 2)
