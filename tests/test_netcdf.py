import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import NDArray, TileQuery
from gridloom.__main__ import main
from gridloom.sources import netcdf3

SHAPE = (8, 6, 10, 4)


@pytest.fixture(scope="module", params=[True, False], ids=["records", "fixed"])
def folder(request, spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("nc"))
    netcdf3.write(NDArray.from_range(spark, SHAPE), out, "wind", records_per_file=3, record_dimension=request.param)
    (tmp := open(f"{out}/zz-other.nc", "wb")).write(b"something else") and tmp.close()
    return out


def test_header_of_published_layout():
    # CDF-1: one dimension x = 3, one unlimited dimension t; byte variable a(t, x) and int b(t, x).
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">II", 10, 2) + name("t") + struct.pack(">I", 0) + name("x") + struct.pack(">I", 3)
    attribute = struct.pack(">II", 12, 1) + name("units") + struct.pack(">II", 2, 5) + b"hello\0\0\0"
    a = name("a") + struct.pack(">III", 2, 0, 1) + attribute + struct.pack(">III", 1, 4, 200)
    b = name("b") + struct.pack(">III", 2, 0, 1) + struct.pack(">II", 0, 0) + struct.pack(">III", 4, 12, 204)
    head = lambda *v: b"CDF\x01" + struct.pack(">I", 7) + dims + struct.pack(">II", 0, 0) + struct.pack(">II", 11, len(v)) + b"".join(v)
    first, second = netcdf3.parse_header(head(a, b))
    assert (first.name, first.shape, first.kind, first.begin, first.record_bytes) == ("a", (7, 3), 1, 200, 16)
    assert (second.name, second.shape, second.begin, second.record_bytes) == ("b", (7, 3), 204, 16)
    assert netcdf3.parse_header(head(a))[0].record_bytes == 3  # a single record variable isn't padded
    for bad in (b"HDF\x01" + b"\0" * 40, b"CDF\x05" + b"\0" * 40, b"CDF\x01" + struct.pack(">III", 0, 99, 1)):
        with pytest.raises(netcdf3.HeaderError):
            netcdf3.parse_header(bad)
    with pytest.raises(EOFError):
        netcdf3.parse_header(head(a, b)[:50])


@pytest.mark.parametrize("mode", ["record", "proportional", "calculated"])
@pytest.mark.parametrize("dependent", [False, True])
def test_all_cells_whatever_the_splits(spark, folder, mode, dependent):
    query = TileQuery(variable="wind", partition_mode=mode, query_dependent=dependent, extraction_shape=(3, 4, 4, 3))
    array = NDArray.read(spark, folder, query, {"block_size": "700"})
    assert array.shape == SHAPE and array.name == "wind"
    assert array.with_flat_id().where(F.col("gid") != F.col("value")).count() == 0
    assert array.df.count() == 1920


def test_record_range_is_pruned_and_exact(spark, folder):
    query = TileQuery(variable="wind", low=2, high=5, partition_mode="record")
    assert {r["c0"] for r in NDArray.read(spark, folder, query).df.select("c0").distinct().collect()} == {2, 3, 4}
    splits = netcdf3.explain_splits(spark, folder, query)
    assert splits.count() == 3
    assert netcdf3.explain_splits(spark, folder, query.with_(noscan=False)).count() == 8
    assert NDArray.read(spark, folder, query.with_(noscan=False)).df.count() == 3 * 240
    assert NDArray.read(spark, folder, query.with_(low=100, high=200)).df.count() == 0


def test_one_frame_serves_several_filters(spark, folder):
    spark.dataSource.register(netcdf3.NetCDF3)
    df = spark.read.format("netcdf3").options(variable="wind", low="1", high="6", partition_mode="record", block_size="1").load(folder)
    assert df.rdd.getNumPartitions() == 5
    assert (df.where("c0 >= 2 AND c0 < 5").count(), df.count()) == (3 * 240, 5 * 240)


def test_files_overlaid(spark, folder):
    array = NDArray.read(spark, folder, TileQuery(multi_file_mode="combine"))
    assert array.shape == (3, 6, 10, 4)
    found = array.tile().completeness().groupBy("g0", "n_cells").count().collect()
    assert sorted(map(tuple, found)) == [(0, 3, 240), (1, 3, 240), (2, 2, 240)]  # the third file has two records


def test_interleaved_variables_and_fill_value(spark, tmp_path):
    head, (a, b), step = netcdf3.header([("t", 0), ("x", 3)], [("a", (0, 1), 3), ("b", (0, 1), 4)], records=4)
    assert step == 8 + 12
    data = bytearray(b - len(head) + 4 * step)
    for r in range(4):
        at = a - len(head) + r * step
        data[at : at + 6] = np.array([r, -1, 9], ">i2").tobytes()
        data[at + 8 : at + 20] = np.array([10 * r, 10 * r + 1, 10 * r + 2], ">i4").tobytes()
    (tmp_path / "two.nc").write_bytes(head + bytes(data[: 4 * step]))
    path = str(tmp_path / "two.nc")
    assert [r["value"] for r in NDArray.read(spark, path).df.orderBy("c0", "c1").collect()] == [10 * r + i for r in range(4) for i in range(3)]
    small = NDArray.read(spark, path, TileQuery(variable="a"), {"fill_value": "-1"})
    assert sorted((r["c0"], r["c1"], r["value"]) for r in small.df.collect()) == [(r, i, v) for r in range(4) for i, v in ((0, r), (2, 9))]
    with pytest.raises(Exception, match="there is no variable"):
        NDArray.read(spark, path, TileQuery(variable="c"))


@pytest.mark.parametrize("records", [True, False])
def test_coordinate_variables(spark, tmp_path, records):
    dims = [netcdf3.Column1D("time", "days", "since midnight, 1,1,1970"), netcdf3.Column1D("lat", "latitude", "half degrees"), netcdf3.Column1D("lon", units="degrees")]
    out = str(tmp_path / "c")
    netcdf3.write(NDArray.from_range(spark, (5, 3, 2)), out, "wind", records_per_file=4, record_dimension=records, coordinates=dims)
    array = NDArray.read(spark, out)
    assert array.name == "wind" and array.shape == (5, 3, 2)
    assert array.df.count() == 30 and array.with_flat_id().where(F.col("gid") != F.col("value")).count() == 0
    second = netcdf3.list_files(out)[1]
    variables = netcdf3.read_header(second)
    assert [(v.name, v.shape, v.dims) for v in variables] == [("time", (1,), ("time",)), ("lat", (3,), ("lat",)), ("lon", (2,), ("lon",)), ("wind", (1, 3, 2), ("time", "lat", "lon"))]
    data = open(second, "rb").read()
    assert np.frombuffer(data, ">f4", 3, variables[1].begin).tolist() == [0.0, 1.0, 2.0]
    assert np.frombuffer(data, ">i4", 1, variables[0].begin).tolist() == [4]
    assert b"half degrees" in data and b"long_name" in data


def test_patterns_in_any_store(spark, folder, tmp_path):
    assert netcdf3.list_files(f"file://{folder}/part-*.nc") == [f"file://{x}" for x in netcdf3.list_files(f"{folder}/part-*.nc")]
    assert NDArray.read(spark, f"file://{folder}/*.nc", TileQuery(variable="wind")).df.count() == 1920
    for day in ("d1", "d2"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "a.nc").write_bytes(b"")
        (tmp_path / day / "_b.nc").write_bytes(b"")
    assert netcdf3.list_files(f"file://{tmp_path}/d?/*.nc") == [f"file://{tmp_path}/d{k}/a.nc" for k in (1, 2)]


def test_missing_and_broken_files(spark, tmp_path):
    (tmp_path / "bad.nc").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no NetCDF classic file"):
        NDArray.read(spark, str(tmp_path))
    with pytest.raises(Exception, match="not a NetCDF classic file|ends inside"):
        NDArray.read(spark, str(tmp_path), options={"skip_invalid": "false"})


def test_several_variables_in_a_file(spark, tmp_path):
    cells = NDArray.from_range(spark, (7, 3, 2))
    both = NDArray(cells.df.withColumn("twice", F.col("value") * 2), 3, (7, 3, 2))
    for records in (True, False):
        out = str(tmp_path / str(records))
        netcdf3.write(both, out, "once", records_per_file=4, record_dimension=records, others=["twice"], coordinates=[netcdf3.Column1D(x) for x in "tyx"])
        for name, factor in (("once", 1), ("twice", 2)):
            array = NDArray.read(spark, out, TileQuery(variable=name, low=2, high=6, partition_mode="calculated"), {"block_size": "40"})
            assert array.df.count() == 24 and array.with_flat_id().where(F.col("gid") * factor != F.col("value")).count() == 0


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(netcdf3, "FILE_BYTES", 100)
    assert [r["records"] for r in netcdf3.write(NDArray.from_range(spark, (7, 3, 2)), str(tmp_path), "v").collect()] == [4, 3]


def test_generate(spark, tmp_path):
    assert main(["generate", str(tmp_path / "a"), "--shape", "6,3,4"], spark) == 0
    array = NDArray.read(spark, str(tmp_path / "a"))
    assert array.name == "windspeed1" and array.shape == (6, 3, 4)
    assert array.with_flat_id().where(F.col("gid") != F.col("value")).count() == 0
    assert main(["generate", str(tmp_path / "b"), "--shape", "20,30,10", "--gaussian", "5", "--variable", "w"], spark) == 0
    found = NDArray.read(spark, str(tmp_path / "b"), TileQuery(variable="w")).df.agg(F.avg("value").alias("mean"), F.min("value").alias("least")).first()
    assert found["least"] == 0 and 29 < found["mean"] < 34  # 40 * sqrt(2 / pi) = 31.9, fractions dropped


def test_command_line(spark, folder, tmp_path):
    out = tmp_path / "out"
    assert main(["average", folder, str(out), "-D", "variable_name=wind", "-D", "extraction_shape=2,3,5,2"], spark) == 0
    lines = [x for p in out.glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 32 and "wind: groupID = [1, 1, 1, 1]\t790" in lines
    assert main(["identity", folder, str(tmp_path / "none")], spark) == 2
    assert main(["identity", folder, str(tmp_path / "m"), "-D", "operator=simpleMedian", "-D", "extraction_shape=8,6,10,4"], spark) == 0
    assert [p.read_text() for p in (tmp_path / "m").glob("part-*") if p.read_text()] == ["wind: groupID = [0, 0, 0, 0]\t960\n"]
