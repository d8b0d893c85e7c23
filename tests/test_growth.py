"""What a task holds or does stays the same when the tables grow."""

import glob
import pickle

import numpy as np
import pytest

from compare import DATA, connect, rows
from gridloom import NDArray, TileQuery, queries
from gridloom.sources import netcdf3


def test_flags_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """multi_file_combine had one file for each flag, so one task sorted and wrote all its cells."""
    monkeypatch.setattr(netcdf3, "FILE_BYTES", 4000)
    monkeypatch.setattr(queries, "shared_folder", lambda spark, name: str(tmp_path / name))
    got = queries.multi_file_combine(spark, f"{DATA}/sf0.001").toPandas()
    found = glob.glob(f"{tmp_path}/flags/*/*.nc")
    assert len(found) > 3 * 4 and all(np.prod(netcdf3.read_header(f)[0].shape) * 4 <= 4000 for f in found)
    assert rows(got) == rows(connect("sf0.001").sql(queries.ORACLE_SQL["multi_file_combine"]).df())


@pytest.mark.parametrize("records,tasks", [(5, 4), (1, 10), (20, 1)])
def test_tasks_write_neighbouring_files(spark, tmp_path, monkeypatch, records, tasks):
    monkeypatch.setattr(netcdf3, "TASK_BYTES", 2 * 4 * 3)  # two records
    seen = []
    lay = type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda self, n, by: seen.append(n) or lay(self, n, by))
    netcdf3.write(NDArray.from_range(spark, (20, 3)), str(tmp_path), "v", records_per_file=records)
    assert seen == [tasks]
    assert NDArray.read(spark, str(tmp_path)).with_flat_id().where("gid = value").count() == 60


@pytest.mark.parametrize("stretch", [1, 1 << 12])
def test_folders_overlaid(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(netcdf3, "STRETCH", stretch)
    for name, records in (("a", 7), ("a.b", 4), ("c", 3)):
        netcdf3.write(NDArray.from_range(spark, (records, 2)), str(tmp_path / name), "v", records_per_file=3)
    query = TileQuery(multi_file_mode="combine_folders")
    path = f"{tmp_path}/*/*.nc"
    starts = {(r["file"].removeprefix(f"{tmp_path}/"), r["start"]) for r in netcdf3.manifest(spark, path, query).collect()}
    assert starts == {(f"{name}/part-{i:09d}.nc", 3 * i) for name, n in (("a", 3), ("a.b", 2), ("c", 1)) for i in range(n)}
    assert {(f.removeprefix(f"{tmp_path}/"), before) for f, _, before in netcdf3.located(path, query)} == starts
    array = NDArray.read(spark, path, query)
    assert array.shape == (7, 2) and array.with_flat_id().where("gid = value").count() == array.df.count() == 2 * (7 + 4 + 3)
    assert TileQuery.from_conf({"multi_file_mode": "combine_folders"}) == query


def test_many_small_files_are_read_by_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    """netcdf_block_average had two tasks for each file of 100 records, and each task was sent the names of all files."""
    monkeypatch.setattr(netcdf3, "TASKS", 5)
    out = str(tmp_path)
    netcdf3.write(NDArray.from_range(spark, (60, 3)), out, "v", records_per_file=1)
    query = TileQuery(partition_mode="proportional")
    files = netcdf3.located(out, query)
    reader = netcdf3.NetCDF3Reader(files, query, {"block_size": "4"})
    found = netcdf3.pieces(files, query, 4)
    tasks = reader.partitions()
    assert len(found) == 60 and len(tasks) == 5
    assert [p for t in tasks for p in t.pieces] == found
    assert pickle.loads(pickle.dumps(reader)).files == [] and reader.files == files
    sent = pickle.loads(pickle.dumps(reader))
    assert sorted(x for t in tasks for b in sent.read(t) for x in b.column("value").to_pylist()) == list(range(180))


@pytest.mark.parametrize("sizes,most,expected", [([], 100, [0]), ([4] * 3, 100, [1, 1, 1]), ([4] * 10, 100, [5, 5]), ([4] * 10, 8, [2] * 5), ([400, 4, 4, 400], 100, [1, 2, 1])])
def test_tasks_are_bounded_by_bytes(monkeypatch, sizes, most, expected):
    monkeypatch.setattr(netcdf3, "TASKS", 2 if len(sizes) != 3 else 4)
    monkeypatch.setattr(netcdf3, "TASK_BYTES", most)
    v = netcdf3.Variable("v", (100, 1), ("a", "b"), 4, 0, None)
    found = [netcdf3.Piece("f", v, 0, (((0, 0), (n // 4, 1)),)) for n in sizes]
    assert [len(t.pieces) for t in netcdf3.tasks_of(found)] == expected
