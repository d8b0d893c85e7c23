"""NetCDF classic files as a Spark data source and sink.

A manifest lists the files of a path with their geometry and the records before
each; headers are parsed in tasks, once, and the manifest serves all reads. The
reader's tasks seek to their rectangles and give Arrow batches of cells, or of
blocks (a rectangle's values in one row). Only the byte runs of the records and
of the slice that a query asks for are read. The writer streams records into
files that appear when the whole write has been done."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import shape as sh
from ..operators.array import NDArray
from ..plans import partition as plan
from ..plans.config import INT_MAX, TileQuery
from .cdf import TYPES, HeaderError, Variable, header, list_files, open_file, parse_header, read_header, read_rectangle, reads, split, store_of
from .folders import shared_folder

__all__ = ["Column1D", "HeaderError", "NetCDF3", "Variable", "explain_splits", "header", "cells_with_offsets", "list_files", "manifest", "parse_header", "read_array", "read_blocks", "read_header", "values_at", "write"]

#: Cells of one batch, and of one block.
BATCH_CELLS = 1 << 18
#: Small pieces are dealt to so many tasks, each of TASK_BYTES of cells at most; the small files that one task writes have TASK_BYTES together, too.
TASKS, TASK_BYTES = 128, 16 << 20


# --- Which files, and where their records are


def choose(variables: list[Variable], name: str) -> Variable:
    """By name, or the last one; of two dimensions at least."""
    found = [v for v in variables if v.name == name] if name else variables[-1:]
    if not found:
        raise ValueError(f"there is no variable {name!r}; there are {', '.join(v.name for v in variables) or 'none'}")
    if len(found[0].shape) < 2:
        raise ValueError(f"{found[0].name} has {len(found[0].shape)} dimension(s); two at least are needed")
    return found[0]


MANIFEST = "number long, file string, name string, shape array<long>, dims array<string>, kind int, begin long, record_bytes long, records long"
#: Files whose record counts are summed in one task.
STRETCH = 1 << 12


def manifest(spark: SparkSession, path: str, query: TileQuery = TileQuery(), skip_invalid: bool = True) -> DataFrame:
    """A row for each NetCDF file of a path: number (its place in the order of names), file, the chosen variable's name, shape, dims, kind, begin and record_bytes, records, and start, the records before it (0 for the multi-file mode "combine"; in its folder for "combine_folders").

    Headers are parsed in tasks, each once; other files are left out, or fail.
    Written as Parquet, it serves as the option manifest of later reads."""

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    v = choose(read_header(file), query.variable)
                except HeaderError:
                    if not skip_invalid:
                        raise
                    continue
                rows.append({"number": number, "file": file, "name": v.name, "shape": list(v.shape), "dims": list(v.dims), "kind": v.kind, "begin": v.begin, "record_bytes": v.record_bytes, "records": v.shape[0]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    lists = {"array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(n, lists[t]) for n, t in (c.split() for c in MANIFEST.split(", "))])
    files = list(enumerate(list_files(path)))
    tasks = max(1, min(len(files) // 16, spark.sparkContext.defaultParallelism * 4))
    found = spark.createDataFrame(files, "number long, file string").repartition(tasks).mapInArrow(parsed, MANIFEST)
    if query.multi_file_mode not in ("concat", "combine_folders"):
        return found.withColumn("start", F.lit(0).cast("long"))
    # Prefix sums in two steps, so that no task gets a row for each file.
    one_array = F.regexp_replace("file", "[^/]*$", "") if query.multi_file_mode == "combine_folders" else F.lit("")
    found = found.withColumn("_array", one_array).withColumn("_stretch", sh.div("number", STRETCH))
    sums = found.groupBy("_array", "_stretch").agg(F.sum("records").alias("_n"))
    before = sums.select("_array", "_stretch", F.coalesce(F.sum("_n").over(Window.partitionBy("_array").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("records").over(Window.partitionBy("_array", "_stretch").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(before, ["_array", "_stretch"]).withColumn("start", F.col("_before") + inside).drop("_array", "_stretch", "_before", "_n")


Located = list[tuple[str, Variable, int]]  # (file, variable, records before it)


def from_manifest(folder: str) -> Located:
    fs, inner = store_of(folder)
    rows = sorted(pads.dataset(inner, filesystem=fs, format="parquet").to_table().to_pylist(), key=lambda r: r["number"])
    return [(r["file"], Variable(r["name"], tuple(r["shape"]), tuple(r["dims"]), r["kind"], r["begin"], r["record_bytes"]), r["start"]) for r in rows]


def located(path: str, query: TileQuery, skip_invalid: bool = True) -> Located:
    """What manifest() has, read by the driver, headers 32 at a time: for a read without a manifest."""

    def header_of(f: str) -> list[Variable] | HeaderError:
        try:
            return read_header(f)
        except HeaderError as e:
            return e

    out, before, files = [], defaultdict(int), list_files(path)
    with ThreadPoolExecutor(32) as pool:
        headers = list(pool.map(header_of, files))
    for f, found in zip(files, headers, strict=True):
        if isinstance(found, HeaderError):
            if skip_invalid:
                continue
            raise found
        v = choose(found, query.variable)
        one_array = {"concat": "", "combine_folders": f.rpartition("/")[0]}.get(query.multi_file_mode, f)
        out.append((f, v, before[one_array]))
        before[one_array] += v.shape[0]
    if not out:
        raise ValueError(f"no NetCDF classic file in {path}")
    return out


@dataclass(frozen=True)
class Piece:
    """Rectangles of one file; offset: the records of the files before."""

    path: str
    variable: Variable
    offset: int
    rectangles: tuple[plan.Rectangle, ...]

    @property
    def bytes_(self) -> int:
        return sum(sh.size(shape) for _, shape in self.rectangles) * self.variable.cell_bytes


class Task(InputPartition):
    """Neighbouring pieces, of one file or several."""

    def __init__(self, pieces: Sequence[Piece]) -> None:
        self.pieces = tuple(pieces)


def tasks_of(found: Sequence[Piece]) -> list[Task]:
    """A task costs more than a small piece does: each gets as many pieces as have a TASKS-th of all bytes, or TASK_BYTES where that is less, and one at least."""
    sizes = [p.bytes_ for p in found]
    most = min(-(-sum(sizes) // TASKS), TASK_BYTES)
    out, first, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and held + n > most:
            out.append(Task(found[first:i]))
            first, held = i, 0
        held += n
    return [*out, Task(found[first:])]


def window_of(query: TileQuery) -> tuple[list[tuple[int, int]], bool]:
    """(first, end) of each dimension that a query asks for, of the first one at least; and whether a dimension beyond the first is limited."""
    low, high = (query.low, query.high) if query.noscan else (0, INT_MAX)
    out = [(low, high)]
    if query.slice_corner is not None:
        inner = [(c, c + s) for c, s in zip(query.slice_corner, query.slice_shape, strict=True)]
        out = [(max(low, inner[0][0]), min(high, inner[0][1])), *inner[1:]]
    return out, len(out) > 1


def pieces(files: Located, query: TileQuery, block_bytes: int) -> list[Piece]:
    """Neighbouring rectangles of a file, of about block_bytes together, which one task reads; parts outside the query's records and slice aren't in them."""
    out = []
    window, _ = window_of(query)
    extraction = query.extraction_shape[0] if query.query_dependent and query.extraction_shape else None
    for path, v, before in files:
        bytes_ = sh.byte_size(v.shape, v.cell_bytes)
        own = [(window[0][0] - before, window[0][1] - before), *window[1:]]
        if query.partition_mode == "calculated" and v.record_bytes is None:
            found = (r for _, r in plan.by_blocks(v.shape, v.begin, v.cell_bytes, block_bytes))
        else:
            step = plan.record_step("record" if query.partition_mode == "record" else "proportional", v.shape, -(-bytes_ // block_bytes), extraction)
            found = plan.by_records(v.shape, step, max(own[0][0], 0), own[0][1])
        group, held = [], 0
        for r in filter(None, (plan.clip(r, own) for r in found)):
            n = sh.size(r[1]) * v.cell_bytes
            if group and held + n > block_bytes:
                out.append(Piece(path, v, before, tuple(group)))
                group, held = [], 0
            group.append(r)
            held += n
        if group:
            out.append(Piece(path, v, before, tuple(group)))
    return out


# --- The source


class NetCDF3Reader(DataSourceReader):
    def __init__(self, files: Located, query: TileQuery, options: Mapping[str, str]) -> None:
        self.files, self.query = files, query
        self.block_bytes, self.fill = int(options.get("block_size") or 64 << 20), float(options["fill_value"]) if options.get("fill_value") else None
        self.blocks, self.offsets = options.get("blocks") == "true", options.get("offsets") == "true"

    def __getstate__(self) -> dict:
        """What each task is sent: all but the files, of which its pieces say what it needs."""
        return self.__dict__ | {"files": []}

    def partitions(self) -> list[Task]:
        return tasks_of(pieces(self.files, self.query, self.block_bytes))

    def read(self, partition: Task) -> Iterator[pa.RecordBatch]:
        for piece in partition.pieces:
            yield from self._read(piece)

    def _read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        v, tile = partition.variable, self.query.extraction_shape
        tile = tile if tile and len(tile) == len(v.shape) else None
        with open_file(partition.path) as f:
            for whole in partition.rectangles:
                for corner, shape in split(*whole, BATCH_CELLS, tile):
                    values = read_rectangle(f, v, corner, shape)
                    moved = (corner[0] + partition.offset, *corner[1:])
                    yield self._block(moved, shape, values) if self.blocks else self._cells(partition, corner, moved, shape, values)

    def _block(self, corner: tuple[int, ...], shape: tuple[int, ...], values: np.ndarray) -> pa.RecordBatch:
        ints, bounds = pa.list_(pa.int32()), pa.array([0, len(values)], pa.int32())
        held = pa.array(values, mask=values == self.fill if self.fill is not None else None)
        return pa.RecordBatch.from_arrays([pa.array([corner], ints), pa.array([shape], ints), pa.ListArray.from_arrays(bounds, held)], names=["corner", "shape", "values"])

    def _cells(self, p: Piece, corner: tuple[int, ...], moved: tuple[int, ...], shape: tuple[int, ...], values: np.ndarray) -> pa.RecordBatch:
        at = np.indices(shape, np.int32, sparse=True)
        columns = [pa.array(np.broadcast_to(a + np.int32(c), shape).ravel()) for a, c in zip(at, moved, strict=True)]
        columns.append(pa.array(values, mask=values == self.fill if self.fill is not None else None))
        names = [*(f"c{i}" for i in range(len(shape))), "value"]
        if self.offsets:
            v = p.variable
            steps = [s * v.cell_bytes for s in sh.strides(v.shape)]
            if v.record_bytes is not None:
                steps[0] = v.record_bytes
            bytes_ = v.begin + sum((a.astype(np.int64) + c) * s for a, c, s in zip(at, corner, steps, strict=True))
            columns += [pa.array([p.path] * len(values), pa.string()), pa.array(np.broadcast_to(bytes_, shape).ravel())]
            names += ["file", "offset"]
        return pa.RecordBatch.from_arrays(columns, names=names)


class NetCDF3(DataSource):
    """Options: path, those of TileQuery.from_conf (variable, low, high, slice_corner, slice_shape, partition_mode, ...), block_size, skip_invalid, fill_value (such cells are null), manifest (a folder with what manifest() gives, instead of path), blocks (rows of corner, shape and values in place of cells), offsets (file and offset of each cell's bytes).

    A variable along the unlimited dimension lies in the file with gaps, so for
    it the mode "calculated", which cuts at the file's blocks, is "proportional".

    Records and slice are pruned by options, not by filters that Spark pushes: in
    Spark 4.1 what is pushed for one query stays with the DataFrame for the next
    one.

    As a sink: see NetCDF3Writer."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _query(self) -> TileQuery:
        return TileQuery.from_conf({k: v for k, v in self.options.items() if v})

    def _files(self) -> Located:
        if self.options.get("manifest"):
            return from_manifest(self.options["manifest"])
        return located(self.options["path"], self._query(), self.options.get("skip_invalid", "true") == "true")

    def schema(self) -> str:
        variable = self._files()[0][1]
        kind = TYPES[variable.kind][1]
        if self.options.get("blocks") == "true":
            return f"corner array<int>, shape array<int>, values array<{kind}>"
        fields = [f"c{i} int" for i in range(len(variable.shape))]
        return ", ".join([*fields, f"value {kind}", *(["file string", "offset long"] if self.options.get("offsets") == "true" else [])])

    def reader(self, schema: StructType) -> NetCDF3Reader:
        return NetCDF3Reader(self._files(), self._query(), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NetCDF3Writer:
        return NetCDF3Writer(schema, self.options, overwrite)


def _scan(spark: SparkSession, path: str, query: TileQuery, options: Mapping[str, str]) -> tuple[DataFrame, Located]:
    """The scan, and the files it reads: from a manifest that is made first where there is a shared folder to keep it in."""
    spark.dataSource.register(NetCDF3)
    settings = {k: getattr(query, k) for k in ("variable", "low", "high", "partition_mode", "multi_file_mode", "noscan", "query_dependent")}
    settings |= {k: ",".join(map(str, x)) for k in ("extraction_shape", "slice_corner", "slice_shape") if (x := getattr(query, k))}
    options = dict(options)
    skip = options.get("skip_invalid", "true") == "true"
    if "manifest" not in options and (folder := shared_folder(spark, "manifest", required=False)):
        manifest(spark, path, query, skip).write.parquet(folder)
        options["manifest"] = folder
    files = from_manifest(options["manifest"]) if "manifest" in options else located(path, query, skip)
    if not files:
        raise ValueError(f"no NetCDF classic file in {path}")
    return spark.read.format("netcdf3").options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in settings.items()}, **options).load(path), files


def _shape(files: Located) -> tuple[int, ...]:
    inner = tuple(map(max, zip(*(v.shape[1:] for _, v, _ in files), strict=True)))
    return (max(v.shape[0] + before for _, v, before in files), *inner)


def read_array(spark: SparkSession, path: str, query: TileQuery, options: Mapping[str, str]) -> NDArray:
    df, files = _scan(spark, path, query, options)
    shape = _shape(files)
    keep = [f"c{i}" for i in range(len(shape))] + ["value"]
    array = NDArray(df.dropna(subset=keep), len(shape), shape, files[0][1].name).where_records(query.low, query.high)
    return array if query.slice_corner is None else array.slice(query.slice_corner, query.slice_shape)


def read_blocks(spark: SparkSession, path: str, query: TileQuery = TileQuery(), options: Mapping[str, str] | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """Blocks (corner, shape, values) of the records and the slice that the query asks for, and the whole array's shape. No cell is a row."""
    df, files = _scan(spark, path, query.with_(noscan=True), dict(options or {}) | {"blocks": "true"})
    return df, _shape(files)


def cells_with_offsets(spark: SparkSession, path: str, query: TileQuery = TileQuery(), options: Mapping[str, str] | None = None) -> DataFrame:
    """c0, c1, ..., value, file, offset: where the bytes of each cell begin in its file, from the begin and the record size of its header."""
    return _scan(spark, path, query, dict(options or {}) | {"offsets": "true"})[0]


def values_at(cells: DataFrame, kind: str) -> DataFrame:
    """cells (with file and offset, next to each other by file) and found: the value that stands there, of an SQL type of TYPES."""
    stored = np.dtype(next(t for t, sql in TYPES.values() if sql == kind))
    names = [*cells.columns, "found"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = np.array(batch.column(names.index("file")).to_pylist(), object)
            at = batch.column(names.index("offset")).to_numpy()
            out = np.empty(len(at), stored)
            for first, end in _segments(np.unique(files, return_inverse=True)[1] if len(files) else np.zeros(0, int)):
                order = np.argsort(at[first:end], kind="stable") + first
                with open_file(files[first]) as f:
                    for i, j in reads(at[order], stored.itemsize):
                        data = np.frombuffer(f.read_at(int(at[order[j - 1]] - at[order[i]]) + stored.itemsize, int(at[order[i]])), np.uint8)
                        places = (at[order[i:j]] - at[order[i]])[:, None] + np.arange(stored.itemsize)
                        out[order[i:j]] = data[places].view(stored).ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(stored.newbyteorder("=")))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    return cells.mapInArrow(run, f"{fields}, found {kind}")


def explain_splits(spark: SparkSession, path: str, query: TileQuery, block_bytes: int = 64 << 20) -> DataFrame:
    """One row for each rectangle that read_array() would read: split, file, variable, corner, shape, offset of the file's records."""
    rows = [(i, p.path, p.variable.name, list(c), list(s), p.offset) for i, p in enumerate(pieces(located(path, query), query, block_bytes)) for c, s in p.rectangles]
    return spark.createDataFrame(rows, "split int, file string, variable string, corner array<int>, shape array<int>, start_offset int")


# --- The sink

#: Bytes of cells in one file, unless records_per_file says otherwise; and of the records that a task holds.
FILE_BYTES, HELD_BYTES = 64 << 20, 1 << 20


@dataclass(frozen=True)
class Column1D:
    """A coordinate variable: a dimension's name, and the attributes of its values 0, 1, 2, ..."""

    name: str
    long_name: str = ""
    units: str = ""


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str]]  # number, temporary name


class NetCDF3Writer(DataSourceArrowWriter):
    """Cells (c0, c1, ..., and a column for each variable) to files of records_per_file records each, number k from record k * records_per_file on.

    Options: path, shape (of the array), variable (the name of the column value,
    the last variable; other columns keep theirs), records_per_file, fill,
    record_dimension (true: records are along the unlimited dimension),
    coordinates (JSON: name, long_name and units of each dimension).

    A task's rows have to be sorted by record, and all rows of one file be in one
    task; write() sees to both. Records are written as they come, HELD_BYTES at a
    time; with several variables and no record dimension a task holds one file.
    A row without a coordinate or value is no cell: it only makes its file exist.
    Missing cells get the fill value. A file of no rows at all fails the write.

    Files appear under their names when all tasks are done; until then, and
    after a failure for good, they are in a hidden folder that goes."""

    def __init__(self, schema: StructType, options: Mapping[str, str], overwrite: bool) -> None:
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        rank = len(self.shape)
        inner = self.shape[1:]
        dims = [f"c{i}" for i in range(rank)]
        columns = [f for f in schema.fields if f.name not in dims]
        columns = [f for f in columns if f.name != "value"] + [f for f in columns if f.name == "value"]
        kinds = {sql: number for number, (_, sql) in TYPES.items() if number != 2}
        if not columns or any(f.dataType.simpleString() not in kinds for f in columns) or not {*dims} <= {*schema.fieldNames()}:
            raise ValueError(f"columns {', '.join(dims)} and variables of types {', '.join(kinds)} are needed, not {schema.simpleString()}")
        self.columns = [(f.name, kinds[f.dataType.simpleString()]) for f in columns]
        self.names = [options.get("variable") or n if n == "value" else n for n, _ in self.columns]
        cells = sum(np.dtype(TYPES[k][0]).itemsize for _, k in self.columns) * sh.size(inner or (1,))
        self.records = int(options.get("records_per_file") or max(1, FILE_BYTES // max(1, cells)))
        self.held = max(1, HELD_BYTES // max(1, cells))
        self.fill, self.along, self.overwrite = float(options.get("fill") or 0), options.get("record_dimension", "true") == "true", overwrite
        self.lines = [Column1D(*x) for x in json.loads(options["coordinates"])] if options.get("coordinates") else None
        self.fs, self.base = store_of(options["path"])
        self.temporary = f"{self.base}/_temporary-{uuid4().hex}"

    def _head(self, number: int) -> tuple[bytes, bytes, np.ndarray | None]:
        """A file's header, the values of its fixed coordinate variables, and of the one along the records."""
        first = number * self.records
        n, inner = min(self.records, self.shape[0] - first), self.shape[1:]
        names = [c.name for c in self.lines] if self.lines else [f"d{i}" for i in range(len(self.shape))]
        dims = [(names[0], 0 if self.along else n), *zip(names[1:], inner, strict=True)]
        extra = [(c.name, (i,), 5 if i else 4, {k: v for k, v in (("long_name", c.long_name), ("units", c.units)) if v}) for i, c in enumerate(self.lines or ())]
        head, _, _ = header(dims, [*extra, *((name, range(len(self.shape)), kind) for name, (_, kind) in zip(self.names, self.columns, strict=True))], n if self.along else 0)
        if not self.lines:
            return head, b"", None
        records = np.arange(first, first + n).astype(">i4")
        fixed = [np.arange(d).astype(">f4").tobytes() for d in inner]
        return (head, b"".join(fixed), records) if self.along else (head, b"".join([records.tobytes(), *fixed]), None)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[int, str]] = []
        file = None
        try:
            for batch in iterator:
                at = [batch.column(batch.schema.get_field_index(f"c{i}")) for i in range(len(self.shape))]
                c0 = at[0].to_numpy(zero_copy_only=False).astype(np.int64)
                cells = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (*at[1:], *(batch.column(batch.schema.get_field_index(n)) for n, _ in self.columns))])
                for first, end in _segments(c0 // self.records):
                    number = int(c0[first] // self.records)
                    if file is None or file.number != number:
                        if file is not None:
                            done.append(file.close())
                        if any(number == k for k, _ in done):
                            raise ValueError(f"rows aren't sorted by record: record {c0[first]} comes late")
                        file = _File(self, number)
                    keep = np.flatnonzero(cells[first:end]) + first
                    inner = [x.take(pa.array(keep)).to_numpy(zero_copy_only=False) for x in at[1:]]
                    file.add(c0[keep], inner, [batch.column(batch.schema.get_field_index(n)).take(pa.array(keep)).to_numpy(zero_copy_only=False) for n, _ in self.columns])
            if file is not None:
                done.append(file.close())
        except BaseException:
            if file is not None:
                file.out.close()
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted(f for m in messages if m for f in m.files)
        numbers = [k for k, _ in files]
        expected = -(-self.shape[0] // self.records)
        if numbers != list(range(expected)):
            self.abort(messages)
            raise ValueError(f"{expected} files of {self.records} records are expected, each from one task; there are {len(numbers)}, of {len(set(numbers))} numbers")
        if self.overwrite:
            for info in self.fs.get_file_info(pafs.FileSelector(self.base, allow_not_found=True)):
                if info.is_file and info.base_name.endswith(".nc"):
                    self.fs.delete_file(info.path)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: self.fs.move(f[1], f"{self.base}/part-{f[0]:09d}.nc"), files))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        if self.fs.get_file_info(self.temporary).type == pafs.FileType.Directory:
            self.fs.delete_dir(self.temporary)


def _segments(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal keys."""
    edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b)


class _File:
    """One file while it is written: records from first on, so many at a time."""

    def __init__(self, w: NetCDF3Writer, number: int) -> None:
        self.w, self.number = w, number
        self.first = number * w.records
        self.n = min(w.records, w.shape[0] - self.first)
        if self.n <= 0 or number < 0:
            raise ValueError(f"record {self.first} is outside the shape {w.shape}")
        streams = w.along or len(w.columns) == 1
        self.step = min(self.n, w.held) if streams else self.n
        w.fs.create_dir(w.temporary, recursive=True)
        self.name = f"{w.temporary}/{number:09d}-{uuid4().hex}"
        self.out = w.fs.open_output_stream(self.name)
        head, fixed, self.records = w._head(number)
        self.out.write(head)
        self.out.write(fixed)
        self.at = 0  # records written
        self._begin()

    def _begin(self) -> None:
        self.blocks = [np.full((min(self.step, self.n - self.at), *self.w.shape[1:]), self.w.fill, TYPES[kind][0]) for _, kind in self.w.columns]

    def add(self, c0: np.ndarray, inner: list[np.ndarray], values: list[np.ndarray]) -> None:
        local = c0 - self.first
        for a, b in _segments(local // self.step):
            begin = int(local[a]) // self.step * self.step
            if begin < self.at:
                raise ValueError(f"rows aren't sorted by record: record {c0[a]} comes late")
            while self.at < begin:
                self._flush()
            for block, column in zip(self.blocks, values, strict=True):
                block[(local[a:b] - self.at, *(x[a:b] for x in inner))] = column[a:b]

    def _flush(self) -> None:
        n = len(self.blocks[0])
        raw = [b.reshape(n, -1).view(np.uint8) if b.size else np.zeros((n, 0), np.uint8) for b in self.blocks]
        if self.w.along:  # the record's number and its cells of each variable, record by record, each padded to four bytes if there are several
            raw = [self.records[self.at : self.at + n].reshape(n, 1).view(np.uint8), *raw] if self.records is not None else raw
            if len(raw) > 1:
                raw = [np.pad(x, ((0, 0), (0, -x.shape[1] % 4))) for x in raw]
            self.out.write(np.ascontiguousarray(np.hstack(raw)).tobytes())
        else:
            for x in raw:
                self.out.write(x.tobytes())
                if self.at + n == self.n:  # the end of a variable
                    self.out.write(b"\0" * (-(self.n * x.shape[1]) % 4))
        self.at += n
        self._begin()

    def close(self) -> tuple[int, str]:
        while self.at < self.n:
            self._flush()
        self.out.close()
        return self.number, self.name


def write(array: NDArray, folder: str, variable: str = "value", records_per_file: int | None = None, record_dimension: bool = True, fill: float = 0, coordinates: Sequence[Column1D] | None = None, others: Sequence[str] = ()) -> DataFrame:
    """Write an array as files of records_per_file records each, by default as many as FILE_BYTES hold; returns (file, records), once written.

    Read as one array again by the multi-file mode "concat". Cells are shuffled
    to their file and sorted by record, and streamed into it (see NetCDF3Writer).
    A task writes one file, or neighbouring ones of TASK_BYTES together where
    there are more files than cores. Missing cells get the fill value, and of repeated ones any stays. coordinates
    names the dimensions and adds a variable for each: INT along the records,
    FLOAT along the others. others are columns of the array's cells beside value,
    a variable each; the array's variable is the last one."""
    spark, shape = array.df.sparkSession, array.measured_shape()
    spark.dataSource.register(NetCDF3)
    inner, columns = shape[1:], [*others, "value"]
    sizes = {f.name: np.dtype(TYPES[next(n for n, (_, sql) in TYPES.items() if sql == f.dataType.simpleString())][0]).itemsize for f in array.df.schema.fields if f.name in columns}
    record_bytes = max(1, sum(sizes.values()) * sh.size(inner or (1,)))
    records = records_per_file or max(1, FILE_BYTES // record_bytes)
    files = -(-shape[0] // records)
    together = max(1, min(TASK_BYTES // (records * record_bytes), files // spark.sparkContext.defaultParallelism))
    cells = array.df.select(*array.dims, *columns)
    every = spark.range(files).select((F.col("id") * records).cast("int").alias("c0"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in cells.schema.fields[1:]))
    task = sh.div("c0", records * together).cast("int")
    laid = cells.unionByName(every).repartitionById(max(1, -(-files // together)), task).sortWithinPartitions("c0")
    options = {"shape": ",".join(map(str, shape)), "variable": variable, "records_per_file": records, "record_dimension": str(record_dimension).lower(), "fill": fill}
    if coordinates:
        options["coordinates"] = json.dumps([(c.name, c.long_name, c.units) for c in coordinates])
    laid.write.format("netcdf3").options(**options).mode("append").save(folder)
    file = F.concat(F.lit(f"{folder.rstrip('/')}/part-"), F.lpad(F.col("id").cast("string"), 9, "0"), F.lit(".nc"))
    return spark.range(files).select(file.alias("file"), F.least(F.lit(records), F.lit(shape[0]) - F.col("id") * records).cast("int").alias("records"))
