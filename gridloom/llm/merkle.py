"""A Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources' roots.

1. Leaves are hashed where rows are read; only digests, ids and sources move on.
   They are laid out by source and id over all tasks, and numbered: a task's
   first source may go on from earlier tasks, which the driver works out from
   one row for each task.
2. A source's leaves are cut into aligned parts of ``fanout ** depth``; a part
   is one row, and its subtree is hashed in one place.
3. Butterfly: in round r, the ``fanout`` parts whose numbers differ in digit r
   alone swap the roots they have so far, and each hashes the parent on its own.
   After as many rounds as the number of parts has digits, every part holds the
   root and all siblings on its way there; nothing is sent down again. A group
   has ``fanout`` rows however large the source. Numbers that the last group
   lacks are filled with empty parts, which take part without a root, so that
   an incomplete node's root reaches all of its group: fewer than there are
   parts.
4. The roots of the sources are numbered and proved by the same steps.
5. Each part, with its proof from above, gives its leaves their proofs.

Hashes are SHA-256 as lowercase hex; a node is the hash of its children's hex
text. A run of nodes is hashed even if it is of one, unless it is all there is."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, skew_join, small_batches

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Digits that the number of a part can have.
DIGITS = 38


@dataclass(frozen=True)
class Shape:
    """fanout: children of a node. depth: levels that one part's subtree has."""

    fanout: int = 3
    depth: int = 7

    def __post_init__(self) -> None:
        if self.fanout < 2 or self.depth < 0:
            raise ValueError(f"a tree needs a fanout of at least 2 and no negative depth: {self}")

    @property
    def part(self) -> int:
        return self.fanout**self.depth


def digest(*hex_texts: str) -> str:
    return hashlib.sha256("".join(hex_texts).encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """The hash of a row: each field as its UTF-8 byte count, a colon and its value, or - if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def levels_of(leaves: list[str], fanout: int, levels: int | None = None) -> list[list[str]]:
    """The nodes of each level from the leaves on: so many levels above these, or up to a single node."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([digest(*now[i : i + fanout]) for i in range(0, len(now), fanout)])
    return out


def paths_of(levels: list[list[str]], fanout: int) -> list[str]:
    """For each leaf: its siblings, level by level, as one text."""
    above = [""]
    for nodes in reversed(levels[:-1]):
        above = ["".join(nodes[i - i % fanout : i] + nodes[i + 1 : i - i % fanout + fanout]) + above[i // fanout] for i in range(len(nodes))]
    return above if len(levels) > 1 else [""] * len(levels[0])


def fold(leaf: str, place: int, total: int, proof: str, fanout: int = 3) -> str:
    """The root that a leaf gives at a place among so many leaves, with its siblings' hashes in a row."""
    at = 0
    while total > 1:
        left = place % fanout
        width = 64 * (min(fanout, total - place + left) - 1)
        siblings = proof[at : at + width]
        leaf = digest(siblings[: 64 * left], leaf, siblings[64 * left :])
        at, place, total = at + width, place // fanout, -(-total // fanout)
    return leaf


# --- Numbers of rows in a global order


def numbered(rows: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """rows with place (long): a row's number, from 0, among those of its key, in the order of by.

    rows are sorted over all tasks, so a key of any size is spread. Rows equal in
    key and by get numbers in any order. key is a string without nulls."""
    order = [key, *(F.col(c).asc_nulls_first() for c in by)]
    laid = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows can be split, too
    laid = cut(laid.repartitionByRange(*order, "_row").sortWithinPartitions(*order).drop("_row"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list] = []
        for batch in batches:
            for k, same in groupby(batch.column(0).to_pylist()):
                n = sum(1 for _ in same)
                if runs and runs[-1][0] == k:
                    runs[-1][1] += n
                else:
                    runs = [*runs[:1], [k, n]]  # the first and the last
        if runs:
            (first, n), (last, m) = runs[0], runs[-1]
            yield pa.RecordBatch.from_pylist([{"task": TaskContext.get().partitionId(), "first": first, "last": last, "first_n": n, "last_n": m}], pa.schema([("task", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("first_n", pa.int64()), ("last_n", pa.int64())]))

    before, open_key, held = {}, None, 0
    for task, first, last, first_n, last_n in sorted(map(tuple, laid.select(key).mapInArrow(count, "task int, first string, last string, first_n long, last_n long").collect())):  # a row for each task
        before[task] = held if first == open_key else 0
        held = before[task] + first_n if first == last else last_n
        open_key = last

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now = before.get(TaskContext.get().partitionId(), 0), None
        for batch in batches:
            places = []
            for k, same in groupby(batch.column(names.index(key)).to_pylist()):
                if now is not None and k != now:
                    at = 0
                now, n = k, sum(1 for _ in same)
                places += range(at, at + n)
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*names, "place"])

    names = laid.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
    return laid.mapInArrow(place, f"{fields}, place long")


# --- Trees


def parts_of(leaves: DataFrame, shape: Shape, payload: Sequence[str]) -> DataFrame:
    """(key, part, leaves: array of (place, leaf, payload...) in order); leaves: key, place, leaf (binary) and the payload."""
    row = F.struct("place", "leaf", *payload)
    return leaves.groupBy("key", F.call_function("div", F.col("place"), F.lit(shape.part)).alias("part")).agg(F.sort_array(F.collect_list(row)).alias("leaves"))


def part_roots(parts: DataFrame, shape: Shape) -> DataFrame:
    """(key, part, n, root, alone): root is what ``depth`` levels give, alone what the part gives as a whole tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for leaves in batch.column(2).to_pylist():
                hexes = [x.hex() for x in leaves]
                levels = levels_of(hexes, shape.fanout, shape.depth)
                rows.append((len(hexes), levels[-1][0], next(x[0] for x in levels if len(x) == 1)))
            n, root, alone = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(root, pa.string()), pa.array(alone, pa.string())], names=["key", "part", "n", "root", "alone"])

    return parts.select("key", "part", F.col("leaves.leaf").alias("l")).mapInArrow(run, "key string, part long, n long, root string, alone string")


def exchange(roots: DataFrame, shape: Shape) -> DataFrame:
    """(key, part, total, above, root) for part_roots(): the leaves of the key, the siblings above the part, and the root of the key's tree, by butterfly rounds."""
    f = shape.fanout
    powers = [f**k for k in range(DIGITS) if f**k < 2**62]
    roots = cut(roots)
    totals = roots.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("parts"))
    rounds = sum(F.when(F.col("parts") > p, 1).otherwise(0) for p in powers)
    totals = cut(totals.withColumn("rounds", rounds))
    aligned = F.element_at(F.array(*(F.lit(p).cast("long") for p in powers)), F.greatest(F.col("rounds"), F.lit(1)))
    upto = F.ceil(F.col("parts") / aligned).cast("long") * aligned
    none = F.lit(None).cast("string")
    empty = totals.where(upto > F.col("parts")).select("key", "total", "rounds", F.explode(F.sequence("parts", upto - 1)).alias("part"), none.alias("node"))
    now = skew_join(roots, totals, "key").select("key", "total", "rounds", "part", F.when(F.col("rounds") > 0, F.col("root")).otherwise(F.col("alone")).alias("node"))
    now = now.withColumn("real", F.lit(True)).unionByName(empty.withColumn("real", F.lit(False))).withColumn("above", F.lit(""))
    most = totals.agg(F.max("rounds")).first()[0] or 0
    for r in range(most):
        taking_part = F.col("rounds") > r
        digit = F.when(taking_part, F.call_function("div", F.col("part"), F.lit(powers[r])) % f).otherwise(0)
        placed = now.withColumn("digit", digit)
        group = placed.groupBy("key", "total", "rounds", (F.col("part") - F.col("digit") * powers[r]).alias("group"))
        met = group.agg(F.sort_array(F.collect_list(F.struct("digit", "part", "node", "real", "above"))).alias("m"))  # fanout rows at most
        parent = F.array_join(F.col("m.node"), "")
        swapped = met.select("key", "total", "rounds", F.when(taking_part & (parent != ""), F.sha2(parent, 256)).when(~taking_part, F.get("m.node", F.lit(0))).alias("node"), "m", F.explode("m").alias("own"))
        others = F.array_join(F.transform(F.filter("m", lambda x: x["digit"] != F.col("own.digit")), lambda x: x["node"]), "")
        now = swapped.select("key", "total", "rounds", F.col("own.part").alias("part"), "node", F.col("own.real").alias("real"), F.concat("own.above", others).alias("above"))
    return now.where("real").select("key", "part", "total", "above", F.col("node").alias("root"))


def proofs(parts: DataFrame, exchanged: DataFrame, shape: Shape, payload: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """A row for each leaf of each part: key, place, leaf (hex), the payload, total, proof (siblings in a row up to the key's root), root, and exchanged's extra columns."""
    joined = parts.join(exchanged, ["key", "part"]).select("key", "leaves", "total", "above", "root", *extra)
    kinds = {f.name: f.dataType for f in joined.schema["leaves"].dataType.elementType} | {f.name: f.dataType for f in joined.schema}
    names = ["key", "place", "leaf", *payload, "total", "proof", "root", *extra]
    strings = {"leaf", "proof", "root"}
    schema = ", ".join(f"`{n}` {'string' if n in strings else kinds['place'].simpleString() if n in ('total', 'place') else kinds[n].simpleString()}" for n in names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = {n: batch.column(batch.schema.get_field_index(n)) for n in ("key", "total", "above", "root", *extra)}
            lists = batch.column(batch.schema.get_field_index("leaves"))
            for i in range(batch.num_rows):
                leaves = lists[i].values  # a struct array
                hexes = [x.hex() for x in leaves.field("leaf").to_pylist()]
                total, above = whole["total"][i].as_py(), whole["above"][i].as_py()
                paths = paths_of(levels_of(hexes, shape.fanout, None if total <= shape.part else shape.depth), shape.fanout)
                repeated = lambda n, i=i, k=len(hexes): pa.repeat(whole[n][i], k)
                columns = [repeated("key"), leaves.field("place"), pa.array(hexes, pa.string()), *(leaves.field(n) for n in payload), repeated("total"), pa.array([p + above for p in paths], pa.string()), repeated("root"), *map(repeated, extra)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)


def manifest(docs: DataFrame, claim: Column | None = None, shape: Shape = Shape(), fields: Sequence[str] = FIELDS, source: str = "source", order: str = "doc_id") -> DataFrame:
    """For each row of docs: doc_id (the column order), key (1 and the source, 0 for a null one), place and total in its source, leaf, proof, subroot, source_place, sources, source_proof, root; with a claim, also claimed and folded_root.

    claim: the text that somebody shows for a row; claimed is the leaf that it
    gives in place of the row's own text, and folded_root what that leaf and the
    row's proof give. It equals root if and only if the claimed leaf is the row's.

    Leaves of a source ascend by order, null first; rows of one order by their
    hash, so repeated rows are leaves of their own, next to each other. Nulls
    count as values of their own in any field; a null source is a source. A
    source of one row has that leaf as its subroot, and a single source its
    subroot as the root. An empty table gives an empty result. Only the named
    fields are read; the text may have any length."""
    small_batches(docs.sparkSession)
    columns = [docs[f"`{c}`"] for c in fields]
    shown = leaf_hash([claim if c == "text" and claim is not None else docs[f"`{c}`"] for c in fields])
    leaf = leaf_hash(columns)
    key = F.coalesce(F.concat(F.lit("1"), docs[f"`{source}`"].cast("string")), F.lit("0"))
    hashed = docs.select(key.alias("key"), docs[f"`{order}`"].alias("doc_id"), F.unhex(leaf).alias("leaf"), (F.unhex(shown) if claim is not None else F.lit(None).cast("binary")).alias("claimed"))
    hashed = cut(hashed)  # else texts are read and hashed again for the bounds of the ranges
    parts = cut(parts_of(numbered(hashed, "key", ["doc_id", "leaf"]), shape, ["doc_id", "claimed"]))
    exchanged = cut(exchange(part_roots(parts, shape), shape))

    subroots = exchanged.where("part = 0").select(F.lit("").alias("key"), F.col("key").alias("source"), F.unhex("root").alias("leaf"))
    above = cut(parts_of(numbered(subroots, "key", ["source"]), shape, ["source"]))
    top = proofs(above, exchange(part_roots(above, shape), shape), shape, ["source"])
    top = cut(top.select(F.col("source").alias("key"), F.col("place").alias("source_place"), F.col("total").alias("sources"), F.col("proof").alias("source_proof"), F.col("root").alias("whole")))

    both = skew_join(exchanged, top, "key")
    rows = proofs(parts, both, shape, ["doc_id", "claimed"], ["source_place", "sources", "source_proof", "whole"])
    rows = rows.select("doc_id", "key", "place", "total", "leaf", "claimed", "proof", F.col("root").alias("subroot"), "source_place", "sources", "source_proof", F.col("whole").alias("root"))
    return rows.drop("claimed") if claim is None else _folded(rows, shape.fanout)


def _folded(rows: DataFrame, fanout: int) -> DataFrame:
    """rows with claimed as hex, and folded_root."""
    names = rows.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {n: batch.column(i) for i, n in enumerate(names)}
            claimed = [x.hex() for x in values["claimed"].to_pylist()]
            get = lambda n: values[n].to_pylist()
            found = [
                fold(fold(leaf, place, total, proof, fanout), at, sources, top, fanout)
                for leaf, place, total, proof, at, sources, top in zip(claimed, get("place"), get("total"), get("proof"), get("source_place"), get("sources"), get("source_proof"), strict=True)
            ]
            values["claimed"] = pa.array(claimed, pa.string())
            yield pa.RecordBatch.from_arrays([*(values[n] for n in names), pa.array(found, pa.string())], names=[*names, "folded_root"])

    kinds = {f.name: "string" if f.name == "claimed" else f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"{', '.join(f'`{n}` {k}' for n, k in kinds.items())}, folded_root string")


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without its line breaks where the CRC-32 of the id is even."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
