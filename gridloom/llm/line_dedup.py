"""Line deduplication through a sharded minimal perfect hash.

1. Each text is cut into lines once; hashes of its long lines, with the document
   and the line's number, are written to the shared folder.
2. Distinct documents are counted for each line. Lines of at least ``min_docs``
   go into shards; each shard is a minimal perfect hash (levels of bit arrays)
   that numbers its lines without gaps and points into compact arrays: a
   fingerprint, the document count and the largest document id.
3. The hashes are dealt to their shards and probe these arrays; a shard of many
   hashes is dealt out several times. What has to go, (document, line number),
   meets the texts again by document.

Shards have a bounded size and there are as many as it takes; nothing passes
through the driver but the number of repeated lines."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, skew_join, small_batches, utf8

#: A document without an id, below all others.
NO_ID = -(2**63)
#: Hashes that meet a shard in one group of rows.
GROUP = 1 << 18
#: Shards whose numbers of groups (16 bytes each) are broadcast; those of more are joined.
MOST_BROADCAST = 1 << 18
#: Bits in a level for each line that reaches it.
GAMMA = 2
#: Levels before the remaining lines are listed plainly.
LEVELS = 40



def line_keys(text: bytes, min_chars: int) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """The lines of a text, and (line number, h1, h2) of those whose key has min_chars code points."""
    lines, found = text.split(b"\n"), []
    for i, line in enumerate(lines):
        key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z alone
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            h = xxhash.xxh3_128_intdigest(key)
            found.append((i, h >> 64, h & 0xFFFFFFFFFFFFFFFF))
    return lines, found


def hash_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, text, line) of each line whose key has min_chars code points; text is a hash of the whole text."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows, numbers = [], [], []
            for row, text in enumerate(utf8(batch.column(1))):
                for i, a, b in line_keys(text or b"", min_chars)[1]:
                    hashes.append((a, b))
                    rows.append(row)
                    numbers.append(i)
            h = np.array(hashes, np.uint64).reshape(-1, 2).view(np.int64)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(2).take(at), pa.array(numbers, pa.int32())], names=["h1", "h2", "doc", "text", "line"])

    return _keyed(docs).mapInArrow(emit, "h1 long, h2 long, doc long, text long, line int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id_of().alias("doc"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("x"))


def _id_of():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def count_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs, last_doc) of each line held by at least min_docs documents; rows of one doc_id are one document."""
    once = lines.select("h1", "h2", "doc").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc")).where(F.col("n_docs") >= min_docs)


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD1342543DE82EF95 + 1) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class Shard:
    """A minimal perfect hash with its arrays. Level by level, lines that meet no other at their bit stay there; the others go on."""

    def __init__(self, row: dict) -> None:
        self.words, self.ranks = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["ranks"], np.uint32)
        self.starts, self.sizes = row["starts"], row["sizes"]
        self.prints, self.counts, self.last_docs = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["last_docs"], np.int64)
        self.rest = {k: i for i, k in enumerate(zip(np.frombuffer(row["rest_h1"], np.uint64).tolist(), np.frombuffer(row["rest_h2"], np.uint64).tolist(), strict=True), len(self.prints) - len(row["rest_h1"]) // 8)}

    @staticmethod
    def build(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, last_docs: np.ndarray) -> dict:
        """The arrays for distinct (h1, h2)."""
        left, starts, sizes, words, slots = np.arange(len(h1)), [], [], [], []
        base = 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(single, bitorder="little").view(np.uint64))
            starts.append(base)
            sizes.append(size)
            stays = single[at]
            slots.append(left[stays][np.argsort(at[stays])])
            left, base = left[~stays], base + size // 64
        order = np.concatenate([*slots, left]).astype(np.int64) if len(h1) else left
        all_words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(all_words))[:-1]]).astype(np.uint32) if len(all_words) else np.zeros(0, np.uint32)
        return {
            "entries": len(h1), "words": all_words.tobytes(), "ranks": ranks.tobytes(), "starts": starts, "sizes": sizes, "prints": h2[order].tobytes(), "counts": counts[order].astype(np.uint32).tobytes(),
            "last_docs": last_docs[order].astype(np.int64).tobytes(), "rest_h1": h1[left].tobytes(), "rest_h2": h2[left].tobytes(),
        }

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each line, or -1 for lines that aren't indexed."""
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes, strict=True)):
            if not len(open_):
                return out
            at = _mix(h1[open_], h2[open_], level) % np.uint64(size)
            word, bit = start + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.ranks[word].astype(np.int64) + np.bitwise_count(below)
            here = open_[hit]
            out[here] = np.where(self.prints[number[hit]] == h2[here], number[hit], -1)
            open_ = open_[~hit]
        for i in open_ if self.rest else ():
            out[i] = self.rest.get((int(h1[i]), int(h2[i])), -1)
        return out


def build_index(counted: DataFrame, n_shards: int) -> DataFrame:
    """(shard, arrays: those of Shard.build(), pickled as one value) of each shard."""

    def build(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        row = Shard.build(lines["h1"].to_numpy().view(np.uint64), lines["h2"].to_numpy().view(np.uint64), lines["n_docs"].to_numpy(), lines["last_doc"].to_numpy())
        return pd.DataFrame([{"shard": key[0], "arrays": pickle.dumps(row)}])

    return counted.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, arrays binary")


def find_repeated(lines: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """(doc, text, lines: numbers of those that go), from the hashes of all lines and the shards' arrays."""
    shard = F.pmod("h1", F.lit(n_shards)).cast("int")
    groups = lines.groupBy(shard.alias("shard")).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups"))
    known, numbered = groups.join(index.select("shard"), "shard"), lines.withColumn("shard", shard)  # a shard without repeated lines has no row
    dealt = numbered.join(F.broadcast(known), "shard") if n_shards <= MOST_BROADCAST else skew_join(numbered, known, "shard")
    probes = dealt.select("shard", F.pmod(F.xxhash64("doc", "line"), F.col("groups")).alias("part"), "h1", "h2", "doc", "text", "line", F.lit(None).cast("binary").alias("arrays"))
    shards = index.join(groups, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), *(F.lit(None).cast(t).alias(c) for c, t in (("h1", "long"), ("h2", "long"), ("doc", "long"), ("text", "long"), ("line", "int"))), "arrays")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            heads = np.flatnonzero(np.array(batch.column("arrays").is_valid()))
            edges = [0, *heads.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = batch.slice(a, b - a)
                if piece.num_rows and piece.column("arrays")[0].is_valid:  # a shard comes before what probes it
                    own = Shard(pickle.loads(piece.column("arrays")[0].as_py()))
                    piece = piece.slice(1)
                h1, h2, doc = (piece.column(c).to_numpy() for c in ("h1", "h2", "doc"))
                number = own.probe(h1.view(np.uint64), h2.view(np.uint64)) if len(h1) else np.zeros(0, np.int64)
                gone = np.flatnonzero((number >= 0) & (own.last_docs[number] != doc)) if len(h1) and len(own.prints) else []
                yield pa.RecordBatch.from_arrays([piece.column(c).take(pa.array(gone, pa.int64())) for c in ("doc", "text", "line")], names=["doc", "text", "line"])

    laid = probes.unionByName(shards).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("arrays").isNull())
    laid = laid.select("h1", "h2", "doc", "text", "line", "arrays")
    return laid.mapInArrow(probe, "doc long, text long, line int").groupBy("doc", "text").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_lines: int = 1 << 16, details: bool = True) -> DataFrame:
    """Drop lines that many documents share, keeping each in one document.

    A line's key is the line without ASCII white space at its ends, A-Z in
    lower case. Keys of at least min_chars code points that occur in at least
    min_docs documents lose all their lines, except in the document with the
    largest doc_id that holds the key. All other columns pass through; details
    adds ``n_lines`` and ``n_dropped`` (a column of docs with such a name is
    replaced).

    A null or empty text is one empty line, and comes out as "". Rows with one
    doc_id are one document: they count once, and all keep the line if that id is
    the largest. Rows without a doc_id are one document below all others. An
    empty table gives an empty result. The size of a text or line has no bound
    but memory for one batch of rows."""
    small_batches(docs.sparkSession)
    lines = cut(hash_lines(docs, min_chars))
    counted = cut(count_lines(lines, min_docs))
    n_shards = max(1, -(-counted.count() // shard_lines))
    index = cut(build_index(counted, n_shards))
    gone = find_repeated(lines, index, n_shards).select(F.struct("doc", "text").alias("key of row"), F.col("lines").alias("lines that go"))
    names = docs.columns
    kept = [c for c in names if not (details and c in ("n_lines", "n_dropped"))]
    keyed = docs.withColumn("key of row", F.struct(_id_of().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text")))
    source = keyed.join(gone, "key of row", "left").select(*(f"`{c}`" for c in names), "lines that go")
    text_at = names.index("text")

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or b"").split(b"\n") for t in utf8(batch.column(text_at))]
            gone = {r: set(x) for r, x in enumerate(batch.column(len(names)).to_pylist()) if x}
            yield _rewritten(batch, texts, gone, kept, details)

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + ["n_lines long", "n_dropped long"] * details
    return source.mapInArrow(rewrite, ", ".join(fields))


def _rewritten(batch: pa.RecordBatch, texts: list, gone: dict[int, set[int]], kept: list[str], details: bool) -> pa.RecordBatch:
    new = [b"\n".join([x for i, x in enumerate(lines) if i not in gone[r]] if r in gone else lines).decode() for r, lines in enumerate(texts)]
    columns = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
    columns["text"] = pa.array(new, pa.string())
    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
        columns["n_chars"] = pa.array([len(x) for x in new], columns["n_chars"].type)
    if details:
        columns |= {"n_lines": pa.array([len(x) for x in texts], pa.int64()), "n_dropped": pa.array([len(gone.get(r, ())) for r in range(len(texts))], pa.int64())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
