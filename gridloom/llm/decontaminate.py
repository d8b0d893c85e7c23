"""Benchmark decontamination: rare n-gram seeds, then local alignment.

A first pass counts, for every n-gram of the test items, the documents that
hold it. The rare ones become seeds; where a stretch of an item has none, its
rarest do, so each item has seeds all along it, however often it is copied. A second pass looks up the
seeds in all texts; where one hits, the words around it are aligned with the
item (Smith-Waterman over words), and passages that score enough are reported,
copies with words changed, added or left out among them. Enough is a share of
the item's best score, or a passage of its own length and few edits, however
long the item is.

The items are the stated query set; they reach the tasks in blocks of bounded
size, one pass over the documents for each block."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, utf8
from .license_scan import tokens_of


@dataclass(frozen=True)
class Settings:
    """min_score: the share of the best possible alignment score. rare: the share of documents (rare_docs of them at least) up to which an n-gram is a seed; stretch: n-grams in a row of which, if none is rare, those not twice as frequent as the rarest are. slack: words more on both sides of where the item would lie, as a share of its length; with 1, no alignment that is enough reaches beyond, since each word added costs half of what a word of the item brings. passage: the score from which an alignment in which each edit costs edit counts as well, whatever its share of the item."""

    n: int = 3
    rare: float = 0.001
    rare_docs: int = 20
    stretch: int = 6
    min_score: float = 0.5
    match: float = 1.0
    mismatch: float = -0.5
    gap: float = -0.5
    slack: float = 1.0
    passage: float = 13.0
    edit: float = -2.0


def words_of(text: bytes) -> list[bytes]:
    return tokens_of(text.decode("utf-8", "replace").lower().encode())


def align(item: np.ndarray, words: np.ndarray, s: Settings) -> tuple[float, int]:
    """The best local alignment score, and the end (exclusive) of the aligned words; the first of equal ends."""
    row, best, end = np.zeros(len(words) + 1), 0.0, 0
    steps = np.arange(len(words) + 1) * -s.gap
    for word in item:
        new = np.maximum(row + s.gap, 0)
        np.maximum(new[1:], row[:-1] + np.where(words == word, s.match, s.mismatch), out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps  # gaps within the row
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


class Items:
    """A block of test items: their words as numbers, and their n-grams as sorted keys."""

    def __init__(self, items: list[tuple[object, bytes]], s: Settings) -> None:
        self.s, self.ids = s, [i for i, _ in items]
        self.strict = replace(s, mismatch=s.edit, gap=s.edit)
        split = [words_of(t) for _, t in items]
        self.vocabulary: dict[bytes, int] = {w: k for k, w in enumerate(sorted({w for x in split for w in x}))}
        self.words = [np.array([self.vocabulary[w] for w in x], np.int64) for x in split]
        self.bags = [Counter(x.tolist()) for x in self.words]
        self.base = len(self.vocabulary) + 1
        grams: dict[int, list[tuple[int, int, int]]] = {}  # length -> (key, item, place)
        for i, x in enumerate(self.words):
            if len(x):
                n = min(s.n, len(x))  # a shorter item is its own n-gram
                grams.setdefault(n, []).extend((int(k), i, q) for q, k in enumerate(self._keys(x, n)))
        self.grams = {n: sorted(v) for n, v in grams.items()}
        self.keys = {n: np.unique([k for k, _, _ in v]) for n, v in self.grams.items()}
        self.first = dict(zip(self.keys, np.cumsum([0, *map(len, self.keys.values())]).tolist(), strict=False))
        self.seeds: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, int]]]]] = {}

    def _keys(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A key for each n words in a row; -1 if one of them is in no item."""
        m = max(0, len(ids) - n + 1)
        out, bad = np.zeros(m, np.int64), np.zeros(m, bool)
        for k in range(n):
            out = out * self.base + ids[k : k + m] + 1
            bad |= ids[k : k + m] < 0
        out[bad] = -1
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def hits(self, ids: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a text of the n-grams among the sorted keys, and their numbers."""
        own = self._keys(ids, n)
        places = np.flatnonzero(own >= 0)
        own = own[places]
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        good = keys[at] == own
        return places[good], at[good]

    def held(self, words: list[bytes]) -> np.ndarray:
        """The numbers of all n-grams that a text holds."""
        ids = self.numbers(words)
        return np.concatenate([np.unique(self.hits(ids, k, n)[1]) + self.first[n] for n, k in self.keys.items()] or [np.zeros(0, np.int64)])

    def choose_seeds(self, documents: dict[int, int], total: int) -> None:
        """documents: number of an n-gram -> documents that hold it, of so many in total. What none holds can't be found."""
        rare = max(self.s.rare_docs, self.s.rare * total)
        for n, grams in self.grams.items():
            number = {int(k): i + self.first[n] for i, k in enumerate(self.keys[n])}
            by_item: dict[int, list[tuple[int, int]]] = {}
            for k, i, q in grams:
                by_item.setdefault(i, []).append((q, k))
            chosen: dict[int, list[tuple[int, int]]] = {}
            for i, places in by_item.items():
                rated = [(documents.get(number[k], 0), q, k) for q, k in sorted(places)]
                picked = set()
                for a in range(max(1, len(rated) - self.s.stretch + 1)):
                    held = [x for x in rated[a : a + self.s.stretch] if x[0]]
                    limit = max(rare, 2 * min((x[0] for x in held), default=0))
                    picked.update(x for x in held if x[0] <= limit)
                for _, q, k in picked:
                    chosen.setdefault(k, []).append((i, q))
            if not chosen:
                continue
            keys = np.array(sorted(chosen), np.int64)
            self.seeds[n] = keys, {j: chosen[int(k)] for j, k in enumerate(keys)}

    def matches(self, words: list[bytes]) -> list[tuple[int, float, int, int]]:
        """(item, best score, first and last word of the passage) of each item found in a text."""
        ids = self.numbers(words)
        windows: dict[int, list[list[int]]] = {}
        for n, (keys, owners) in self.seeds.items():
            for p, j in zip(*(x.tolist() for x in self.hits(ids, keys, n)), strict=True):
                for i, q in owners[j]:
                    size = len(self.words[i])
                    slack = 2 + int(size * self.s.slack)
                    a, b = max(0, p - q - slack), min(len(ids), p - q + size + slack)
                    windows.setdefault(i, []).append([a, b])
        out = []
        for i, found in sorted(windows.items()):
            spans: list[list[int]] = []
            for a, b in sorted(found):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            item, bag, best = self.words[i], self.bags[i], (0.0, 0, 0)
            least = self.s.min_score * self.s.match * len(item)
            for a, b in spans:
                near = ids[a:b]
                if sum(min(c, bag.get(w, 0)) for w, c in Counter(near.tolist()).items()) * self.s.match < min(least, self.s.passage):
                    continue  # too few words in common for any alignment
                for s, enough in ((self.s, least), (self.strict, self.s.passage)):
                    score, end = align(item, near, s)
                    if score >= enough:
                        if score > best[0]:
                            back = align(item[::-1], near[:end][::-1], s)[1]
                            best = score, a + end - back, a + end - 1
                        break
            if best[0]:
                out.append((i, best[0] / (self.s.match * len(item)), best[1], best[2]))
        return out


def _prepared(docs: DataFrame, benchmark: DataFrame, s: Settings, block_bytes: int) -> Iterator:
    """Blocks of items with their seeds, each at most about block_bytes (or one item), as broadcast variables."""
    spark = docs.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, total = max(1, -(-size // block_bytes)), docs.count()
    for k in range(blocks):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        items = Items(sorted(((r["item_id"], (r["text"] or "").encode()) for r in rows if r["item_id"] is not None), key=lambda x: (x[0], x[1])), s)
        shared = spark.sparkContext.broadcast(items)

        def count(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            total = np.zeros(sum(map(len, items.keys.values())), np.int64)
            for batch in batches:
                for text in utf8(batch.column(0)):
                    total[items.held(words_of(text or b""))] += 1
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

        counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        items.choose_seeds({r["gram"]: r["n"] for r in counted.collect()}, total)  # a row for each n-gram of the block at most
        yield spark.sparkContext.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each test item found in a document: the best passage, as places among the document's words.

    Null and empty texts hold nothing, and null and empty items are not looked
    for. Repeated rows are searched each; repeated items are found each. An item
    of fewer than n words is found by its whole wording. Words are compared in
    lower case; all that isn't a letter or digit only separates them. An empty
    table on either side gives an empty result. All of a text is searched."""
    parts = []
    doc_type, item_type = docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    for shared in _prepared(docs, benchmark, settings, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                rows = [(doc, items.ids[m[0]], *m[1:]) for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for m in items.matches(words_of(text or b""))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        types = [to_arrow_type(doc_type), to_arrow_type(item_type), pa.float64(), pa.int64(), pa.int64()]
        parts.append(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, score double, first_word long, last_word long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, unchanged, in which no test item is found."""
    out, at = docs, docs.columns.index("text")
    for shared in _prepared(docs, benchmark, settings, block_bytes):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(words_of(t or b"")) for t in utf8(batch.column(at))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
