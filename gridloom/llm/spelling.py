"""Spelling variants: words one edit apart, found by Bloom-guided neighbourhoods.

1. Words are counted in the tasks that read the texts, then over all documents.
2. The words that are frequent enough, the vocabulary, go into blocked Bloom
   filters, one for each length and slice: a hash picks a block of 512 bits, and
   sets one bit in each of its eight words. Blocks are put together by Spark
   (bit_or over the words of a block).
3. Each word's edits (one code point deleted, or replaced by a larger one of the
   vocabulary's alphabet; an insertion is a deletion of the other word) are
   hashed from prefix sums, without being spelled, and probe the filter of their
   length. Only those that a filter has are spelled, and joined to the
   vocabulary, which drops false positives.
4. A word's form is the most frequent of its near words, if that is frequent
   enough; forms are followed to the last by doubling.

Filters are broadcast, ``filter_bytes`` of them at most: a vocabulary that needs
more is cut into slices, and each pass over the words probes the filters of
one."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, skew_join, small_batches, utf8

_U = np.uint64
_RUN = re.compile(r"[a-zÀ-ÿ]+")
#: Words that a task counts at once, and bytes of a text that it cuts up at once.
HELD, STRETCH = 1 << 18, 1 << 20
#: Edits that a task hashes at once.
EDITS = 1 << 20
LANES = 8


@dataclass(frozen=True)
class Settings:
    """min_chars, min_count: what a word of the vocabulary has at least. typo: the divisor of the contract's planted deletions, 0 for none. factor: how many times as frequent a form is. bits: in a filter, for each word. filter_bytes: of the filters that are broadcast together."""

    min_chars: int = 5
    min_count: int = 3
    factor: int = 2
    typo: int = 97
    bits: int = 16
    filter_bytes: int = 32 << 20


# --- Words


def _stretches(text: bytes) -> Iterator[str]:
    """The text in lower case (A-Z alone), cut where no run is cut."""
    if len(text) <= STRETCH:
        yield text.lower().decode()
        return
    whole, at = text.lower().decode(), 0
    while at < len(whole):
        end = min(at + STRETCH, len(whole))
        if run := _RUN.match(whole, end):
            end = run.end()
        yield whole[at:end]
        at = end


def count_words(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, n) of the vocabulary. The runs of a null text are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            words = list(total)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                seed = zlib.crc32(f"{doc}:".encode()) if doc is not None else None
                for stretch in _stretches(text or b""):
                    for word, n in Counter(_RUN.findall(stretch)).items():
                        if len(word) >= s.min_chars:
                            if s.typo and seed is not None and not (h := zlib.crc32(word.encode(), seed)) % s.typo:
                                word = word[: (i := h % len(word))] + word[i + 1 :]
                                if len(word) < s.min_chars:
                                    continue
                            total[word] += n
                    if len(total) >= HELD:
                        yield counted()
        yield counted()

    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= s.min_count)


# --- Hashes


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A word's hash is the mixed sum of its code points times powers of BASE; step back by its inverse.
BASE = 0x9E3779B97F4A7C15
_BACK = _U(pow(BASE, -1, 1 << 64))


def _code_points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(_U)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, BASE, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def hashes(words: list[str]) -> np.ndarray:
    """Of words of one length."""
    c = _code_points(words)
    return _mix((c * _powers(c.shape[1])).sum(axis=1, dtype=_U) + _U(c.shape[1]))


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Where the words of each length stand."""
    lengths = np.array([len(w) for w in words], np.int64)
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def edit_hashes(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For words of one length, in turn: (length of the edits, edits, hashes), edits with the columns word, place and code point put there (0: deleted).

    Of equal neighbours only the last is deleted; a code point is replaced by larger ones alone: each pair of near words comes once."""
    c = _code_points(words)
    n, length = c.shape
    p = _powers(length)
    terms = c * p
    whole = terms.sum(axis=1, dtype=_U)
    if length > 1:
        before = np.cumsum(terms, axis=1, dtype=_U) - terms
        after = whole[:, None] - before - terms
        last = np.ones(c.shape, bool)
        last[:, :-1] = c[:, :-1] != c[:, 1:]
        row, place = np.nonzero(last)
        yield length - 1, np.stack([row, place, np.zeros(len(row), np.int64)], axis=1), _mix((before + after * _BACK)[row, place] + _U(length - 1))
    for i in range(length):
        row, k = np.nonzero(alphabet[None, :] > c[:, i : i + 1])
        yield length, np.stack([row, np.full(len(row), i), alphabet[k].astype(np.int64)], axis=1), _mix(whole[row] + (alphabet[k] - c[row, i]) * p[i] + _U(length))


# --- Filters


class Filters:
    """Blocked Bloom filters, one for each length: bits is (blocks, LANES), a length's blocks next to each other from first on. slices: of all hashes, this has those of one."""

    def __init__(self, first: dict[int, int], blocks: dict[int, int], bits: np.ndarray, part: int, parts: int) -> None:
        self.first, self.blocks, self.bits, self.part, self.parts = first, blocks, bits, part, parts

    def __contains__(self, length: int) -> bool:
        return length in self.blocks

    def probe(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which hashes may be of words of this length and this slice; others of the slice aren't."""
        at = np.flatnonzero(slice_of(h, self.parts) == self.part) if self.parts > 1 else np.arange(len(h))
        block = self.first[length] + block_of(h[at], self.blocks[length])
        for lane in range(LANES):
            hit = (self.bits[block, lane] >> lane_bit(h[at], lane)) & _U(1) == 1
            at, block = at[hit], block[hit]
        return at


def slice_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(h ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.int64) % parts


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> _U(32)) * _U(blocks)) >> _U(32)).astype(np.int64)


def lane_bit(h: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane that a hash sets: six bits of the hash, mixed anew."""
    return _mix((h & _U(0xFFFFFFFF)) + _U(0x632BE59BD9B4E019)) >> _U(6 * lane) & _U(63)


def build_filters(vocabulary: DataFrame, words_of: dict[int, int], part: int, parts: int, s: Settings) -> Filters:
    """The filters of one slice; words_of: the number of words of each length."""
    blocks = {n: max(1, -(-k * s.bits // (512 * parts))) for n, k in sorted(words_of.items())}
    first, at = {}, 0
    for n, k in blocks.items():
        first[n], at = at, at + k

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            places, lanes = [], []
            for n, rows in _by_length(words).items():
                h = hashes([words[i] for i in rows])
                h = h[slice_of(h, parts) == part] if parts > 1 else h
                places.append(first[n] + block_of(h, blocks[n]))
                lanes.append(np.stack([_U(1) << lane_bit(h, lane) for lane in range(LANES)]))
            both = np.concatenate(lanes, axis=1) if lanes else np.zeros((LANES, 0), _U)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places) if places else [], pa.int64()), *(pa.array(x.view(np.int64)) for x in both)], names=["block", *(f"l{i}" for i in range(LANES))])

    made = vocabulary.select("word").mapInArrow(run, "block long, " + ", ".join(f"l{i} long" for i in range(LANES)))
    table = made.groupBy("block").agg(*(F.bit_or(f"l{i}").alias(f"l{i}") for i in range(LANES))).toArrow()  # filter_bytes at most, but for the block numbers
    bits = np.zeros((at, LANES), _U)
    where = table.column("block").to_numpy()
    for i in range(LANES):
        bits[where, i] = table.column(f"l{i}").to_numpy().view(_U)
    return Filters(first, blocks, bits, part, parts)


# --- Near words


def candidates(vocabulary: DataFrame, filters, alphabet: str) -> DataFrame:
    """(word, edit) of a word's edits that the filters (a broadcast) have."""
    letters = np.array(sorted(map(ord, alphabet)), _U)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = filters.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            for n, rows in _by_length(words).items():
                step = max(1, EDITS // max(1, len(letters) * 2))
                for i in range(0, len(rows), step):
                    own = [words[k] for k in rows[i : i + step]]
                    found, edits = [], []
                    for length, edit, h in edit_hashes(own, letters):
                        if length in held:
                            for row, place, new in edit[held.probe(length, h)].tolist():
                                w = own[row]
                                found.append(w)
                                edits.append(w[:place] + (chr(new) if new else "") + w[place + 1 :])
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(edits, pa.string())], names=["word", "edit"])

    return vocabulary.select("word").mapInArrow(run, "word string, edit string")


def near_words(vocabulary: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(word, near, near_n) both ways round, for all words of the vocabulary (word, n) that are one edit apart."""
    lengths = {r["k"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()  # the letters there are, 90 at most
    parts = max(1, -(-sum(lengths.values()) * s.bits // (8 * s.filter_bytes)))
    sc, found = vocabulary.sparkSession.sparkContext, []
    counts = vocabulary.withColumnsRenamed({"word": "edit", "n": "edit_n"})
    for part in range(parts):
        shared = sc.broadcast(build_filters(vocabulary, lengths, part, parts, s))
        hits = candidates(vocabulary, shared, "".join(r["c"] for r in letters))
        exact = hits.join(counts, "edit").select("word", "edit", "edit_n")
        found.append(cut(exact))
        shared.unpersist()
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    back = pairs.join(vocabulary, "word").select(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")).unionByName(back)


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows without nulls: the last of the chain of forms that begins at word. A form is more frequent than its word, so chains end, after 63 steps at most; each round doubles what has been followed."""
    now = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(skew_join(now, further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary.

    Words are the runs of letters (a-z once A-Z are lower-cased, and U+00C0 to
    U+00FF) of at least min_chars code points that occur min_count times. Of
    equally frequent near words the smallest in code-point order is the form. A
    null text has no words, and neither has an empty one; repeated rows count
    each. In a row with a null doc_id nothing is deleted. A word of any length
    is a word. An empty table gives an empty result. Only doc_id and text are
    read."""
    vocabulary = cut(count_words(docs, s))
    best = near_words(vocabulary, s).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    named = vocabulary.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    fits = F.col("form_n") >= s.factor * F.col("n")
    named = cut(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = follow(named.where("form IS NOT NULL"))
    return named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
