"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

1. Shingles are five words in a row. A shingle weighs its occurrences times the
   mean inverse document frequency of its words (see Weights). Frequencies count
   every document, in an array of fixed size by word hash.
2. Improved consistent weighted sampling draws ``bands * rows`` samples from
   each document; two documents share a sample with the probability of their
   weighted Jaccard similarity.
3. Exact copies are one text from here on. Texts that agree in all samples of a
   band meet in its bucket. In each bucket all are compared with one of them,
   the pivot. Where that leaves several groups, texts of different groups
   are compared if arithmetic doesn't rule a link out: what two texts share is
   what they share of the pivot, bounded by how much of it each has lost, and
   what both have added to it. Pairs that can be linked without a shared
   addition are few; others must share a least weight of their additions, and
   meet by the rarest of these (prefix filtering), so that no link is missed.
4. Compared means: the weighted Jaccard similarity of the whole texts, at least
   ``threshold``. Classes are the connected components of these links.

Nothing of this passes through the driver but the word frequencies, an array of
fixed size; pairs carry numbers alone until texts are joined to them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, skew_join, small_batches, utf8

_U = np.uint64
_LOW32 = _U(0xFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """bands: 64 at most. counters: the size of the array of word frequencies, a power of two."""

    words: int = 5
    bands: int = 16
    rows: int = 4
    threshold: float = 0.8
    counters: int = 1 << 20
    seed: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.bands <= 64:
            raise ValueError(f"1 to 64 bands are possible, not {self.bands}")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _mix(np.array([seed], _U)))


class Shingler:
    """Hashes of a text's shingles, from its bytes by whole-array operations.

    A word's hash is a polynomial over its bytes modulo 2**64, from prefix sums;
    a shingle's is a mixed sum over its words' hashes and places."""

    def __init__(self, n: int = 5) -> None:
        self.n = n
        self.space = np.zeros(256, bool)
        self.space[list(SPACE)] = True
        self.letters, self.places = _numbers(11, 256), _numbers(12, n) | _U(1)
        self.powers = self.inverses = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            base, size = 0x9E3779B97F4A7C15, 1 << n.bit_length()
            step = np.full(size, base, _U)
            back = np.full(size, pow(base, -1, 1 << 64), _U)
            step[0] = back[0] = 1
            self.powers, self.inverses = np.multiply.accumulate(step), np.multiply.accumulate(back)

    def words(self, text: bytes) -> np.ndarray:
        """The hash of each word, A-Z in lower case."""
        b = np.frombuffer(text.lower(), np.uint8)
        if not len(b):
            return np.zeros(0, _U)
        self._grow(len(b))
        gap = self.space[b]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.letters[b] * self.powers[: len(b)], dtype=_U)])
        return _mix((sums[ends] - sums[starts]) * self.inverses[starts])

    def shingles(self, w: np.ndarray) -> np.ndarray:
        """The hash of each shingle of these words, in order; fewer words are one shingle."""
        if not len(w):
            return w
        n = min(self.n, len(w))
        total = np.zeros(len(w) - n + 1, _U)
        for k in range(n):
            total += w[k : k + len(total)] * self.places[k]
        return _mix(total + _U(n))

    def __call__(self, text: bytes) -> np.ndarray:
        return self.shingles(self.words(text))


@dataclass(frozen=True)
class Weights:
    """TF-IDF in whole units. A word in n of N documents has the level round(2 ln(1 + N / n)), 1 at least; a shingle weighs its occurrences times the rounded mean level of its words.

    n is read from a counter that words of one hash share, so it may be too
    large: by the documents of all words over the number of counters on the mean,
    which lowers the level of the rarest words alone. The levels of words, not
    the frequency of the shingle itself, weigh it: a text that many documents
    copy would devalue its own shingles against each copy's edits.

    levels: one for each counter."""

    levels: np.ndarray
    words: int = 5

    def of(self, cut_up: Shingler, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a text, sorted, and their weights."""
        w = cut_up.words(text)
        if not len(w):
            return w, np.zeros(0)
        h, first, n = np.unique(cut_up.shingles(w), return_index=True, return_counts=True)
        k = min(self.words, len(w))
        sums = np.concatenate([[0], np.cumsum(self.levels[counter_of(w, len(self.levels))], dtype=np.int64)])
        return h, (n * ((2 * (sums[first + k] - sums[first]) + k) // (2 * k))).astype(float)


def counter_of(words: np.ndarray, counters: int) -> np.ndarray:
    return (words >> _U(65 - counters.bit_length())).astype(np.int64)


class Sampler:
    """Improved consistent weighted sampling.

    For each sample, a shingle of weight S gets r, c ~ Gamma(2, 1) and b ~ U(0, 1),
    then t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r; the shingle
    with the least a is drawn, together with its t. The three numbers come from
    a table of 65,536 draws, at a place that the shingle and the sample give;
    shingles at one place with equal a are told apart by further bits of their
    hash. A draw is a 64-bit number: a in the upper half (in an order-preserving
    form; it tells t, too), the shingle in the lower. Weights are whole numbers,
    so a is looked up for the TABLED smallest ones."""

    TABLED = 32

    def __init__(self, samples: int, seed: int) -> None:
        self.multipliers = _numbers(seed, samples) | _U(1)
        u = ((_numbers(seed + 1, 5 << 16) >> _U(11)).astype(float) + 0.5).reshape(5, -1) / 2**53
        self.r, self.log_c, self.b = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]
        everything = np.arange(1 << 16)
        self.table = np.concatenate([self._a(everything, np.log(max(k, 1))) for k in range(self.TABLED + 1)])

    def _a(self, at: np.ndarray, log_weight) -> np.ndarray:
        r, b = self.r[at], self.b[at]
        return self._ordered(self.log_c[at] - r * (np.floor(log_weight / r + b) - b) - r)

    @staticmethod
    def _ordered(x: np.ndarray) -> np.ndarray:
        bits = x.astype(np.float32).view(np.uint32)
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(_U) << _U(32)

    def __call__(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = np.full(len(self.multipliers), ~_U(0))
        small = w <= self.TABLED
        plain, rows, others, logs = h[small], w[small].astype(np.int64) << 16, h[~small], np.log(w[~small])
        for i in range(0, len(plain), 1024):  # bounded memory for long texts
            x = plain[i : i + 1024, None] * self.multipliers
            a = self.table[(x >> _U(48)).view(np.int64) + rows[i : i + 1024, None]]
            np.minimum(out, (a | ((x >> _U(16)) & _LOW32)).min(axis=0), out=out)
        for i in range(0, len(others), 1024):
            x = others[i : i + 1024, None] * self.multipliers
            a = self._a((x >> _U(48)).view(np.int64), logs[i : i + 1024, None])
            np.minimum(out, (a | ((x >> _U(16)) & _LOW32)).min(axis=0), out=out)
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller weights over the sum of the larger; 0 if both are empty."""
    (h, v), (g, w) = a, b
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    common = float(np.minimum(v[i], w[j]).sum())
    total = float(v.sum() + w.sum()) - common
    return common / total if total else 0.0


def additions(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles with more weight in b than in a, and by how much."""
    surplus = b[1].copy()
    if len(a[0]) and len(b[0]):
        at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        surplus -= np.where(a[0][at] == b[0], a[1][at], 0.0)
    return b[0][surplus > 1e-12], surplus[surplus > 1e-12]


# --- Statistics over all documents


def learn_weights(docs: DataFrame, s: Settings) -> Weights:
    """Levels from the documents that hold each word: one pass, and one number for each counter to the driver."""
    size = s.counters

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, seen, total = Shingler(s.words), np.zeros(size, np.int64), 0
        for batch in batches:
            for text in utf8(batch.column(0)):
                seen[np.unique(counter_of(cut_up.words(text or b""), size))] += 1
                total += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([total, *seen[some]], pa.int64())], names=["i", "n"])

    counted = docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # 1 + counters rows at most
    at, seen = (counted.column(c).to_numpy() for c in ("i", "n"))
    n = np.ones(size)
    n[at[at >= 0]] = seen[at >= 0]
    total = seen[at < 0].sum()
    return Weights(np.maximum(1, np.round(2 * np.log1p(total / n))).astype(np.uint8), s.words)


def signatures(docs: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """(doc_id, x1, x2, total weight, bands: a hash of each band's samples). A text without words has no bands."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, weigh, sample = Shingler(s.words), shared.value, Sampler(s.bands * s.rows, s.seed)
        factors = _numbers(s.seed + 2, s.rows) | _U(1)
        for batch in batches:
            totals, bands = [], []
            for text in utf8(batch.column(1)):
                h, w = weigh.of(cut_up, text or b"")
                totals.append(float(w.sum()))
                bands.append(_mix((_mix(sample(h, w)).reshape(s.bands, s.rows) * factors).sum(axis=1, dtype=_U)).view(np.int64) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(totals, pa.float64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "x1", "x2", "total", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_hashes(docs).select("doc_id", "text", "x1", "x2").mapInArrow(run, f"doc_id {kind}, x1 long, x2 long, total double, bands array<long>")


def _with_hashes(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with x1 and x2, 128 bits that stand for a text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"x1": F.xxhash64(text), "x2": F.xxhash64(F.lit(seed), text)})


# --- Pairs

#: Shingles that go along with each addition of a text, so that a pair needn't meet again.
FIRST = 32
#: Texts that meet a pivot's text in one group of rows; a pivot of more has several groups.
GROUP = 256


def beside_pivots(pairs: DataFrame, bodies: DataFrame, weights: Weights, s: Settings, found, schema: str) -> DataFrame:
    """found(pivot, text) for each pair (a, b) of numbers, from the whole texts in bodies (id, text): a, b and its columns.

    A pivot's text stands once before each group of at most about GROUP others,
    not in each row, and is cut up once."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups"))
    dealt = skew_join(pairs, groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    texts = bodies.select(F.col("id").alias("b"), "text")
    others = skew_join(dealt, texts, "b").select("a", "part", "b", "text")
    pivots = groups.join(bodies.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up, weigh, pivot = Shingler(s.words), shared.value, None
        for batch in batches:
            ids, rows = [], []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                own = weigh.of(cut_up, text or b"")
                if b is None:
                    pivot = own
                else:
                    ids.append((a, b))
                    rows.append(found(pivot, own))
            columns = [*zip(*ids, strict=True)] or [[], []]
            values = [*zip(*rows, strict=True)] or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=names)

    names = ["a", "b", *(c.split()[0] for c in schema.split(", "))]
    kinds = [{"double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}[c.split()[1]] for c in schema.split(", ")]
    laid = others.unionByName(pivots).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return laid.select("a", "b", "text").mapInArrow(run, f"a long, b long, {schema}")


def compare(pairs: DataFrame, bodies: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """(a, b, similarity) of pairs (a, b)."""
    return beside_pivots(pairs, bodies, weights, s, lambda x, y: (weighted_jaccard(x, y),), "similarity double")


def added_shingles(pairs: DataFrame, bodies: DataFrame, weights: Weights, s: Settings) -> DataFrame:
    """(a, b, h, w): arrays of the shingles with more weight in b's text than in its pivot a's, and of how much more, for each pair (a, b)."""

    def found(x, y):
        h, w = additions(x, y)
        return h.view(np.int64), w

    return beside_pivots(pairs, bodies, weights, s, found, "h array<long>, w array<double>")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, class): the smallest id of the connected component, for each id in the edges (a, b) but the smallest ones.

    Alternating stars: each round, every id points to the smallest around it,
    first from larger neighbours, then from smaller ones, until all point to a
    smallest one. Each round is written, and takes the place of the one before."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    now = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def done(e: DataFrame) -> bool:
        twice = e.groupBy("u").count().where("count > 1").select("u")
        inner = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        return twice.union(inner).isEmpty()

    while not done(now):
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skew_join(around, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skew_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, now = now, scratch.cut(small.distinct())
        scratch.drop(before)
    return now.select(F.col("u").alias("id"), F.col("v").alias("class"))


def linked_texts(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three relations.

    signed: (doc_id, x1, x2) of each row of docs with a doc_id; x1 and x2 stand for its text.
    texts: (id, rep, x1, x2, component): each distinct text, the smallest doc_id that holds it, and a number of its class.
    links: (a, b, similarity): texts found to be near duplicates, a and b as in texts.id; these links connect each class."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dup")
    cut, drop = scratch.cut, scratch.drop
    ids = docs.select("doc_id", "text")
    weights = learn_weights(ids, s)
    signed = cut(signatures(ids.where("doc_id IS NOT NULL"), weights, s))
    texts = signed.groupBy("x1", "x2").agg(F.min("doc_id").alias("rep"), F.first("total").alias("total"), F.first("bands").alias("bands"))
    texts = cut(texts.withColumn("id", F.monotonically_increasing_id()))

    # What is joined to hot buckets is cut first: Spark splits a large partition of a join only where both sides are shuffled for it.
    rows = texts.select("id", "rep", "total", F.posexplode("bands").alias("band", "hash"))
    buckets = rows.groupBy("band", "hash").agg(F.min(F.struct("rep", "id", "total")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(buckets.select("band", "hash", F.col("first.id").alias("a"), F.col("first.total").alias("pivot")))
    met = cut(rows.drop("rep").join(buckets, ["band", "hash"]))  # id, total, band, hash, a, pivot: the weight of a
    drop(buckets)
    signed_all, texts_all = signed, texts
    signed, texts = cut(signed.select("doc_id", "x1", "x2")), cut(texts.drop("bands"))
    drop(signed_all, texts_all)
    pairs = cut(met.where("id <> a").select("a", F.col("id").alias("b")).distinct())
    involved = skew_join(texts, met.select("id").distinct(), "id").select("id", F.col("rep").alias("doc_id"), "x1", "x2")
    bodies = cut(_with_hashes(ids).join(involved, ["doc_id", "x1", "x2"]).select("id", "text").dropDuplicates(["id"]))
    compared = cut(compare(pairs, bodies, weights, s))
    drop(pairs)
    links = compared.where(F.col("similarity") >= s.threshold)
    classes = components(links.select("a", "b"), scratch)

    # Copies edited each in its own way are less like each other than like what they come from: of those that met a pivot, the one most like it
    # is compared with those of other classes, so that few classes are left for what follows.
    labelled = skew_join(compared, classes.withColumnRenamed("id", "b"), "b", "left").select("a", "b", "similarity", F.coalesce("class", "b").alias("class"))
    nearest = compared.groupBy("a").agg(F.max_by("b", F.struct("similarity", -F.col("b"))).alias("near"))
    nearest = skew_join(nearest.withColumnRenamed("near", "id"), classes, "id", "left").select("a", F.col("id").alias("near"), F.coalesce("class", "id").alias("main"))
    again = cut(skew_join(labelled, nearest, "a").where("class <> main").select(F.col("near").alias("a"), "b").distinct())
    central = cut(compare(again, bodies, weights, s).where(F.col("similarity") >= s.threshold))
    drop(again)
    links = links.unionByName(central)
    classes = components(classes.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(central.select("a", "b")), scratch)

    # Buckets that are still several groups: lost and added are the weights of what a text lacks of the pivot and has besides.
    own = F.col("id") == F.col("a")
    similarity = F.when(own, 1.0).otherwise(F.col("similarity"))
    shared = similarity / (1 + similarity) * (F.col("pivot") + F.col("total"))
    about = compared.select("a", F.col("b").alias("id"), "similarity")
    group = met.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id")).join(about, ["a", "id"], "left")
    group = group.select("band", "hash", "a", "pivot", "id", "class", "total", similarity.alias("similarity"), (F.col("pivot") - shared).alias("lost"), (F.col("total") - shared).alias("added"))
    group = cut(group)
    drop(met)
    several = group.groupBy("band", "hash").agg(F.max_by("class", own).alias("main"), (F.min("class") != F.max("class")).alias("several"), F.count(F.lit(1)).alias("n")).where("several AND n > 2")
    several = cut(several.select("band", "hash", "main"))
    still = group.join(several, ["band", "hash"]).where(~own)
    bit = F.expr("shiftleft(1L, band)")
    still = cut(still.withColumn("same", F.bit_or(bit).over(Window.partitionBy("a", "id"))))  # a bit for each band where id meets this pivot
    drop(group, several)
    t, slack = s.threshold, 1e-6
    far = (F.abs(F.col("x_similarity") - F.col("y_similarity")) > 1 - t + 1e-9) | (F.least("x_total", "y_total") < (t - 1e-9) * F.greatest("x_total", "y_total"))
    sides = ("id", "class", "total", "similarity", "lost", "added")
    side = lambda df, k, *keys: df.select(*keys, *(F.col(c).alias(f"{k}_{c}") for c in sides))
    pair = (F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"))

    # Without a shared addition, at best min(lost) of what is lost is lost by both.
    needed = F.col("x_lost") + F.col("y_lost") + t * (F.col("x_added") + F.col("y_added")) - (1 - t) * F.col("pivot")
    enough = needed <= (1 + t) * F.least("x_lost", "y_lost") + slack
    can = still.where(t * F.col("added") <= (1 - t) * (F.col("pivot") - F.col("lost")) + slack)
    # What holds in one bucket of a pair holds in all with the same pivot, so the first of these decides; other pivots may tell otherwise.
    # A pivot has one bucket in each band, so two texts that both meet it there are in the same.
    first = F.col("x_same").bitwiseAND(F.col("y_same")).bitwiseAND(bit - 1) == 0
    left = side(can.where("class <> main").withColumnRenamed("same", "x_same"), "x", "band", "hash", "pivot", "x_same")
    right = side(can.withColumnRenamed("same", "y_same"), "y", "band", "hash", "y_same")
    bare = left.join(right, ["band", "hash"]).where((F.col("x_class") != F.col("y_class")) & ~far & enough & first).select(*pair)

    # With one: of the additions that several classes hold, rarest first, each keeps those up to which the rest (its own weight counted) is
    # enough for a link to any other, so the first that a linked pair shares is kept by both, and what both have left there bounds what they share.
    members = cut(still.dropDuplicates(["a", "id"]).select("a", "pivot", *sides))
    # A pair meets once for each pivot, at the first shingle in that order that both keep, unless that comes after the first FIRST ones that either keeps:
    # only these go along with each shingle, so that what a text needs grows with its length.
    lists = cut(added_shingles(members.select("a", F.col("id").alias("b")), bodies, weights, s))
    added = lists.select("a", F.col("b").alias("id"), F.explode(F.arrays_zip("h", "w")).alias("x")).select("a", "id", "x.h", "x.w")
    labelled = skew_join(added, members.select("id", "class").distinct(), "id")
    common = labelled.groupBy("a", "h").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("a", "h", "n")
    common = cut(common)
    held = added.join(common, ["a", "h"])
    held = held.withColumn("rest", F.sum("w").over(Window.partitionBy("a", "id").orderBy(F.desc("n"), F.desc("h")).rowsBetween(Window.unboundedPreceding, 0)))
    least = t * F.col("added") - (1 - t) * (F.col("pivot") - F.col("lost"))
    held = held.join(members, ["a", "id"]).where(F.col("rest") + slack >= least)
    in_order = Window.partitionBy("a", "id").orderBy("n", "h")
    held = held.withColumn("place", F.row_number().over(in_order))
    first_ones = F.collect_list(F.when(F.col("place") <= FIRST, F.col("h"))).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = cut(held.withColumn("before", F.slice(first_ones, 1, F.least(F.col("place") - 1, F.lit(FIRST)))).select("a", "h", "pivot", "rest", "before", *sides))
    drop(lists, common, members)
    reach = needed <= (1 + t) * (F.least("x_lost", "y_lost") + F.least("x_rest", "y_rest")) + slack
    own_too = lambda k: (F.col("rest").alias(f"{k}_rest"), F.col("before").alias(f"{k}_before"))
    left, right = side(held, "x", "a", "h", "pivot", *own_too("x")), side(held, "y", "a", "h", *own_too("y"))
    met_again = left.join(right, ["a", "h"]).where((F.col("x_id") < F.col("y_id")) & ~F.arrays_overlap("x_before", "y_before") & (F.col("x_class") != F.col("y_class")) & ~far & reach).select(*pair)
    more = cut(bare.unionByName(met_again).distinct())
    drop(still, held)
    if not more.isEmpty():
        new = cut(compare(more, bodies, weights, s).where(F.col("similarity") >= s.threshold))
        links = links.unionByName(new)
        classes = components(classes.select(F.col("id").alias("a"), F.col("class").alias("b")).unionByName(new.select("a", "b")), scratch)
    drop(more, bodies)
    named = texts.select("id", "rep", "x1", "x2").join(classes, "id", "left").select("id", "rep", "x1", "x2", F.coalesce("class", "id").alias("component"))
    return signed, named, links


def _classes(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, x1, x2, class_id, n_links_found) of each row with a doc_id."""
    signed, texts, links = linked_texts(docs, s)
    smallest = texts.groupBy("component").agg(F.min("rep").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links_found"))
    labelled = skew_join(texts, smallest, "component").join(degree, "id", "left").select("x1", "x2", "class_id", F.coalesce("n_links_found", F.lit(0)).cast("long").alias("n_links_found"))
    return signed.join(labelled, ["x1", "x2"])


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, n_links_found) for each row of docs: class_id is the smallest doc_id of its class of near duplicates, its own if it has none; n_links_found counts the other texts that its text was compared with and is linked to, which need not be all.

    Equal texts are in one class (null counts as empty); so are texts linked, if
    only through others, by a weighted Jaccard similarity of at least the
    threshold. A text without words is like its exact copies alone. Rows of one
    doc_id with several texts are classed each by its own text, and don't join
    those texts' classes. A row with a null doc_id has a null class. An
    empty table gives an empty result. Only doc_id and text are read."""
    nulls = docs.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links_found"))
    return _classes(docs, s).select("doc_id", "class_id", "n_links_found").unionByName(nulls)


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of docs, unchanged, without those of which a near duplicate with a smaller doc_id stays. Rows with a null doc_id stay."""
    gone = _classes(docs, s).where("doc_id <> class_id").select("doc_id", "x1", "x2").distinct()
    names = [f"`{c}`" for c in docs.columns]
    row = docs.select(F.struct(*names).alias("row"), "doc_id", "text")
    return _with_hashes(row).join(gone, ["doc_id", "x1", "x2"], "left_anti").select("row.*")
