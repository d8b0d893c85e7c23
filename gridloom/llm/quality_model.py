"""Quality classifier: a sparse ensemble of rules.

Boosted trees over statistics of the text propose conjunctive rules (their
paths); a logistic regression with an L1 penalty gives most of them no weight;
those left are compiled into one Spark column. Labels come from a bounded
sample, statistics and scores from Spark columns over all documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .text_stats import with_stats

#: Ratio -> its two statistics; the lower one counts as 1 at least.
RATIOS = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"), "marks": ("n_marks", "n_words"), "upper": ("n_upper", "word_chars"), "stop": ("n_stop", "n_words"),
    "digits": ("n_digits", "word_chars"), "line_words": ("n_words", "n_lines"), "dup_lines": ("n_dup_lines", "n_lines"), "repeated": ("n_repeat_words", "n_words"), "adjacent": ("n_adjacent", "n_words"),
}


def ratios(stats: str = "stats") -> list[Column]:
    def one(top: str, bottom: str | None) -> Column:
        number = F.col(f"{stats}.{top}").cast("double")
        return number if bottom is None else number / F.greatest(F.col(f"{stats}.{bottom}"), F.lit(1))

    return [one(*x) for x in RATIOS.values()]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[trees.Rule, float], ...]

    def score(self, features: list[Column]) -> Column:
        """The probability of label 1, between 0 and 1."""
        odds = F.lit(self.intercept)
        for rule, weight in self.rules:
            tests = [features[f] <= t if low else features[f] > t for f, low, t in rule]
            odds = odds + F.when(reduce(Column.__and__, tests), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def holds(rule: trees.Rule, x: np.ndarray) -> np.ndarray:
    return np.all([x[:, f] <= t if low else x[:, f] > t for f, low, t in rule], axis=0)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, rounds: int = 400) -> Model:
    """Rules from boosted trees, weighted by L1 logistic regression (proximal gradient with momentum). With one class or no rows, the base rate alone."""
    start, ensemble = trees.boost(x, y, n_trees=24, depth=3, rate=0.5)
    rules = list(dict.fromkeys(p for t in ensemble for p in trees.paths(t)))
    if not rules:
        return Model(start, ())
    z = np.array([holds(r, x) for r in rules]).T
    keep = np.unique(z, axis=1, return_index=True)[1]  # rules that hold for the same rows say the same
    rules, z = [rules[i] for i in sorted(keep)], z[:, sorted(keep)].astype(float)
    w, b, v, vb, k = np.zeros(z.shape[1]), start, np.zeros(z.shape[1]), start, 1.0
    step = 4 * len(y) / (np.linalg.norm(z, 2) ** 2 + len(y))
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(z @ v + vb))) - y
        nw = v - step * (z.T @ error) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * error.mean()
        nk = (1 + np.sqrt(1 + 4 * k * k)) / 2
        v, vb = nw + (k - 1) / nk * (nw - w), nb + (k - 1) / nk * (nb - b)
        w, b, k = nw, nb, nk
    return Model(float(b), tuple((r, float(a)) for r, a in zip(rules, w, strict=True) if a))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text, mod 5, is 0. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> Model:
    """Fit on at most sample_rows labelled documents (those with the smallest hash of doc_id), none of them held out.

    Labels other than 0 and 1, null ids and documents labelled both ways are
    left out; a label given twice counts once. Of several texts with one doc_id
    the first in order is learned from; a label without a document isn't.
    Without labels the model is the base rate."""
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    agreed = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows rows are broadcast
    sample = with_stats(found.groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    rows = sample.select("row.quality", *(c.alias(k) for k, c in zip(RATIOS, ratios(), strict=True)), "row.doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], *r[:-1]))
    data = np.array([r[:-1] for r in rows], float).reshape(-1, len(RATIOS) + 1)
    return fit(data[:, 1:], data[:, 0])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """row (all columns of docs), held_out, score (0 to 1) and predicted (1 if score >= threshold).

    Null and empty texts have statistics of zero and get a score like any
    other. Repeated rows get equal scores; an empty table gives an empty result."""
    scored = with_stats(docs).select("row", model.score(ratios()).alias("score"))
    return scored.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
