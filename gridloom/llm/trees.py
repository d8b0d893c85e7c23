"""Small gradient-boosted trees, fitted on a bounded sample and compiled into Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: Split | float
    high: Split | float


def _fit(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, cuts: list[np.ndarray], least: float) -> Split | float:
    """A tree for the Newton step -g/h; a cut needs that much weight on both sides."""
    value = lambda r: float(-g[r].sum() / (h[r].sum() + 1.0))
    if depth == 0 or len(rows) < 2:
        return value(rows)
    gs, hs = g[rows].sum(), h[rows].sum()
    best, choice = 1e-6, None
    for f, at in enumerate(cuts):
        if not len(at):
            continue
        bin_ = np.searchsorted(at, x[rows, f], side="left")  # x <= at[k] falls into bins up to k
        gl, hl, nl = (np.cumsum(np.bincount(bin_, weights=w, minlength=len(at) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
        gain[(nl < least) | (len(rows) - nl < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, choice = gain[k], (f, float(at[k]))
    if choice is None:
        return value(rows)
    side = x[rows, choice[0]] <= choice[1]
    return Split(*choice, *(_fit(x, g, h, r, depth - 1, cuts, least) for r in (rows[side], rows[~side])))


def apply(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.threshold, apply(tree.low, x), apply(tree.high, x))


def boost(x: np.ndarray, y: np.ndarray, n_trees: int = 30, depth: int = 3, rate: float = 0.3, max_cuts: int = 48, least: int = 5) -> tuple[float, list[Split | float]]:
    """Logistic boosting: the starting log odds, and trees whose values are to be added to it."""
    p = min(max(float(np.mean(y)) if len(y) else 0.5, 0.01), 0.99)
    start = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return start, []
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        mid = (values[1:] + values[:-1]) / 2
        cuts.append(mid if len(mid) <= max_cuts else np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_cuts + 2)[1:-1])))
    odds, trees = np.full(len(y), start), []
    for _ in range(n_trees):
        q = 1 / (1 + np.exp(-odds))
        tree = _fit(x, q - y, np.maximum(q * (1 - q), 1e-6), np.arange(len(y)), depth, cuts, least)
        tree = _scaled(tree, rate)
        trees.append(tree)
        odds = odds + apply(tree, x)
    return start, trees


def _scaled(tree: Split | float, rate: float) -> Split | float:
    return Split(tree.feature, tree.threshold, _scaled(tree.low, rate), _scaled(tree.high, rate)) if isinstance(tree, Split) else tree * rate


def to_column(tree: Split | float, features: Sequence[Column]) -> Column:
    if not isinstance(tree, Split):
        return F.lit(float(tree))
    return F.when(features[tree.feature] <= tree.threshold, to_column(tree.low, features)).otherwise(to_column(tree.high, features))


Rule = tuple[tuple[int, bool, float], ...]


def paths(tree: Split | float, above: Rule = ()) -> list[Rule]:
    """The conjunctions that lead to each node but the root: (feature, whether at most, threshold)."""
    if not isinstance(tree, Split):
        return []
    out = []
    for low, child in ((True, tree.low), (False, tree.high)):
        here = (*above, (tree.feature, low, tree.threshold))
        out += [here, *paths(child, here)]
    return out
