"""Quality rules: a table of thresholds, compiled into one projection.

Each rule bounds a ratio of two statistics of the text. All of it is column
expressions; nothing is shuffled and no user function runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import with_stats


@dataclass(frozen=True)
class Rule:
    """low * denominator <= numerator <= high * denominator, over names of text_stats.STATS or "1"."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Length, symbols, stop words and lines. A clean text passes all.
RULES = (
    Rule("words", "n_words", "1", low=20),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.3),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols_per_word", "n_marks", "n_words", high=0.2),
    Rule("stop_words", "n_stop", "n_words", low=0.02),
    Rule("upper_case", "n_upper", "word_chars", high=0.6),
    Rule("adjacent_words", "n_adjacent", "n_words", high=0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.5),
)
#: Those of RULES whose failure alone is the contract's base verdict.
BASE_RULES = ("words", "repeated_words")


def failed(rule: Rule, stats: str = "stats") -> Column:
    """Whether a text fails the rule; a rule over nothing (a ratio to zero words) doesn't fail."""
    number = lambda x: F.lit(1) if x == "1" else F.col(f"{stats}.{x}")
    top, bottom = number(rule.numerator), number(rule.denominator)
    outside = []
    if rule.low is not None:
        outside.append(1000 * top < round(1000 * rule.low) * bottom)
    if rule.high is not None:
        outside.append(1000 * top > round(1000 * rule.high) * bottom)
    return reduce(Column.__or__, outside)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row (all columns of docs), stats, and verdict: a struct with failed (names of failed rules), base_failed and kept.

    Null and empty texts have no words and fail the first rule. Repeated rows
    are judged each; an empty table gives an empty result. All columns of docs
    are inside row, so their names can't clash."""
    checks = [F.when(failed(r), F.lit(r.name)) for r in rules]
    base = reduce(Column.__or__, (failed(r) for r in RULES if r.name in BASE_RULES))
    names = F.array_compact(F.array(*checks))
    return with_stats(docs).select("row", "stats", F.struct(names.alias("failed"), base.alias("base_failed"), (~base & (F.size(names) == 0)).alias("kept")).alias("verdict"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, unchanged."""
    return judge(docs, rules).where("verdict.kept").select("row.*")
