"""Statistics of a text as Spark column expressions, without user functions.

They are laid out in steps (each a projection), so that what several
statistics need, the array of words above all, is computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYMBOLS = "#*$%&|<>"
_MARKS = _SYMBOLS + "!=~^\\\\{}"
_SPACE_CLASS = "[ \\t\\n\\x0B\\f\\r]"
WINDOW = 8

#: Frequent function words of English, French, German and Spanish (fixed values).
STOP_WORDS = (
    "the of and to a in is that for on are with as was be by this from at or an it not "
    "le la les de des et en un une du que qui dans pour par sur au est avec pas plus "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
    "el la los de y que en un una las por con para del se su al lo es no como más"
).split()

#: Long columns that with_stats() adds in one struct.
STATS = ("n_words", "word_chars", "n_symbols", "n_marks", "n_upper", "n_stop", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent")


def _repeated_windows(pairs: Column) -> Column:
    """The sorted places of windows whose hash stands next to an equal one in pairs, which is sorted by hash."""
    same = lambda p, k: p["h"].eqNullSafe(F.get(pairs, k)["h"])
    marked = F.transform(pairs, lambda p, k: F.when(same(p, k - 1) | same(p, k + 1), p["i"]))
    return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """Words inside windows that begin at these sorted places."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda a: a["n"])


def _doubled(hashes: str, by: int) -> Column:
    """The hash of each 2 * by words in a row, from those of by words; the last ones, which lack words, mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, by + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))


def with_stats(docs: DataFrame) -> DataFrame:
    """Two struct columns: row (all columns of docs) and stats (STATS, all long). A null text is empty: all zero, with one line.

    Windows of 8 words are hashed by doubling (1, 2, 4, 8 words), so that each
    costs three short hashes. A condition on the result isn't pushed below the
    projections, where it would repeat their expressions many times over: stats
    hangs on a value that Spark may not compute twice."""
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    plain = row.select("row", "t", F.btrim(F.regexp_replace("t", f"{_SPACE_CLASS}++", " "), F.lit(" ")).alias("plain"), F.split("t", "\n", -1).alias("lines"))
    words = plain.select("row", "t", "plain", F.when(F.col("plain") == "", F.array().cast("array<string>")).otherwise(F.split("plain", " ", -1)).alias("words"), F.size("lines").alias("n_lines"), F.filter("lines", lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("lines"))
    hashed = words.select("row", "t", "plain", "words", "n_lines", "lines", F.transform("words", lambda w: F.xxhash64(w)).alias("w1"))
    for n in (1, 2, 4):
        hashed = hashed.select(*hashed.columns, _doubled(f"w{n}", n).alias(f"w{2 * n}"))
    windows = F.slice(f"w{WINDOW}", F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    hashed = hashed.select("row", "t", "plain", "words", "n_lines", "lines", "w1", windows.alias("windows"))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
    only = lambda c, chars: F.regexp_replace(c, f"[^{chars}]++", "")
    last = hashed.select("row", "t", "plain", "words", "n_lines", "lines", "w1", F.when(repeated, pairs).alias("pairs"), only("t", _MARKS).alias("marks"))
    short = F.lit(max(len(w.encode()) for w in STOP_WORDS))
    n = F.size("words")
    counts = {
        "n_words": n,
        "word_chars": F.length("plain") - F.greatest(n - 1, F.lit(0)),
        "n_symbols": F.length(only("marks", _SYMBOLS)),
        "n_marks": F.length("marks"),
        "n_upper": F.regexp_count("t", F.lit("[A-ZÀ-ÖØ-Þ]")),
        "n_stop": F.size(F.filter("words", lambda w: (F.octet_length(w) <= short) & F.lower(w).isin(*sorted(set(STOP_WORDS))))),
        "n_digits": F.regexp_count("t", F.lit("[0-9]")),
        "n_lines": F.col("n_lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(_covered(_repeated_windows(F.col("pairs"))), F.lit(0)),
        "n_adjacent": F.size(F.filter("w1", lambda h, i: h == F.get(F.col("w1"), i - 1))),
    }
    stats = F.struct(*(c.cast("long").alias(k) for k, c in counts.items()))
    return last.select("row", F.when(F.monotonically_increasing_id() >= 0, stats).alias("stats"))
