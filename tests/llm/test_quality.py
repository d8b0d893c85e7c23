"""The quality rules and the quality model: filters on their results, labels that clash, and scores against a plain evaluation."""

import math

import edges
import numpy as np
from pyspark.sql import functions as F

import brute
from compare import DATA
from gridloom.llm import quality_model, quality_rules
from gridloom.llm.text_stats import STATS, STOP_WORDS, with_stats


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_do_not_repeat_the_statistics(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = quality_model.learn(docs, spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    judged, scored = quality_rules.judge(docs), quality_model.score(docs, model)
    for bare, filtered in ((judged, judged.where("verdict.kept")), (scored, scored.where("score > 0.5")), (judged, judged.groupBy("verdict.failed").count())):
        assert len(plan_of(filtered)) < 1.5 * len(plan_of(bare)) + 2000
    assert judged.where("verdict.kept").count() == quality_rules.keep_good(docs).count() == sum(r["kept"] for r in judged.select("verdict.kept").collect())


def plain_stats(text):
    """All of STATS, from the definitions."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = brute.rules(text)
    text = text or ""
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    upper = lambda c: "A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ"
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_marks": sum(c in "#*$%&|<>!=~^\\{}" for c in text), "n_upper": sum(map(upper, text)), "n_stop": sum(w.lower() in STOP_WORDS for w in words),
        "n_digits": sum("0" <= c <= "9" for c in text), "n_lines": text.count("\n") + 1, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def test_statistics_against_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").union(edges.table(spark).select("doc_id", "text"))
    for r in with_stats(docs).collect():
        assert r["stats"].asDict() == plain_stats(r["row"]["text"]), (r["row"]["text"] or "")[:60]
    assert set(STATS) == set(plain_stats(""))


def test_score_is_that_of_the_rules(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    model = quality_model.learn(docs, spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"))
    assert 0 < len(model.rules) < 80
    for r in with_stats(docs).select("row", "stats", model.score(quality_model.ratios()).alias("score")).collect():
        s = plain_stats(r["row"]["text"])
        x = [float(s[a]) if b is None else s[a] / max(s[b], 1) for a, b in quality_model.RATIOS.values()]
        odds = model.intercept + sum(w for rule, w in model.rules if all((x[f] <= t) == low for f, low, t in rule))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-odds)), rel_tol=1e-9, abs_tol=1e-12)


def test_clashing_and_repeated_labels(spark):
    docs = spark.createDataFrame([(d, "some words of a text " * (1 + d % 7)) for d in range(40)], "doc_id long, text string")
    labels = [(d, d % 2) for d in range(40)]
    plain = quality_model.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert quality_model.learn(docs, spark.createDataFrame(labels * 3, "doc_id long, quality int")) == plain
    both = spark.createDataFrame([*labels, *((d, 1 - d % 2) for d in range(0, 40, 4))], "doc_id long, quality int")
    without = spark.createDataFrame([x for x in labels if x[0] % 4], "doc_id long, quality int")
    assert quality_model.learn(docs, both) == quality_model.learn(docs, without)


def test_l1_gives_most_rules_no_weight():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.7) & (x[:, 1] < 0.4)).astype(float)
    model = quality_model.fit(x, y)
    odds = model.intercept + sum((w * quality_model.holds(r, x) for r, w in model.rules), np.zeros(len(x)))
    assert ((odds > 0) == (y == 1)).mean() > 0.99 and len(model.rules) < 40


def test_filter_on_a_column_of_the_row(spark):
    judged = quality_rules.judge(edges.table(spark))
    assert judged.where(F.col("row.doc_id") == 4).select("verdict.kept").collect()[0]["kept"]
