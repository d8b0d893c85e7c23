import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import edges
from gridloom.llm import line_dedup


@pytest.mark.parametrize("options", [{}, {"shard_lines": 3}, {"shard_lines": 2, "group": 3}, {"shard_lines": 2, "group": 5, "most": 0}], ids=["one", "shards", "groups", "joined"])
def test_against_brute_force(spark, options, monkeypatch):
    options = dict(options)
    for name in ("GROUP", "MOST_BROADCAST"):
        monkeypatch.setattr(line_dedup, name, options.pop(name.split("_")[0].lower(), getattr(line_dedup, name)))
    shared = [f"This is line number {i} of those that many documents share, {i}." for i in range(9)]
    docs = {d: "\n".join(f"{' ' * (d % 3)}{shared[(d * k) % 9].upper() if d % 2 else shared[(d * k) % 9]}\t" for k in range(1, 5)) + f"\nshort\nshort\nown line {d}" for d in range(40)}
    docs |= {100: None, 101: "", 102: shared[0] + "\n" + shared[0] + "\n\n", 103: "é" * 39 + "\n" + "É" * 40, **{104 + i: "É" * 40 + "\n" + "é" * 40 for i in range(5)}}
    df = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, n_lines string").repartition(3)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df, **options).collect()}
    expected = brute.lines(docs)
    assert {d: (r["n_lines"], r["n_dropped"], r["text"]) for d, r in out.items()} == expected
    plain = line_dedup.dedup_lines(df, details=False, **options)
    assert plain.columns == df.columns and {r["n_lines"] for r in plain.collect()} == {"x"}


def test_edges(spark):
    docs = edges.table(spark)
    out = line_dedup.dedup_lines(docs.withColumn("n_chars", F.length("text").cast("int")), min_docs=3)
    assert out.count() == len(edges.TEXTS) and set(docs.columns) <= set(out.columns)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] >= 1
        if r["doc_id"] == 16:
            assert r["n_dropped"] == 0  # the largest id that holds the line keeps all of its copies
        if r["doc_id"] in (4, 5):
            assert r["n_dropped"] == 1 and r["text"] == ""
        if r["doc_id"] is None:
            assert r["n_dropped"] == (1 if r["n_chars"] == 0 and r["n_dropped"] else 0)
    assert line_dedup.dedup_lines(edges.empty(spark)).collect() == []
    key = lambda r: (r["doc_id"] or 0, r["text"], r["n_dropped"])
    several = line_dedup.dedup_lines(docs, min_docs=3, shard_lines=1)
    assert several.columns == line_dedup.dedup_lines(docs, min_docs=3).columns
    assert sorted(map(key, several.collect())) == sorted(map(key, line_dedup.dedup_lines(docs, min_docs=3).collect()))


def test_repeated_rows_are_one_document(spark):
    """As the SQL has it: distinct ids count, and a document's rows share their fate."""
    line = "A line of at least forty code points, which several rows hold."
    few = [(1, line)] * 4 + [(2, line)]
    many = [(d, f"{line}\nown {d}") for d in (3, 3, 4, 5, 6, 7, 7)]
    for rows in (few, many, few + many):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = sorted((r["doc_id"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(df).collect())
        last = max(d for d, _ in rows) if len({d for d, _ in rows}) >= 5 else None
        gone = lambda d: last is not None and d != last
        assert out == sorted((d, int(gone(d)), "\n".join(x for x in t.split("\n") if not (gone(d) and x == line))) for d, t in rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    h1[: n // 2] = 7  # equal first halves still part
    row = line_dedup.Shard.build(h1, h2, np.arange(n), np.arange(n) * 2)
    shard = line_dedup.Shard(row)
    at = shard.probe(h1, h2)
    assert sorted(at) == list(range(n))  # minimal and perfect
    assert (shard.counts[at] == np.arange(n)).all() and (shard.last_docs[at] == np.arange(n) * 2).all()
    assert (shard.probe(h1, h2 ^ np.uint64(1)) == -1).all()
    size = sum(len(row[k]) for k in ("words", "ranks", "prints", "counts", "last_docs", "rest_h1", "rest_h2"))
    assert size <= 24 * n + 4096


def test_hashes_that_never_part(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 2)
    h = np.arange(500, dtype=np.uint64)
    shard = line_dedup.Shard(line_dedup.Shard.build(h, h, h, h.astype(np.int64)))
    assert shard.rest and (shard.last_docs[shard.probe(h, h)] == h).all()
