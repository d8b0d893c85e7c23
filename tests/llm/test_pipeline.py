import brute
import corpus_pipeline
import edges
from pyspark.sql import functions as F

from compare import DATA
from gridloom.llm import decontaminate, near_dup
from test_near_dup import brute as classes
from test_packing import verify


def test_stages_against_plain_versions(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert all(not brute.rules(t)[-1] for t in kept.values()) and all(texts[d] == t for d, t in kept.items()) and len(kept) > 150

    lines = corpus_pipeline.lines(spark, good, sf)
    assert lines.columns == docs.columns
    cleaned = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert cleaned == {d: t for d, (_, _, t) in brute.lines(kept).items()}

    one = corpus_pipeline.near_copies(spark, lines, sf)
    assert one.columns == docs.columns
    expected = classes(cleaned, near_dup.Settings())
    assert {r["doc_id"] for r in one.collect()} == set(expected.values())

    clean = corpus_pipeline.leaks(spark, one, sf)
    assert clean.columns == docs.columns
    words = lambda t: b" " + b" ".join(decontaminate.words_of(t.encode())) + b" "
    last = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert set(last) == {d for d in set(expected.values()) if not any(words(x) in words(cleaned[d]) for x in items)}

    packed = corpus_pipeline.run(spark, sf).collect()
    verify(packed, last)


def test_awkward_tables(spark, tmp_path):
    """Null and empty texts, repeated rows, ties, very long texts and columns whose names stages use: each stage keeps the columns, and what is clean comes out whole."""
    sf = f"{DATA}/sf0.001"
    docs = edges.table(spark, ("n_links", "pivot", "hash")).withColumn("n_chars", F.length("text").cast("long")).withColumn("source", F.lit("s"))
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(brute.rules(r["text"])[0] >= 20 for r in docs.collect())
    assert {r["doc_id"] for r in docs.collect()} <= {d for d, _ in edges.TEXTS} and 4 in {r["doc_id"] for r in docs.collect()}


def test_empty_table(spark, tmp_path):
    sf = f"{DATA}/sf0.001"
    docs = edges.empty(spark).withColumn("n_chars", F.lit(0).cast("long")).withColumn("source", F.lit("s"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        assert docs.count() == 0


def test_run_leaves_the_last_stage_alone(spark):
    import glob

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{folder}/pipeline-*"))
    corpus_pipeline.run(spark, f"{DATA}/sf0.001").count()
    (new,) = set(glob.glob(f"{folder}/pipeline-*")) - before
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{new}/*")] == ["packing"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dup", "decontaminate", "packing"]
