import random

import edges
import pytest
from compare import DATA
from gridloom.llm import decontaminate, queries
from pyspark.sql import functions as F


def contained(text, item):
    w, x = decontaminate.words_of(text.encode()), decontaminate.words_of(item.encode())
    return any(w[i : i + len(x)] == x for i in range(len(w) - len(x) + 1))


def test_all_exact_passages_and_no_others(spark):
    sf = f"{DATA}/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if contained(t, x)}
    found = queries.op5_decontaminate(spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == exact and exact
    for r in found:
        w = decontaminate.words_of(docs[r["doc_id"]].encode())
        assert r["score"] == 1.0 and w[r["first_word"] : r["last_word"] + 1] == decontaminate.words_of(items[r["item_id"]].encode())


VOCABULARY = ["the", "of", "and", "to", "in", *(f"w{i}" for i in range(400))]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.mark.parametrize("block", [8 << 20, 500], ids=["one", "blocks"])
def test_edited_copies(spark, block):
    rng = random.Random(5)
    items = [(i, prose(rng, 40)) for i in range(12)] + [(98, ["single"]), (99, ["two", "words"])]
    docs, expected = [], set()
    for d in range(60):
        i, x = items[d % 12]
        x = list(x)
        for k in range(0, 40, 8):  # an edit each eight words: changed, dropped, or one added
            x[k] = {0: "new", 1: "", 2: f"{x[k]} extra"}[d % 3]
        docs.append((d, " ".join([*prose(rng, 200), *x, *prose(rng, 100)]).upper() + "."))
        expected.add((d, i))
    docs += [(100 + d, " ".join(prose(rng, 300))) for d in range(60)] + [(200, "A Single. thing"), (201, None), (202, "Two -- words")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items] + [(None, "x y z"), (97, None), (96, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, block_bytes=block).collect()}
    assert found == expected | {(200, 98), (202, 99)}
    kept = decontaminate.drop_leaks(df.withColumn("doc", F.lit(1)), bench, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "doc"] and sorted(r["doc_id"] for r in kept.collect()) == [*range(100, 160), 201]


def test_items_that_all_documents_hold(spark):
    item = " ".join(f"word{i} of the test" for i in range(12))
    df = spark.createDataFrame([(d, f"before {d} {item} after") for d in range(50)], "doc_id long, text string")
    assert decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 50


def test_edges(spark):
    docs = edges.table(spark)
    bench = spark.createDataFrame([(1, edges.PROSE), (1, edges.PROSE)], "item_id int, text string")
    found = decontaminate.find_leaks(docs, bench).collect()
    assert sorted({r["doc_id"] or 0 for r in found}) == [0, 4, 5, 8, 10, 16] and len(found) == 2 * 7
    assert decontaminate.find_leaks(edges.empty(spark), bench).collect() == []
    assert decontaminate.find_leaks(docs, bench.where("false")).collect() == []
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns
    assert decontaminate.drop_leaks(docs, bench.where("false")).count() == docs.count()


@pytest.mark.parametrize(("size", "first", "n"), [(59, 0, 29), (59, 30, 29), (150, 60, 50), (1000, 500, 40), (400, 100, 13), (400, 100, 12)])
def test_passages_of_longer_items(spark, size, first, n):
    rng = random.Random(size + first)
    item = [f"i{k}" for k in range(size)]
    text = [*prose(rng, 200), *item[first : first + n], *prose(rng, 100)]
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(prose(rng, 300)))], "doc_id long, text string")
    found = decontaminate.find_leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["first_word"], r["last_word"]) for r in found] == ([(1, 7, 200, 199 + n)] if n >= 13 else [])


@pytest.mark.parametrize("early", [2, 5, 8, 11, 14])
def test_windows_begin_at_the_first_place_of_a_repeated_seed(early):
    item = [f"i{k}" for k in range(60)]
    item[early : early + 3] = item[40:43]
    copy = [f"c{k}" if k < 40 and (k % 3 == 1 or k > 37) else w for k, w in enumerate(item)]
    items = decontaminate.Items([(1, " ".join(item).encode())], decontaminate.Settings())
    items.choose_seeds(dict.fromkeys(range(100), 1), 1)
    words = [w.encode() for w in ["before"] * 100 + copy + ["after"] * 50]
    [(_, score, first, last)] = items.matches(words)
    assert (first, last) == (100, 159) and score > 0.6


def edited(rng, words, rate, kind):
    out = []
    for w in words:
        k = (kind if kind != "mixed" else rng.choice(("changed", "added", "dropped"))) if rng.random() < rate else ""
        out += {"": [w], "changed": [rng.choice(VOCABULARY)], "added": [w, *prose(rng, rng.choice((1, 1, 2, 6)))], "dropped": []}[k]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_that_full_alignment_finds(seed):
    """Random items with repeated phrases, their copies edited in all ways: every pair at or above the bar by Smith-Waterman over the whole text is found, with its score."""
    rng, s = random.Random(seed), decontaminate.Settings()
    items = []
    for n in (20, 20, 25, 30, 40, 60, 80, 120, 200, 300):
        x = prose(rng, n)
        for _ in range(n // 12):
            a, b = rng.randrange(n - 3), rng.randrange(n - 3)
            x[a : a + 3] = x[b : b + 3]
        items.append(x)
    texts = []
    for rate in (0.1, 0.2, 0.3, 0.4):
        for kind in ("changed", "added", "dropped", "mixed"):
            for x in items:
                texts.append([w.encode() for w in [*prose(rng, 60), *edited(rng, x, rate, kind), *prose(rng, 60)]])
    found = decontaminate.Items([(i, " ".join(x).encode()) for i, x in enumerate(items)], s)
    held = {}
    for t in texts:
        for g in found.held(t).tolist():
            held[g] = held.get(g, 0) + 1
    found.choose_seeds(held, len(texts))
    n = 0
    for k, t in enumerate(texts):
        i, ids = k % len(items), found.numbers(t)
        whole = decontaminate.align(found.words[i], ids, s)[0]
        strict = decontaminate.align(found.words[i], ids, found.strict)[0]
        got = {m[0]: m[1] for m in found.matches(t)}
        if whole >= s.min_score * len(items[i]):
            n += 1
            assert abs(got[i] - whole / len(items[i])) < 1e-9
        elif strict >= s.passage:
            assert i in got
    assert n > 60
