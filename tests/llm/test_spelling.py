import re
import zlib
from collections import Counter, defaultdict

import edges
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import DATA, connect
from gridloom.llm import queries, spelling
from gridloom.llm.spelling import Settings


def vocabulary(docs, s=Settings()):
    """docs: (doc_id, text) rows."""
    total = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= s.min_chars and n >= s.min_count}


def near(words):
    """All pairs one edit apart, by every string that a deletion or a wildcard gives."""
    by_key = defaultdict(list)
    for w in words:
        by_key[w].append(w)
        for i in range(len(w)):
            by_key[w[:i] + "*" + w[i + 1 :]].append(w)
    out = defaultdict(set)
    for key, same in by_key.items():
        if "*" in key:
            for a in same:
                out[a].update(x for x in same if x != a)
    for w in words:
        for i in range(len(w)):
            if (shorter := w[:i] + w[i + 1 :]) in words:
                out[w].add(shorter)
                out[shorter].add(w)
    return out


def variants(docs, s=Settings()):
    n = vocabulary(docs, s)
    around, form = near(n), {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= s.factor * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = variants(docs)
    assert found(queries.op11_spelling(spark, f"{DATA}/sf0.01")) == want
    assert set(connect("sf0.01").sql(f"SELECT word, form, root, n, n_near, form_n FROM ({queries.ORACLE_SQL['op11_spelling']})").fetchall()) == want
    assert len(want) > 3000 and sum(x[1] is not None for x in want) > 300


@pytest.mark.parametrize("filter_bytes,bits", [(1 << 20, 16), (600, 16), (1 << 20, 1)])
def test_slices_and_false_positives(spark, filter_bytes, bits):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(5, 8))) for _ in range(900)]
    docs = [(i, " ".join(rng.choice(words, 60))) for i in range(80)]
    s = Settings(filter_bytes=filter_bytes, bits=bits)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = variants(docs, s)
    assert found(spelling.spelling_variants(df, s)) == want and any(x[4] > 3 for x in want)


def test_edits_come_once_and_hash_as_they_are_spelled():
    words, letters = ["aabba", "abcde", "ééééé"], np.array(sorted(map(ord, "abcdeé")), np.uint64)
    got = []
    for _, edits, h in spelling.edit_hashes(words, letters):
        for (row, place, new), x in zip(edits.tolist(), h, strict=True):
            w = words[row]
            edit = w[:place] + (chr(new) if new else "") + w[place + 1 :]
            assert spelling.hashes([edit])[0] == x
            got.append((w, edit))
    want = {(w, w[:i] + w[i + 1 :]) for w in words for i in range(5)} | {(w, w[:i] + c + w[i + 1 :]) for w in words for i in range(5) for c in "abcdeé" if c > w[i]}
    assert len(got) == len(set(got)) and set(got) == want


def test_filter_has_all_of_its_words_and_few_others(spark):
    words = [f"word{i:06d}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(20_000)]
    df = spark.createDataFrame([(w,) for w in words[::2]], "word string")
    s = Settings()
    for parts in (1, 3):
        seen = np.zeros(len(words), int)
        for part in range(parts):
            held = spelling.build_filters(df, {10: 10_000}, part, parts, s)
            seen[held.probe(10, spelling.hashes(words))] += 1
        assert (seen[::2] == 1).all() and seen[1::2].sum() < 40  # 0.4 % of those that aren't words


def test_chains_are_followed_to_the_end(spark):
    texts = [" ".join(["letters"] * 48 + ["letter"] * 24 + ["lettes"] * 12 + ["lettis"] * 6 + ["lettisx"] * 3)]
    got = {x[0]: x for x in found(spelling.spelling_variants(spark.createDataFrame([(None, texts[0])], "doc_id long, text string")))}
    assert got["lettisx"] == ("lettisx", "lettis", "letters", 3, 1, 6) and got["letters"][1:3] == (None, "letters")
    assert got["lettis"][1:3] == ("lettes", "letters") and got["lettes"][1:3] == ("letters", "letters")


def test_awkward_tables(spark):
    want = variants([(d, t) for d, t in edges.TEXTS])
    assert found(spelling.spelling_variants(edges.table(spark, ("word", "n", "form", "root")))) == want and want
    assert spelling.spelling_variants(edges.empty(spark)).collect() == []


def test_long_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "STRETCH", 7)
    text = "Ab cdéfghÿjklmn opq  rst uvwxyz " * 9 + "z" * 50
    assert [w for x in spelling._stretches(text.encode()) for w in spelling._RUN.findall(x)] == spelling._RUN.findall(text.lower())


def test_hot_words_leave_one_row_for_each_word_and_task(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("thousand " * 50).alias("text"))
    counted = spelling.count_words(df.repartition(4), Settings(typo=0))
    assert counted.collect() == [("thousand", 20_000)]
