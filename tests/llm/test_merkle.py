import hashlib
import zlib

import edges
import pytest
from pyspark.sql import functions as F

from compare import DATA, connect
from gridloom.llm import merkle, queries
from gridloom.llm.merkle import Shape


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The root, and each leaf's path: (nodes on the left, nodes on the right) for each level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % fanout
            paths[k].append((nodes[first:at], nodes[at + 1 : first + fanout]))
        where = [at // fanout for at in where]
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def up(node, path):
    for left, right in path:
        node = H(*left, node, *right)
    return node


def plain(rows, fanout=3):
    """rows: (doc_id, source, lang, n_chars, text). Result rows of the contract, sorted."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: tree([leaf(*r) for r in own[s]], fanout) for s in sources}
    root, tops = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip(own[s], trees[s][1], strict=True):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = up(up(leaf(*r[:4], text), path), top)
            out.append((r[0], leaf(*r), trees[s][0], root, H(*(x for a, b in path + top for x in a + b)), folded, folded == root))
    return sorted(out, key=repr)


def result(docs, shape=Shape()):
    out = merkle.manifest(docs, merkle.tampered_text(docs["doc_id"], docs["text"]), shape)
    rows = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat("proof", "source_proof"), 256), "folded_root", F.col("folded_root") == F.col("root"))
    return sorted(map(tuple, rows.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def test_query_against_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select(*merkle.FIELDS).collect()]
    got = queries.op13_merkle(spark, f"{DATA}/sf0.01")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain(docs)
    sql = connect("sf0.01").sql(f"SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, verified FROM ({queries.ORACLE_SQL['op13_merkle']})")
    assert sorted(sql.fetchall(), key=repr) == got
    assert {x[-1] for x in got} == {True, False}


@pytest.mark.parametrize("shape", [Shape(3, 0), Shape(3, 1), Shape(3, 2), Shape(2, 1), Shape(4, 1)], ids=str)
def test_shapes(spark, shape):
    rows = [(i * 7, f"of {n}", "en", i, f"text {i}\n\n{i}") for n in (1, 2, 3, 4, 9, 10, 28, 82) for i in range(n)] + [(i, f"s{i % 5}", None, None, None) for i in range(30)]
    assert result(table(spark, rows), shape) == plain(rows, shape.fanout)


def test_nulls_ties_and_order(spark):
    rows = [(1, None, "en", 3, "a\nb"), (2, None, None, None, None), (None, "x", "en", 1, "y"), (None, "x", "en", 1, "z"), (5, "", "de", 0, ""), (5, "", "de", 0, ""), (5, "", "de", 0, "\n")]
    rows += [(i, s, "fr", 9, "é\U0001f600\n" * i) for i, s in enumerate(["é", "z", "Z", "\U0001f600", "￿", "0", "1", "-"])]
    assert result(table(spark, rows), Shape(3, 1)) == plain(rows)


def test_a_source_spread_over_many_tasks(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 50}", "en", i, str(i)) for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(table(spark, rows), Shape(3, 3)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_each_group_of_a_round_has_fanout_rows(spark):
    """40 parts of one source: no more than 54 with the empty ones, and all end with the same root."""
    roots = spark.createDataFrame([("k", i, 1, H(str(i)), H(str(i))) for i in range(40)], "key string, part long, n long, root string, alone string")
    got = merkle.exchange(roots, Shape(3, 0)).collect()
    root, paths = tree([H(str(i)) for i in range(40)], 3)
    assert {r["root"] for r in got} == {root} and len(got) == 40
    assert all(r["above"] == "".join(x for a, b in paths[r["part"]] for x in a + b) for r in got)


def test_awkward_tables(spark):
    docs = edges.table(spark, ("place", "part", "leaf", "proof", "root", "claimed")).drop("lang").withColumns({"source": F.when(F.col("doc_id") % 2 == 0, "even"), "lang": F.lit("x"), "n_chars": F.length("text").cast("long")})
    assert result(docs, Shape(3, 1)) == plain([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
    assert result(docs.where("false")) == []


def test_fold_needs_the_right_place():
    nodes = [H(str(i)) for i in range(11)]
    root, paths = tree(nodes, 3)
    for i, path in enumerate(paths):
        proof = "".join(x for a, b in path for x in a + b)
        assert merkle.fold(nodes[i], i, 11, proof) == root
        assert merkle.fold(nodes[i], (i + 1) % 9, 11, proof) != root
