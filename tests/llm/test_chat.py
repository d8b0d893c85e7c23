import hashlib
import random

import edges
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import DATA, connect, rows
from gridloom.llm import chat_format as chat
from gridloom.llm import packing, queries

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
PIECES = st.lists(st.sampled_from(["<", "|", ">", "\\", "/", "s", "s>", "[", "INST", "]", "INST]", "<|", "<|end|>", "</s>", "<<SYS>>", "<</SYS>>", "SYS>>", "\n", "é", "a", "<start_of_turn>", "<|text|>", "<|image|>"]), max_size=12)


@given(PIECES.map("".join))
@settings(max_examples=2000, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in ("<|", *chat.FOREIGN))


@given(st.lists(st.tuples(PIECES.map("".join), st.lists(st.one_of(PIECES.map("".join), st.sampled_from([1, 2, 3])), max_size=5)), max_size=4))
@settings(max_examples=500, deadline=None)
def test_turns_are_read_back(turns):
    kinds = {1: "image", 2: "audio", 3: "document"}
    empty = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    visit, out, attached, want = chat.Visitor(), "", [], []
    for role, parts in turns:
        given_ = [empty | ({"type": "text", "text": p} if isinstance(p, str) else {"type": kinds[p], "ref": f"r{p}"}) for p in parts]
        content, spans, found = visit(given_)
        assert "".join(chat.unescape(content[a:b]) for a, b in spans) == "".join(p for p in parts if isinstance(p, str))
        out += f"{chat.TURN}{chat.escape(role)}{chat.TEXT}{content}{chat.END}"
        attached += [{"type": t, "ref": r, "tokens": n} for t, r, n in found]
        flat = []
        for p in parts:
            if not isinstance(p, str):
                flat.append(kinds[p])
            elif flat and flat[-1][:1] == "=":
                flat[-1] += p
            elif p:
                flat.append("=" + p)
        want.append((role, flat))
    got = [(role, ["=" + p["text"] if p["type"] == "text" else p["type"] for p in parts]) for role, parts in chat.parse(out, attached)]
    assert got == want
    assert [p["ref"] for _, parts in chat.parse(out, attached) for p in parts if p["type"] != "text"] == [a["ref"] for a in attached]


def plain(turns):
    """turns: (role, text) in order."""
    assistant = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(assistant), sha(assistant)


def of(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_query_against_sql_and_plain_version(spark):
    sf = f"{DATA}/sf0.01"
    got = queries.op12_chat_format(spark, sf)
    by_conv = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by_conv.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert of(got) == {c: plain(t) for c, t in by_conv.items()}
    sql = connect("sf0.01").sql(queries.ORACLE_SQL["op12_chat_format"]).df()
    assert rows(got.select(*sql.columns).toPandas()) == rows(sql)


def messages(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")


def part(type, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (type, text, ref, width, height, seconds, pages)


def test_attachments_and_expanded_tokens(spark):
    table = [
        (1, 0, "user", [part("text", "look: <|image|> "), part("image", ref="a.png", width=280, height=57), part("text", " and "), part("document", ref="b.pdf", pages=3), part("text", "?")]),
        (1, 1, "assistant", [part("text", "first "), part("audio", ref="c.wav", seconds=1.01), part("text", " last")]),
        (1, 2, "user", [part("video", ref="d"), part(None), None, part("image", ref="e", width=10**6, height=10**6)]),
        (2, 0, "assistant", None),
    ]
    got = {r["conv_id"]: r for r in chat.format_chat(messages(spark, table)).collect()}
    one = got[1]
    assert [(a["type"], a["ref"], a["turn"], a["tokens"]) for a in one["attachments"]] == [("image", "a.png", 0, 30), ("document", "b.pdf", 0, 1536), ("audio", "c.wav", 1, 26), ("other", "d", 2, 1), ("other", None, 2, 1), ("image", "e", 2, 1024)]
    for a in one["attachments"]:
        assert one["formatted"].startswith(f"<|{a['type']}|>", a["start"])
    assert [one["formatted"][s["start"] : s["end"]] for s in one["loss"]] == ["first ", " last"]
    assert one["n_tokens"] == 9 + 30 + 1536 + 26 + 1 + 1 + 1024 and one["n_turns"] == 3
    assert got[2]["formatted"] == "<|turn|>assistant<|text|><|end|>" and got[2]["loss"] == []


def test_tokens_of_texts(spark):
    encode = packing.Encoder()
    table = [(1, 0, "user", [part("text", "one two </s> three"), part("image", ref="x")])]
    row = chat.format_chat(messages(spark, table), tokens=packing.Encoder).first()
    assert row["n_tokens"] == 3 + 1 + len(encode(b"user")) + len(encode(chat.escape("one two </s> three").encode()))


@pytest.mark.parametrize("piece", [1, 40, 1 << 24])
def test_long_conversations_go_on_in_pieces(spark, piece):
    rng = random.Random(1)
    turns = [(c, t, rng.choice(("user", "assistant")), [part("text", "x<|y" * rng.randrange(9)), part("image", ref=str(t))]) for c in range(5) for t in range(rng.randrange(1, 40))]
    out = chat.format_chat(messages(spark, rng.sample(turns, len(turns))), piece_chars=piece)
    by_conv = {}
    for c, _, role, parts in sorted(turns, key=lambda x: x[:2]):
        by_conv.setdefault(c, []).append((role, parts[0][1]))
    assert of(chat.digests(out)) == {c: plain(t) for c, t in by_conv.items()}
    refs = {}
    for r in out.collect():
        refs.setdefault(r["conv_id"], []).extend(a["ref"] for a in r["attachments"])
        assert all(r["formatted"].startswith("<|image|>", a["start"]) for a in r["attachments"])
    assert all(v == [str(i) for i in range(len(v))] for v in refs.values())
    assert (out.count() == 5) == (piece == 1 << 24)


def test_awkward_tables(spark):
    docs = edges.table(spark, ("piece", "formatted", "parts")).drop("turn", "role")
    rows_ = docs.withColumns({"conv_id": F.when(F.col("doc_id") > 3, F.col("doc_id") % 3), "turn": F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")), "role": F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 2 == 0, "assistant").otherwise("a\nb<|end|>"))})
    by_conv = {}
    for r in rows_.collect():
        by_conv.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, chat.escape(r["role"] or ""), chat.escape(r["text"] or ""), r["role"], r["text"]))
    want = {c: plain([x[4:] for x in sorted(t, key=lambda x: x[:4])]) for c, t in by_conv.items()}
    assert of(chat.digests(chat.format_chat(chat.text_messages(rows_)))) == want and None in want
    assert chat.digests(chat.format_chat(chat.text_messages(rows_.where("false")))).collect() == []
