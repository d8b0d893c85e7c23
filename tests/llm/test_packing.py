import random
import zlib

import edges
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from compare import DATA
from gridloom.llm import packing, queries

TOKENS = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*TOKENS.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def verify(rows, docs, tiers=packing.TIERS):
    """Every id in exactly one piece, gapless sequences, and the padding that is left."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for d, own in by_doc.items():
        ids, at = ids_of(docs[d]), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    padding, steps = 0, {}
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= own[0]["tier"] and len({(r["tier"], r["step_group"]) for r in own}) == 1 and own[0]["tier"] in tiers
        padding += own[0]["tier"] - at
        steps.setdefault(own[0]["step_group"], []).append(own[0]["tier"])
    assert all(len(set(t)) == 1 and sum(t) <= 8192 for t in steps.values())
    return padding, len(by_sequence)


def test_round_trip(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    rows = queries.op9_packing(spark, f"{DATA}/sf0.01").collect()
    padding, sequences = verify(rows, docs)
    tasks = len({r["sequence_id"] >> 40 for r in rows})
    assert padding < 1024 * tasks and sequences > 900


@pytest.mark.parametrize("block", [1, 3000, 1 << 20])
def test_blocks_and_tiers(spark, block):
    rng = random.Random(block)
    docs = {d: " ".join(f"word{rng.randrange(99)}" for _ in range(rng.choice((0, 1, 5, 50, 120, 300, 900)))) for d in range(150)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack_documents(df, tiers=(256, 64, 16), block_tokens=block).collect()
    padding, _ = verify(rows, docs, (256, 64, 16))
    assert padding < 256


def test_ids_are_those_of_the_library():
    encode = packing.Encoder()
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|> a<|endoftext|>", "it's we'll I'M", "\n\n  \t x  ", "日本語 ñ é 😀👨‍👩‍👧 ​﻿", "a" * 5000, "x\0y\x1f", "1234567 ½ ١٢٣", "    ."]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x1F300, 0x1F700)))) for _ in range(400)) for _ in range(30)]
    for t in texts:
        assert (np.append(encode(t.encode()), 0) == ids_of(t)).all(), t[:40]
    assert list(encode(b"a <|endoftext|> b")) == [64, 220, 50256, 275]  # a token of the file, as it is loaded
    # One way for texts of any length; only runs of white space of a million go to the library itself.
    for long in ("word and more " * 150_000, "x" * 1_500_000, " " * 1_200_000, "a" + "\n" * 1_200_000 + " b"):
        assert (np.append(encode(long.encode()), 0) == ids_of(long)).all(), long[:20]


def test_step_groups_are_balanced():
    """Costs of the groups of a tier: within a few per cent of their mean, where the order of arrival is far from it."""
    rng = random.Random(4)
    packer = packing.Packer(0)
    for d in range(4000):
        packer.add(d, np.zeros(rng.choice((40, 90, 200, 500, 1500, 4000)), "<u4"))
    packer.pack(True)
    groups, arrival = {}, {}
    for r in packer.out:
        groups.setdefault((r[7], r[8]), []).append(r)
        arrival.setdefault((r[7], r[5] // 8), []).append(r[2] ** 2)
    for tier in packing.TIERS:
        own = [v for k, v in groups.items() if k[0] == tier]
        full = [sum(r[2] ** 2 for r in v) for v in own if len({r[5] for r in v}) == 8192 // tier]
        if len(full) > 10:
            assert max(full) < 1.05 * np.mean(full) and min(full) > 0.9 * np.mean(full)
            before = [sum(v) for k, v in arrival.items() if k[0] == tier]
            assert min(before) < 0.7 * np.mean(before), (min(before), np.mean(before))


def test_edges(spark):
    docs = edges.table(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    verify(packing.pack_documents(docs.coalesce(2)).collect(), dict(t for t in edges.TEXTS if t[0] is not None))
    everything = packing.pack_documents(edges.table(spark)).collect()
    assert sum(r["length"] for r in everything) == sum(len(ids_of(t)) for _, t in edges.TEXTS)
    assert packing.pack_documents(edges.empty(spark)).collect() == []
    again = packing.pack_documents(docs.coalesce(1)).collect()
    assert again == packing.pack_documents(docs.coalesce(1)).collect()
