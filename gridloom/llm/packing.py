"""Hierarchical packing of tokenised documents into sequences of several lengths.

Each task packs what it reads, block after block of at most ``block_tokens``
tokens, so memory is bounded and nothing is shuffled. Within a block:

1. A document gives full windows of the longest size; what is left of it is
   routed to the shortest tier (window size) that holds it.
2. Tiers are packed from long to short. A window takes the largest piece of its
   tier, then its gap is filled from shorter tiers: whole pieces first, the
   largest that fits; then the front of a piece, cut to fit.
3. The last piece of a block goes on into the next block; only the last one of
   a task may leave a window with padding, which then has the smallest tier
   that holds it.
4. Windows of one size form step groups of ``step_tokens`` tokens. The windows
   of a block are dealt to its groups by their cost, the dearest first, each to
   the group that costs least so far; a window's cost is the sum of the squared
   lengths of its pieces, as attention within documents has it.

Every window but the last of a task has exactly the length of its tier."""

from __future__ import annotations

import base64
import bisect
import heapq
import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches, utf8

TIERS = (1024, 512, 256, 128)
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Encoder:
    """Texts to ids of a byte-level BPE vocabulary: the ids that ``tokenizers`` gives with its json file as loaded, added tokens in a text included.

    Ranks of the same vocabulary in tiktoken's form give the same ids in a
    quarter of the time (a test compares them). A text with a run of white space
    too long for tiktoken's pattern (a million characters) makes it fail, and
    ``tokenizers`` itself encodes that text."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(vocabulary, encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file).get("added_tokens", ())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
        self.load = lambda: Tokenizer.from_file(vocabulary)
        self.slow = None

    def __call__(self, text: bytes) -> np.ndarray:
        try:
            return np.array(self.fast.encode(text.decode(), allowed_special="all"), "<u4")
        except ValueError:
            self.slow = self.slow or self.load()
            return np.array(self.slow.encode(text.decode(), add_special_tokens=False).ids, "<u4")


class Packer:
    """Packs one block after another; out collects rows (doc, start, length, crc, doc_tokens, sequence, offset, tier, step)."""

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192) -> None:
        self.tiers, self.step_tokens = tuple(sorted(tiers, reverse=True)), step_tokens
        self.sequence = self.steps = first_sequence
        self.windows: dict[int, list[tuple[int, list[tuple]]]] = {t: [] for t in self.tiers}  # tier -> (cost, rows) of windows without a step group
        self.out: list[tuple] = []
        self.pieces: dict[int, list[tuple]] = {t: [] for t in self.tiers}  # tier -> (length, order, doc, start, ids, doc_tokens), sorted
        self.order = 0

    def add(self, doc, ids: np.ndarray) -> None:
        top, at = self.tiers[0], 0
        while len(ids) - at >= top:
            self._emit(top, [(doc, at, ids[at : at + top], len(ids))])
            at += top
        if at < len(ids):
            self._route(doc, at, ids[at:], len(ids))

    def _route(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        tier = next(t for t in reversed(self.tiers) if len(ids) <= t)
        self.order += 1
        bisect.insort(self.pieces[tier], (len(ids), self.order, doc, start, ids, doc_tokens), key=lambda p: p[:2])

    def _emit(self, tier: int, parts: list[tuple]) -> None:
        offset, rows = 0, []
        for doc, start, ids, doc_tokens in parts:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.sequence, offset, tier))
            offset += len(ids)
        self.windows[tier].append((sum(r[2] ** 2 for r in rows), rows))
        self.sequence += 1

    def _deal(self, last: bool) -> None:
        """Give windows their step groups; unless last, those that don't fill a group wait on."""
        for tier, waiting in self.windows.items():
            size = max(1, self.step_tokens // tier)
            groups = -(-len(waiting) // size) if last else len(waiting) // size
            now, self.windows[tier] = waiting[: groups * size], waiting[groups * size :]
            loads = [(0, 0, self.steps + k) for k in range(groups)]  # cost, windows, group
            self.steps += groups
            for cost, rows in sorted(now, key=lambda w: -w[0]):
                load, n, group = heapq.heappop(loads)
                self.out += [(*r, group) for r in rows]
                if n + 1 < size:
                    heapq.heappush(loads, (load + cost, n + 1, group))

    def _take(self, tiers: tuple[int, ...], most: int) -> tuple | None:
        """The largest waiting piece of at most so many tokens."""
        for t in tiers:
            k = bisect.bisect_right(self.pieces[t], most, key=lambda p: p[0])
            if k:
                return self.pieces[t].pop(k - 1)
        return None

    def pack(self, last: bool) -> None:
        """Pack all waiting pieces; unless last, one window's worth and an open step group may wait on."""
        self._fill(last)
        self._deal(last)

    def _fill(self, last: bool) -> None:
        for i, tier in enumerate(self.tiers):
            while self.pieces[tier]:
                size, parts, gap = tier, [], tier
                while gap:
                    piece = self._take(self.tiers[i:], gap)
                    if piece is None:  # nothing fits whole: cut the front off the smallest that waits
                        t = next((t for t in reversed(self.tiers[i:]) if self.pieces[t]), None)
                        if t is None:
                            break
                        n, _, doc, start, ids, total = self.pieces[t].pop(0)
                        self._route(doc, start + gap, ids[gap:], total)
                        piece = (gap, 0, doc, start, ids[:gap], total)
                    parts.append((piece[2], piece[3], piece[4], piece[5]))
                    gap -= piece[0]
                if gap and not last:
                    for doc, start, ids, total in parts:
                        self._route(doc, start, ids, total)
                    return
                if gap:  # the last window: the smallest tier that holds it
                    size = next(t for t in reversed(self.tiers) if tier - gap <= t)
                self._emit(size, parts)


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8192, block_tokens: int = 1 << 20, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, tier (its window's size) and step_group.

    A document is its ids and then id 0, so a null or empty text is the id 0
    alone. Every id lies in exactly one piece; pieces of a sequence follow each
    other from offset 0. Repeated rows are packed each; an empty table gives an
    empty result; a null doc_id stays null. A text of any length is packed whole.

    sequence_id and step_group hold the number of the task's partition in their
    upper bits. A task that runs again gives the same rows if docs gives its
    partitions the same rows in the same order, as files do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        packer = Packer(TaskContext.get().partitionId() << 40, tiers, step_tokens)
        waiting = 0

        def flush(last: bool) -> pa.RecordBatch:
            packer.pack(last)
            rows, packer.out = packer.out, []
            columns = zip(*rows, strict=True) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (key_type, *[pa.int64()] * 8), strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = np.append(encode(text or b""), np.uint32(0)).astype("<u4")
                packer.add(doc, ids)
                waiting += len(ids)
                if waiting >= block_tokens:
                    yield flush(False)
                    waiting = 0
        yield flush(True)

    small_batches(docs.sparkSession)
    field = docs.schema["doc_id"]
    key_type = to_arrow_type(field.dataType)
    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {field.dataType.simpleString()}, {SCHEMA}")
