"""Conversations as training texts, from turns of typed content parts.

A turn's content is a list of parts: text, image, audio, document, or of any
other type. A visitor goes over the parts in order. Text is escaped and stands
as it is; any other part becomes a placeholder ``<|type|>``, and its reference
and the number of tokens that it expands to are recorded, in the order of the
placeholders. Turns are visited where their rows are; then a conversation's
turns are put together:

    <|turn|>role<|text|>content<|end|>

Control strings inside roles and texts are escaped: a backslash goes in after
their first character, where there may be backslashes already, which makes it
reversible. No text can thus hold a mark of the template, nor one of the control
strings of other templates in FOREIGN.

The loss mask are the spans of the assistant's texts, without marks and
placeholders."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, besides all that begin with <|.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
_CONTROL = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in ("<|", *FOREIGN))
_ESCAPE = re.compile(_CONTROL)
_UNESCAPE = re.compile(_CONTROL.replace(r"\\*", r"\\+"))
_MARK = re.compile(r"<\|([^|]*)\|>")
#: A turn's content in a messages table.
PARTS = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass(frozen=True)
class Costs:
    """Tokens that a part expands to: one for each square patch of an image (scaled down to at most image_most of them), for each second of sound, and for each page."""

    image_patch: int = 28
    image_most: int = 1024
    audio_per_second: float = 25.0
    tokens_per_page: int = 512
    other: int = 1


class Visitor:
    """Flattens one turn's parts: content, the spans of its texts in it, and (type, ref, tokens) of each placeholder."""

    def __init__(self, costs: Costs = Costs()) -> None:
        self.costs = costs

    def __call__(self, parts: Iterable[dict | None]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str | None, int]]]:
        self.content, self.at, self.spans, self.found, self.text = [], 0, [], [], []
        for part in parts or ():
            if part is not None:
                getattr(self, f"visit_{part['type']}", self.visit_other)(part)
        self._flush()
        return "".join(self.content), self.spans, self.found

    def visit_text(self, part: dict) -> None:
        self.text.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        w, h, p = max(1, part["width"] or 1), max(1, part["height"] or 1), self.costs.image_patch
        self._placeholder("image", part, min(-(-w // p) * -(-h // p), self.costs.image_most))

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0.0
        self._placeholder("audio", part, max(1, math.ceil(seconds * self.costs.audio_per_second)) if math.isfinite(seconds) else 1)

    def visit_document(self, part: dict) -> None:
        self._placeholder("document", part, max(1, part["pages"] or 1) * self.costs.tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self._placeholder("other", part, self.costs.other)

    def _flush(self) -> None:
        """Texts next to each other are one, so that no control string can arise where they meet."""
        if text := escape("".join(self.text)):
            self.spans.append((self.at, self.at + len(text)))
            self._add(text)
        self.text = []

    def _placeholder(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        self.found.append((kind, part["ref"], tokens))
        self._add(f"<|{kind}|>")

    def _add(self, text: str) -> None:
        self.content.append(text)
        self.at += len(text)


def text_messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and parts of rows that have one text each; a null text is an empty one."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.array(part).cast(PARTS).alias("parts"))


def _visited(messages: DataFrame, costs: Costs, tokens: Callable[[], Callable[[bytes], object]] | None) -> DataFrame:
    """(conv_id, turn, role, content, spans, attachments, n_tokens): each row on its own, where it is."""
    fields = [("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("types", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("expands", pa.list_(pa.int64()))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visit, count = Visitor(costs), tokens() if tokens else None
        for batch in batches:
            roles = [escape(r or "") for r in batch.column(2).to_pylist()]
            turns = [visit(p) for p in batch.column(3).to_pylist()]
            pick = lambda i, j, turns=turns: [[x[j] for x in t[i]] for t in turns]
            lists = [pick(1, 0), pick(1, 1), pick(2, 0), pick(2, 1), pick(2, 2)]
            totals = [3 + sum(x[2] for x in t[2]) + (sum(len(count(s.encode())) for s in (r, *(t[0][a:b] for a, b in t[1]))) if count else 0) for r, t in zip(roles, turns, strict=True)]  # the three marks of a turn are a token each
            columns = [*batch.columns[:2], pa.array(roles, pa.string()), pa.array([t[0] for t in turns], pa.string()), *(pa.array(v, k) for v, (_, k) in zip(lists, fields, strict=True)), pa.array(totals, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "content", *(n for n, _ in fields), "n_tokens"])

    small_batches(messages.sparkSession)
    key = messages.schema["conv_id"].dataType.simpleString()
    kinds = "starts array<int>, ends array<int>, types array<string>, refs array<string>, expands array<long>"
    return messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("parts").cast(PARTS)).mapInArrow(run, f"conv_id {key}, turn long, role string, content string, {kinds}, n_tokens long")


FORMATTED = "piece int, formatted string, loss array<struct<start: long, end: long>>, attachments array<struct<type: string, ref: string, turn: long, start: long, tokens: long>>, n_turns long, n_tokens long"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("start", pa.int64()), ("tokens", pa.int64())]))


def format_chat(messages: DataFrame, costs: Costs = Costs(), loss_roles: tuple[str, ...] = ("assistant",), tokens: Callable[[], Callable[[bytes], object]] | None = None, piece_chars: int = 1 << 24) -> DataFrame:
    """A row for each conversation: conv_id, piece, formatted, loss (spans of code points in formatted), attachments (in the order of their placeholders; start is where that stands), n_turns, n_tokens.

    messages: conv_id, turn, role and parts (see PARTS). Rows go by turn, null
    first; rows of one turn by role and content. Repeated rows are turns of
    their own. A null role or text is an empty one, null or no parts an empty
    content; a part of an unknown or null type is one token, "other". Rows with a
    null conv_id are one conversation. n_tokens counts a token for each mark,
    what placeholders expand to, and with tokens (which makes an encoder of
    UTF-8 text in each task) the escaped texts. An empty table gives an empty
    result. Other columns aren't read.

    A conversation is put together in one task, a turn at a time; after
    piece_chars it goes on in another row, whose positions begin anew, so that
    memory is bounded however long it is. Pieces follow each other in order."""
    loss = {escape(r) for r in loss_roles}
    key = messages.schema["conv_id"].dataType.simpleString()
    laid = _visited(messages, costs, tokens).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "content", F.hash("refs"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        texts: list[str] = []
        spans: list[dict] = []
        attached: list[dict] = []
        now, piece, at, turns, total, held = None, 0, 0, 0, 0, 0

        def close() -> None:
            nonlocal texts, spans, attached, at, turns, total, held
            done.append((now[0], piece, "".join(texts), spans, attached, turns, total))
            texts, spans, attached, held = [], [], [], held + at
            at = turns = total = 0

        def flushed(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal done, held
            columns, done, held = list(zip(*done, strict=True)), [], 0
            types = [kind, pa.int32(), pa.string(), _LOSS, _ATTACHED, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, turn, role, content, starts, ends, types, refs, expands, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, piece = (conv,), 0
                elif at >= piece_chars:
                    close()
                    piece += 1
                if held >= piece_chars and done:
                    yield flushed(kind)
                head = f"{TURN}{role}{TEXT}"
                first = at + len(head)
                if role in loss:
                    spans += [{"start": first + a, "end": first + b} for a, b in zip(starts, ends, strict=True)]
                if types:
                    places = _gaps(content, starts, ends)
                    attached += [{"type": t, "ref": r, "turn": turn, "start": first + p, "tokens": e} for t, r, p, e in zip(types, refs, places, expands, strict=True)]
                texts += [head, content, END]
                at, turns, total = first + len(content) + len(END), turns + 1, total + n
        if now is not None:
            close()
            yield flushed(kind)

    names = ["conv_id", "piece", "formatted", "loss", "attachments", "n_turns", "n_tokens"]
    return laid.mapInArrow(run, f"conv_id {key}, {FORMATTED}")


def _gaps(content: str, starts: list[int], ends: list[int]) -> list[int]:
    """Where placeholders stand: outside the spans of texts."""
    out, at = [], 0
    for a, b in zip([*starts, len(content)], [*ends, len(content)], strict=True):
        out += [at + m.start() for m in _MARK.finditer(content[at:a])]
        at = b
    return out


def parse(formatted: str, attachments: Iterable[dict] = ()) -> list[tuple[str, list[dict]]]:
    """(role, parts) of each turn, read back from a formatted conversation: texts unescaped, other parts with their type, ref and tokens."""
    attachments, out = iter(attachments), []
    for turn in formatted.split(END)[:-1]:
        role, content = turn.removeprefix(TURN).split(TEXT, 1)
        parts, at = [], 0
        for m in _MARK.finditer(content):
            if m.start() > at:
                parts.append({"type": "text", "text": unescape(content[at : m.start()])})
            parts.append({"type": m[1]} | {k: v for k, v in next(attachments, {}).items() if k in ("ref", "tokens")})
            at = m.end()
        if at < len(content):
            parts.append({"type": "text", "text": unescape(content[at:])})
        out.append((unescape(role), parts))
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """For each conversation of format_chat(), read back from its formatted text and loss mask: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_attachments.

    Pieces of a conversation have to follow each other, as format_chat() gives them."""
    key = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row() -> tuple:
            conv, n, turns, chars, loss, size, tokens, attached = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, tokens, attached

        for batch in batches:
            rows = []
            for conv, piece, text, loss, attached, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece == 0:
                    if state:
                        rows.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, parts in parse(text):
                    state[1] += 1
                    state[2].update("".join([role, "\n", *(p["text"] for p in parts if p["type"] == "text"), "\n"]).encode())
                for span in loss:
                    learned = unescape(text[span["start"] : span["end"]])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(text)
                state[6] += tokens
                state[7] += len(attached)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(batch), strict=True)], names=names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), types(batch), strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_attachments"]
    types = lambda batch: [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return formatted.select("conv_id", "piece", "formatted", "loss", "attachments", "n_tokens").mapInArrow(run, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_attachments long")
