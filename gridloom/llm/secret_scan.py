"""Secret detection: keywords first, anchored expressions next, checksums last.

An Aho-Corasick automaton finds keywords (in either case) in one pass over a
text. Only where a keyword begins, or in the words near one, is an expression
tried, anchored there; a private key's span runs to its END line. The strict hex
pattern, which has no keyword, is the one that reads the whole text. Formats with a checksum of their own (access tokens that end in a CRC-32
in base 62, keys in Base58Check, signed web tokens) must pass it.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, map_text

#: Kinds of the contract in their order, then those of the method.
KINDS = ("assign", "access", "hex", "checked_token", "web_token", "wallet_key", "private_key")
_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_WEB = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_WALLET = re.compile(rb"[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])")
_BEGIN = re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_END = re.compile(rb"-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_BODY = re.compile(rb"[A-Za-z0-9+/=\s:,-]*+")
_SHORT_BODY = re.compile(rb"[A-Za-z0-9+/=\s]*+")
_WEB_RUN = re.compile(rb"[A-Za-z0-9_-]*+")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
#: How far from a keyword a wallet key may begin.
NEAR = 200
_WORD58 = re.compile(rb"[1-9A-HJ-NP-Za-km-z]+")
#: Keyword (lower case) -> kind whose expression is tried where the keyword begins.
_KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "checked_token"), "eyj": "web_token", "-----begin": "begin", "-----end": "end",
    **dict.fromkeys(("key", "wallet", "bitcoin", "btc", "wif", "private", "privkey", "import"), "wallet_key"),
}


def _crc62_ok(m: re.Match) -> bool:
    n = 0
    for c in m[2]:
        n = n * 62 + _BASE62.index(c)
    return n == zlib.crc32(m[1])


def _web_ok(m: re.Match) -> bool:
    head = m[0].split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _wallet_ok(m: re.Match) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes(40, "big").lstrip(b"\0")
    return len(raw) in (37, 38) and raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


#: Kind -> (expression, what a match must pass).
_RULES = {
    "assign": (_ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (_ACCESS, lambda m: len(m[0]) >= 16),
    "checked_token": (_CHECKED, _crc62_ok),
    "web_token": (_WEB, _web_ok),
}


def _automaton() -> ahocorasick.Automaton:
    words = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def find_secrets(text: bytes, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, unordered. Matches of a kind don't overlap, leftmost first; one that fails its check still uses up its place.

    Each part of a text is read a fixed number of times, whatever stands in it."""
    found, last, near, marks = [], {}, [], {"begin": [], "end": []}
    for end, (length, kind) in words.iter(text.lower().decode("latin-1")):  # bytes.lower() keeps all places
        start = end - length + 1
        if kind == "wallet_key":
            near.append(start)
            continue
        if kind in marks:
            if m := (_BEGIN if kind == "begin" else _END).match(text, start):
                marks[kind].append(m)
            continue
        if start < last.get(kind, 0):
            continue
        rule, good = _RULES[kind]
        if m := rule.match(text, start):
            last[kind] = m.end()
            if good(m):
                found.append((kind, m.start(), m.end()))
        elif kind == "web_token":  # nor does one begin later in this run
            last[kind] = _WEB_RUN.match(text, start).end()
    found += _private_keys(text, **marks)
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    done = 0
    for at in near:  # in order
        for w in _WORD58.finditer(text, max(done, at - NEAR), min(len(text), at + NEAR + 52)):
            done = max(done, w.start() + 1)
            if 51 <= len(w[0]) <= 52 and (w.start() == 0 or not _WORD58.match(text, w.start() - 1)) and (m := _WALLET.match(text, w.start())) and _wallet_ok(m):
                found.append(("wallet_key", m.start(), m.end()))
    return found


def _private_keys(text: bytes, begin: list[re.Match], end: list[re.Match]) -> list[tuple[str, int, int]]:
    """From each BEGIN line to the END line of the same label before the next BEGIN, with nothing but a key's characters between, or else to the end of what may be one."""
    found, k = [], 0
    for i, b in enumerate(begin):
        limit = begin[i + 1].start() if i + 1 < len(begin) else len(text)
        while k < len(end) and end[k].start() < b.end():
            k += 1
        j = k
        while j < len(end) and end[j].start() < limit and end[j][1] != b[1]:
            j += 1
        if j < len(end) and end[j].start() < limit and _BODY.match(text, b.end(), end[j].start()).end() == end[j].start():
            found.append(("private_key", b.start(), end[j].end()))
        else:
            found.append(("private_key", b.start(), _SHORT_BODY.match(text, b.end(), limit).end()))
    return found


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in each whole text.

    Returns doc_id, n_assign, n_access, n_hex, and the spans as strings of
    kind:start:end, comma-joined, by start and then kind in the order of KINDS
    (code points, end exclusive): base_spans has the first three kinds, spans
    all. Spans of different kinds may overlap.

    A null text is empty and has none. Repeated rows give repeated rows; an
    empty table gives none; other columns are ignored. All of a text is read."""
    words = None

    def scan(text: bytes):
        nonlocal words
        words = words or _automaton()  # once in each Python worker
        found = find_secrets(text, words)
        if not found:
            return 0, 0, 0, "", ""
        if not text.isascii():
            at = code_points(text, {x for _, a, b in found for x in (a, b)})
            found = [(k, at[a], at[b]) for k, a, b in found]
        found.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        n = [sum(k == kind for k, _, _ in found) for kind in KINDS[:3]]
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        return *n, say(x for x in found if x[0] in KINDS[:3]), say(found)

    return map_text(docs, scan, "n_assign long, n_access long, n_hex long, base_spans string, spans string")


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: a hash in place of the base spans."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")
