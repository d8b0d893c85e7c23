"""Plain versions of the contracts, for whole small tables."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    good = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m.group().split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 8 <= len(digits(m)) <= 15),
    }
    found = {k: [(m.start(), m.end()) for m in rx.finditer(text) if ok(m)] for k, (rx, ok) in good.items()}
    return *(len(v) for v in found.values()), sha(",".join(f"{k}:{a}:{b}" for k, v in found.items() for a, b in v)), found


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if len(m.group()) >= 32]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], order.index(x[0])))
    return *(sum(k == o for k, _, _ in found) for o in order), sha(",".join(f"{k}:{a}:{b}" for k, a, b in found)), found


def licenses(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({k for _, k in places}))


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n


def lines(docs, min_chars=40, min_docs=5):
    """docs: {doc_id: text}. doc_id -> (n_lines, n_dropped, kept)"""
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for d, t in docs.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in docs.items():
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == d]
        out[d] = len(own), len(own) - len(kept), "\n".join(kept)
    return out
