"""Personal data: generators propose spans, boosted trees judge them, by Spark columns alone.

Four strict patterns give the base spans. Wider generators propose further,
overlapping candidates: addresses with a spelled-out at, spaced, bracketed or
spelled-out dots, other separators, 00 for the plus, national numbers. Each gets
features of its format (digits, separators, checksums, dates, address parts) and
of its context (what stands before and after it, words that announce its kind or
another one). Boosted trees tell true candidates from others and are compiled
into column expressions.

What they learn isn't the strict patterns: base spans of a bounded sample are
rewritten in forms that no strict pattern matches, and are true. False are those
rewritten with a wrong checksum or out of range, numbers of other kinds (dates,
versions, sections, book and order numbers, amounts), and candidates of the
texts as they stand whose digits can't be of their kind. Either stand in the
same surroundings, with words before them that fit or don't. A quarter of the
documents calibrates a threshold for each kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees

KINDS = ("email", "ip", "card", "phone")

#: The base patterns (fixed values). A match begins at the edge of a run of its first class or where the last match ended,
#: as it would anyway; saying so keeps the search linear in long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider generators, for the same kinds.
GENERATORS = {
    "email": r"(?:\G|(?<![\w.%+-]))[\w.%+-]{1,64}(?:\x20?@\x20?|\x20?[(\[{<](?i:at)[)\]}>]\x20?|\x20(?i:at)\x20)[\w-]{1,64}(?:(?:\.|\x20?[(\[{<](?i:dot)[)\]}>]\x20?|\x20(?i:dot)\x20)[\w-]{1,64}){1,8}",
    "ip": r"(?:\G|(?<![0-9.]))[0-9]{1,3}(?:(?:\x20?\.\x20?|\x20?[(\[{<](?:\.|(?i:dot))[)\]}>]\x20?|\x20(?i:dot)\x20)[0-9]{1,3}){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9]{4}(?:[\x20./_-]{0,3}[0-9]{2,4}){2,5}",
    "phone": r"(?:\G|(?<![0-9]))(?:\+|00|\(|0(?=[1-9])|(?=[0-9]{3}[\x20./-][0-9]{3}[\x20./-][0-9]{4}))\x20?[0-9][\x20().0-9/-]{5,22}[0-9]",
}
#: What a text must hold for a pattern, or a generator, to match: cheap tests.
_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_NEEDS_WIDE = {
    "email": r"@|[(\[{<](?i:at)[)\]}>]|\x20(?i:at)\x20[\w-]{1,64}(?:\.[\w-]|\x20?[(\[{<](?i:dot)[)\]}>]|\x20(?i:dot)\x20)",
    "ip": r"[0-9](?:\x20?\.\x20?|\x20?[(\[{<](?:\.|(?i:dot))[)\]}>]\x20?|\x20(?i:dot)\x20)[0-9]",
    "card": r"[0-9]{4}[\x20./_-]{0,3}[0-9]{2}", "phone": r"(?:\+|00|\()\x20?[0-9]|0[1-9]|[0-9]{3}[\x20./-][0-9]{3}[\x20./-][0-9]{4}",
}
#: Words that announce a kind (fixed values), looked for in the 24 characters before a candidate.
CUES = {"email": "e-?mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|mastercard|amex", "phone": "phone|tel|call|fax|mobile|whatsapp|ring"}
#: Words that announce a number of another kind.
OTHER_CUES = r"version|release|build|\bv\b|section|chapter|figure|table|clause|page|part|isbn|issn|ean|order|invoice|ref|serial|model|batch|account|dated?\b|year|score|price|look|meet|arrive|sold|bought"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_ANY = rf"[0-9]|{_NEEDS_WIDE['email']}"  # no pattern or generator matches without one of these
_SPAN = "array<struct<s:int,e:int,m:string>>"
_CANDIDATE = "array<struct<s:int,c:int,e:int,kind:string,m:string,before:string,after:string>>"
_SNIPPET = "array<struct<text:string,label:int,planted:string>>"
_BEFORE = 24  # characters of context before a candidate
FEATURES = ("digits", "letters", "length", "separators", "at", "dots", "plus", "zeros", "luhn", "octets", "groups", "last_letters", "cue", "other_cue", "dated", "spelled", "bracketed", "word_at", "name_marks", "ean", "most", "fours", "after_word", "before_word")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Each element combined with all before it, by doubling: n log n steps, where appending to an array would take n * n."""

    def double(v: Column, k: Column) -> Column:
        by = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(v, lambda e, i: F.when(i >= by, combine(F.get(v, i - by), e)).otherwise(e))

    def levels(v: Column) -> Column:
        return F.when(F.size(v) > 1, F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)).otherwise(F.array().cast("array<int>"))

    return _let(values, lambda v: F.aggregate(levels(v), v, double))


def _pieces(text: Column, pattern: str) -> Column:
    """(gap, hit): what stands before each leftmost non-overlapping match, and the match; the last gap has none."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))


def _ends(pieces: Column, length: Callable[[Column], Column] = F.length) -> Column:
    """Where each hit ends, in code points."""
    return _running(F.transform(pieces, lambda p: F.length(p["gap"]) + F.coalesce(length(p["hit"]), F.lit(0))), lambda a, b: a + b)


def spans(text: Column, pattern: str, context: bool = False) -> Column:
    """(s, e, m) of the leftmost non-overlapping matches, in code points; context adds the characters before (up to the last match) and the one after."""

    def placed(p: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            end = F.get(ends, i)
            around = [F.right(x["gap"], F.lit(_BEFORE)).alias("before"), F.left(F.get(p, i + 1)["gap"], F.lit(1)).alias("after")] if context else []
            return F.struct((end - F.length(x["hit"])).alias("s"), end.alias("e"), x["hit"].alias("m"), *around)

        return F.transform(F.slice(p, F.lit(1), F.size(p) - 1), span)

    return _let(_pieces(text, pattern), lambda p: _let(_ends(p), lambda ends: placed(p, ends)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.when(F.length(digits) > 0, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def _ean(digits: Column) -> Column:
    """Whether the last thirteen digits are a book or article number, by their check digit."""
    last = F.right(digits, F.lit(13))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda t, i: t + F.substring(last, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(F.length(digits) >= 13, total % 10 == 0).otherwise(F.lit(False))


def _dotted(match: Column) -> Column:
    """Digits and dots alone, spelled-out dots as dots."""
    return F.regexp_replace(F.regexp_replace(match, "(?i)dot", "."), r"[^0-9.]", "")


def _octets(match: Column) -> Column:
    return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def _could_be(kind: str, match: Column) -> Column:
    """Whether a candidate's digits allow its kind, however they are written."""
    digits = _digits(match)
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(digits, "^00", "")).between(8, 15)
    return _octets(_dotted(match)) if kind == "ip" else F.lit(True)


#: Kind -> what a match of its pattern must pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def _features(x: Column) -> list[Column]:
    """FEATURES of one candidate (kind, m, before, after), then the number of its kind, all INT."""
    m, kind = x["m"], x["kind"]
    digits = _digits(m)
    count = lambda rest: F.length(F.regexp_replace(m, rest, ""))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, F.lower(x["before"]).rlike(words)).otherwise(cue)
    octets = F.filter(F.split(m, "[^0-9]+"), lambda v: v != "")
    name = F.split(m, r"(?i)\x20?(?:@|[(\[{<]at[)\]}>]|\x20at\x20)", 2)
    out = [
        F.length(digits), count("[^A-Za-z]"), F.when(kind == "email", F.length(m)).otherwise(0), F.when(kind.isin("card", "phone"), count(r"[^\x20()./_-]")).otherwise(count(r"[^\x20/_-]")), m.contains("@"), F.when(kind.isin("card", "phone"), 0).otherwise(count("[^.]")), m.startswith("+"), m.startswith("00"),
        F.length(digits).between(16, 19) & luhn(digits), _octets(_dotted(m)), F.size(F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+", -1)), F.length(F.regexp_extract(m, "[A-Za-z]*$", 0)),
        cue, F.lower(x["before"]).rlike(OTHER_CUES), m.rlike(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])|(?<![0-9])[0-3]?[0-9][./-][01]?[0-9][./-][0-9]{2,4}(?![0-9])"),
        F.size(F.split(m, r"(?i)\x20dot\x20|[(\[{<]dot[)\]}>]")) - 1, m.rlike(r"[\[{(<](?:\.|(?i:dot|at))[\]})>]"), m.rlike(r"(?i)\x20at\x20"), F.get(name, F.lit(0)).rlike(r"[._%+0-9-]"), _ean(digits), F.coalesce(F.array_max(F.transform(octets, F.length)), F.lit(0)), (F.size(octets) >= 4) & F.forall(octets, lambda v: F.length(v) == 4),
        x["after"].rlike(r"[\w@]"), x["before"].rlike(r"[\w@.]$"), F.array_position(F.array(*map(F.lit, KINDS)), kind),
    ]
    return [F.coalesce(c.cast("int"), F.lit(0)) for c in out]


def _laid_out(docs: DataFrame) -> DataFrame:
    """row, t, base (a struct with the base spans of each kind) and free: the candidates (s, c, e, kind, m, before, after) that touch no base span, by place."""
    row = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    some = row.select("row", "t", F.col("t").rlike(_ANY).alias("some"))
    t, some_ = F.col("t"), F.col("some")

    def base(k: str) -> Column:
        hits = F.when(some_ & t.rlike(_NEEDS[k]), spans(t, PATTERNS[k])).otherwise(F.array().cast(_SPAN))
        return F.filter(hits, lambda x: CHECKS[k](x["m"])).alias(k)

    def wide(k: str) -> Column:
        marked = F.transform(spans(t, GENERATORS[k], True), lambda x: F.struct(x["s"], F.lit(1).alias("c"), x["e"], F.lit(k).alias("kind"), x["m"], x["before"], x["after"]))
        return F.when(some_ & t.rlike(_NEEDS_WIDE[k]), marked).otherwise(F.array().cast(_CANDIDATE))

    raw = some.select("row", "t", F.struct(*map(base, KINDS)).alias("base"), F.concat(*map(wide, KINDS)).alias("wide"))
    taken = F.concat(*(F.transform(f"base.{k}", lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("c"), x["e"].alias("e"), *(F.lit("").alias(n) for n in ("kind", "m", "before", "after")))) for k in KINDS))

    def untouched(marks: Column) -> Column:
        """By place, a candidate is free if all base spans that begin before it have ended, and the next one begins after it."""
        ended = _running(F.transform(marks, lambda x: F.when(x["c"] == 0, x["e"]).otherwise(0)), F.greatest)
        begins = _running(F.transform(F.reverse(marks), lambda x: F.when(x["c"] == 0, x["s"]).otherwise(2**31 - 1)), F.least)
        kept = lambda e, n: F.filter(marks, lambda x, i: (x["c"] == 1) & (F.get(e, i) <= x["s"]) & (F.get(n, F.size(n) - 1 - i) >= x["e"]))
        return _let(ended, lambda e: _let(begins, lambda n: kept(e, n)))

    free = F.when(F.size("wide") == 0, F.col("wide")).otherwise(_let(F.array_sort(F.concat(taken, F.col("wide"))), untouched))
    return raw.select("row", "t", "base", free.alias("free"))


@dataclass(frozen=True)
class Judge:
    """The log odds of a candidate are start + the sum of the trees; at or above its kind's threshold it is selected."""

    start: float
    ensemble: tuple
    thresholds: dict[str, float]

    def selects(self, x: Column) -> Column:
        able = [k for k in KINDS if np.isfinite(self.thresholds.get(k, np.inf))]
        if not self.ensemble or not able:
            return F.lit(False)

        def judged(values: Column) -> Column:
            features = [F.get(values, F.lit(i)) for i in range(len(FEATURES) + 1)]
            odds = F.lit(self.start)
            for tree in self.ensemble:
                odds = odds + trees.to_column(tree, features)
            limit = F.lit(float("inf"))
            for k in able:
                limit = F.when(x["kind"] == k, F.lit(self.thresholds[k])).otherwise(limit)
            return odds >= limit

        return _let(F.array(*_features(x)), judged)


# --- Learning


def _draw(seed: int, most: int, *of: Column) -> Column:
    """A number from 0 to most - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(most))


def _rewritten(kind: str, m: Column) -> tuple[list[Column], list[Column]]:
    """A base span in forms that its strict pattern doesn't match, and others with what its kind can't have."""
    pick = lambda *forms: list(forms)
    digits = _digits(m)
    if kind == "email":
        name, host = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        label = F.substring_index(host, ".", 1)
        short = F.left(name, 2 + _draw(1, 6, m)), F.concat(F.left(label, 2 + _draw(2, 6, m)), F.substring(host, F.length(label) + 1, F.lit(99)))  # addresses of all lengths
        written = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("[at]", "."), (" at ", " dot "), (" AT ", " DOT "), (" @ ", "."), ("{at}", "{dot}"))
        true = [F.concat(who, F.lit(at), F.replace(where, F.lit("."), F.lit(dot))) for who, where in ((name, host), short) for at, dot in written]
        amount = F.concat((F.pmod(F.hash(m), F.lit(90)) + 2).cast("string"), F.lit(" (at) "), (F.pmod(F.crc32(m), F.lit(40)) + 1).cast("string"), F.lit(".50"))
        return true, [amount]
    if kind == "ip":
        forms = lambda x: pick(*(F.replace(x, F.lit("."), F.lit(by)) for by in (" . ", ". ", "[.]", "(.)", " dot ", "[dot]")))
        beyond = F.concat((F.pmod(F.hash(m), F.lit(700)) + 300).cast("string"), F.regexp_extract(m, r"\..*", 0))
        small = F.concat_ws(".", *((_draw(k, 10, m)).cast("string") for k in range(4)))  # only brackets and words tell these from a section's number
        return forms(m) + forms(small)[2:], forms(beyond)
    if kind == "card":
        forms = lambda x: pick(*(F.regexp_replace(x, r"([0-9]{4})(?=[0-9]{2})", f"$1{by}") for by in (".", "/", "_", "  ", " - ")))
        wrong = F.concat(F.left(digits, F.length(digits) - 1), F.pmod(F.right(digits, F.lit(1)).cast("int") + 1 + F.pmod(F.hash(m), F.lit(8)), F.lit(10)).cast("string"))
        return forms(digits), forms(wrong)
    rest = F.substring(m, 2, 100)
    inner = F.regexp_extract(m, r"(\([0-9]+\).*)", 1)
    slashes = lambda x: F.regexp_replace(x, r"[\x20().-]+", "/")
    ten = F.right(digits, F.lit(10))
    grouped = lambda by: F.when(F.length(digits) >= 10, F.concat(F.substring(ten, 1, 3), F.lit(by), F.substring(ten, 4, 3), F.lit(by), F.substring(ten, 7, 4)))

    def cut(k: int, first: str, groups: tuple[int, ...], by: str) -> Column:
        """Digits of the span and others, in groups after a first part, at least 8 with these: numbers of all lengths."""
        more, out = F.concat(digits, F.lpad(_draw(k, 10**6, m).cast("string"), 6, "7")), F.lit(first)
        begin = 2
        for n in groups:
            out, begin = F.concat(out, F.lit(by) if begin > 2 or first == "00" else F.lit(""), F.substring(more, begin, n)), begin + n
        return out

    styles = [(f, g, by) for f in ("0", "00") for g in ((3, 6), (2, 4, 4), (3, 3, 3), (3, 3, 4), (4, 6), (2, 2, 2, 2, 2)) for by in (" ", "-", "/", ".")]
    some = [cut(50 + k, *styles[k * 11 % len(styles)]) for k in range(8)]  # each with its own lengths and separators
    true = pick(F.concat(F.lit("00"), rest), F.when(F.length(_digits(inner)) >= 8, inner).otherwise(F.concat(F.lit("00"), rest)), F.concat(F.lit("+"), slashes(rest)), F.concat(F.lit("00"), digits), F.concat(F.lit("00 "), digits), grouped("-"), grouped("."), grouped(" "), *some)
    wrong = pick(F.concat(F.lit("00"), digits, digits), F.concat(F.lit("("), F.left(digits, F.lit(4)), F.lit(") "), F.substring(digits, 5, 3)), F.concat(F.lit("+"), slashes(F.concat(rest, F.lit("-"), F.left(digits, F.lit(8))))), F.concat(F.lit("00"), digits, F.left(digits, F.lit(7))))
    return [F.coalesce(x, F.concat(F.lit("00"), digits)) for x in true], wrong


def _others(kind: str, key: Column) -> list[Column]:
    """Numbers and phrases of other kinds that the generator of a kind proposes, drawn by key."""
    n = lambda seed, low, high: (_draw(seed, high - low, key) + low).cast("string")
    two = lambda seed, low, high: F.lpad(n(seed, low, high), 2, "0")
    word = lambda seed, *words: F.element_at(F.array(*map(F.lit, words)), (_draw(seed, len(words), key) + 1).cast("int"))
    date = F.concat(two(1, 1, 29), F.lit("."), two(2, 1, 13), F.lit("."), n(3, 1950, 2030))
    join = lambda by, *parts: F.concat_ws(by, *parts)
    if kind == "email":
        return [
            F.concat(word(1, "look", "meet", "arrive", "us", "prices", "it", "not", "sold"), F.lit(" at "), word(2, "example", "home", "noon", "shop", "news"), F.lit("."), word(3, "com", "Then", "The", "org", "But")),
            F.concat(n(4, 2, 90), word(5, " @ ", " at ", " (at) "), n(6, 1, 99), F.lit("."), two(7, 0, 99)), F.concat(word(8, "open", "back", "live", "stay"), F.lit(" @ "), word(9, "noon", "home", "work"), F.lit("."), word(10, "See", "We", "Then")),
            F.concat(word(11, "seen", "meet", "arrive"), F.lit(" at "), word(12, "the", "a", "each"), F.lit(" dot "), word(13, "on", "in", "of")),
        ]
    if kind == "ip":
        small = [n(i, 1, 13) for i in range(4)]
        return [join(" . ", *small), join(". ", *small), join(" . ", n(5, 1, 5), *small[:3])]
    if kind == "card":
        years = [n(i, 1950, 2030) for i in range(4)]
        return [join(" / ", *years), join("/", *years), join(".", *(F.rpad(n(i, 1, 10), 4, "0") for i in range(4))), F.concat(join(".", years[0], two(5, 1, 13), two(6, 1, 29)), F.lit(" - "), join(".", years[1], two(7, 1, 13), two(8, 1, 29))), join(" _ ", *(n(20 + i, 1000, 9999) for i in range(3)))]
    isbn = F.concat(F.lit("97"), n(1, 8, 10), n(2, 100_000_000, 999_999_999))
    check = F.pmod(F.lit(10) - F.pmod(F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda t, i: t + F.substring(isbn, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(10)), F.lit(10)).cast("string")
    return [
        date, F.concat(two(4, 1, 10), F.lit("/"), two(5, 1, 13), F.lit("/"), n(6, 1990, 2030)), F.concat(date, F.lit(" - "), date), F.concat(F.lit("00"), F.substring(isbn, 1, 12), check), F.concat(F.lit("0"), n(7, 1, 10), F.lit("-"), n(8, 1000, 9999), F.lit("-"), n(9, 1000, 9999), F.lit("-"), n(10, 0, 10)),
        F.concat(F.lit("("), n(11, 1, 20), F.lit(") "), n(12, 1990, 2030), F.lit("-"), two(13, 1, 13), F.lit("-"), two(14, 1, 29)), F.concat(F.lit("00"), n(15, 10, 99), F.lit(" "), two(16, 1, 13), F.lit(" "), two(17, 1, 29), F.lit(" "), n(18, 1990, 2030)), F.concat(two(19, 1, 10), F.lit("."), two(20, 10, 60), F.lit(" - "), two(21, 10, 24), F.lit("."), two(22, 10, 60)),
        F.concat(F.lit("000"), n(23, 10_000, 9_999_999)), F.concat(F.lit("("), n(24, 1990, 2030), F.lit("-"), n(25, 1990, 2030), F.lit(")"), F.lit(" "), n(26, 10, 99)),
    ]


#: Words that are put before examples (fixed values).
_SAID = {"email": ("email ", "contact: ", "write to "), "ip": ("ip ", "host ", "server at "), "card": ("card ", "visa: ", "credit card no "), "phone": ("call ", "tel. ", "phone: ")}
_SAID_OTHER = ("version ", "section ", "chapter ", "isbn ", "order ", "dated ", "invoice no. ", "serial ", "figure ", "price ")


def _announced(kind: str, label: int, key: Column) -> Column:
    """What is put before an example: nothing for half of them, else for true ones a word of their kind, for others one of another kind, or now and then of this one."""
    pick = lambda seed, words: F.element_at(F.array(*map(F.lit, words)), (_draw(seed, len(words), key) + 1).cast("int"))
    part = _draw(31, 10, key)
    fits, other = pick(32, _SAID[kind]), pick(33, _SAID_OTHER)
    return F.when(part < 5, "").otherwise(fits) if label else F.when(part < 4, "").when(part < 9, other).otherwise(fits)


def _snippets(kind: str) -> Callable[[Column], Column]:
    """From the pieces of a text: each base span in all its other forms, with what stands around it."""

    def all_of(p: Column) -> Column:
        def made(x: Column, i: Column) -> Column:
            before, after = F.right(x["gap"], F.lit(2 * _BEFORE)), F.left(F.get(p, i + 1)["gap"], F.lit(2 * _BEFORE))
            true, wrong = _rewritten(kind, x["hit"])
            key = F.concat(x["hit"], before)
            times = 3 if kind == "email" else 1  # about as many false as true ones
            all_ = [(1, new) for new in true] + [(0, new) for new in (*wrong, *(o for k in range(times) for o in _others(kind, F.concat(key, F.lit(str(k))))))]
            # As they stand the surroundings announce the base span; every other example has them without the last words, and words of its own.
            cut = F.regexp_replace(before, r"\S*\s*$", "")
            forms = []
            for n, (label, new) in enumerate(all_):
                plain = F.concat(cut, F.lit(" "), _announced(kind, label, F.concat(key, F.lit(str(n)))))
                around = F.when(_draw(40 + n, 2, key) == 0, before).otherwise(plain) if label else plain
                forms.append(F.struct(F.concat(around, new, F.when(after.rlike("^[^\\w.@-]"), after).otherwise(F.concat(F.lit(" "), after))).alias("text"), F.lit(label).alias("label"), new.alias("planted")))
            return F.when(CHECKS[kind](x["hit"]), F.array(*forms)).otherwise(F.array().cast(_SNIPPET))

        return F.flatten(F.transform(F.slice(p, F.lit(1), F.size(p) - 1), made))

    return all_of


def examples(docs: DataFrame) -> DataFrame:
    """(doc_id, label, kind, m, features): candidates of docs, and of their base spans rewritten with what stands around them.

    Label 1: a base span in another form, found whole. Label 0: one with what its
    kind can't have, or a candidate of a text as it stands that can't be of its
    kind by its digits; other candidates of such a text may be true and are left out."""
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = [texts.select("doc_id", "text", F.lit(None).cast("string").alias("edited"), F.lit(-1).alias("label"), F.lit("").alias("planted"))]
    for kind in KINDS:
        own = texts.where(F.col("text").rlike(_NEEDS[kind])).select("doc_id", F.explode(_let(_pieces(F.col("text"), PATTERNS[kind]), _snippets(kind))).alias("x"))
        parts.append(own.select("doc_id", "x.text", F.lit(kind).alias("edited"), "x.label", "x.planted"))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    found = _laid_out(both).select("row.*", F.explode("free").alias("x"))
    could = F.lit(False)
    for k in KINDS:
        could = F.when(F.col("x.kind") == k, _could_be(k, F.col("x.m"))).otherwise(could)
    label = F.when(F.col("label") == -1, F.when(~could, 0)).when((F.col("edited") == F.col("x.kind")) & (F.col("planted") == F.col("x.m")), F.col("label"))
    labelled = found.select("doc_id", label.alias("label"), F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), F.array(*_features(F.col("x"))).alias("features"))
    return labelled.where("label IS NOT NULL")


def learn(docs: DataFrame, sample_docs: int = 2000, sample_candidates: int = 20_000, precision: float = 0.95, least: int = 5) -> Judge:
    """Fit on the examples of at most sample_docs documents (those with the smallest hash of doc_id among texts with a digit or @), at most sample_candidates of them (those with the smallest hashes).

    A quarter of the documents is left out of the fit and calibrates the
    thresholds: of those with that precision over at least so many true ones,
    the one of the best F-score, halfway down to the next candidate; a kind
    that can't reach it adds nothing. Null ids and texts are not
    learned from; of several texts with one doc_id, the first in order is. With
    no examples of both labels no candidate is ever selected."""
    some = docs.where(F.col("text").rlike(_ANY) & F.col("doc_id").isNotNull())
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = some.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most sample_docs ids
    chosen = examples(sample).orderBy(F.xxhash64("doc_id", "kind", "m", "label"), "doc_id", "kind", "m", "label", "features").limit(sample_candidates)
    rows = chosen.select("label", "features", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)).alias("part")).collect()
    data = np.array([[r["part"], r["label"], *r["features"]] for r in rows], float).reshape(-1, len(FEATURES) + 3)
    held, y, x = data[:, 0] == 0, data[:, 1], data[:, 2:]
    start, ensemble = trees.boost(x[~held], y[~held], n_trees=48, depth=4)
    odds = start + sum((trees.apply(t, x[held]) for t in ensemble), np.zeros(held.sum()))
    thresholds = {}
    for i, kind in enumerate(KINDS):
        own = x[held, -1] == i + 1
        o, t = odds[own], y[held][own]
        good = []
        for v in np.unique(o):
            hits = t[o >= v].sum()
            if t[o >= v].mean() >= precision and hits >= least:
                good.append((2 * hits / ((o >= v).sum() + t.sum()), v))
        if good:
            best = max(good)[1]
            below = o[o < best]
            thresholds[kind] = float((best + below.max()) / 2 if len(below) else best - 1)
        else:
            thresholds[kind] = float("inf")
    return Judge(start, tuple(ensemble), thresholds)


def find_pii(docs: DataFrame, judge: Judge) -> DataFrame:
    """row (all columns of docs), base and all: structs with the spans (s, e, m) of each kind, in code points, end exclusive, by place.

    base has the strict patterns' matches that pass their checks, all those and
    the judge's additions (which touch no base span of any kind). A null text is
    empty and has none. Repeated rows are searched each; an empty table gives an
    empty result. Time grows with the length of a text and n log n with its n
    matches."""
    laid = _laid_out(docs).select("row", "base", F.filter("free", judge.selects).alias("more"))
    added = lambda k: F.transform(F.filter("more", lambda x: x["kind"] == k), lambda x: F.struct(x["s"], x["e"], x["m"]))
    everything = [F.array_sort(F.concat(F.col(f"base.{k}"), added(k))).alias(k) for k in KINDS]
    return laid.select("row", "base", F.struct(*everything).alias("all"))


def spelled(spans_of: str) -> Column:
    """The spans of a struct as kind:start:end, by kind and place, comma-joined."""
    named = lambda k: F.transform(f"{spans_of}.{k}", lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    return F.array_join(F.concat(*map(named, KINDS)), ",")


def redact(docs: DataFrame, judge: Judge) -> DataFrame:
    """docs with the spans of all kinds replaced by [kind] in text; of overlapping spans the one that begins first, and of those the longest, is replaced.

    A null text comes out as "". Repeated rows stay, an empty table gives an empty
    one, and other columns pass through whatever their names."""
    found = find_pii(docs, judge)
    mark = lambda k: F.transform(f"all.{k}", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(k).alias("kind")))
    marks = F.array_sort(F.concat(*map(mark, KINDS)))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    # A span that begins inside one before it goes with that one.
    outer = lambda x, i, ends: (i == 0) | (x["s"] >= F.get(ends, i - 1))
    kept = _let(marks, lambda v: _let(_running(F.transform(v, lambda x: -x["ne"]), F.greatest), lambda ends: F.filter(v, lambda x, i: outer(x, i, ends))))
    begin = lambda v, i: F.when(i == 0, 0).otherwise(-F.get(v, i - 1)["ne"])
    chunk = lambda a, b: F.substring(text, a + 1, b - a)
    pieces = lambda v: F.transform(v, lambda x, i: F.concat(chunk(begin(v, i), x["s"]), F.lit("["), x["kind"], F.lit("]")))
    tail = lambda v: F.substring(text, F.coalesce(-F.get(v, F.size(v) - 1)["ne"], F.lit(0)) + 1, F.length(text))
    new = _let(kept, lambda v: F.concat(F.array_join(pieces(v), ""), tail(v)))
    return found.select("row", new.alias("new")).select(*(F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
