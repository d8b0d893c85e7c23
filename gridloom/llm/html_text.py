"""Main text of web pages by two passes of rules over blocks.

A page is cut into tags and text; text between block tags is a block, with the
characters of it that lie in links and what encloses it. Pass one decides
blocks: those in menus, footers, adverts, comments and the like, or made of
links, are boilerplate; long ones with enough stop words are content. Short or
otherwise ambiguous blocks take, in pass two, the label of the nearest decided
block around them. Inside an article element, what isn't boilerplate by what
encloses it is content, but for lists and tables of links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, utf8
from .text_stats import STOP_WORDS

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")

# Kinds of elements, and words in class, id or role that mark what isn't the article.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
RAW = frozenset("script style textarea title xmp noframes".split())
HIDDEN = frozenset("script style textarea title head noscript template svg math iframe object canvas video audio map select button datalist noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form dialog menu".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs footer share sharing social related recommended recommendations comment comments discussion replies respond disqus widget pagination pager "
    "toolbar masthead contentinfo complementary search copyright".split()
)
#: Of these, those that don't mark the layout of a page around its article, but other texts.
OTHER_TEXTS = frozenset("comment comments discussion replies respond disqus related recommended recommendations sponsored promo promotion ad ads advert adverts advertisement advertising".split())
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
_STOP = frozenset(STOP_WORDS)


@dataclass
class Block:
    text: str
    links: int  # characters in links
    boilerplate: bool  # by what encloses it
    article: bool  # inside article or main
    heading: bool
    listed: bool  # in a list or table
    label: bool | None = None


@dataclass(frozen=True)
class Rules:
    """Lengths in characters; densities as shares."""

    long_chars: int = 70
    stop_density: float = 0.08
    link_density: float = 0.5


def _marks(tag: str, attributes: str, article: bool) -> tuple[int, bool]:
    """What an element encloses: 0 content, 1 boilerplate unless an article begins inside, 2 boilerplate; and whether it is hidden."""
    boilerplate, hidden = 2 * (tag in BOILERPLATE_TAGS or (tag == "header" and not article)), tag in HIDDEN
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _NAME.findall(value)}
                if tag in ("article", "section") and words & (OTHER_TEXTS - {"ads"}) or tag not in ("html", "body", "main", "article") and words & OTHER_TEXTS:
                    boilerplate = 2
                elif tag not in ("html", "body", "main", "article") and (words & BOILERPLATE_NAMES or ("header" in words and not article and tag not in HEADINGS)):
                    boilerplate = max(boilerplate, 1)
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = True
    return boilerplate, hidden


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, without empty ones. Tags that aren't closed end where HTML lets them."""
    out: list[Block] = []
    stack: list[tuple] = []  # tag, boilerplate, hidden, article, link, heading, listed
    open_at: dict[str, list[int]] = {}  # where each tag's open elements are in the stack
    outside = state = ("", 0, False, False, False, False, False)
    parts: list[str] = []
    links, first, begun = 0, state, False

    def end_block() -> None:
        nonlocal parts, links, begun
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, links, bool(first[1]), first[3], first[5], first[6]))
        parts, links, begun = [], 0, False

    def say(text: str) -> None:
        nonlocal links, first, begun
        if state[2] or not text:
            return
        text = html.unescape(text)
        if not begun and text.strip():  # what encloses the first character counts
            first, begun = state, True
        parts.append(text)
        if state[4]:
            links += len("".join(text.split()))

    def close(tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        nonlocal state
        last = max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)
        if last < 0 or any(open_at[t][-1] > last for t in stop if open_at.get(t)):
            return
        for element in stack[last:]:
            open_at[element[0]].pop()
        del stack[last:]
        state = stack[-1] if stack else outside

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in BLOCKS or tag in HIDDEN:
                end_block()
            close({tag})
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW:  # its content has no tags; without an end tag, it is all that follows
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in ("td", "th"):
            say(" ")
        if tag in BLOCKS:
            end_block()
            close({"p"}, frozenset(("div", "article", "section", "body", "td", "th", "button")))
            if tag in _IMPLIED_END:
                close(_IMPLIED_END[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        if tag == "body":
            close({"head"})
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        boilerplate, hidden = _marks(tag, attributes, state[3])
        opens = tag in ("article", "main")
        around = 0 if opens and state[1] == 1 else state[1]
        state = (tag, max(around, boilerplate), state[2] or hidden, state[3] or opens, state[4] or tag == "a", state[5] or tag in HEADINGS, tag not in ("article", "main") and (state[6] or tag in LISTS))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(state)
    end_block()
    return out


def decide(found: list[Block], rules: Rules = Rules()) -> None:
    """Set the labels (True: content)."""
    article = any(b.article and not b.boilerplate for b in found)
    for b in found:
        if b.boilerplate or (article and not b.article):
            b.label = False
    inside = [b for b in found if b.label is None]
    for b in inside:
        n = len(b.text)
        if b.article and not b.listed:
            b.label = True
        elif b.links > rules.link_density * len(b.text.replace(" ", "")):
            b.label = False
        elif n >= rules.long_chars:
            words = _WORD.findall(b.text.lower())
            if words and sum(w in _STOP for w in words) >= rules.stop_density * len(words):
                b.label = True
    decided = [b.label for b in inside]
    before: list[tuple[int, bool] | None] = []
    last = None
    for i, label in enumerate(decided):
        last = last if label is None else (i, label)
        before.append(last)
    after = None
    for i in range(len(inside) - 1, -1, -1):
        if decided[i] is not None:
            after = (i, decided[i])
            continue
        a, z = before[i], after
        if a and z and a[1] != z[1]:
            near_after = inside[i].heading or z[0] - i < i - a[0] or (z[0] - i == i - a[0] and z[1])
            inside[i].label = z[1] if near_after else a[1]
        else:
            # Between equal neighbours, theirs; inside an article with no decided block, or none that is content, content.
            label = (a or z or (0, True))[1]
            inside[i].label = label or (inside[i].article and not any(decided))


def main_text(page: str, rules: Rules = Rules()) -> str:
    found = blocks(page)
    decide(found, rules)
    return "\n\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text (the article's blocks, joined by an empty line) and n_chars.

    A null or empty page has the text "" and 0 characters. Repeated rows are
    extracted each; an empty table gives an empty result; other columns are
    ignored. All of a page is read, and no block of the article is dropped for
    its length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((x or b"").decode(), rules) for x in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    key, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {key}, url {url}, text string, n_chars long")
