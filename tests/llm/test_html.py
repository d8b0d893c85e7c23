import html as escapes
import re

import edges
import pytest
from compare import DATA
from gridloom.llm import html_text, queries


def test_generated_pages(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()}
    out = queries.op3_html_text(spark, f"{DATA}/sf0.01").collect()
    assert len(out) == len(pages)
    for r in out:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        blocks = [" ".join(escapes.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|br)>", " ", article))]
        assert r["text"] == "\n\n".join(x for x in blocks if x)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


GOOD = "this is the text of a paragraph and it goes on with all of the words that one would have in it"


def text(page):
    return html_text.main_text(page)


def test_what_is_left_out():
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice"><p>{GOOD}</p></div>
    <div class="main-content"><h2>Title</h2><p>{GOOD} one</p><p>short</p><ul><li><a href=x>a link</a></li></ul><p>{GOOD} two<br>three</p><!-- {GOOD} --></div>
    <aside><p>{GOOD}</p></aside><div class="sideBar widget"><p>{GOOD}</p></div><form><label>{GOOD}</label></form><section class="comments"><p>{GOOD}</p></section>
    <p hidden>{GOOD}</p><p style="display: none">{GOOD}</p><script>document.write("<p>{GOOD}</p>")</script><footer><p>{GOOD}</p></footer></body></html>"""
    assert text(page) == f"Title\n\n{GOOD} one\n\nshort\n\n{GOOD} two three"


def test_article_alone_counts():
    page = f"<p>{GOOD} outside</p><article><header><h1>Head</h1></header><p>x &amp;lt; y &eacute;&#x41;&nbsp; z<p>unknown zzz qqq www</p><div class='ad'>{GOOD}</div><p>end</article><p>{GOOD}"
    assert text(page) == "Head\n\nx &lt; y éA z\n\nunknown zzz qqq www\n\nend"


def test_names_of_the_layout_around_an_article():
    page = f"<div class='with-sidebar'><div class='sidebar'>{GOOD} menu</div><article class='post has-ads'><p>{GOOD}</p></article><div class='comments'><article><p>{GOOD} says one</p></article></div><article class='comment'>{GOOD} says two</article></div>"
    assert text(page) == GOOD


def test_unclosed_and_odd_markup():
    assert text(f"<p>{GOOD}<p>{GOOD} two") == f"{GOOD}\n\n{GOOD} two"
    assert text(f"<article>{GOOD} 1 < 2 <b>bold<p>more") == f"{GOOD} 1 < 2 bold\n\nmore"
    assert text("") == text("<html></html>") == text("<script>x") == text("<!-- never closed <p>x") == ""
    assert text(f'<article><p title="a > b">{GOOD}</p></article>') == GOOD
    assert text("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>") == "a b\n\nc"
    long = "<article>" + "<b>w </b>" * 50_000 + "</article>"
    assert text(long) == " ".join(["w"] * 50_000)
    assert text("<p>" * 50_000 + '<a b="' * 5000 + "<" * 100_000) is not None


def test_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", f"<p>{GOOD}"), (3, "w", f"<p>{GOOD}"), (3, "w", f"<p>{GOOD}")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "'x' AS n_chars")
    out = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()))
    assert out == [(0, GOOD, len(GOOD)), (1, "", 0), (2, "", 0), (3, GOOD, len(GOOD)), (3, GOOD, len(GOOD))]
    assert html_text.extract(pages.where("false")).collect() == []
    assert edges.TEXTS


ENGLISH = "It was the best of all the ways in which a person could go on with the work that they had to do, and so it went on."
RUSSIAN = "Длинный текст на языке, для которого нет списка частых слов, но который занимает в статье целый абзац, как и другие."


def test_an_article_keeps_all_that_it_says():
    page = f'<nav>Home</nav><article><p>{ENGLISH}</p><p><a href="x">Read the whole report of the commission here</a></p><p>{RUSSIAN}</p><p>More next week.</p><ul><li><a href="a">One</a></li><li><a href="b">Two</a></li></ul></article><footer>Imprint</footer>'
    assert html_text.main_text(page) == "\n\n".join([ENGLISH, "Read the whole report of the commission here", RUSSIAN, "More next week."])
    inside = f'<article><p>{ENGLISH}</p><div class="share"><p>{RUSSIAN}</p></div><aside><p>{ENGLISH}</p></aside><p>The end.</p></article>'
    assert html_text.main_text(inside) == f"{ENGLISH}\n\nThe end."


def seconds(make, n, repeat=3):
    import time

    took = []
    for _ in range(repeat):
        page, began = make(n), time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - began)
    return min(took)


@pytest.mark.parametrize(
    "make",
    [lambda n: "<b>" * n + "</i>" * n, lambda n: "<p><button>" + "<b>" * n + "<hr>" * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<ul>" + "<li><b>x" * n, lambda n: "<!" * n, lambda n: "<a href='" * n],
    ids=["unmatched ends", "rules over open elements", "deep", "items", "comments", "quotes"],
)
def test_time_grows_with_a_hostile_page(make):
    assert seconds(make, 40_000) < 12 * max(seconds(make, 4000), 0.005)
