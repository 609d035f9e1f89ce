import html
import re

from netweir.llm.queries import QUERIES
from netweir.llm.text_density import extract, main_text

LONG = "A sentence that is long enough to count as text of an article, said twice over for good measure. "


def test_parts_that_are_no_article_go():
    page = f"""<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body class="home"><header><h1>Site</h1></header>
    <div id="cookie-notice">{LONG}</div><nav><a href=x>one</a></nav><ul class="menu"><li>a<li>b</ul><div class="wrap"><div class="content"><h2>Title</h2><p>{LONG}<b>bold</b> &amp; more
    &eacute;&#33;<p>second<br>line {LONG}<div class="ad-slot">Buy!</div><script>var x = "<p>no</p>";</script><!-- <p>no</p> --><ul><li>one<li>two</ul></div><aside>side {LONG}</aside></div>
    <form><p>{LONG}</p><input></form><div class="comments"><article><p>{LONG}{LONG}{LONG}</p></article></div><p hidden>{LONG}</p><footer>foot</footer></body></html>"""
    s = LONG.strip()
    assert main_text(page) == f"Title\n{s} bold & more é!\nsecond line {s}\none\ntwo"


def test_article_with_its_heading_and_short_parts():
    page = f"<body><article><header><h1>T</h1></header><div><p>{LONG}<p>{LONG}</div><p>x</p></article><div>{'<a href=x>link text</a> ' * 20}</div>"
    assert main_text(page).split("\n") == ["T", LONG.strip(), LONG.strip(), "x"]


def test_odd_input():
    assert main_text(None) == "" and main_text("") == "" and main_text("   ") == ""
    assert main_text("just text &lt; here") == "just text < here"
    assert main_text("<p>a<p>b</") == "a\nb"
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<p>5 < 6 and 7 > 3</p>") == "5 < 6 and 7 > 3"
    assert main_text("<script>only") == "" and main_text("<p>x<!-- open") == "x" and main_text("<table><tr><td>a<td>b</table>") == "a\nb"
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999


def test_rows(spark):
    rows = [(1, "u", None, 5), (1, "u", None, 5), (None, None, "<p>x", 6), (2, "v", "", 7)]
    got = [tuple(r) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "v", "", 0)], key=str)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_query(spark, sf_dir):
    """The test pages hold one article element each: its blocks, cut by a plain pattern."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op6_text_density"](spark, sf_dir).collect():
        m = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id] or "", re.S)
        body = re.sub(r"<[a-zA-Z/][^>]*\Z", "", m[1]) if m else ""
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
