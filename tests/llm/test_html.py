"""Main text of pages: hand-made pages, and the table against a plain pattern."""

import html as standard
import re

import pytest
from oracle import compare, connect

from tidegauge.llm import html
from tidegauge.llm.queries import ORACLES, QUERIES

LONG = "The harbour was quiet in the morning, and nobody had seen the ship that came in with the tide before dawn."
MORE = "When the keeper of the light went down to the pier, he found three crates and a letter addressed to the council."
MENU = "<ul>" + "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Weather", "Contact us")) + "</ul>"


def page(body, head="<title>Not this</title><style>p{margin:0}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize("name,body,text", [
    ("article", f"<nav>{MENU}</nav><div class='ad'>{LONG}</div><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article>"
                f"<footer>{LONG}</footer>", f"Title {LONG} Short."),
    ("broken markup", f"<article><h1>T &am</h1><p><b>{LONG}<br><p>{MORE}</article><footer>&copy; x", f"T &am {LONG} {MORE}"),
    ("one word", f"<div class='ad'>{LONG}</div><article><p>Yes</p></article><footer>{LONG}</footer>", "Yes"),
    ("named container", f"<div id='header'>{MENU}</div><div id='content'><h2>Title</h2><p>{LONG}</p><p>No.</p><p>{MORE}</p></div>"
                        f"<div class='sidebar'><p>{LONG}</p></div><div id='comments'><p>{LONG}</p></div>", f"Title {LONG} No. {MORE}"),
    ("plain containers", f"<div>{MENU}</div><div><h2>Title</h2><p>{LONG}</p><p>No.</p><p>{MORE}</p></div><div>{MENU}</div>",
     f"Title {LONG} No. {MORE}"),
    ("flat page", f"{MENU}<p>{LONG}<p>No.<p>{MORE}{MENU}", f"{LONG} No. {MORE}"),
    ("noise inside", f"<main><article><header><h1>Title</h1><p>By me</p></header><p>{LONG}</p><aside>{MORE}</aside>"
                     f"<div class='cookie-notice'>{MORE}</div><form><input><label>Mail</label><button>Go</button></form>"
                     f"<script>var t='</p>{LONG}';</script><p>End.</p><footer>Share</footer></article>"
                     f"<section class='comments'><article class='comment'><p>{LONG}{MORE}{LONG}</p></article></section></main>",
     f"Title {LONG} End."),
    ("form around all", f"<form><nav>{MENU}</nav><div class='content-sidebar'><main><p>{LONG}</p></main></div></form>", LONG),
    ("references", "<article><p>a&nbsp;b &lt;p&gt; &#233;&#x41; &amp;amp; <i>c</i>d<br>e\n\t f</p></article>", "a b <p> éA &amp; cd e f"),
    ("list and table", f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>",
     f"{LONG} one two x y"),
    ("hidden", f"<article><p>{LONG}</p><p hidden>no</p><p style='display: none'>no</p><div role='dialog'>no</div></article>", LONG),
    ("marked sections", f"<article><![if IE]><p>{LONG}</p><![endif]><![CDATA[x]]></article>", LONG),
    ("nothing", f"<nav>{MENU}</nav><footer>{LONG}</footer>", ""),
    ("no markup", LONG, LONG),
    ("class of the body", f"<article class='post has-sidebar'><p>{LONG}</p></article>", LONG),
    ("teasers beside", f"<main><article><p>{LONG}</p><p>{MORE}</p></article></main><aside><article><p>{LONG}</p></article></aside>",
     f"{LONG} {MORE}"),
])
def test_pages(name, body, text):
    assert html.extract(page(body)) == text


def test_smoothing_and_threshold():
    ratios = html.smoothed(html.np.array([0.0, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0]))
    assert abs(ratios.sum() - 100) < 1e-9 and ratios.argmax() == 3 and ratios[0] == 0 and ratios[1] > 0
    lines = [html.Line("x" * n, t, 0, (), False) for n, t in [(4, 4)] * 8 + [(200, 2)] * 5 + [(4, 4)] * 8]
    assert list(html.content(lines)) == [False] * 8 + [True] * 5 + [False] * 8


def test_table_cases(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", page(f"<article>{LONG}</article>"), "x"),
            (2, "u", page(f"<article>{LONG}</article>"), "x"), (3, "u", "<article><p>" + "é " * 500_000 + "</article>", None),
            (4, "u", "<<<>&&& </ <!-- ", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = {(r.page_id, r.text[:20], r.n_chars) for r in html.main_text(df).collect()}
    assert html.main_text(df).count() == 6
    assert {(1, "", 0), (None, "", 0), (2, LONG[:20], len(LONG)), (3, "é é é é é é é é é é ", 999_999)} <= found
    assert html.main_text(df.limit(0)).count() == 0


def plain(source):
    """The pages of the table have one article element, inline b, and blocks."""
    body = re.search("<article>(.*)</article>", source, re.S).group(1)
    text = standard.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body)))
    return " ".join(text.split())


def test_query_equals_a_plain_pattern_and_sql(spark, data):
    name = "op13_html_extraction"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES[name](spark, data).collect()
    assert {r.page_id: r.text for r in rows} == {k: plain(v) for k, v in source.items()}
    assert all(r.n_chars == len(r.text) for r in rows)
    assert compare(QUERIES[name](spark, data), connect(data), ORACLES[name]) == []
