from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from tabweave.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="has-ads">
<header class="top"><h2>Site</h2></header><nav><ul><li><a href="/a">menu {i}</a><li>b</ul></nav><div class="cookie-notice">We use cookies {i}</div>
<article><header><h1>Title {i} &amp; more</h1></header><p>First\n  para &lt;{i}&gt; with <b>bold</b>text.<p>Second<br>line
<div class="ad">buy {i}</div><aside>side {i}</aside><form><input><label>mail</label></form><!-- hidden <p>x</p> -->
<table><tr><td>c1<td>c2</table><ul><li>one<li>two</ul></article>
<section id="comments"><p>comment {i}</p></section><div class="sidebar"><p>related</p></div><footer>&copy; 2024</footer></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in ht.main_text(df).collect()}


def test_parts_of_a_page(spark):
    rows = [(i, f"https://a.example.com/{i}", PAGE.format(i=i)) for i in range(8)]
    for i, text in extracted(spark, rows).items():
        assert text == f"Title {i} & more First para <{i}> with boldtext. Second line c1 c2 one two"


def test_hosts_without_an_article_element(spark):
    page = "<html><body><div class='top'>Home</div><div class='wrap'><div class='text'><p>{a}</p><p>{b}</p></div><div class='promo'>x {a}</div></div><div class='foot'>Same line</div></body></html>"
    rows = [(i, f"http://b.example.org/x?{i}", page.format(a=f"alpha {i} " * 9, b=f"beta {i} " * 9)) for i in range(12)]
    for i, text in extracted(spark, rows).items():
        assert text == " ".join([f"alpha {i}"] * 9 + [f"beta {i}"] * 9)


def test_odd_pages(spark):
    rows = [
        (1, None, "<p>no address</p>"), (2, "not a url", None), (3, "http://c/", ""), (4, "http://c/4", "plain text & more"),
        (5, "http://c/5", "<article><p>never closed <b>bold"), (6, "http://c/6", "a < b <c d='x>y'>e</c> <i f=\"g>h</i>"),
        (7, "http://c/7", "<script>x"), (8, "http://d/8", "<article>&nbsp; a&#8212;b &amp;lt; &unknown; </article>"), (9, "http://e/9", "<p>" * 5000 + "deep"),
        (9, "http://e/9", "<p>" * 5000 + "deep"),
    ]
    got = extracted(spark, rows)
    assert got[1] == "no address" and got[2] == "" and got[3] == "" and got[4] == "plain text & more"
    assert got[5] == "never closed bold" and got[7] == "" and got[8] == "a—b &lt; &unknown;" and got[9] == "deep"
    assert got[6].startswith("a < b e")
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert ht.main_text(df).count() == 10 and ht.main_text(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://f/1", "<article>x</article>", "a", "b", "c")], "page_id int, url string, html string, text string, _main string, host string")
    row = ht.main_text(df).first()
    assert (row.text, row._main, row.host) == ("x", "b", "c")


def test_equal_vectors_form_classes(spark):
    rows = [("h", i, "<body><ul>" + "<li><em>x</em><div>y</div></li>" * (1 + i % 3) + f"</ul><p>t{i}</p></body>") for i in range(9)]
    classes = ht.host_templates(spark.createDataFrame(rows, "host string, page bigint, html string")).first().classes
    by_path = {t["path"]: (g["on"], g["tokens"]) for g in classes for t in g["tokens"] if not t["text"]}
    assert {t["path"] for t in by_path["/body/ul/li"][1]} >= {"/body/ul/li", "/body/ul/li/div"}
    assert "/body/ul" in {t["path"] for t in by_path["/body"][1]} and "/body/ul/li" not in {t["path"] for t in by_path["/body"][1]}


def test_names_do_not_lose_the_article(spark):
    shell = "<html><body><nav>menu</nav>{}<footer>end</footer></body></html>"
    bodies = {
        "wrap": "<div class='content-sidebar-wrap'><article><p>text {i}</p></article></div>", "main": "<main class='site-main has-sidebar'><p>text {i}</p></main>",
        "post": "<article class='post comments-open'><p>text {i}</p></article>", "holds": "<div class='search'><article class='social'><p>text {i}</p></article></div>",
        "form": "<form id='aspnet'><article><p>text {i}</p></article></form>", "note": "<article><p>text</p><p class='notice'>{i}</p></article>",
        "once": "<article><p>text {i}</p></article>", "math": "<article><p>text <math><mi>{i}</mi></math></p><object>o</object> <canvas>c</canvas></article>",
    }
    rows = [(100 * k + i, f"http://{name}.example.org/{i}", shell.format(body.format(i=i))) for k, (name, body) in enumerate(bodies.items()) for i in range(8)]
    rows[6 * 8] = (600, "http://once.example.org/0", shell.format("<article><p>text 0</p><div class='alert'>kept</div></article>"))
    got = extracted(spark, rows)
    for k, name in enumerate(bodies):
        for i in range(8):
            want = {"math": f"text {i} o c", "once": f"text {i} kept" if i == 0 else f"text {i}"}.get(name, f"text {i}")
            assert got[100 * k + i] == want, name


def test_template_text_inside_articles_and_layouts(spark):
    boiler = "<article><p>Read our terms before use.</p><p>{t}</p></article>"
    left = "<html><body><div class='a'><div class='link'>{s}</div><div class='words'><p>{t}</p><p>{t}</p><p>Told by the left desk.</p></div></div></body></html>"
    right = "<html><body><div class='b'><section><div class='story'><p>{t}</p><p>{t}</p></div></section><div class='more'>{s}</div></div></body></html>"
    third = "<html><body><div class='c'>{s}<article><p>{t}</p></article></div></body></html>"
    text = lambda i: f"some words of page number {i} " * 4
    rows = [(i, f"http://b.example.com/{i}", boiler.format(t=text(i))) for i in range(24)]
    rows += [(100 + i, f"http://l.example.com/{i}", (left, right, third)[i % 3].format(t=text(i), s=f"see {i}")) for i in range(30)]
    got = extracted(spark, rows)
    assert all(got[i] == text(i).strip() for i in range(24))
    for i in range(30):
        assert got[100 + i] == " ".join([text(i).strip()] * (2, 2, 1)[i % 3])
    copies = [(i, f"http://c.example.com/{i}", boiler.format(t="Always the same page.")) for i in range(24)]
    assert set(extracted(spark, copies).values()) == {"Read our terms before use. Always the same page."}


BLOCK = re.compile(r"</?(?:p|h1|br|article)[^>]*>")


def plain(source: str) -> str:
    """The text of the article, by the shape of the test pages."""
    inner = re.search(r"<article>(.*?)</article>", source or "", re.S)
    if not inner:
        return ""
    blocks = [html.unescape(re.sub(r"</?b>", "", b)) for b in BLOCK.split(inner[1])]
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    from tabweave.llm.queries import op9_main_text

    folder = f"/root/testdata/{sf}"
    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op9_main_text(spark, folder).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)
    assert op9_main_text(spark, folder).select(F.col("n_chars")).dtypes == [("n_chars", "bigint")]
