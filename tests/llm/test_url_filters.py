from __future__ import annotations

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from tabweave.llm import url_filters as uf
from tabweave.llm.queries import URL_RULES, op12_url_filters
from tests.oracle_check import connect

RULES = [uf.Rule("block", "bad.com", "/"), uf.Rule("allow", "bad.com", "/good/"), uf.Rule("block", "net", "/x/")]


def judged(spark, rows, links=None, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    edges = None if links is None else spark.createDataFrame(links, "url string, target string")
    found = uf.judge_urls(pages, RULES, links=edges, **options).collect()
    assert len(found) == len(rows)
    return {r.page_id: (r.judged.rule, r.judged.verdict) for r in found}


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head></html>'


def test_host_and_path(spark):
    urls = ["https://A.com:8080/X?y#z", "a.com/x", None, "http://H?x", "://h/p", "http://a://b/c", "x://", "http://é.com/é", "http://h#/a"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(uf.url_host(F.col("url")), uf.url_path(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.com:8080", "/X"), ("", ""), ("", ""), ("h", ""), ("h", "/p"), ("a:", "//b/c"), ("", ""), ("é.com", "/é"), ("h", ""),
    ]


def test_rules(spark):
    rows = [(0, "http://bad.com/", ""), (1, "http://a.bad.com/good/1", ""), (2, "http://notbad.com/", None), (3, "http://bad.com", ""), (4, "http://b.net/x/y", ""), (5, None, canonical("http://bad.com/"))]
    got = judged(spark, rows)
    assert got[0] == ("bad.com/", "block") and got[1] == ("bad.com/good/", "allow") and got[2] == (None, "allow")
    # The bare host fits no rule that asks for a slash, but is the same page as the one with it.
    assert got[3] == (None, "block") and got[4] == ("net/x/", "block") and got[5] == (None, "allow")


def test_aliases_over_chains_and_allow_first(spark):
    rows = [
        (0, "http://one.org/a", canonical("http://two.org/b")),
        (1, "https://www.two.org/b/?utm_source=q", '<meta http-equiv="refresh" content="0;url=//three.org/c?k=1&amp;l=2">'),
        (2, "http://three.org/c?k=1&l=2#top", canonical("http://bad.com/p")),
        (3, "http://four.org/a", canonical("http://bad.com/q")),
        (4, "http://five.org/", canonical("http://four.org/a")),
        (5, "http://bad.com/q", canonical("http://bad.com/good/q")),
        (6, "http://six.org/", "<!-- " + canonical("http://bad.com/p") + "-->"),
        (7, "http://three.org/c?k=1", ""),
    ]
    got = judged(spark, rows)
    assert [got[i] for i in (0, 1, 2)] == [(None, "block")] * 3
    # A class with an explicitly allowed address is allowed, but a rule that fits an address itself decides it.
    assert got[3] == (None, "allow") and got[4] == (None, "allow") and got[5] == ("bad.com/", "block")
    assert got[6] == (None, "allow") and got[7] == (None, "allow")


def test_links_from_elsewhere(spark):
    rows = [(0, "http://one.org/a", canonical("http://bad.com/p")), (1, "http://two.org/", "")]
    assert judged(spark, rows, [("http://two.org/", "http://y.net/x/z")], html=None) == {0: (None, "allow"), 1: (None, "block")}
    assert judged(spark, rows, default="block")[1] == (None, "block")


@pytest.mark.parametrize("few", [True, False])
def test_against_plain_components(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(uf, "BROADCAST_ENTRIES", 0)
    draw = random.Random(7)
    urls = [f"http://h{draw.randrange(60)}.org/{draw.randrange(3)}" for _ in range(150)] + [f"http://bad.com/{p}{i}" for i in range(5) for p in ("", "good/")]
    rows = [(i, draw.choice(urls), canonical(draw.choice(urls)) if draw.random() < 0.4 else "") for i in range(300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    told = {}
    for _, url, html in rows:
        target = html.split('href="')[1].split('"')[0] if html else url
        parent[find(url)] = find(target)
        for u in (url, target):
            if "bad.com" in u:
                told[u] = "good" in u
    votes = {}
    for u, allowed in told.items():
        votes[find(u)] = votes.get(find(u), False) or allowed
    expected = {i: ("allow" if told[u] else "block") if u in told else ("allow" if votes.get(find(u), True) else "block") for i, u, _ in rows}
    assert {i: v for i, (_, v) in judged(spark, rows).items()} == expected and len(set(expected.values())) == 2


def test_relative_links_as_urllib_joins_them(spark):
    base = "https://h.org/a/b/c.html?q=1"
    links = ["x", "../x", "./", "..", "/r/../s", "//o.net/z", "?p=2", "http://e.com/", "a/./b/../c?x=/../y", "../../../../z", "/./a", "d/.."]
    rows = spark.createDataFrame([(base, x) for x in links], "base string, link string").select(uf.resolved(F.col("base"), F.col("link"))).collect()
    assert [r[0] for r in rows] == [urljoin(base, x) for x in links]


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/", "x" * 100_000 + "<link"), (1, "http://bad.com/", "")], "page_id bigint, url string, html string")
    clash = pages.withColumns({c: F.lit(9) for c in ("host", "path", "rule", "verdict", "node", "u", "row", "a.b")})
    found = uf.judge_urls(clash, RULES).collect()
    assert [(r.page_id, r.host, r["a.b"], r.judged.verdict) for r in found] == [(1, 9, 9, "block")] * 2
    assert uf.judge_urls(pages.limit(0), RULES).count() == 0


def test_functions_of_spark_only(spark):
    frame = op12_url_filters(spark, "/root/testdata/sf0.001")
    assert not any(word in frame._jdf.queryExecution().toString() for word in ("Python", "Pandas", "Arrow"))


def test_query(spark):
    """The query against rules read with urllib; the given pages have no links, so only forms of one address are aliases."""
    sf = "/root/testdata/sf0.001"
    rows = connect(sf).sql("SELECT page_id, url FROM pages").fetchall()
    got = {r.page_id: r for r in op12_url_filters(spark, sf).collect()}
    assert len(got) == len(rows)
    for page, url in rows:
        parts = urlsplit(url)
        fits = [r for r in URL_RULES if (parts.netloc == r.host or parts.netloc.endswith("." + r.host)) and parts.path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[page].host, got[page].path, got[page].rule) == (parts.netloc, parts.path, best and best.name)
        assert best is None or got[page].verdict == best.verdict
