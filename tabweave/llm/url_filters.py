"""URL block and allow rules, carried over to aliases of the same page by redirects and canonical links.

Rules are prefixes of host and path. Addresses that a page says lead to one another (a canonical link, a redirect of its
head) or that differ only in ways which sites redirect (scheme, default port, ``www.``, tracking parameters, fragment, a
slash at the end) are edges. Connected components of these edges are classes of aliases: a class with an allowed
address is allowed, else one with a blocked address is blocked. A rule that fits an address itself always decides it.

DataFrame functions only. Most pages have no edge besides their own normal form and take no part in the components.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.lookup import BROADCAST_ENTRIES, SALTS
from tabweave.llm.common import col, components, saved

ALLOW, BLOCK = "allow", "block"
# Parameters of links that count visits and leave the page as it is.
TRACKING = "utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref"
DEFAULT_PORTS = {"http": "80", "https": "443"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What holds no links of its own: comments and raw text.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|noscript|template|iframe|title|xmp)\b.*?(?:</\1\s*>|\z)"
TAG = r"(?i)<(?:link|meta)\s[^>]*>"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://`` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``(name, verdict)`` of the longest rule that fits, null if none does; of equally long ones an allowing one, then the
    first by name."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.verdict != ALLOW, r.name), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def _ruled(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``urls`` with the host, path and best rule of each url."""
    placed = urls.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    return placed.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))


def normal_url(url: Column) -> Column:
    """The address that variants of a url are redirected to; null without a host.

    Scheme, ``www.``, default port, fragment, tracking parameters and slashes at the end of the path go; other parameters stay in
    their order.
    """
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    host = url_host(url)
    for name, port in DEFAULT_PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    host = F.regexp_replace(host, r"^www\.(?=.*\.)", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(rf"(?s)^(?:{TRACKING})(?:=.*)?$")))
    path = F.rtrim(url_path(url), F.lit("/"))
    whole = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))
    return F.when(host != "", whole)


def without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` steps."""
    steps = F.split(path, "/")
    up = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.lit(1), F.size(kept) - 1))
    step = lambda kept, s: F.when(s == "..", up(kept)).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    walked = F.aggregate(F.slice(steps, F.lit(2), F.greatest(F.lit(0), F.size(steps) - 1)), F.array(F.lit("")), step)
    # A step up or in place at the end leaves its folder.
    closed = F.when(F.rlike(path, F.lit(r"/\.\.?$")), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path.contains("/."), F.array_join(closed, "/")).otherwise(path)


def resolved(base: Column, link: Column) -> Column:
    """A link as an address, as seen from the page at ``base``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), url_host(base))
    folder = F.regexp_replace(F.concat(F.lit("/"), F.ltrim(url_path(base), F.lit("/"))), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), link)
    whole = whole.when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
    # Other schemes, such as mailto:, lead to no page.
    whole = whole.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
    whole = whole.when(path == "", F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), rest))
    whole = whole.when(F.startswith(link, F.lit("/")), F.concat(site, without_dots(path), rest))
    return whole.otherwise(F.concat(site, without_dots(F.concat(folder, path)), rest))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, with the commonest character references decoded; empty if it is not there."""
    found = F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = F.regexp_replace(F.regexp_replace(found, rf"(?is)^[\s\"'/]{name}\s*=\s*", ""), r"""^["']|["']$""", "")
    for reference, letter in (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(reference), F.lit(letter))
    return F.trim(value, F.lit(" \t\n\f\r"))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, target)``: canonical links and head redirects of all pages, as addresses."""
    body = F.regexp_replace(col(html), HIDDEN, "")
    # Texts that cannot hold such a link are not searched further.
    may = F.rlike(col(html), F.lit(r"(?i)canonical|http-equiv"))
    tags = pages.filter(may & (url_host(col(url)) != "")).select(col(url).alias("url"), F.explode(F.regexp_extract_all(body, F.lit(TAG), F.lit(0))).alias("tag"))
    canonical = F.when(F.lower(F.substring("tag", 2, 4)) == "link", F.when(F.rlike(_attribute(F.col("tag"), "rel"), F.lit(r"(?i)(?:^|\s)canonical(?:\s|$)")), _attribute(F.col("tag"), "href")))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    links = tags.select("url", F.coalesce(canonical, refresh).alias("link")).filter("link <> ''")
    return links.select("url", resolved(F.col("url"), F.trim(F.col("link"))).alias("target")).filter(F.col("target").isNotNull())


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str | None = "html", links: DataFrame | None = None, default: str = ALLOW
) -> DataFrame:
    """``pages`` with a last column ``judged``: host, path, rule, verdict and the normal address ``alias``.

    ``links`` adds edges ``(url, target)`` known from elsewhere, such as a crawler's redirects; ``html=None`` reads none
    from the pages. Targets that are no pages are judged as well and pass their verdict on. Null urls and urls without
    ``://`` or host have no aliases, fit no rule with a host and get the default. Repeated rows are judged alike; an empty
    table gives an empty one; other columns are kept as they are, whatever their names.

    Classes are found over the edges alone. Rows that a rule decides are not joined; the others meet one row per address,
    broadcast if there are few, so a hot address only makes more rows to stream.
    """
    held = pages.select(F.struct(*[col(c).alias(c) for c in pages.columns]).alias("row"), col(url).alias("url"))
    if html is None:
        found = held.select("url", F.lit(None).cast("string").alias("target")).limit(0)
    else:
        found = page_links(pages, url, html)
    if links is not None:
        found = found.unionByName(links.select("url", "target"))
    edges = saved(found.select(normal_url(F.col("url")).alias("u"), normal_url(F.col("target")).alias("v"), "target").filter("u <> v"), "url-edges")
    # What each address is told by the rules: through the urls of its pages and through links to it.
    addresses = held.filter("url IS NOT NULL").select("url").unionByName(edges.select(F.col("target").alias("url")))
    told = _ruled(addresses, rules).select(normal_url(F.col("url")).alias("node"), (F.col("rule.verdict") == ALLOW).cast("int").alias("allowed"))
    votes = told.filter("node IS NOT NULL AND allowed IS NOT NULL").groupBy("node").agg(F.max("allowed").alias("allowed"))
    classes = saved(components(edges, "url-classes"), "url-classes")
    by_class = classes.join(votes, "node").groupBy("component").agg(F.max("allowed").alias("allowed"))
    inside = classes.join(by_class, "component").select("node", "allowed")
    verdicts = saved(inside.unionByName(votes.join(classes, "node", "left_anti").select("node", "allowed")), "url-verdicts")
    few = verdicts.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    table = verdicts.select(F.col("node").alias("_node"), "allowed", F.lit(False).alias("_sure"))
    rows = _ruled(held, rules).withColumn("alias", normal_url(F.col("url")))
    # Rows that a rule decides meet nothing; a hash spreads them.
    sure = F.col("rule").isNotNull() | F.col("alias").isNull()
    rows = rows.withColumns({"sure": sure, "key": F.when(sure, F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("string")).otherwise(F.col("alias"))})
    joined = rows.join(F.broadcast(table) if few else table, (F.col("key") == F.col("_node")) & (F.col("sure") == F.col("_sure")), "left")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("allowed") == 1, ALLOW).when(F.col("allowed") == 0, BLOCK), F.lit(default))
    result = F.struct("host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), "alias").alias("judged")
    return joined.select("row", result).select(*[F.col("row").getField(c).alias(c) for c in pages.columns], "judged")
