"""Main text of web pages by template deduction from same-host pages.

Every page is read as a stream of tokens: elements with the path they stand at, and blocks of text at a path. Over the
pages of a host a token has an occurrence vector, how often each page holds it; it is summed up as a number, so that equal
vectors give equal numbers whatever the order of the pages. Tokens with equal vectors on enough pages form an equivalence
class. A class is valid if it has an element that stands once on each of its pages; it may be that of a layout which only
some pages of the host follow. Classes of nearly all pages are the skeleton, other valid classes are nested in the slot of
the skeleton that their elements stand below. Text tokens of valid classes and of nearly all pages are template and are left
out wherever they stand, in articles too. The main slot is the article of the skeleton or layout, or else the innermost
element that holds most of the text; the names of tags and classes decide where the template has such elements, and on
pages without a template. It is extracted without the parts that name themselves menus, notices, adverts, forms or comments.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.llm.common import col, saved

# Share of a host's pages on which a token of the template occurs, and of its variable text that a main slot holds.
FREQUENT = 0.8
MAIN_SHARE = 0.6
# Share of a host's pages that a layout of its own has.
LAYOUT = 0.05
# Pages of a host from which repeated text counts as template.
LEAST_PAGES = 5
# Pages on which a text inside an article has to be the same before it counts as template.
ARTICLE_PAGES = 20
BROADCAST_BYTES = 8_000_000
# Elements deeper than this share the path of the one at this depth.
MAX_DEPTH = 24

# Element and attribute names of HTML and of common page parts.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp"
    " math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mfenced mstyle mpadded mphantom menclose mtable mtr mtd semantics"
    " object canvas video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select annotation annotation-xml".split())
APART = frozenset("head nav footer aside form button dialog menu header".split()) | RAW
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert sidebar menu nav"
    " navbar navigation breadcrumb breadcrumbs footer comment comments replies respond disqus social share sharing related recommended newsletter subscribe"
    " signup login search popup modal overlay pagination pager toolbar skip"
    " ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper banner-ad cookie-banner cookie-bar cookie-consent cookie-notice side-bar site-footer site-nav main-nav"
    " main-menu nav-bar nav-menu page-footer comment-form comment-list comment-section comments-area related-posts related-articles share-buttons social-links"
    " social-share newsletter-signup search-form skip-link".split()
)
COMMENT_NAMES = frozenset("comment comments replies respond disqus comment-list comment-section comments-area".split())
# Elements of running text: a name on them is no sign of a page part.
TEXT_NAMES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figure figcaption caption".split())
MAIN_NAMES = frozenset("article main".split())
CLOSED_BY = {
    "p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()),
    "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split()),
}
SCOPES = frozenset("ul ol dl table article section main div body nav aside footer header form blockquote".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
JOINT = re.compile(r"[-_]+")


class Block:
    """One run of text without a block boundary, the path it stands at, and the element numbers above it."""

    __slots__ = ("text", "path", "apart", "above")

    def __init__(self, text: str, path: str, apart: bool, above: tuple[int, ...]):
        self.text, self.path, self.apart, self.above = text, path, apart, above


def read_page(source: str, confirmed: frozenset[str] | set[str] | None = None) -> tuple[list[Block], list[tuple[str, bool, bool]]]:
    """Blocks in page order, and ``(path, apart, main)`` of each element that is no inline one.

    Parts stand apart by their tag or by a whole class name, id or role. Names mark nothing that is or holds most of the
    page's articles, nor, where there are none, most of its text; with ``confirmed``, only parts at these paths.
    """
    blocks: list[Block] = []
    # Elements: path, number of the one around it, the tag and the names that set it apart, whether it is an article.
    seen: list[tuple[str, int, str, frozenset[str], bool]] = []
    # Open elements: name, number, path, whether it is in an article.
    stack: list[tuple[str, int, str, bool]] = [("", -1, "", False)]
    held: list[str] = []
    at = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(Block(text, stack[-1][2], False, tuple(e[1] for e in stack[1:])))
            held.clear()

    def close(names: frozenset[str], scopes: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scopes:
                return

    while True:
        found = TOKEN.search(source, at)
        if found is None:
            if at < len(source):
                held.append(html.unescape(source[at:]))
            break
        if found.start() > at:
            held.append(html.unescape(source[at : found.start()]))
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            if found[0].startswith("<![CDATA["):
                held.append(found[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        ends = found["end"] or found["end2"]
        if name in INLINE:
            continue
        flush()
        if ends:
            close(frozenset((name,)), frozenset())
            continue
        if name in CLOSED_BY:
            close(CLOSED_BY[name], SCOPES)
        rest = found["rest"] or found["rest2"] or ""
        if name in RAW and not rest.endswith("/"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else len(source)
            continue
        if name in VOID or rest.endswith("/"):
            continue
        values = " ".join(a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(rest)).lower()
        words = [w for w in SPLIT.split(values) if w]
        _, _, path, inside = stack[-1]
        if len(stack) <= MAX_DEPTH:
            path = f"{path}/{name}" + "".join(f".{w}" for w in words[:4])
        whole = frozenset(JOINT.sub("-", v) for v in values.split())
        names = APART_NAMES & whole if name not in ("body", "html") and name not in TEXT_NAMES else frozenset()
        if confirmed is not None and path not in confirmed:
            names = frozenset()
        tag = "" if name not in APART or (name == "header" and inside) else name
        seen.append((path, stack[-1][1], tag, names, name in MAIN_NAMES or "main" in whole))
        stack.append((name, len(seen) - 1, path, inside or name == "article"))
    flush()
    return blocks, _settle_parts(blocks, seen)


def _settle_parts(blocks: list[Block], seen: list[tuple[str, int, str, frozenset[str], bool]]) -> list[tuple[str, bool, bool]]:
    """``(path, apart, main)`` of the elements; marks the blocks that stand apart."""
    count = len(seen)

    def spread(own: list[bool]) -> list[bool]:
        out = []
        for i, mark in enumerate(own):
            up = seen[i][1]
            out.append(mark or (up >= 0 and out[up]))
        return out

    # A form may be laid around the whole page.
    by_tag = spread([e[2] not in ("", "form") for e in seen])
    articles = [e[4] and not t for e, t in zip(seen, by_tag)]
    in_article = spread(articles)
    holds = list(articles)
    for i in range(count - 1, -1, -1):
        if holds[i] and seen[i][1] >= 0:
            holds[seen[i][1]] = True
    named = any(articles)
    whole, letters = 0, [0] * count
    for block in blocks:
        if block.above and by_tag[block.above[-1]]:
            continue
        if not named or (block.above and in_article[block.above[-1]]):
            whole += len(block.text)
            for i in block.above:
                letters[i] += len(block.text)
    marked = []
    for (_, _, tag, names, _), most, held in zip(seen, letters, holds):
        if named:
            spared = held and 2 * most >= whole
        else:
            spared = bool(whole) and most >= MAIN_SHARE * whole and COMMENT_NAMES.isdisjoint(names)
        marked.append(bool(tag or names) and not spared)
    apart = spread([m or t for m, t in zip(marked, by_tag)])
    if named and all(a for a, article in zip(apart, articles) if article):
        # All articles were marked by names: names are wrong here.
        apart = spread([t or (m and not h) for m, t, h in zip(marked, by_tag, holds)])
    for block in blocks:
        block.apart = bool(block.above) and apart[block.above[-1]]
    return [(e[0], a, e[4] and not a) for e, a in zip(seen, apart)]


def _number(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "big") >> 4


def block_token(block: Block) -> str:
    """The number of a text token: the same text at another path is another token."""
    return f"{_number(f'{block.path} {block.text}'):x}"


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each page: how often it has them and, for elements, the letters of all text below that
    is not apart and their millionths of those of the page."""
    for batch in batches:
        rows = []
        for host, page, source in zip(batch["host"], batch["page"], batch["html"]):
            blocks, elements = read_page(source)
            counts: dict[tuple[str, str], list] = {}
            letters = [0] * len(elements)
            whole = 0
            for block in blocks:
                if not block.apart:
                    whole += len(block.text)
                    for i in block.above:
                        letters[i] += len(block.text)
                entry = counts.setdefault((block.path, block_token(block)), [0, 0, block.apart, False])
                entry[0] += 1
                entry[1] += len(block.text)
            for (path, apart, main), below in zip(elements, letters):
                entry = counts.setdefault((path, ""), [0, 0, apart, main])
                entry[0] += 1
                entry[1] += below
            for (path, text), (n, size, apart, main) in counts.items():
                rows.append((host, path, text, n, size, 1_000_000 * size // max(1, whole), apart, main, _number(f"{page}|{n}")))
        yield pd.DataFrame(rows, columns=["host", "path", "text", "n", "letters", "share", "apart", "main", "vector"])


def host_templates(pages: DataFrame) -> DataFrame:
    """``(host, classes)`` from ``(host, page, html)``: the frequent equivalence classes of each host.

    Tokens are counted across the cluster; of a host only the tokens of frequent classes meet in one row, which are no
    more than a page has on average, divided by ``LAYOUT``.
    """
    tokens = pages.mapInPandas(_tokens, "host string, path string, text string, n bigint, letters bigint, share bigint, apart boolean, main boolean, vector bigint")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    vectors = tokens.groupBy("host", "path", "text").agg(
        F.count("*").alias("on"), F.sum("n").alias("n"), F.sum("letters").alias("letters"), F.sum("share").alias("share"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"),
        F.max("apart").alias("apart"), F.max("main").alias("main"),
    )
    # Classes: equal vectors. Their number of pages is part of the vector.
    nearly_all, layout = F.col("on") >= FREQUENT * F.col("pages"), (F.col("on") >= LAYOUT * F.col("pages")) & (F.col("on") >= LEAST_PAGES)
    frequent = vectors.join(totals, "host").filter(nearly_all | layout)
    token = F.struct("path", "text", "n", "letters", "share", "apart", "main", "pages")
    classes = frequent.groupBy("host", "on", "vector").agg(F.collect_list(token).alias("tokens"))
    return classes.groupBy("host").agg(F.collect_list(F.struct("on", "tokens")).alias("classes"))


def confirmed_parts(classes: list) -> list[str] | None:
    """Paths of elements that stand apart and are in the template; None for a host of too few pages to tell."""
    tokens = [t for group in classes for t in group["tokens"]]
    if not tokens or tokens[0]["pages"] < LEAST_PAGES:
        return None
    return sorted({t["path"] for t in tokens if t["apart"] and not t["text"]})


def outermost(paths: list[str]) -> list[str]:
    return [p for p in paths if not any(p.startswith(f"{q}/") for q in paths)]


def main_paths(classes: list) -> tuple[list[str], list[str], list[str], list[str]]:
    """The paths of a host's main slot, those of the main slots of its layouts nested in it, the numbers of the texts of
    nearly all pages, and those of texts that a valid class holds."""
    skeleton, layouts, repeated, shared = [], [], [], []
    articles = tuple({f"{t['path']}/" for group in classes for t in group["tokens"] if t["main"]})
    for group in classes:
        # One per page: an element around a slot.
        once = [t for t in group["tokens"] if not t["text"] and t["n"] == group["on"]]
        texts = [t["text"] for t in group["tokens"] if t["text"] and (group["on"] >= ARTICLE_PAGES or not f"{t['path']}/".startswith(articles))]
        everywhere = any(group["on"] >= FREQUENT * t["pages"] for t in group["tokens"][:1])
        if group["on"] >= LEAST_PAGES:
            if everywhere:
                repeated += texts
            elif once:
                shared += texts
        once = [t for t in once if not t["apart"]]
        if everywhere:
            skeleton += once
        elif once:
            layouts.append(once)
    named = sorted(t["path"] for t in skeleton if t["main"])
    most = max((t["letters"] for t in skeleton), default=0)
    inner = [t["path"] for t in skeleton if t["letters"] >= MAIN_SHARE * most and t["letters"]]
    # The outermost article; one inside it is part of it.
    main = outermost(named) if named else [max(inner, key=lambda p: (p.count("/"), p))] if inner else []
    nested = []
    for once in layouts:
        # By position: what stands in the slot that the skeleton leaves open, or beside it on pages that lack it.
        below = [t for t in once if named or not main or t["path"].startswith(f"{main[0]}/")]
        if own := [t["path"] for t in below if t["main"]]:
            nested += outermost(sorted(own))
        elif deep := [t["path"] for t in below if t["share"] >= MAIN_SHARE * 1_000_000 * t["n"]]:
            nested.append(max(deep, key=lambda p: (p.count("/"), p)))
    return main, sorted(set(nested)), repeated, shared


def page_text(
    source: str, main: set[str], repeated: set[str], confirmed: set[str] | None = None, nested: set[str] | frozenset = frozenset(),
    shared: set[str] | frozenset = frozenset(),
) -> str:
    """The text of the main slot of the page's layout without template texts; of a page without it, of its articles, or
    else of its body.

    Texts that all or most of the slot consists of are no template: such pages are copies.
    """
    blocks, elements = read_page(source, confirmed)
    free = [b for b in blocks if not b.apart]
    tokens = [block_token(b) if repeated or shared else "" for b in free]

    def within(chosen: set[int]) -> list[int]:
        return [k for k, b in enumerate(free) if not chosen or not chosen.isdisjoint(b.above)]

    def size(places: list[int]) -> int:
        return sum(len(free[k].text) for k in places if tokens[k] not in repeated)

    def at(paths) -> set[int]:
        return {i for i, (path, apart, _) in enumerate(elements) if path in paths and not apart}

    chosen, named = at(main), {i for i, (_, _, is_main) in enumerate(elements) if is_main}
    if not any(elements[i][2] for i in chosen):
        layout = at(nested)
        articles = {i for i in layout if elements[i][2]}
        if layout:
            chosen = articles or layout
        elif named and (not chosen or size(within(named)) >= MAIN_SHARE * size(within(chosen))):
            chosen = set()
    # Further articles of the page belong to its text.
    chosen = chosen | named
    inside = within(chosen)
    left = [k for k in inside if tokens[k] not in repeated] or inside
    own = [k for k in left if tokens[k] not in shared]
    if 2 * sum(len(free[k].text) for k in own) >= sum(len(free[k].text) for k in left):
        left = own
    return " ".join(free[k].text for k in left)


def main_text(df: DataFrame, url: str = "url", source: str = "html", name: str = "text") -> DataFrame:
    """All columns but ``source``, and ``name``, the main text of the page.

    Null and empty pages have an empty text; pages without an address form a host of their own. Character references are
    decoded, white space inside a block is one space, blocks are joined by one space in page order, and nothing is cut
    off. Repeated rows are kept. Templates are one short row per host: they are broadcast if their checked size allows,
    else joined by shuffle, where a hot host's pages may be split.
    """
    rest = [f for f in df.schema.fields if f.name not in (source, name)]
    host = F.lower(F.coalesce(F.regexp_extract(col(url), r"^[^/]*//([^/?#]*)", 1), F.lit("")))
    pages = df.select(host.alias("host"), F.xxhash64(col(url), col(source)).alias("page"), F.coalesce(col(source), F.lit("")).alias("html"))
    classes = host_templates(pages)
    names = ["_main", "_nested", "_repeated", "_shared", "_parts"]

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*main_paths(c), confirmed_parts(c)) for c in batch["classes"]]
            yield pd.DataFrame({"_host": batch["host"], **{name: [f[i] for f in found] for i, name in enumerate(names)}})

    templates = saved(classes.mapInPandas(settle, "_host string, " + ", ".join(f"{n} array<string>" for n in names)), "templates")
    size = templates.agg(F.sum(F.octet_length(F.to_json(F.struct("_host", *names))))).first()[0] or 0
    rows = df.select(
        F.struct(*([col(f.name).alias(f.name) for f in rest] or [F.lit(True).alias("_")])).alias("_row"), col(source).alias("_html"), host.alias("_at")
    )
    joined = rows.join(F.broadcast(templates) if size <= BROADCAST_BYTES else templates, F.col("_at") == F.col("_host"), "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(*(batch.column(i).to_pylist() for i in range(1, 7)))
            texts = [page_text(s, set(m or ()), set(r or ()), None if p is None else set(p), set(n or ()), set(h or ())) if s else "" for s, m, n, r, h, p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_out"])

    schema = T.StructType([rows.schema["_row"], T.StructField("_out", T.StringType())])
    found = joined.select("_row", "_html", *names).mapInArrow(extract, schema)
    return found.select(*[F.col("_row")[f.name].alias(f.name) for f in rest], F.col("_out").alias(name))
