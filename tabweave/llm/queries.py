"""The numbered operators as queries over the test tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import bpe, embeddings, fingerprints, html_text, licences, near_documents, packing, phrases, quality, spellings, token_files, toxicity, url_filters
from tabweave.sources import read_table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def op1_embedding_components(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.embedding_components(_table(spark, sf, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they spell."""
    encoded = bpe.encode_texts(_table(spark, sf, "documents").select("doc_id", "text"), RANKS, public_tokenizers.PATTERN)
    digests = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), bpe.id_digest("ids").alias("ids_sha256"), "ids")
    decoded = bpe.decode_ids(digests, RANKS, out="decoded")
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every token of every document."""
    return packing.pack_documents(_table(spark, sf, "documents"))


def op4_near_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Class and group of every document."""
    return near_documents.near_documents(_table(spark, sf, "documents"))


def op5_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Own and inherited licence of every document.

    Documents have no paths, so source, language and thousands of the id serve as directories; a document whose first
    line is a licence statement serves as the licence file of its directory.
    """
    docs = _table(spark, sf, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    first = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^\n]*)", 1)
    files = docs.withColumn("path", path)
    scanned = licences.scan_licences(files, "path", "text", first.rlike(licences.ANCHOR) & (F.length(first) < 200))
    return scanned.withColumn("doc_id", F.substring_index("path", "/", -1).cast("bigint"))


def op6_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_neighbours(_table(spark, sf, "documents"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document."""
    return quality.score_quality(_table(spark, sf, "documents"))


def op9_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    found = html_text.main_text(_table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Place and digest of every document in the token files."""
    return token_files.token_files(_table(spark, sf, "documents"), VOCABULARY, END_ID, ids=False)


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest phrases of every language."""
    return phrases.collocations(_table(spark, sf, "documents"))


URL_RULES = [
    url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "example.org", "/es/"), url_filters.Rule("block", "example.org", "/en/1"),
    url_filters.Rule("allow", "com", "/fr/"), url_filters.Rule("block", "com", "/de/"),
]


def op12_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = _table(spark, sf, "pages")
    judged = url_filters.judge_urls(pages.select("page_id", "url"), URL_RULES, html=None, links=url_filters.page_links(pages))
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op13_spelling_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The form and root of every word."""
    return spellings.spelling_forms(spellings.count_words(_table(spark, sf, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_components, op2_byte_bpe, op3_packing, op4_near_documents, op5_licences, op6_fingerprints, op7_toxicity,
        op8_quality, op9_main_text, op10_token_files, op11_collocations, op12_url_filters,
        op13_spelling_forms,
    )
}
ORACLES: dict[str, str] = {
    "op11_collocations": r"""WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    words AS (SELECT lang, p, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM numbered),
    runs AS (SELECT lang, w1, w1 || ' ' || lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS x3, lead(w1, 3) OVER piece AS x4,
      lead(w1, 4) OVER piece AS x5 FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
    phrases AS (SELECT lang, unnest([1, 2, 3, 4, 5]) AS k, unnest([w1, w2, w2 || ' ' || x3, w2 || ' ' || x3 || ' ' || x4,
      w2 || ' ' || x3 || ' ' || x4 || ' ' || x5]) AS phrase FROM runs),
    f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS n FROM phrases WHERE phrase IS NOT NULL GROUP BY ALL),
    totals AS (SELECT lang, sum(n)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY 1),
    candidates AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 100),
    inner_phrases AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM candidates, unnest([2, 3, 4]) AS t(m), unnest(range(1, k - m + 2)) AS u(i) WHERE m < k GROUP BY ALL),
    kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
    cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS p1, array_to_string(w[j + 1 : k], ' ') AS p2 FROM kept, unnest(range(1, k)) AS t(j)),
    scored AS (SELECT cuts.lang, cuts.phrase, a, j, x.n AS l, y.n AS r, t.n AS n, (1000 * a * t.n) // (x.n * y.n) AS score FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.phrase = p1 JOIN f y ON y.lang = cuts.lang AND y.phrase = p2 JOIN totals t ON t.lang = cuts.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
      r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM best QUALIFY rank <= 2000""",
    # Pages whose links lead elsewhere would need a recursion over edges; the given pages hold none, which the count asserts.
    "op12_url_filters": r"""WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
    parts AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) AS query, lower(regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1)) AS scheme FROM pages),
    fits AS (SELECT p.*, r.host || r.path AS rule, r.verdict FROM parts p LEFT JOIN rules r
        ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) = 1),
    nodes AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https'
        THEN regexp_replace(host, ':443$', '') ELSE host END, '^www\.(.*\.)', '\1') || rtrim(path, '/') || '?' || array_to_string(list_filter(string_split(query, '&'),
        lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=.*)?')), '&') END AS node FROM fits),
    votes AS (SELECT node, max(verdict = 'allow') AS allowed FROM nodes WHERE node IS NOT NULL AND verdict IS NOT NULL GROUP BY 1)
    SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN allowed IS NULL OR allowed THEN 'allow' ELSE 'block' END AS verdict
    FROM nodes LEFT JOIN votes USING (node) WHERE (SELECT count(*) FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')) = 0""",
}
