"""Queries of this subpackage: one for each operator, over its whole table, with production parameters; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobledger.llm import decontaminate, embeddings, linededup, mixing, paragraphs, repeats, simhash, tokencount, toxicity, urlfilter
from jobledger.llm.tables import table

#: Weights of the mix's tree of domains, languages and sources; what is not named weighs 1 among its siblings.
DOMAINS = 4
LANGUAGES = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.5}
WEIGHTS = {("domain0",): 3.0, ("domain1",): 2.0, **{(f"domain{d}", k): w for d in range(DOMAINS) for k, w in LANGUAGES.items()}, ("domain0", "en", "src0"): 3.0}


def levels() -> list:
    """The tree's columns.  The tables have no domain, so a source's follows from the CRC-32 of its name."""
    domain = F.concat(F.lit("domain"), (F.crc32(F.coalesce(F.col("source"), F.lit(""))) % DOMAINS).cast("string"))
    return [domain, "lang", "source"]


MODEL = "piece_bpe_32k.model"


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), levels(), WEIGHTS, tokens_col="n_taken")
    return mixed.select("doc_id", levels()[0].alias("domain"), "lang", "source", mixing.token_estimate().alias("n_tokens"), "copies", "n_taken")


def contaminated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def paragraph_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.near_duplicates(table(spark, sf_dir, "documents"))


def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    kept = linededup.drop_boilerplate(docs, dropped_col="n_dropped")
    return kept.select("doc_id", "n_dropped", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5("text").alias("kept_md5"))


def simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: The tables carry neither fetch times nor a dated list, so both follow from the rows by fixed rules: a capture's
#: date from its page_id, and for every host entries on days that its MD5 names (a third of hosts are never listed).
def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetch_date", F.expr("date_add(DATE '2023-01-01', cast(page_id % 730 as int))"))


def dated_list(pages: DataFrame) -> DataFrame:
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host is not null").distinct().withColumn("m", F.md5("host"))
    digit = lambda k: F.ascii(F.substring("m", k, 1))
    rows = [F.struct(F.expr(f"date_add(DATE '2023-01-01', {days})").alias("d"), F.lit(action).alias("action"), F.lit(cat).alias("category")) for days, action, cat in ((60, "add", "spam"), (200, "remove", "spam"), (400, "add", "malware"))]
    chosen = F.filter(F.array(*rows), lambda r: (digit(1) % 3 != 0) & ((r["category"] == "spam") | (digit(2) % 2 == 0)))
    return hosts.select("host", "m", F.explode(chosen).alias("r")).select("host", F.date_add(F.col("r.d"), digit(3) % 30).alias("entry_date"), "r.action", "r.category")


def filtered_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captures(spark, sf_dir)
    return urlfilter.filter_captures(pages, dated_list(pages)).select("page_id", "fetch_date", "listed_host", "listed_category", "blocked")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity_scores,
        "op2_token_counts": token_counts,
        "op3_source_mix": source_mix,
        "op4_decontamination": contaminated_documents,
        "op5_paragraph_dedup": paragraph_duplicates,
        "op6_substring_repeats": repeated_substrings,
        "op7_embedding_dedup": embedding_duplicates,
        "op8_line_dedup": boilerplate_lines,
        "op9_simhash": simhash_duplicates,
        "op10_url_filter": filtered_captures,
        "pipeline": pipeline,
    }


LINE_DEDUP_SQL = r"""
WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT source, line FROM (SELECT source, unnest(list_distinct(parts)) AS line FROM l) WHERE trim(line) <> ''),
n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT u.source, u.line FROM u JOIN n ON u.source IS NOT DISTINCT FROM n.source
      GROUP BY u.source, u.line HAVING count(*) >= 10 AND count(*) > any_value(n.pages) * CAST(0.05 AS DOUBLE)),
g AS (SELECT source, list(line) AS gone FROM b GROUP BY source),
k AS (SELECT l.doc_id, l.parts, CASE WHEN g.gone IS NULL THEN l.parts ELSE list_filter(l.parts, lambda x: NOT list_contains(g.gone, x)) END AS kept
      FROM l LEFT JOIN g ON l.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(coalesce(len(parts) - len(kept), 0) AS BIGINT) AS n_dropped,
       CAST(coalesce(strlen(CASE WHEN parts IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END), 0) AS BIGINT) AS n_bytes,
       md5(CASE WHEN parts IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END) AS kept_md5
FROM k
"""

URL_FILTER_SQL = r"""
WITH p AS (SELECT page_id, CAST(DATE '2023-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS fetch_date,
           nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '') AS host FROM pages),
h AS (SELECT DISTINCT host, ascii(substr(md5(host), 1, 1)) AS a, ascii(substr(md5(host), 2, 1)) AS b, ascii(substr(md5(host), 3, 1)) % 30 AS c FROM p WHERE host IS NOT NULL),
e AS (SELECT host, DATE '2023-01-01' + CAST(60 + c AS INTEGER) AS d, 'add' AS action, 'spam' AS category FROM h WHERE a % 3 <> 0
      UNION ALL SELECT host, DATE '2023-01-01' + CAST(200 + c AS INTEGER), 'remove', 'spam' FROM h WHERE a % 3 <> 0
      UNION ALL SELECT host, DATE '2023-01-01' + CAST(400 + c AS INTEGER), 'add', 'malware' FROM h WHERE a % 3 <> 0 AND b % 2 = 0),
v AS (SELECT host, d, lead(d) OVER (PARTITION BY host ORDER BY d) AS until, action, category FROM e),
i AS (SELECT * FROM v WHERE action = 'add'),
m AS (SELECT p.page_id, i.host, i.category, row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.host) DESC) AS r
      FROM (SELECT page_id, fetch_date, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p WHERE host IS NOT NULL) p
      JOIN i ON array_to_string(list_slice(string_split(p.host, '.'), k, 999), '.') = i.host AND p.fetch_date >= i.d AND (i.until IS NULL OR p.fetch_date < i.until))
SELECT p.page_id, p.fetch_date, m.host AS listed_host, m.category AS listed_category, m.host IS NOT NULL AS blocked
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.r = 1
"""

EMBEDDING_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS root FROM r GROUP BY x),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, coalesce(c.root, v.vec_id) AS component_id, v.vec_id = coalesce(c.root, v.vec_id) AS kept
FROM v LEFT JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


CONTAMINATION_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win
      FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM g),
o AS MATERIALIZED (SELECT x.doc_id, x.k, x.n, g.item
      FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)) x JOIN g ON g.n = x.n AND g.win = x.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": CONTAMINATION_SQL, "op7_embedding_dedup": EMBEDDING_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op10_url_filter": URL_FILTER_SQL}
