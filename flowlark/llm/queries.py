"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    concat_cut,
    html_wrapper,
    jaccard_fragments,
    language_fusion,
    line_runs,
    ogg_media,
    secret_ownership,
    size_tiered,
    warc_chunks,
    winnowing,
)
from .shared import table


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = winnowing.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, with what their ownership says."""
    found = secret_ownership.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example"
    )


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and of every page."""
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    languages, model = language_fusion.fit(documents.select("text", "lang"))
    nothing = F.lit(None).cast("long")
    answer = ("lang", "confidence", "text_lang", "accepted")
    a = language_fusion.identify(language_fusion.document_evidence(documents), languages, model)
    b = language_fusion.identify(language_fusion.page_evidence(pages), languages, model, markup=True)
    return a.select(F.col("id").alias("doc_id"), nothing.alias("page_id"), *answer).unionByName(
        b.select(nothing.alias("doc_id"), F.col("id").alias("page_id"), *answer)
    )


def op5_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences."""
    return concat_cut.pack(table(spark, sf_dir, "documents")).drop("ids")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    found = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_jaccard_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard_fragments.similar_documents(table(spark, sf_dir, "documents"))


def op8_size_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in the compacted store."""
    return size_tiered.shard_rows(table(spark, sf_dir, "documents"))


def op9_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back."""
    return warc_chunks.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an Ogg file, read back."""
    return ogg_media.media_round_trip(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_wrapper, op2_winnowing, op3_secret_ownership, op4_language_fusion, op5_concat_cut,
        op6_line_runs, op7_jaccard_fragments, op8_size_tiered, op9_warc_chunks, op10_ogg_media,
    )
}

def _secret_sql() -> str:
    """Kinds as rows; positions from the lengths of pieces and matches, ownership from two counts."""
    secret = secret_ownership
    patterns = {"assign": secret.ASSIGN, "access": secret.ACCESS, "hex": secret.HEX, **secret.EXTRA, "generic": secret.GENERIC}
    quoted = {k: v.replace("'", "''") for k, v in patterns.items()}
    rows = ", ".join(f"('{k}', {i}, '{v}', {secret.LEAST.get(k, 0)})" for i, (k, v) in enumerate(quoted.items()))
    random = "(regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 8)"
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS x FROM documents),
p(kind, rank, pat, least) AS (VALUES {rows}),
m AS (SELECT rid, owner, kind, rank, least, regexp_extract_all(x, pat) AS ms, string_split_regex(x, pat) AS ps FROM t, p),
e AS (SELECT rid, owner, kind, rank, least, i, ms[i] AS hit, ps[i] AS pre FROM m, LATERAL (SELECT unnest(range(1, len(ms) + 1)) AS i)),
s AS (SELECT *, sum(length(pre) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS fin,
  CASE WHEN kind = 'assign' THEN regexp_extract(hit, '{quoted["assign"]}', 2) ELSE hit END AS value FROM e),
f AS (SELECT rid, owner, kind, rank, fin - length(hit) AS start, fin, value, {random} AS random FROM s
  WHERE length(value) >= least AND (kind <> 'generic' OR ({random} AND NOT regexp_matches(value, '^[0-9a-f]+$')))),
o AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT rid) AS repos FROM f GROUP BY value),
j AS (SELECT f.*, CASE WHEN owners >= {secret.EXAMPLE_OWNERS} OR repos >= {secret.EXAMPLE_REPOSITORIES} THEN 'example'
  WHEN owners = 1 AND random THEN 'live' ELSE 'unsure' END AS verdict FROM f JOIN o USING (value)),
k AS (SELECT *, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(fin AS VARCHAR) AS span FROM j WHERE kind <> 'generic' OR verdict = 'live'),
a AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example,
  string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE {base}) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM k GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN a USING (rid)"""


ORACLE_SQL: dict[str, str] = {
    "op3_secret_ownership": _secret_sql(),
    "op2_winnowing": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
n AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM n, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS s)),
ks AS (SELECT DISTINCT k FROM v),
g AS (SELECT doc_id, ks.k, s, array_to_string(w[s : s + ks.k - 1], ' ') AS win FROM d, ks, LATERAL (SELECT unnest(range(1, len(d.w) - ks.k + 2)) AS s)),
h AS (SELECT g.doc_id, g.s, g.k, v.item FROM g JOIN v ON g.k = v.k AND g.win = v.win),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS q FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op6_line_runs": r"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, n, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, n, line, coalesce(k.doc_id <> r.last, FALSE) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id""",
    "op7_jaccard_fragments": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM d, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, f.b FROM r JOIN f ON r.b = f.a)
SELECT r.a AS doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a""",
}
