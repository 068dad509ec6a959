"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontam, jaccard, licenses, linecrf, mixing, quality, secrets, suffixlm, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.contract(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contract(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(table(spark, sf_dir, "documents"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlm.contract(table(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linecrf.contract(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.contract(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item_id, w, least(8, len(w)) AS size, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS pos FROM i WHERE item_id IS NOT NULL AND len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[pos : pos + size - 1], ' ') AS gram FROM p),
sizes AS (SELECT DISTINCT size FROM windows),
g AS (SELECT row, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
hits AS (SELECT row, pos, size, item_id FROM (SELECT row, pos, size, array_to_string(w[pos : pos + size - 1], ' ') AS gram FROM g) JOIN windows USING (size, gram)),
covered AS (SELECT row, count(DISTINCT x) AS n FROM (SELECT row, unnest(range(pos, pos + size)) AS x FROM (SELECT DISTINCT row, pos, size FROM hits)) GROUP BY 1),
items AS (SELECT row, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (max(a.n) + max(b.n) - count(*))),
r AS (SELECT doc_id, doc_id AS of FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.of)
SELECT doc_id, len(s.s) AS n_shingles, component_id FROM s JOIN (SELECT doc_id, min(of) AS component_id FROM r GROUP BY 1) USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express. The others fit models, or return spans and verdicts of one: tests hold them
    against plain versions."""
    return {"op2_decontamination": DECONTAMINATION, "op4_warc": WARC, "op10_jaccard_join": JACCARD}
