"""One query for each operator, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, ngram_join, packing, perspectives, pii, quality_rules, token_counts, token_files, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.components(_table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i:i + least(4, len(ws)) - 1] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
l AS (SELECT a, count(*) AS m FROM e GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(l.m, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) AS m ON d.doc_id = m.doc_id LEFT JOIN l ON d.doc_id = l.a
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"), size=2048, end_id=0)
    return out.select(F.col("_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(_table(spark, sf_dir, "documents"), tokens.default_path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, manifest).withColumnRenamed("_id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.with_counts(_table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    add = lambda column: F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit = add("ends") - add("starts")
    return found.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, ws[i:i + least(10, len(ws)) - 1] AS k FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, ws[i:i + size - 1] AS k FROM (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(size)) AS o FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i:i + 4] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) > 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(5) AS r(o) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN l ON d.doc_id = l.doc_id LEFT JOIN rep ON d.doc_id = rep.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
f AS (SELECT *, (base_failed OR 100 * n_symbols > 10 * word_chars OR n_dup_lines > 3) AS failed FROM b),
h AS (SELECT source, count(*) AS docs, sum(CAST(failed AS BIGINT)) AS fails FROM f GROUP BY source),
s AS (SELECT count(*) AS k, sum(fails) / sum(docs) AS mean, var_samp(fails / docs) AS v, avg(1.0 / docs) AS r FROM h),
p AS (SELECT k, mean, CASE WHEN v - mean * (1 - mean) * r > 0 THEN mean * (1 - mean) / (v - mean * (1 - mean) * r) - 1 ELSE 0 END AS w FROM s),
q AS (
  SELECT CASE WHEN k < 2 OR mean <= 0 OR mean >= 1 THEN greatest(mean, 0.001) * 20 ELSE mean * CASE WHEN w > 0 THEN w ELSE 20 END END AS a,
    CASE WHEN k < 2 OR mean <= 0 OR mean >= 1 THEN greatest(1 - mean, 0.001) * 20 ELSE (1 - mean) * CASE WHEN w > 0 THEN w ELSE 20 END END AS b FROM p),
bad AS (SELECT source FROM h, q WHERE source IS NOT NULL AND (fails + a) / (docs + a + b) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad))) AS kept
FROM f
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    kinds = F.array(*(F.lit(k) for k in pii.KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(kinds, c["kind"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda c: c["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select(F.col("_id").alias("doc_id"), *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perspectives.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string"))), ",")
    return out.select(F.col("_id").alias("conv_id"), "part", "perspective", "n_turns", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), spans.alias("mask"))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, role, coalesce(role, 'unknown') AS name, regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text, turn FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, text) - 1 AS n FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM o WHERE role <> 'system'),
r AS (
  SELECT p.conv_id, p.perspective, o.n, coalesce(o.role = p.perspective, false) AS own,
    '<|im_start|>' || CASE WHEN o.role = p.perspective THEN 'assistant' WHEN o.role = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(regexp_replace(o.name, '<(\\*)\|', '<\\\1|', 'g'), '[\r\n]', ' ', 'g') END || chr(10) AS head,
    o.text || '<|im_end|>' AS body
  FROM p JOIN o ON p.conv_id = o.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
g AS (
  SELECT conv_id, n // 1000 AS part, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY n) AS text,
    string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(pos + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY n) FILTER (own) AS mask
  FROM s GROUP BY conv_id, part, perspective)
SELECT conv_id, CAST(part AS BIGINT) AS part, perspective, n_turns, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256, coalesce(mask, '') AS mask FROM g
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(_table(spark, sf_dir, "pages"), min_dedup_bytes=100)
    return warc.read(spark, manifest).withColumnRenamed("_id", "page_id")


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_packing": op2_packing,
        "op3_language_id": op3_language_id,
        "op4_token_files": op4_token_files,
        "op5_decontamination": op5_decontamination,
        "op6_quality_rules": op6_quality_rules,
        "op7_pii": op7_pii,
        "op8_token_counts": op8_token_counts,
        "op9_perspectives": op9_perspectives,
        "op10_warc": op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": OP1_SQL,
        "op5_decontamination": OP5_SQL,
        "op6_quality_rules": OP6_SQL,
        "op9_perspectives": OP9_SQL,
        "op10_warc": OP10_SQL,
    }
