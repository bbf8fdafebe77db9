"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import (
    bpe,
    decontaminate,
    licenses,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    url_filter,
    warc,
)

#: The tokenizer file and the split pattern of the production query; both are parameters of the operator.
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        "coverage",
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return records.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs)
    base = F.filter("pii_spans", lambda s: s["ord"] < len(pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[pii.count_of(k.name).alias(f"n_{k.name}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("pii_spans")).alias("spans"),
        F.array_max(F.transform("pii_spans", lambda s: s["score"])).alias("max_score"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer_path(), tokenizer_pattern(), keep=["doc_id"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs, keep=["doc_id"])


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.train()).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs, keep=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_pii": op3_pii,
    "op4_near_dedup": op4_near_dedup,
    "op5_shard": op5_shard,
    "op6_bpe": op6_bpe,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_licenses": op10_licenses,
}
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, k, k + 9), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
p AS (SELECT r, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS g
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS (SELECT DISTINCT r, k, p.size, item_id FROM p JOIN g ON p.g = g.g AND p.size = g.size),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r),
l AS (SELECT r, max(size) AS longest FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated, CASE WHEN len(w) > 0 THEN CAST(coalesce(n_hit, 0) AS DOUBLE) / len(w) ELSE 0.0 END AS coverage
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha1(body), CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM p""",
    "op4_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
}
