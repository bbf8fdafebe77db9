"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows get global numbers 0..N-1 in an order that only their content decides. A Feistel network over Z_a x Z_b, with
a * b just above N, permutes the numbers; a value outside 0..N-1 goes through again until it falls inside. The position
p then gives shard p mod S and slot p div S, so shard sizes differ by one row at most (law ``rows``), and either
direction is computed without a lookup. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinwork.llm.common import written

ROUNDS = 6
#: Rows are numbered bucket by bucket; their number is fixed so that the order doesn't follow the cluster.
BUCKETS = 2048
_STEP = 1 << 16


def sides(n: int) -> tuple[int, int]:
    """a and b, near-equal, with n <= a * b < n + a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _half(v: Column, k: int, seed: int, m: int) -> Column:
    return F.pmod(F.xxhash64(v, F.lit(seed * ROUNDS + k).cast("bigint")), F.lit(m))


def feistel(df: DataFrame, col: str, a: int, b: int, seed: int) -> DataFrame:
    """Permutes ``col`` inside 0..a*b-1."""
    df = df.withColumns({"__l": F.expr(f"{col} div {b}L"), "__r": F.col(col) % F.lit(b)})
    for k in range(ROUNDS):
        x, y, m = ("__l", "__r", a) if k % 2 == 0 else ("__r", "__l", b)
        df = df.withColumn(x, (F.col(x) + _half(F.col(y), k, seed, m)) % F.lit(m))
    return df.withColumn(col, F.col("__l") * F.lit(b) + F.col("__r")).drop("__l", "__r")


def unfeistel(df: DataFrame, col: str, a: int, b: int, seed: int) -> DataFrame:
    """The inverse of :func:`feistel`."""
    df = df.withColumns({"__l": F.expr(f"{col} div {b}L"), "__r": F.col(col) % F.lit(b)})
    for k in reversed(range(ROUNDS)):
        x, y, m = ("__l", "__r", a) if k % 2 == 0 else ("__r", "__l", b)
        df = df.withColumn(x, F.pmod(F.col(x) - _half(F.col(y), k, seed, m), F.lit(m)))
    return df.withColumn(col, F.col("__l") * F.lit(b) + F.col("__r")).drop("__l", "__r")


def longest_walk(spark: SparkSession, n: int, seed: int, step=feistel) -> int:
    """The most steps that any number below ``n`` needs: one more than the longest stay outside. It is found by walking
    the fewer than sqrt(n) + 1 outside values alone, so no row is ever left outside.

    Each step's values are written: a filter over several nested steps would be pushed down through all of them, and its
    expression grow with a power of their number. A value that only meets other outside values is never met from inside.
    """
    a, b = sides(n)
    left = spark.range(n, a * b).select(F.col("id").alias("x"))
    for k in range(1, a * b - n + 1):
        left = written(step(left, "x", a, b, seed), "shard-walk").where(F.col("x") >= n)
        if left.isEmpty():
            return k + 1
    return a * b - n + 1


def permute(df: DataFrame, col: str, n: int, seed: int, walk: int, step=feistel) -> DataFrame:
    """Permutes the numbers 0..n-1 in ``col`` by cycle walking with at most ``walk`` steps."""
    a, b = sides(n)
    df = step(df, col, a, b, seed)
    for _ in range(walk - 1):
        df = step(df.withColumn("__was", F.col(col)), col, a, b, seed)
        df = df.withColumn(col, F.when(F.col("__was") < n, F.col("__was")).otherwise(F.col(col))).drop("__was")
    return df


def shard_rows(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240, buckets: int = BUCKETS
) -> DataFrame:
    """One row per document: ``id_col``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``row_no``, ``law`` ("rows"),
    ``shard``, ``slot``, ``grown_shard`` (null: the law gives no promise for another shard count).

    A null text counts as empty (size 1, crc 0); null and repeated ids are rows like others. Rows equal in id, size and
    crc are interchangeable, so they are counted first and numbered as a block: a hot document is one row until its
    numbers are dealt out, in steps over many tasks. The numbers, and so the shuffle, depend on the content, ``seed``
    and ``buckets`` alone. An empty table gives none.
    """
    return _placed(docs, shards, id_col, text_col, seed, buckets, {})


def _placed(docs: DataFrame, shards: int, id_col: str, text_col: str, seed: int, buckets: int, more: dict[str, Column]) -> DataFrame:
    """As :func:`shard_rows`; ``more`` are further columns of the key, which order rows that are equal without them."""
    spark = docs.sparkSession
    body = F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b""))
    key = [id_col, "size", "text_crc32", *more]
    rows = docs.select(F.col(id_col), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"), *[x.alias(c) for c, x in more.items()])
    bucket = F.pmod(F.xxhash64(*key[:3]), F.lit(buckets)).cast("int")
    same = written(rows.groupBy(*key).agg(F.count("*").alias("__n")).withColumn("__bucket", bucket), "shard-rows")
    counts = {r["__bucket"]: r["n"] for r in same.groupBy("__bucket").agg(F.sum("__n").alias("n")).collect()}  # <= buckets rows
    total, starts = 0, []
    for k in range(buckets):
        starts.append((k, total))
        total += counts.get(k, 0)
    start = spark.createDataFrame(starts, "__bucket int, __start bigint")
    before = Window.partitionBy("__bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(before), F.lit(0)) + F.col("__start")
    numbered = same.join(F.broadcast(start), "__bucket").withColumn("__first", first)
    blocks = numbered.withColumn("__step", F.explode(F.expr(f"sequence(0L, (__n - 1L) div {_STEP}L)")))
    blocks = blocks.withColumn("__lo", F.col("__step") * _STEP)
    each = F.explode(F.expr(f"sequence(__first + __lo, __first + least(__n, __lo + {_STEP}L) - 1L)"))
    out = blocks.select(*key, each.alias("row_no")).withColumn("__p", F.col("row_no"))
    out = permute(out, "__p", total, seed, longest_walk(spark, total, seed)) if total else out
    return out.select(
        *key,
        "row_no",
        F.lit("rows").alias("law"),
        (F.col("__p") % shards).cast("int").alias("shard"),
        F.expr(f"__p div {shards}L").alias("slot"),
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )


def row_numbers(places: DataFrame, n: int, shards: int = 8, seed: int = 20240) -> DataFrame:
    """Adds ``row_no`` to rows of ``shard`` and ``slot``: the inverse of the shuffle of ``n`` rows."""
    spark = places.sparkSession
    out = places.withColumn("row_no", F.col("slot").cast("bigint") * shards + F.col("shard"))
    return permute(out, "row_no", n, seed, longest_walk(spark, n, seed, unfeistel), unfeistel)


#: Rows of a file of :func:`write_shards`, about.
ROWS_A_FILE = 1 << 20


def write_shards(
    docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 20240, rows_a_file: int = ROWS_A_FILE
) -> None:
    """Writes id, text and slot to ``path``/shard=K, each shard's files in slot order, at the places of :func:`shard_rows`.

    Texts are told apart by SHA-256, so rows equal in id, size and crc32 keep their own texts. Null ids and texts are
    written as they are; an empty table writes no rows.
    """
    digest = F.sha2(F.coalesce(F.encode(F.col(text_col).cast("string"), "utf-8"), F.lit(b"")), 256)
    key = {"__digest": digest, "__null": F.col(text_col).isNull()}
    placed = _placed(docs, shards, id_col, text_col, seed, BUCKETS, key)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col), digest.alias("__text_digest"), F.col(text_col).isNull().alias("__text_null"))
    texts = texts.dropDuplicates(["__id", "__text_digest", "__text_null"])
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__text_digest")) & (F.col("__null") == F.col("__text_null"))
    rows = placed.join(texts, same).select(id_col, text_col, "shard", "slot")
    files = shards * max(1, -(-docs.count() // (shards * rows_a_file)))
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
