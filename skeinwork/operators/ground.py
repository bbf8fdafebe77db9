"""Labels, batches, and joining quotes to the exact text that supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.text import norm_for_match

LABELS = ("lore", "mechanic", "noise", "ambiguous")


def attach_labels(messages: DataFrame, labels: DataFrame, on: list[str], label: str = "label", pos: str = "pos") -> DataFrame:
    """Adds ``label``: the last valid label of a message; a missing or unknown one is "ambiguous", never lost."""
    good = labels.where(F.lower(F.trim(label)).isin(*LABELS))
    last = good.groupBy(*on).agg(F.max(F.struct(F.col(pos), F.lower(F.trim(label)).alias("l"))).alias("__b"))
    return messages.join(last, on, "left").withColumn("label", F.coalesce("__b.l", F.lit("ambiguous"))).drop("__b")


def select_for_extraction(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("label").isin("lore", "ambiguous"))


def batches(df: DataFrame, size: int, order: list[str], by: list[str]) -> DataFrame:
    """Adds ``batch`` and ``local_id`` (both from 0) within ``by`` in ``order``."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("__rn", rn).withColumns({"batch": F.floor(F.col("__rn") / size).cast("bigint"), "local_id": (F.col("__rn") % size).cast("bigint")}).drop("__rn")


def global_batches(df: DataFrame, size: int, order: str, chunk: str) -> DataFrame:
    """As :func:`batches` over the whole table, without one task that sees all rows: rows are numbered within ``chunk``
    (a column that rises with ``order``) and chunk sizes are summed up."""
    w = Window.partitionBy(chunk).orderBy(order)
    sizes = df.groupBy(chunk).agg(F.count("*").alias("__n"))
    first = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rows = df.join(first, chunk).withColumn("__rn", F.row_number().over(w) - 1 + F.col("__first"))
    return rows.withColumns({"batch": F.floor(F.col("__rn") / size).cast("bigint"), "local_id": (F.col("__rn") % size).cast("bigint")}).drop("__rn", "__first")


def _grams(text: Column, n: int) -> Column:
    """Hashes of the distinct ``n``-word runs, from shifted copies of the words side by side."""
    words = F.split(text, " ")
    shifted = F.arrays_zip(*[F.slice(words, F.lit(k + 1), F.size(words)).alias(f"w{k}") for k in range(n)])
    runs = F.slice(shifted, F.lit(1), F.size(words) - (n - 1))
    return F.when(F.size(words) >= n, F.array_distinct(F.transform(runs, lambda x: F.xxhash64(*[x[f"w{k}"] for k in range(n)]))))


#: Short quotes are broadcast up to this number; more are looked up by characters.
MAX_BROADCAST_QUOTES = 10_000


def _by_rarest(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """``__q`` and ``__k`` of quotes and texts that have the quote's rarest gram in common; ``wanted`` (``__q``, ``__g``) are the
    quotes' grams, ``held`` (``__k``, ``__g``) the texts'."""
    held = held.join(wanted.select("__g").distinct(), "__g", "left_semi")
    freq = held.groupBy("__g").agg(F.count("*").alias("__f"))
    rare = wanted.join(freq, "__g", "left").groupBy("__q").agg(F.min(F.struct(F.coalesce("__f", F.lit(0)).alias("f"), F.col("__g").alias("g"))).alias("__r"))
    return held.join(rare.where("__r.f > 0").select("__q", F.col("__r.g").alias("__g")), "__g").select("__q", "__k").distinct()


def _char_grams(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.xxhash64(g)))


def containment_join(quotes: DataFrame, quote: str, texts: DataFrame, text: str, inner: int = 4, max_broadcast: int = MAX_BROADCAST_QUOTES) -> DataFrame:
    """All pairs of a quote and a text that holds it, both normalised; a blank quote is in none.

    A quote's words, its first and last left out (they may be parts of words), stand in the text as they are. So every
    quote of ``inner`` + 2 words or more is looked up by one hashed gram of its inner words among the texts' grams; the
    gram is the rarest one in the texts, so that common passages don't gather. Shorter quotes are names and fragments: up
    to ``max_broadcast`` distinct ones are broadcast and held against every text, more are looked up by their rarest run of
    three characters (or of their own length).
    """
    q = quotes.withColumn("__q", norm_for_match(quote)).where("__q <> ''")
    t = texts.withColumn("__t", norm_for_match(text)).withColumn("__k", F.sha2("__t", 256))
    words = F.split("__q", " ")
    q = q.withColumn("__inner", F.when(F.size(words) >= inner + 2, F.array_join(F.slice(words, F.lit(2), F.size(words) - 2), " ")))
    wanted = q.where("__inner IS NOT NULL").select("__q", F.explode(_grams(F.col("__inner"), inner)).alias("__g")).distinct()
    found = _by_rarest(wanted, t.select("__k", F.explode(_grams(F.col("__t"), inner)).alias("__g")))
    fragments = q.where("__inner IS NULL").select("__q").distinct()
    if fragments.limit(max_broadcast + 1).count() <= max_broadcast:
        texts_once = t.select("__k", "__t").where("__t IS NOT NULL")
        found = found.unionByName(texts_once.join(F.broadcast(fragments), F.contains("__t", F.col("__q"))).select("__q", "__k").distinct())
    else:
        for n in (1, 2, 3):
            own = fragments.where(F.length("__q") >= 3 if n == 3 else F.length("__q") == n)
            found = found.unionByName(_by_rarest(own.select("__q", F.explode(_char_grams(F.col("__q"), n)).alias("__g")), t.select("__k", F.explode(_char_grams(F.col("__t"), n)).alias("__g"))))
    pairs = q.join(found, "__q").join(t, "__k").where(F.contains("__t", F.col("__q")))
    return pairs.select(*quotes.columns, *texts.columns)


def pick_support(pairs: DataFrame, quote_id: str, cited: str, text_id: str) -> DataFrame:
    """Per quote the text it cites if it is among its pairs, else the first one; ``ambiguous`` where more than one could."""
    best = pairs.groupBy(quote_id).agg(
        F.min(F.struct(F.when(F.col(cited) == F.col(text_id), 0).otherwise(1).alias("other"), F.col(text_id).alias("id"))).alias("__b"),
        F.count_distinct(text_id).alias("n_texts"),
    )
    return best.select(quote_id, F.col("__b.id").alias(text_id), (F.col("__b.other") == 0).alias("is_cited"), (F.col("n_texts") > 1).alias("ambiguous"))


def skeleton(c: Column | str) -> Column:
    """Lower-case ASCII letters and digits alone."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), "[^0-9a-z]", "")


def skeleton_join(quotes: DataFrame, quote: str, texts: DataFrame, text: str, size: int = 20) -> DataFrame:
    """All pairs of a quote and a text whose skeletons hold one another; a quote without a skeleton is in none.

    Texts' skeletons are cut into blocks of ``size`` characters. Wherever a quote of 2 * ``size`` - 1 characters or more
    stands, it covers a whole block, and from there on one at every ``size``-th of its positions. So it is looked up once
    for each of its first ``size`` positions, by the rarest block that would be there; a start of which one block is in no
    text is not looked up. Hashes only propose, the skeletons decide. Shorter quotes are held against all texts, as in
    :func:`containment_join`.
    """
    q = quotes.withColumn("__q", skeleton(quote)).where("__q <> ''")
    t = texts.withColumn("__t", skeleton(text)).withColumn("__k", F.xxhash64("__t"))
    is_long = F.length("__q") >= 2 * size - 1
    blocks = t.select("__k", F.explode(F.regexp_extract_all("__t", F.lit(f"(.{{{size}}})"), F.lit(1))).alias("__g"))
    blocks = blocks.select("__k", F.xxhash64("__g").alias("__g"))
    at = q.where(is_long).select("__q").distinct().select("__q", F.explode(F.sequence(F.lit(0), F.length("__q") - size)).alias("__p"))
    wanted = at.select("__q", (F.col("__p") % size).alias("__r"), F.xxhash64(F.substring("__q", F.col("__p") + 1, F.lit(size))).alias("__g"))
    held = blocks.join(wanted.select("__g").distinct(), "__g", "left_semi").distinct()
    freq = held.groupBy("__g").agg(F.count("*").alias("__f"))
    rare = wanted.join(freq, "__g", "left").groupBy("__q", "__r").agg(F.min(F.struct(F.coalesce("__f", F.lit(0)).alias("f"), F.col("__g").alias("g"))).alias("__b"))
    rare = rare.where("__b.f > 0").select("__q", F.col("__b.g").alias("__g"))
    found = held.join(rare, "__g").select("__q", "__k").distinct()
    by_block = q.where(is_long).join(found, "__q").join(t, "__k").where(F.contains("__t", F.col("__q")))
    by_all = q.where(~is_long).join(t, F.contains("__t", F.col("__q")))
    return by_block.select(*by_all.columns).unionByName(by_all).drop("__q", "__t", "__k")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests whose key the cache does not hold."""
    return requests.join(cache.select(key), key, "left_anti")
