"""Ordering on several calendars: ranks, gaps, placements, positions; and checks of order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNDATED = "(undated)"


def date_guard(parts: Column | str, text: Column | str, anchor_relative: Column) -> Column:
    """A dated event is usable if it is relative, or its text has no digits, or one of its parts is a number in it."""
    text = F.col(text) if isinstance(text, str) else text
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return anchor_relative | (F.size(numbers) == 0) | F.arrays_overlap(F.col(parts) if isinstance(parts, str) else parts, numbers)


def spine(dated: DataFrame, system: str, parts: str) -> DataFrame:
    """Adds ``rank``: equal dates share one, from 0, per calendar system."""
    return dated.withColumn("rank", (F.dense_rank().over(Window.partitionBy(system).orderBy(parts)) - 1).cast("bigint"))


def gaps(ranked: DataFrame, system: str) -> DataFrame:
    """``system``, ``gap`` 0..m for a system of m ranks, and the one gap of the undated system."""
    top = ranked.groupBy(system).agg((F.max("rank") + 1).alias("m"))
    out = top.select(F.col(system).cast("string").alias("system"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("gap"))
    one = ranked.sparkSession.range(1).select(F.lit(UNDATED).alias("system"), F.lit(0).cast("bigint").alias("gap"))
    return out.unionByName(one)


def valid_placements(placements: DataFrame, known_gaps: DataFrame, dated: DataFrame, event: str, order: list[str]) -> DataFrame:
    """Placements into a known gap of an event without a date; the first of each event."""
    ok = placements.join(known_gaps.select("system", "gap"), ["system", "gap"], "left_semi").join(dated.select(event), event, "left_anti")
    first = F.row_number().over(Window.partitionBy(event).orderBy(*order))
    return ok.withColumn("__rn", first).where("__rn = 1").drop("__rn")


def weave(ranked: DataFrame, placed: DataFrame, system: str, event: str, ord_col: str) -> DataFrame:
    """``event``, ``system``, ``position`` from 0: placed events stand before the rank that ends their gap, events of one
    rank in their own order."""
    a = ranked.select(F.col(event), F.col(system).alias("system"), F.col("rank").alias("k"), F.lit(1).alias("kind"), F.col(ord_col).alias("o"))
    b = placed.select(F.col(event), F.col("system"), F.col("gap").alias("k"), F.lit(0).alias("kind"), F.col("placement_pos").alias("o"))
    pos = F.row_number().over(Window.partitionBy("system").orderBy("k", "kind", "o", event)) - 1
    return a.unionByName(b).withColumn("position", pos.cast("bigint")).select(event, "system", "position")


def inversions(df: DataFrame, by: list[str], pos: str, rank: str) -> DataFrame:
    """Per group the pairs that stand in one order and rank in the other, and the pairs of all; equal ranks never count.

    Pairs are only counted, group by group over distinct (position, rank) cells with their sizes.
    """
    cells = df.groupBy(*by, F.col(pos).alias("p"), F.col(rank).alias("r")).agg(F.count("*").alias("n"))
    a, b = cells.alias("a"), cells.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("p").alias("p2"), F.col("r").alias("r2"), F.col("n").alias("n2"))
    on = [F.col(f"a.{c}") == F.col(f"__{c}") for c in by] + [F.col("a.p") < F.col("p2"), F.col("a.r") > F.col("r2")]
    found = a.join(b, on).groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.sum(F.col("a.n") * F.col("n2")).alias("inversions"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("n_ranked"))
    return sizes.join(found, by, "left").withColumn("inversions", F.coalesce("inversions", F.lit(0)).cast("bigint"))


def order_violations(df: DataFrame, by: list[str], order: list[str], key: str, strict: bool = False) -> DataFrame:
    """Per group the rows whose key is below (``strict``: not above) that of the row before, and the pairs looked at."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("__b", before).where("__b IS NOT NULL")
    bad = F.col(key) <= F.col("__b") if strict else F.col(key) < F.col("__b")
    return rows.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.count_if(bad).alias("n_violations"))


# Labels of calendars that are offsets from the present which were left as they are; they would sort backwards.
OFFSET_SYSTEM = r"(?i)years?\s+ago|before\s+present|\bago\b"


def valid_dates(dated: DataFrame, events: DataFrame) -> DataFrame:
    """The usable ones of dated rows (``index``, ``pos``, ``system``, ``parts``, ``anchor_relative``): an event that there is and that
    states a date (``events``: ``index``, ``date_text``), parts that are whole numbers from 0, a calendar with a name that is no
    offset, and a number of the date among the parts. Of several rows of an event the first sound one counts."""
    known = events.where(F.trim(F.coalesce("date_text", F.lit(""))) != "").select("index", "date_text")
    sound = (F.size("parts") > 0) & F.forall("parts", lambda x: F.coalesce(x >= 0, F.lit(False))) & (F.trim(F.coalesce("system", F.lit(""))) != "")
    rows = dated.join(known, "index").where(F.coalesce(sound, F.lit(False)))
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("index").orderBy("pos"))).where("__n = 1").drop("__n")
    moored = date_guard("parts", "date_text", F.coalesce("anchor_relative", F.lit(False)))
    return first.where(~F.col("system").rlike(OFFSET_SYSTEM) & F.coalesce(moored, F.lit(False)))


def gathered_placements(placements: DataFrame) -> DataFrame:
    """Placements (``ord``, ``gap_id``, ``pos``, ``index``) with one entry per gap: gaps in the order they come first, events of a gap
    once, in the order they come first. Returns ``gap_id``, ``gap_ord``, ``index``, ``at``."""
    firsts = placements.groupBy("gap_id").agg(F.min("ord").alias("gap_ord"))
    once = placements.groupBy("gap_id", "index").agg(F.min(F.struct("ord", "pos")).alias("at"))
    return once.join(firsts, "gap_id")


def order_history(events: DataFrame, dated: DataFrame, placements: DataFrame) -> DataFrame:
    """``events`` (``index``, ``date_text``) with ``calendar_system`` and ``chronological_position``.

    Usable dates make a spine per calendar; events without one are placed in its gaps ("system#k", before rank k) or in the
    one of the undated sequence ("(undated)#0"). An event counts in the first gap that names it; a gap that there is not, or
    an event that has a date, is passed over. What is in no gap has neither calendar nor position.
    """
    ranked = spine(valid_dates(dated, events), "system", "parts")
    known = gaps(ranked, "system").withColumn("gap_id", F.concat("system", F.lit("#"), F.col("gap").cast("string")))
    told = gathered_placements(placements).join(events.select("index"), "index", "left_semi").join(known, "gap_id")
    placed = valid_placements(told, known, ranked, "index", ["gap_ord", "at"])
    order = F.row_number().over(Window.partitionBy("system", "gap").orderBy("at"))
    woven = weave(ranked, placed.withColumn("placement_pos", order.cast("bigint")), "system", "index", "index")
    out = events.join(woven, "index", "left")
    return out.withColumn("calendar_system", F.when(F.col("system") != UNDATED, F.col("system"))).withColumnRenamed("position", "chronological_position").drop("system")
