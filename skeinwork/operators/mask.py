"""Hiding what came from excluded sources only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_public(sources: Column, excluded: list[str]) -> Column:
    """Whether a source is not excluded; no sources: hidden."""
    gone = F.array(*[F.lit(x) for x in excluded]).cast("array<string>")
    return F.size(F.array_except(F.coalesce(sources, F.expr("array()").cast("array<string>")), gone)) > 0


def mask_facts(facts: DataFrame, sources: str, excluded: list[str]) -> DataFrame:
    """Facts with a public source; the excluded ones are gone from their lineage."""
    gone = F.array(*[F.lit(x) for x in excluded]).cast("array<string>")
    return facts.where(is_public(F.col(sources), excluded)).withColumn(sources, F.filter(sources, lambda s: ~F.array_contains(gone, s)))


def mask_entities(entities: DataFrame, excluded: list[str]) -> DataFrame:
    """Entities as public sources alone tell them.

    Columns: ``name``, ``name_sources``, ``aliases`` and ``details`` (arrays of text and source_files), ``quotes`` (array
    of text, speaker and source_file), ``prose``. Facts, aliases and quotes without a public source go, entities without
    a fact or quote too. A name without one gives way to the first public alias, without which the entity goes. Prose is
    dropped: it may tell hidden facts.
    """
    gone = F.array(*[F.lit(x) for x in excluded]).cast("array<string>")
    keep = lambda x: is_public(x["source_files"], excluded)
    out = entities.withColumns(
        {
            "aliases": F.filter("aliases", keep),
            "details": F.filter("details", keep),
            "quotes": F.filter("quotes", lambda q: ~F.array_contains(gone, q["source_file"])),
            "prose": F.lit(None).cast("string"),
        }
    ).where((F.size("details") > 0) | (F.size("quotes") > 0))
    named = is_public(F.col("name_sources"), excluded)
    out = out.where(named | (F.size("aliases") > 0)).withColumn("__n", named)
    return out.withColumns(
        {
            "name": F.when(F.col("__n"), F.col("name")).otherwise(F.get("aliases", F.lit(0))["text"]),
            "name_sources": F.when(F.col("__n"), F.col("name_sources")).otherwise(F.get("aliases", F.lit(0))["source_files"]),
            "aliases": F.when(F.col("__n"), F.col("aliases")).otherwise(F.slice("aliases", F.lit(2), F.greatest(F.size("aliases"), F.lit(1)))),
        }
    ).drop("__n")


def check_exclusions(files: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Problems of an exclusion list: ``name`` and ``problem`` ("duplicate" base names, "unknown" names)."""
    spark = files.sparkSession
    twice = files.groupBy(name).agg(F.count("*").alias("n")).where("n > 1").select(F.col(name).alias("name"), F.lit("duplicate").alias("problem"))
    asked = spark.createDataFrame([(x,) for x in wanted], "name string")
    unknown = asked.join(files.select(F.col(name).alias("name")), "name", "left_anti").select("name", F.lit("unknown").alias("problem"))
    return twice.unionByName(unknown)
