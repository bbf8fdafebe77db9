"""Entity resolution: ordered distinct, lineage unions, merges by key, folds, candidates, components, votes on fields.

Every table carries an ordinal column; first-seen order always means that column's, never the physical one.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share; a local session gets a temporary one."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_distinct(df: DataFrame, by: list[str], value: str, ord_col: str) -> DataFrame:
    """Distinct trimmed values within ``by``, each with its first original and first ordinal; blanks stay."""
    return (
        df.groupBy(*by, F.trim(value).alias("key"))
        .agg(F.min_by(value, ord_col).alias("first_value"), F.min(ord_col).alias("first_ord"))
    )


def in_order(value: Column | str, ord_col: str) -> Column:
    """All values of a group as an array in ordinal order, ties by value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), value.alias("v")))), lambda x: x["v"])


def dedup_lineage(facts: DataFrame, by: list[str], text: str, source: str, ord_col: str) -> DataFrame:
    """Facts with equal trimmed text as one: the first original, the ordered union of the sources, the first ordinal.

    A hot fact is reduced map-side to one row per source first, so no task gathers its repetitions.
    """
    per_source = facts.groupBy(*by, F.trim(text).alias("fact"), F.col(source).alias("__s")).agg(
        F.min(F.struct(F.col(ord_col).alias("o"), F.col(text).alias("t"))).alias("__f")
    )
    return (
        per_source.groupBy(*by, "fact")
        .agg(F.min("__f").alias("__first"), F.array_sort(F.collect_list(F.struct(F.col("__f.o").alias("o"), F.col("__s").alias("v")))).alias("__all"))
        .select(*by, "fact", F.col("__first.t").alias("text"), F.col("__first.o").alias("first_ord"), F.transform("__all", lambda x: x["v"]).alias("sources"))
    )


def merge_by_key(entities: DataFrame, key: str, ord_col: str, id_col: str) -> DataFrame:
    """Adds ``group_id``, the first id with the same non-blank key; rows with a blank key stay alone."""
    firsts = entities.where(F.col(key) != "").groupBy(F.col(key).alias("__k")).agg(F.min_by(id_col, F.struct(ord_col, id_col)).alias("__g"))
    out = entities.join(firsts, F.col(key) == F.col("__k"), "left")
    return out.withColumn("group_id", F.coalesce("__g", id_col)).drop("__k", "__g")


def scope_rank(scope: Column | str) -> Column:
    scope = F.col(scope) if isinstance(scope, str) else scope
    return F.when(scope == "world", 2).when(scope == "regional", 1).when(scope == "personal", 0)


def broadest_scope(scope: str) -> Column:
    """The broadest scope of a group."""
    return F.element_at(F.array(F.lit("personal"), F.lit("regional"), F.lit("world")), F.max(scope_rank(scope)) + 1)


def first_stated(value: str, ord_col: str) -> Column:
    """The first value of a group that is not blank, trimmed."""
    stated = F.when(F.trim(value) != "", F.struct(F.col(ord_col), F.trim(value).alias("v")))
    return F.min(stated)["v"]


def majority(df: DataFrame, by: list[str], value: str, ord_col: str) -> DataFrame:
    """Per group: the value of a strict plurality, counted without case, in its first spelling; on a tie ``winner`` is
    null and ``vetoed`` true."""
    counts = df.where(F.trim(value) != "").groupBy(*by, F.lower(F.trim(value)).alias("__k")).agg(
        F.count("*").alias("__n"), F.min_by(value, F.struct(ord_col, value)).alias("__v")
    )
    top = counts.groupBy(*by).agg(F.max("__n").alias("__top"), F.count("*").alias("n_values"))
    led = counts.join(top, by).where("__n = __top").groupBy(*by).agg(
        F.count("*").alias("__leaders"), F.min("__v").alias("__w"), F.max("__top").alias("n_votes"), F.max("n_values").alias("n_values")
    )
    return led.select(*by, F.when(F.col("__leaders") == 1, F.col("__w")).alias("winner"), (F.col("__leaders") > 1).alias("vetoed"), "n_votes", "n_values")


def short_name_veto(members: DataFrame, group: str, member: str, name: str, aliases: str, short: int = 3) -> DataFrame:
    """Per group whether its merge is refused: a name of at most ``short`` characters is in it, the names differ, and no
    member's name is among another member's aliases."""
    key = F.lower(F.trim(name))
    facts = members.groupBy(group).agg(F.max(F.length(F.trim(name)) <= short).alias("has_short"), (F.min(key) != F.max(key)).alias("differ"))
    names = members.select(group, F.col(member).alias("__m"), key.alias("__k"))
    others = members.select(group, F.col(member).alias("__o"), F.explode(aliases).alias("__a")).withColumn("__a", F.lower(F.trim("__a")))
    stated = names.join(others, [group]).where("__k = __a AND __m <> __o").select(group).distinct().withColumn("__stated", F.lit(True))
    out = facts.join(stated, group, "left")
    return out.select(group, (F.col("has_short") & F.col("differ") & F.col("__stated").isNull()).alias("vetoed"))


def subset_folds(entities: DataFrame, block: list[str], id_col: str, tokens: str) -> DataFrame:
    """Folds by name: A into B where B is the one entity of the block whose tokens strictly contain A's.

    Found by an inverted index on tokens; an entity that is itself folded is no target. Returns block, ``frag``, ``target``.
    """
    base = entities.select(*block, F.col(id_col).alias("id"), F.array_distinct(tokens).alias("toks")).where(F.size("toks") > 0)
    base = base.withColumn("n", F.size("toks"))
    tall = base.select(*block, "id", "n", F.explode("toks").alias("tok"))
    small = tall.select(*block, F.col("id").alias("frag"), F.col("n").alias("n_f"), "tok")
    large = tall.select(*block, F.col("id").alias("target"), F.col("n").alias("n_t"), "tok")
    hits = small.join(large, [*block, "tok"]).where("frag <> target AND n_t > n_f").groupBy(*block, "frag", "target").agg(F.count("*").alias("m"), F.max("n_f").alias("n_f"))
    supers = hits.where("m = n_f").groupBy(*block, "frag").agg(F.min("target").alias("target"), F.count("*").alias("n_super"))
    folds = supers.where("n_super = 1").select(*block, "frag", "target")
    return folds.join(folds.select(*block, F.col("target").alias("frag")).distinct(), [*block, "frag"], "left_anti")


def candidate_pairs(names: DataFrame, ord_col: str, key: str, edits: int = 2, limit: int | None = 50) -> DataFrame:
    """Pairs of keys worth a look, i before j: within ``edits`` of each other (both of four characters or more), or the
    tokens of one inside the other's, or a shared rare token (four characters, in three names at most).

    Pairs are proposed by shared tokens and by deletion neighbourhoods (what is left of a key without up to ``edits``
    characters), which any two keys within ``edits`` share; no all-pairs join. ``limit`` keeps the first pairs in (i, j)
    order, as the report does.
    """
    base = names.select(F.col(ord_col).alias("o"), F.col(key).alias("k")).where(F.col("k") != "")
    toks = base.select("o", "k", F.array_distinct(F.split(F.regexp_replace("k", "^(the|a|an) ", ""), " ")).alias("t"))
    tall = toks.select("o", "k", "t", F.explode("t").alias("w"))
    cut = lambda arr: F.flatten(F.transform(arr, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda p: F.concat(F.left(s, p - 1), F.substring(s, p + 1, F.length(s))))))
    forms = F.array(F.col("k"))
    level = forms
    for _ in range(edits):
        level = cut(level)
        forms = F.concat(forms, level)
    near = toks.where(F.length("k") >= 4).select("o", "k", "t", F.explode(F.array_distinct(forms)).alias("w"))
    rare = tall.where(F.length("w") >= 4).groupBy("w").agg(F.count("*").alias("f")).where("f <= 3").select("w", F.lit(True).alias("rare"))

    def pairs(df: DataFrame) -> DataFrame:
        a = df.select("w", F.col("o").alias("i"), F.col("k").alias("ki"), F.col("t").alias("ti"))
        b = df.select("w", F.col("o").alias("j"), F.col("k").alias("kj"), F.col("t").alias("tj"))
        return a.join(b, "w").where("i < j AND ki <> kj")

    by_edit = pairs(near).select("i", "j", "ki", "kj", "ti", "tj", F.lit(False).alias("rare"))
    by_token = pairs(tall).join(rare, "w", "left").select("i", "j", "ki", "kj", "ti", "tj", F.coalesce("rare", F.lit(False)).alias("rare"))
    one = by_edit.unionByName(by_token).groupBy("i", "j").agg(*[F.first(c).alias(c) for c in ("ki", "kj", "ti", "tj")], F.max("rare").alias("rare"))
    close = (F.least(F.length("ki"), F.length("kj")) >= 4) & F.levenshtein("ki", "kj", edits).between(1, edits)
    inside = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))
    reason = F.when(close, "edit").when(inside("ti", "tj") | inside("tj", "ti"), "subset").when(F.col("rare"), "token")
    out = one.withColumn("reason", reason).where("reason IS NOT NULL").select("i", "j", "reason")
    return out.orderBy("i", "j").limit(limit) if limit is not None else out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) by label propagation with pointer jumping; each round is
    written to the shared folder."""
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.least("root", "r").alias("root"))
        jump = step.join(labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left")
        new = written(jump.select("node", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").isEmpty()
        labels = new
        if changed:
            return labels


def merge_components(members: DataFrame, group: str, member: str, cap: int = 8) -> DataFrame:
    """Overlapping groups as components of their members; components beyond ``cap`` members are not merged (each member
    stays its own), as the resolver's safety rule has it. Returns ``node``, ``root``, ``merged``."""
    first = members.groupBy(group).agg(F.min(member).alias("a"))
    links = members.join(first, group).select("a", F.col(member).alias("b"))
    found = components(links)
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    out = found.join(sizes, "root").withColumn("merged", F.col("n").between(2, cap))
    return out.select("node", F.when(F.col("merged"), F.col("root")).otherwise(F.col("node")).alias("root"), "merged")


def priority_join(entities: DataFrame, id_col: str, tiers: list[DataFrame], declared_col: str = "declared") -> DataFrame:
    """Union of tiers of (id, declared), the first tier that hits wins, ties by the smaller ``declared``."""
    every = None
    for k, tier in enumerate(tiers):
        rows = tier.select(id_col, declared_col, F.lit(k).alias("tier"))
        every = rows if every is None else every.unionByName(rows)
    best = every.groupBy(id_col).agg(F.min(F.struct("tier", declared_col)).alias("__b"))
    return entities.join(best, id_col, "left").withColumn("tier", F.col("__b.tier")).withColumn(declared_col, F.col(f"__b.{declared_col}")).drop("__b")


def cross_type_clusters(tall: DataFrame, key: str, kind: str, facts: str, kinds: list[str], exempt: tuple[str, ...] = ()) -> DataFrame:
    """Keys that entities of two kinds or more share (unless all are exempt kinds), with the winning kind: the one with
    the most facts, the earlier one of ``kinds`` on a tie."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    per = tall.groupBy(key, kind).agg(F.sum(facts).alias("__f"))
    out = per.groupBy(key).agg(
        F.array_sort(F.collect_set(kind)).alias("kinds"), F.max_by(kind, F.struct(F.col("__f"), (-order).alias("o"))).alias("winner"), F.sum("__f").alias("n_facts")
    )
    rest = F.size(F.array_except("kinds", F.array(*[F.lit(x) for x in exempt]).cast("array<string>")))
    return out.where((F.size("kinds") >= 2) & (rest > 0))


def guarded_map(pairs: DataFrame, key: str, value: str, taken: DataFrame, taken_col: str) -> DataFrame:
    """key to value where a key has one value only and is no name in ``taken``; keys and names are compared lower-cased."""
    one = pairs.groupBy(F.lower(F.trim(key)).alias("map_key")).agg(F.min(value).alias("map_value"), F.count_distinct(value).alias("__n"))
    names = taken.select(F.lower(F.trim(taken_col)).alias("map_key")).distinct()
    return one.where("__n = 1").drop("__n").join(names, "map_key", "left_anti")


def first_within(df: DataFrame, by: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
