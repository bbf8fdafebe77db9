"""Reconciling the entities of a type: merge decisions are checked, salvaged and applied, then fixed rules merge on.

Entities are one tall table: ``entity_type``, ``ord`` (an array of longs that sorts), ``name``, ``name_sources``, ``aliases``,
``details``, ``quotes``, ``is_pc``, ``player_name``, ``pronouns``, ``description``, ``scope``, ``date_text``. Every step takes all
types at once. A merge rather fails than goes too far: what is vetoed stays as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.text import name_key, strip_article, strip_ws
from skeinwork.operators.extract import empty
from skeinwork.operators.resolve import broadest_scope, components, first_stated, in_order, majority, short_name_veto, written

COLUMNS = ("entity_type", "ord", "name", "name_sources", "aliases", "details", "quotes", "is_pc", "player_name", "pronouns", "description", "scope", "date_text")
#: Components of overlapping groups beyond this are taken for a runaway chain, and fuzzy folds spare shorter names.
COMPONENT_CAP, SHORT, TYPO_CHARS = 8, 3, 4
# Types whose names are no evidence, the order of types in a conflict, and the pair that may share a name.
UNNAMED_TYPES = ("history",)
CONFLICT_ORDER = ("locations", "organizations", "people", "characters", "items")
REALM_TYPES = ("locations", "organizations")

_FACT = "struct<text:string,source_files:array<string>>"
_QUOTE = "struct<text:string,speaker:string,source_file:string>"


def _same(keys: list[str], left: str = "", right: str = "__") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in keys])


def surface_rows(entities: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``k`` (-1 for the name), ``text``, ``sources`` of every name and alias."""
    own = entities.select(*keys, F.lit(-1).alias("k"), F.col("name").alias("text"), F.col("name_sources").alias("sources"))
    other = entities.select(*keys, F.posexplode("aliases").alias("k", "a")).select(*keys, "k", F.col("a.text").alias("text"), F.col("a.source_files").alias("sources"))
    return own.unionByName(other)


def lineage_arrays(rows: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Facts (``text``, ``sources``, ``order``) with equal trimmed texts as one, with the ordered union of their sources, as an
    array per group. A fact that repeats is one row per source before it is gathered."""
    tall = rows.select(*by, "text", F.col(order).alias("__o"), F.posexplode_outer("sources").alias("__p", "__s"))
    per = tall.groupBy(*by, strip_ws("text").alias("__k"), strip_ws("__s").alias("__sk")).agg(F.min(F.struct("__o", "__p", "__s", "text")).alias("__f"))
    heard = F.filter(F.array_sort(F.collect_list(F.struct("__f.__o", "__f.__p", "__f.__s"))), lambda x: x["__s"].isNotNull())
    one = per.groupBy(*by, "__k").agg(F.min(F.struct("__f.__o", "__f.text")).alias("__f"), F.transform(heard, lambda x: x["__s"]).alias("__s"))
    fact = F.struct(F.col("__f.text").alias("text"), F.col("__s").alias("source_files"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__f.__o").alias("o"), fact.alias("f")))), lambda x: x["f"]).alias(out))


def canonical_names(members: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``heading``, ``heading_sources``: ``canonical`` as a member spells it, in a name rather than in an alias, with the
    sources of all that state just that; as it is if no member does."""
    said = surface_rows(members, [*by, "pos"]).withColumn("__key", name_key("text"))
    asked = members.withColumn("__w", F.struct("canonical", name_key("canonical").alias("__want"))).groupBy(*by).agg(F.min_by("__w", "pos").alias("__w"))
    asked = asked.select(*[F.col(c).alias(f"__{c}") for c in by], "__w.canonical", "__w.__want")
    found = said.join(asked, _same(by)).where("__key = __want").groupBy(*by).agg(F.min_by("text", F.struct((F.col("k") >= 0).alias("a"), "pos", "k")).alias("__text"))
    heads = asked.select(*[F.col(f"__{c}").alias(c) for c in by], "canonical").join(found, by, "left").select(*by, F.coalesce("__text", "canonical").alias("heading"))
    named = heads.select(*[F.col(c).alias(f"__{c}") for c in by], "heading")
    tall = said.join(named, _same(by)).where(strip_ws("text") == strip_ws("heading")).select(*by, "pos", "k", F.posexplode("sources").alias("p", "s"))
    firsts = tall.groupBy(*by, strip_ws("s").alias("__s")).agg(F.min(F.struct("pos", "k", "p", "s")).alias("f"))
    sources = firsts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["s"]).alias("heading_sources"))
    return heads.join(sources, by, "left").withColumn("heading_sources", F.coalesce("heading_sources", empty("string")))


def players(members: DataFrame, by: list[str], allow_majority: bool) -> DataFrame:
    """``by``, ``player_name``, ``vetoed``: one name, or with ``allow_majority`` the one most members have; else a veto."""
    named = members.where(F.coalesce("player_name", F.lit("")) != "")
    led = majority(named, by, "player_name", "pos").select(*by, "winner", "vetoed")
    if not allow_majority:
        many = named.groupBy(*by).agg((F.count_distinct(strip_ws("player_name")) > 1).alias("vetoed"), F.min_by("player_name", "pos").alias("winner"))
        led = many.select(*by, "winner", "vetoed")
    return led.withColumnRenamed("winner", "player_name")


def combine(members: DataFrame, by: list[str], allow_majority: bool = False) -> DataFrame:
    """One row per group of ``members`` (an entity each, with ``pos`` and the group's ``canonical``), and ``vetoed``.

    Losing names become aliases with their own sources, the heading is no alias. Facts and aliases are deduplicated with
    the union of their sources, quotes by all fields. A character is a player's if any member is; scope is the broadest,
    the date the first, descriptions follow one another. ``pronouns`` start anew.
    """
    heads = canonical_names(members, by)
    keys = [F.col(c).alias(f"__{c}") for c in by]
    facts = members.select(*by, "pos", F.posexplode("details").alias("k", "d")).select(*by, F.struct("pos", "k").alias("o"), F.col("d.text").alias("text"), F.col("d.source_files").alias("sources"))
    named = members.join(heads.select(*keys, "heading"), _same(by))
    losers = named.where("name <> heading").select(*by, F.struct("pos", F.lit(1).alias("last"), F.lit(0).alias("k")).alias("o"), F.col("name").alias("text"), F.col("name_sources").alias("sources"))
    others = members.select(*by, "pos", F.posexplode("aliases").alias("k", "a")).select(*by, F.struct("pos", F.lit(0).alias("last"), "k").alias("o"), F.col("a.text").alias("text"), F.col("a.source_files").alias("sources"))
    aliases = lineage_arrays(others.unionByName(losers), by, "o", "aliases")
    details = lineage_arrays(facts, by, "o", "details")
    quotes = members.select(*by, "pos", F.posexplode("quotes").alias("k", "q")).groupBy(*by, "q.text", "q.speaker", "q.source_file").agg(F.min(F.struct("pos", "k")).alias("o"))
    quotes = quotes.groupBy(*by).agg(in_order(F.struct("text", "speaker", "source_file"), "o").alias("quotes"))
    told = members.where("description IS NOT NULL").groupBy(*by, strip_ws("description").alias("__k")).agg(F.min(F.struct("pos", "description")).alias("f"))
    told = told.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["description"]), "\n\n").alias("description"))
    flat = members.groupBy(*by).agg(F.max("is_pc").alias("is_pc"), broadest_scope("scope").alias("scope"), first_stated("date_text", "pos").alias("date_text"), F.count("*").alias("n_members"))
    out = flat.join(heads, by).join(players(members, by, allow_majority), by, "left")
    for part in (aliases, details, quotes, told):
        out = out.join(part, by, "left")
    event = F.col("entity_type").isin(*UNNAMED_TYPES)
    return out.withColumns(
        {
            "name": F.col("heading"),
            "name_sources": F.col("heading_sources"),
            "aliases": F.filter(F.coalesce("aliases", empty(_FACT)), lambda a: a["text"] != F.col("heading")),
            "details": F.when(~event, F.coalesce("details", empty(_FACT))),
            "quotes": F.coalesce("quotes", empty(_QUOTE)),
            "pronouns": F.when(F.col("entity_type") == "characters", empty("string")),
            "vetoed": F.coalesce("vetoed", F.lit(False)),
        }
    ).drop("heading", "heading_sources")


# --- decisions -----------------------------------------------------------------------------------------------------


def _in_range(merges: DataFrame, entities: DataFrame) -> DataFrame:
    known = entities.select("entity_type", "index", F.lit(True).alias("known"))
    return merges.join(known, ["entity_type", "index"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _bad_canonicals(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """Groups whose canonical name is no name or alias of a member."""
    by = ["entity_type", "group"]
    said = surface_rows(merges.join(entities, ["entity_type", "index"]), [*by, "canonical"])
    ok = said.where(name_key("text") == name_key("canonical")).select(*by).distinct()
    return merges.select(*by).distinct().join(ok, by, "left_anti")


def merge_problems(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity_type``, ``group``, ``problem`` of merge decisions (``entity_type``, ``group``, ``pos``, ``index``, ``canonical``):
    "members" (fewer than two), "range" (no such index), "reused" (an index that stood before), "canonical"."""
    by = ["entity_type", "group"]
    rows = _in_range(merges, entities)
    again = F.row_number().over(Window.partitionBy("entity_type", "index").orderBy("group", "pos")) > 1
    rows = rows.withColumn("__again", again & F.col("known"))
    counted = rows.groupBy(*by).agg((F.count("index") < 2).alias("members"), F.max(~F.col("known")).alias("range"), F.max("__again").alias("reused"))
    tall = counted.select(*by, F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("members", "range", "reused")])).alias("problem")).where("problem IS NOT NULL")
    fresh = rows.where(F.col("known") & ~F.col("__again"))
    return tall.unionByName(_bad_canonicals(fresh.select(*merges.columns), entities).withColumn("problem", F.lit("canonical")))


def salvage_merges(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """The groups that may be applied: sound on their own (two members or more, none twice, all known, a member's name as the
    canonical one), the earlier of two that share a member; a group that is dropped frees its members.

    In rounds: a group that comes first for all its members is kept, and those that meet a kept one go.
    """
    by = ["entity_type", "group"]
    rows = _in_range(merges, entities)
    sound = rows.groupBy(*by).agg(F.count("index").alias("n"), F.count_distinct("index").alias("d"), F.min("known").alias("known")).where("n >= 2 AND n = d AND known").select(*by)
    sound = sound.join(_bad_canonicals(rows.where("known").select(*merges.columns), entities), by, "left_anti")
    merges = written(merges, "merges")
    left = written(merges.join(sound, by, "left_semi").select(*by, "index"), "open")
    kept = None
    while True:
        first = left.groupBy("entity_type", "index").agg(F.min("group").alias("__first"))
        free = left.join(first, ["entity_type", "index"]).groupBy(*by).agg(F.min(F.col("__first") == F.col("group")).alias("ok")).where("ok").select(*by)
        free = written(free, "free")
        if free.isEmpty():
            break
        kept = free if kept is None else kept.unionByName(free)
        taken = left.join(free, by, "left_semi").select("entity_type", "index").distinct()
        met = left.join(taken, ["entity_type", "index"], "left_semi").select(*by).distinct()
        left = written(left.join(met, by, "left_anti"), "open")
    return merges.join(kept, by, "left_semi") if kept is not None else merges.limit(0)


def coalesce_groups(merges: DataFrame, entities: DataFrame, cap: int = COMPONENT_CAP) -> DataFrame:
    """Sound groups that share members as one: all members in order, the canonical name of the largest (the first one on a
    tie). More than ``cap`` members: all of them go. Groups that share nothing and unsound ones stay as they are."""
    by = ["entity_type", "group"]
    rows = written(_in_range(merges, entities), "groups")
    sizes = rows.groupBy(*by).agg(F.count("index").alias("n"), F.count_distinct("index").alias("d"), F.min("known").alias("known"))
    clean = rows.join(sizes.where("n >= 2 AND n = d AND known").select(*by, "n"), by)
    node = F.concat_ws("#", "entity_type", F.col("index").cast("string"))
    first = clean.groupBy(*by).agg(F.min("index").alias("__i"))
    links = clean.join(first, by).select(F.concat_ws("#", "entity_type", F.col("__i").cast("string")).alias("a"), node.alias("b"))
    found = components(links)
    placed = clean.withColumn("node", node).join(found, "node")
    each = placed.groupBy("root").agg(F.count_distinct("group").alias("n_groups"), F.count_distinct("index").alias("n_members"), F.min("group").alias("first_group"), F.min_by("canonical", F.struct(-F.col("n"), "group")).alias("__canonical"))
    many = placed.join(each.where("n_groups > 1"), "root")
    joined = many.where(F.col("n_members") <= cap).groupBy("entity_type", F.col("first_group").alias("group"), "index").agg(F.first("__canonical").alias("canonical"))
    joined = joined.withColumn("pos", F.col("index").cast("int"))
    rest = rows.join(many.select(*by).distinct(), by, "left_anti")
    return rest.select(*merges.columns).unionByName(joined.select(*merges.columns))


def declined_pairs(entities: DataFrame, candidates: DataFrame, merges: DataFrame, possible: DataFrame) -> DataFrame:
    """``entity_type``, ``k1``, ``k2`` (article-free name keys, in order): candidate pairs (``entity_type``, ``i``, ``j``) that no
    group holds together, and all pairs of a possible duplicate (``entity_type``, ``item``, ``index``)."""
    own = merges.select("entity_type", "index", "group")
    a, b = (own.select("entity_type", F.col("index").alias(side), F.col("group").alias(f"g{side}")) for side in "ij")
    apart = candidates.join(a, ["entity_type", "i"], "left").join(b, ["entity_type", "j"], "left").where("NOT (gi <=> gj AND gi IS NOT NULL)")
    x, y = (possible.select("entity_type", "item", F.col("index").alias(side)) for side in "ij")
    parked = x.join(y, ["entity_type", "item"]).where("i < j")  # a handful of members each, as a model writes them
    pairs = apart.select("entity_type", "i", "j").unionByName(parked.select("entity_type", "i", "j")).distinct()
    keys = entities.select("entity_type", "index", strip_article(name_key("name")).alias("key"))
    for side in "ij":
        pairs = pairs.join(keys.select("entity_type", F.col("index").alias(side), F.col("key").alias(f"k{side}")), ["entity_type", side])
    return pairs.where("ki <> '' AND kj <> '' AND ki <> kj").select("entity_type", F.least("ki", "kj").alias("k1"), F.greatest("ki", "kj").alias("k2")).distinct()


def _replace(entities: DataFrame, members: DataFrame, merged: DataFrame, by: list[str], at: str) -> DataFrame:
    """``entities`` with ``merged`` groups in place of their members; members of vetoed groups stay, side by side at the place
    (``at``) of their group."""
    good = merged.where("NOT vetoed")
    back = members.join(merged.where("vetoed").select(*[F.col(c).alias(f"__{c}") for c in by]), _same(by), "left_semi")
    back = back.withColumn("ord", F.concat(F.col(at), F.col("ord")))
    left = entities.join(members.select("entity_type", "ord").distinct(), ["entity_type", "ord"], "left_anti")
    spots = members.groupBy(*by).agg(F.min(at).alias("ord"))
    out = left.select(*COLUMNS).unionByName(back.select(*COLUMNS))
    return out.unionByName(good.drop("ord").join(spots, by).select(*COLUMNS))


def apply_merges(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """Entities (with ``index``) after the groups of ``merges``: merged ones first, in the order of the decision, then what no
    merge took, in its own. A group of short names without a stated alias, or of players that tie, is not merged."""
    by = ["entity_type", "group"]
    members = merges.join(entities, ["entity_type", "index"])
    texts = members.withColumn("__aliases", F.transform("aliases", lambda a: a["text"])).withColumn("__g", F.struct(*by))
    vetoed = short_name_veto(texts, "__g", "index", "name", "__aliases", SHORT).where("vetoed").select("__g.*")
    members = members.join(vetoed, by, "left_anti")
    merged = combine(members, by, allow_majority=True).where("NOT vetoed")
    gone = members.join(merged.select(*by), by, "left_semi").select("entity_type", "index").distinct()
    left = entities.join(gone, ["entity_type", "index"], "left_anti").withColumn("ord", F.array(F.lit(1).cast("bigint"), F.col("index").cast("bigint")))
    merged = merged.withColumn("ord", F.array(F.lit(0).cast("bigint"), F.col("group").cast("bigint")))
    return left.select(*COLUMNS).unionByName(merged.select(*COLUMNS))


# --- rules ---------------------------------------------------------------------------------------------------------


def merge_equal_names(entities: DataFrame, articles: bool = False) -> DataFrame:
    """Entities of a type with one name key as one (``articles``: keys without a leading article); events and names without
    a key stay. Members with players of their own are not merged."""
    key = strip_article(name_key("name")) if articles else name_key("name")
    rows = written(entities.where(~F.col("entity_type").isin(*UNNAMED_TYPES)).withColumn("__key", key).where("__key <> ''"), "keyed")
    groups = rows.groupBy("entity_type", "__key").agg(F.min("ord").alias("__at"), F.min_by("name", "ord").alias("canonical"), F.count("*").alias("__n")).where("__n > 1")
    members = rows.join(groups.drop("__n"), ["entity_type", "__key"]).withColumn("pos", F.col("ord"))
    by = ["entity_type", "__key"]
    return _replace(entities, members, combine(members, by), by, "__at")


def subset_targets(entities: DataFrame, declined: DataFrame | None = None) -> DataFrame:
    """``entity_type``, ``frag``, ``target`` (their ``ord``): names whose words are a proper part of a name or alias of one other
    entity alone, which an alias or a common quote ties to it, and which were not declined.

    Parts are looked up by their rarest word. Names of three characters or fewer are no parts; a part is no target.
    """
    rows = entities.where(~F.col("entity_type").isin(*UNNAMED_TYPES)).withColumn("key", strip_article(name_key("name")))
    rows = written(rows.select("entity_type", "ord", "name", "name_sources", "aliases", "quotes", "key"), "subset")
    keys = surface_rows(rows, ["entity_type", "ord"]).select("entity_type", "ord", strip_article(name_key("text")).alias("s")).where("s <> ''").distinct()
    keys = written(keys.withColumn("words", F.array_distinct(F.split("s", " "))), "surfaces")
    words = keys.select("entity_type", "ord", "words", F.explode("words").alias("w"))
    often = words.groupBy("entity_type", "w").agg(F.count("*").alias("f"))
    parts = rows.where((F.col("key") != "") & (F.length(strip_ws("name")) > SHORT)).select("entity_type", F.col("ord").alias("frag"), F.array_distinct(F.split("key", " ")).alias("part"))
    rare = parts.select("entity_type", "frag", "part", F.explode("part").alias("w")).join(often, ["entity_type", "w"])
    rare = rare.groupBy("entity_type", "frag").agg(F.min_by(F.struct("part", "w"), F.struct("f", "w")).alias("b")).select("entity_type", "frag", "b.*")
    over = rare.join(words.withColumnRenamed("ord", "target"), ["entity_type", "w"]).where("frag <> target AND size(words) > size(part)")
    over = over.where(F.size(F.array_except("part", "words")) == 0).select("entity_type", "frag", "target").distinct()
    only = over.groupBy("entity_type", "frag").agg(F.min("target").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    told = keys.groupBy("entity_type", "ord").agg(F.collect_set("s").alias("said"))
    known = rows.select("entity_type", "ord", "key", "quotes").join(told, ["entity_type", "ord"], "left")
    for side in ("frag", "target"):
        only = only.join(known.select("entity_type", F.col("ord").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("key", "quotes", "said")]), ["entity_type", side])
    tied = F.array_contains("target_said", F.col("frag_key")) | F.array_contains("frag_said", F.col("target_key")) | F.arrays_overlap("frag_quotes", "target_quotes")
    only = only.where(F.coalesce(tied, F.lit(False)))
    if declined is not None:
        both = only.select("entity_type", "frag", "target", F.explode("frag_said").alias("x"), "target_said").select("entity_type", "frag", "target", "x", F.explode("target_said").alias("y"))
        said_no = both.select("entity_type", "frag", F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2")).join(declined, ["entity_type", "k1", "k2"], "left_semi")
        only = only.join(said_no.select("entity_type", "frag").distinct(), ["entity_type", "frag"], "left_anti")
    only = only.select("entity_type", "frag", "target")
    return only.join(only.select("entity_type", F.col("target").alias("frag")).distinct(), ["entity_type", "frag"], "left_anti")


def merge_subsets(entities: DataFrame, declined: DataFrame | None = None) -> DataFrame:
    """Entities with the parts of :func:`subset_targets` merged into their targets, which keep their names."""
    folds = written(subset_targets(entities, declined), "folds")
    zero, one = (F.array(F.lit(k).cast("bigint")) for k in (0, 1))
    parts = folds.select("entity_type", F.col("frag").alias("ord"), F.col("target").alias("__at"), F.concat(one, F.col("frag")).alias("pos"))
    heads = folds.select("entity_type", F.col("target").alias("ord"), F.col("target").alias("__at"), F.concat(zero, F.col("target")).alias("pos")).distinct()
    members = entities.join(heads.unionByName(parts), ["entity_type", "ord"])
    by = ["entity_type", "__at"]
    names = members.where("ord = __at").select(*by, F.col("name").alias("canonical"))
    members = members.join(names, by)
    merged = combine(members.withColumn("__place", F.col("__at")), by)
    return _replace(entities, members.withColumn("__place", F.concat(F.col("__at"), F.slice("pos", 1, 1))), merged, by, "__place")


def declared_tiers(characters: DataFrame, declared: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """``ord``, ``group``, ``tier`` of characters that the declared party (``group``, ``player``, ``recognition``) knows.

    Tiers, the first that hits: "exact" (name or alias), "typo" (one edit from a declared name, both of four characters or
    more), "token" (a declared single word of four characters or more among the name's words), "player" (named like a
    player of one declared character, unless another player is stated). ``flagged`` (``key``): names that were looked at and
    left apart; they take no typo or token.
    """
    key = F.lower(strip_ws("text"))
    keys = surface_rows(characters, ["ord"]).select("ord", key.alias("key")).distinct()
    known = declared.select("group", F.explode("recognition").alias("known"))
    exact = keys.join(F.broadcast(known), F.col("key") == F.col("known")).select("ord", "group", F.lit(0).alias("tier"))
    spared = keys.join(flagged.select("key").distinct(), "key", "left_semi").select("ord").distinct() if flagged is not None else keys.limit(0).select("ord")
    loose = keys.join(spared, "ord", "left_anti")
    shorter = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda p: F.concat(F.left(c, p - 1), F.substring(c, p + 1, F.length(c))))))
    near = loose.where(F.length("key") >= TYPO_CHARS).select("ord", "key", F.explode(shorter(F.col("key"))).alias("form"))
    meant = known.where(F.length("known") >= TYPO_CHARS).select("group", "known", F.explode(shorter(F.col("known"))).alias("form"))
    typo = near.join(F.broadcast(meant), "form").where(F.levenshtein("key", "known") == 1).select("ord", "group", F.lit(1).alias("tier"))
    words = characters.select("ord", F.explode(F.regexp_extract_all(F.lower("name"), F.lit(r"(?U)([\w&&[^_]]+)"), F.lit(1))).alias("known"))
    bare = known.where((F.length("known") >= TYPO_CHARS) & ~F.contains("known", F.lit(" ")))
    token = words.join(spared, "ord", "left_anti").join(F.broadcast(bare), "known").select("ord", "group", F.lit(2).alias("tier"))
    owners = declared.groupBy(F.lower(strip_ws("player")).alias("known")).agg(F.min("group").alias("group"), F.count("*").alias("n")).where("n = 1").drop("n")
    named = characters.select("ord", F.lower(strip_ws("name")).alias("known"), F.lower(strip_ws(F.coalesce("player_name", F.lit("")))).alias("stated"))
    player = named.join(F.broadcast(owners), "known").where("stated = '' OR stated = known").select("ord", "group", F.lit(3).alias("tier"))
    every = exact.unionByName(typo).unionByName(token).unionByName(player)
    best = every.groupBy("ord").agg(F.min(F.struct("tier", "group")).alias("b"))
    names = F.array(*[F.lit(x) for x in ("exact", "typo", "token", "player")])
    return best.select("ord", F.col("b.group").alias("group"), F.get(names, F.col("b.tier")).alias("tier"))


def without_aliases(aliases: Column, names: Column) -> Column:
    """Aliases that are none of ``names`` (lower-case)."""
    return F.filter(aliases, lambda a: ~F.array_contains(names, F.lower(strip_ws(a["text"]))))


def merge_declared(entities: DataFrame, declared: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Characters of one declared party member (``group``, ``player``, ``main_name``, ``recognition``, ``pronouns``) as one, under
    the declared main name and with its pronouns. A player's own name does not stay as an alias."""
    people = entities.where("entity_type = 'characters'")
    tiers = written(declared_tiers(people, declared, flagged), "tiers")
    members = people.join(tiers, "ord").join(F.broadcast(declared.select("group", "main_name", "recognition", F.col("pronouns").alias("__said"))), "group")
    by = ["entity_type", "group"]
    own = members.select(*by, "ord", F.lower(strip_ws("name")).alias("__low"), "name", "recognition")
    spoken = own.withColumn("__rank", F.array_position("recognition", F.col("__low"))).where("__rank > 0").groupBy(*by).agg(F.min_by("name", F.struct("__rank", "ord")).alias("__spoken"))
    sizes = members.groupBy(*by).agg(F.min("ord").alias("__at"), F.min_by("name", "ord").alias("__first"), F.count("*").alias("__n"), F.collect_set(F.when(F.col("tier") == "player", F.lower(strip_ws("name")))).alias("__strip"))
    members = members.join(sizes, by).join(spoken, by, "left").withColumn("pos", F.col("ord"))
    main = F.when(strip_ws("main_name") != "", F.col("main_name"))
    members = members.withColumn("canonical", F.coalesce(main, "__spoken", "__first"))
    said = F.when(F.size("__said") > 0, F.col("__said"))
    groups = members.where("__n > 1")
    merged = combine(groups, by, allow_majority=True)
    facts = groups.groupBy(*by).agg(F.first("__strip").alias("__strip"), F.first("__said").alias("__said"))
    merged = merged.join(facts, by).withColumns({"aliases": without_aliases(F.col("aliases"), F.col("__strip")), "pronouns": F.coalesce(said, "pronouns")})
    alone = members.where("__n = 1").withColumn("pronouns", F.coalesce(said, "pronouns"))
    rest = entities.join(alone.select("entity_type", "ord"), ["entity_type", "ord"], "left_anti").select(*COLUMNS).unionByName(alone.select(*COLUMNS))
    return _replace(rest, groups, merged, by, "__at")


def reconcile(
    entities: DataFrame,
    merges: DataFrame,
    candidates: DataFrame,
    possible: DataFrame,
    declared: DataFrame | None = None,
    undecided: tuple[str, ...] = (),
) -> DataFrame:
    """The whole chain over ``entities`` (``index`` counts from 0 within a type): overlapping groups are joined, sound ones
    applied, then equal names, names equal but for an article, parts of names and the declared party are merged.

    Types in ``undecided`` gave no usable decision: equal names and the declared party alone are merged.
    """
    start = entities.withColumn("ord", F.array(F.lit(1).cast("bigint"), F.col("index").cast("bigint")))
    open_types = start.where(~F.col("entity_type").isin(*undecided)) if undecided else start
    one = coalesce_groups(merges, open_types)
    kept = written(salvage_merges(one, open_types), "kept")
    out = written(apply_merges(open_types, kept), "applied")
    out = written(merge_equal_names(out), "equal")
    out = written(merge_equal_names(out, articles=True), "articles")
    out = written(merge_subsets(out, declined_pairs(open_types, candidates, kept, possible)), "subsets")
    if undecided:
        rest = merge_equal_names(written(start.where(F.col("entity_type").isin(*undecided)).select(*COLUMNS), "undecided"))
        out = written(out.unionByName(rest), "both")
    if declared is None:
        return out
    flagged = possible.join(entities, ["entity_type", "index"]).where("entity_type = 'characters'").select(F.lower(strip_ws("name")).alias("key"))
    return merge_declared(out, declared, flagged)


# --- types ---------------------------------------------------------------------------------------------------------


def type_conflicts(entities: DataFrame) -> DataFrame:
    """``cluster`` (from 0), ``key``, ``entity_type``, ``ord``, ``n_facts``: article-free names that several types have, but for a
    place and its government. Clusters are numbered as a model is shown them, by the first entity in the order of types."""
    rank = F.array_position(F.array(*[F.lit(t) for t in CONFLICT_ORDER]), F.col("entity_type"))
    rows = entities.where(F.col("entity_type").isin(*CONFLICT_ORDER)).withColumn("key", strip_article(name_key("name"))).where("key <> ''")
    facts = F.size("details") + F.size("quotes")
    per = rows.groupBy("key", "entity_type").agg(F.min(F.struct("ord", facts.alias("n_facts"))).alias("f"), F.min(rank).alias("rank"))
    wide = per.groupBy("key").agg(F.collect_set("entity_type").alias("types"), F.min(F.struct("rank", "f.ord")).alias("at"))
    realm = F.size(F.array_except("types", F.array(*[F.lit(t) for t in REALM_TYPES]))) == 0
    wide = wide.where((F.size("types") > 1) & ~realm).withColumn("cluster", F.row_number().over(Window.orderBy("at")) - 1)
    return per.join(wide.select("key", "cluster"), "key").select("cluster", "key", "entity_type", "f.ord", "f.n_facts", "rank")


def choice_problems(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """``cluster``, ``problem`` of choices (``cluster``, ``keep_types``): "unknown" cluster, or "types" without one it has."""
    shown = conflicts.groupBy("cluster").agg(F.collect_set("entity_type").alias("shown"))
    rows = choices.join(shown, "cluster", "left")
    none = ~F.coalesce(F.arrays_overlap("keep_types", "shown"), F.lit(False))
    return rows.select("cluster", F.when(F.col("shown").isNull(), "unknown").when(none, "types").alias("problem")).where("problem IS NOT NULL")


def resolve_types(entities: DataFrame, choices: DataFrame) -> DataFrame:
    """Entities after ``choices`` (``cluster``, ``keep_types``) on :func:`type_conflicts`: the types left out go, their facts,
    aliases and quotes to the kept one with the most facts, the earlier type on a tie. Without a usable choice all stay."""
    found = written(type_conflicts(entities), "conflicts")
    kept = choices.select("cluster", F.explode("keep_types").alias("entity_type")).distinct().withColumn("keep", F.lit(True))
    rows = found.join(kept, ["cluster", "entity_type"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    best = rows.where("keep").groupBy("cluster").agg(F.max_by(F.struct("entity_type", "ord"), F.struct("n_facts", -F.col("rank"))).alias("w"))
    losers = rows.where("NOT keep").join(best, "cluster")
    by = ["entity_type", "ord"]
    gone = losers.select(*by)
    texts = entities.join(losers.select(*by, "rank", F.col("w.entity_type").alias("__t"), F.col("w.ord").alias("__o")), by)
    heads = losers.select("w.*").distinct()
    lost = texts.select(F.col("__t").alias("entity_type"), F.col("__o").alias("ord"), F.col("rank").alias("pos"), "aliases", "details", "quotes")
    parts = entities.join(heads, by, "left_semi").select(*by, F.lit(0).alias("pos"), "aliases", "details", "quotes").unionByName(lost)
    tall = lambda c: parts.select(*by, "pos", F.posexplode(c).alias("k", "x")).select(*by, F.struct("pos", "k").alias("o"), "x.*")
    facts = lineage_arrays(tall("details").withColumnRenamed("source_files", "sources"), by, "o", "__details")
    names = lineage_arrays(tall("aliases").withColumnRenamed("source_files", "sources"), by, "o", "__aliases")
    quotes = tall("quotes").groupBy(*by, "text", "speaker", "source_file").agg(F.min("o").alias("o"))
    quotes = quotes.groupBy(*by).agg(in_order(F.struct("text", "speaker", "source_file"), "o").alias("__quotes"))
    out = entities.join(gone, by, "left_anti")
    for part, c in ((facts, "details"), (names, "aliases"), (quotes, "quotes")):
        out = out.join(part, by, "left").withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out.select(*entities.columns)
