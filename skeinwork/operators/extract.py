"""Typed entities and events from decision rows: one JSON object each, with quotes that their batch must hold.

Decisions come in as a table (``batch`` columns, ``entity_type``, ``entry``, ``raw``); messages as (``batch`` columns,
``local_id``, ``sender``, ``source_file``, ``content``). A batch is of one file. All types come out as one tall table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.text import is_verbatim, strip_ws
from skeinwork.operators.resolve import in_order

# The entity types in the order of the documents' lists, and the scopes of events.
TYPES = ("locations", "people", "organizations", "characters", "items", "history")
SCOPES = ("world", "regional", "personal")
#: Characters of a name that is made from a fact or a description.
NAME_CHARS = 80

_QUOTE = "struct<text:string,speaker:string,source_file:string>"
_FACT = "struct<text:string,source_files:array<string>>"


def empty(kind: str) -> Column:
    return F.expr("array()").cast(f"array<{kind}>")


def _kind(v: Column, path: str = "$") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def text_field(v: Column, path: str) -> Column:
    """A field that is a JSON string, else null: numbers are no names."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def list_field(v: Column, path: str) -> Column:
    """The elements of a field, none if it is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), empty("variant"))


def int_field(v: Column, path: str) -> Column:
    """A field that is a whole number; true and 1.5 are none."""
    return F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def resolve_quotes(claims: DataFrame, messages: DataFrame, batch: list[str], key: list[str], verify: bool = True) -> DataFrame:
    """``claims`` (``quote``, ``source_id``) with ``speaker``, ``source_file``, ``at`` (the message's local id) and
    ``n_texts``; a claim that nothing supports goes.

    A claim needs a quote and a cited id that its batch has. The cited message counts if it holds the quote, else the
    first of the batch that does. The join is on the batch alone, so a claim meets no more rows than its batch has.
    ``verify`` off: the cited message counts as it is.
    """
    m = messages.select(*[F.col(c).alias(f"__{c}") for c in batch], F.col("local_id").alias("at"), F.col("sender").alias("speaker"), "source_file", F.col("content").alias("__content"))
    sizes = messages.groupBy(*[F.col(c).alias(f"__{c}") for c in batch]).agg(F.max("local_id").alias("__last"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in batch]
    asked = claims.where("quote IS NOT NULL AND source_id IS NOT NULL").join(sizes, on).where("source_id BETWEEN 0 AND __last").drop(*[f"__{c}" for c in batch])
    holds = is_verbatim("quote", "__content") if verify else F.col("at") == F.col("source_id")
    pairs = asked.join(m, on).where(holds)
    rest = [c for c in claims.columns if c not in key]
    best = pairs.groupBy(*key).agg(
        F.min_by(F.struct(*rest, "at", "speaker", "source_file"), F.struct((F.col("at") != F.col("source_id")).alias("other"), F.col("at"))).alias("__b"), F.count("*").alias("n_texts")
    )
    return best.select(*key, "__b.*", "n_texts")


def _aliases(v: Column, source: Column) -> Column:
    texts = F.filter(F.transform(list_field(v, "$.aliases"), lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string"))), lambda x: x.isNotNull())
    return F.transform(texts, lambda x: F.struct(x.alias("text"), F.array(source).alias("source_files")))


def build_entries(raw: DataFrame, messages: DataFrame, batch: list[str], json: str = "raw", verify: bool = True) -> DataFrame:
    """The tall entity table of ``raw``: batch columns, ``entity_type``, ``entry``, ``name``, ``name_sources``, ``aliases``,
    ``details``, ``quotes``, ``is_pc``, ``player_name``, ``description``, ``scope``, ``date_text``.

    A row that is no JSON object goes. Fields of another type than they should have count as missing. A detail counts
    with a text and a quote that its batch holds; equal quotes of an entry are one. A location or character without a
    name goes; an organization, item or people takes the start of its first detail, an event the first sentence of its
    description, which it must have. An unknown scope is "world".
    """
    key = [*batch, "entity_type", "entry"]
    rows = raw.withColumn("__v", F.try_parse_json(F.col(json))).where(F.startswith(_kind(F.col("__v")), F.lit("OBJECT")))
    files = messages.groupBy(*batch).agg(F.min_by("source_file", "local_id").alias("__file"))
    rows = rows.join(files, batch)
    v, is_event = F.col("__v"), F.col("entity_type") == "history"
    claims = F.when(is_event, list_field(v, "$.quotes")).otherwise(list_field(v, "$.details"))
    tall = rows.select(*key, F.posexplode(claims).alias("pos", "__c"))
    tall = tall.select(*key, "pos", text_field(F.col("__c"), "$.detail").alias("detail"), text_field(F.col("__c"), "$.quote").alias("quote"), int_field(F.col("__c"), "$.source_id").alias("source_id"))
    tall = tall.where((F.col("entity_type") == "history") | F.col("detail").isNotNull())
    held = resolve_quotes(tall, messages, batch, [*key, "pos"], verify)
    one_quote = F.struct(F.col("quote").alias("text"), "speaker", "source_file")
    one_fact = F.struct(F.col("detail").alias("text"), F.array("source_file").alias("source_files"))
    facts = held.groupBy(*key).agg(in_order(one_fact, "pos").alias("details"), F.array_distinct(in_order(one_quote, "pos")).alias("quotes"))
    out = rows.join(facts, key, "left").withColumns({"details": F.when(~is_event, F.coalesce("details", empty(_FACT))), "quotes": F.coalesce("quotes", empty(_QUOTE))})

    said = text_field(v, "$.description")
    description = F.when(is_event & (strip_ws(said) != ""), said)
    sentence = strip_ws(F.get(F.split(strip_ws(description), r"\.", 2), F.lit(0)))
    made_up = F.when(is_event, F.left(F.when(sentence != "", sentence).otherwise(strip_ws(description)), F.lit(NAME_CHARS))).when(
        F.col("entity_type").isin("organizations", "items", "people"), F.left(F.get("details", F.lit(0))["text"], F.lit(NAME_CHARS))
    )
    given = text_field(v, "$.name")
    scope = F.lower(strip_ws(text_field(v, "$.scope")))
    date = strip_ws(text_field(v, "$.date_text"))
    is_character = F.col("entity_type") == "characters"
    stated_pc = F.when(_kind(v, "$.is_pc") == "BOOLEAN", F.try_variant_get(v, "$.is_pc", "boolean"))
    player = text_field(v, "$.player_name")
    out = out.withColumns(
        {
            "name": F.when(strip_ws(given) != "", given).otherwise(made_up),
            "name_sources": F.array("__file"),
            "aliases": _aliases(v, F.col("__file")),
            "is_pc": F.when(is_character, F.coalesce(stated_pc, F.lit(False))),
            "player_name": F.when(is_character & (strip_ws(player) != ""), player),
            "description": description,
            "scope": F.when(is_event, F.when(scope.isin(*SCOPES), scope).otherwise("world")),
            "date_text": F.when(is_event & (date != ""), date),
        }
    )
    out = out.where(F.col("name").isNotNull() & (~is_event | description.isNotNull()))
    return out.select(*key, "name", "name_sources", "aliases", "details", "quotes", "is_pc", "player_name", "description", "scope", "date_text")


def assign_players(characters: DataFrame, roster: DataFrame, declared: DataFrame, id_col: str = "entry") -> DataFrame:
    """Characters with ``player_name``, ``is_pc`` and ``pronouns`` as the configuration has them, and ``is_roster_name``.

    ``roster`` (``name``): real people; a player who is none of them is struck out, unless there is no roster at all.
    ``declared`` (``name``, ``player``, ``pronouns``, ``ord``): the name counts first, then aliases in order, the last
    declaration of a name wins. A declared character is its player's; if anything is declared, others have no player.
    """
    known = roster.select(F.lower(strip_ws("name")).alias("__r")).distinct()
    rules = declared.groupBy(F.lower(strip_ws("name")).alias("__n")).agg(F.max_by(F.struct("player", "pronouns"), "ord").alias("__d"))
    have = roster.sparkSession.range(1).select(
        F.lit(1).alias("__one")
    ).join(known.agg(F.count("*").alias("__n_roster"))).join(rules.agg(F.count("*").alias("__n_declared")))
    names = characters.select(id_col, F.posexplode(F.concat(F.array("name"), F.transform("aliases", lambda a: a["text"]))).alias("__p", "__s"))
    hits = names.join(F.broadcast(rules), F.lower(strip_ws("__s")) == F.col("__n")).groupBy(id_col).agg(F.min_by("__d", "__p").alias("__d"))
    out = characters.join(hits, id_col, "left").join(F.broadcast(have.drop("__one")))
    out = out.join(F.broadcast(known.select(F.col("__r").alias("__rp"))), F.lower(strip_ws("player_name")) == F.col("__rp"), "left")
    out = out.join(F.broadcast(known.select(F.col("__r").alias("__rn"))), F.lower(strip_ws("name")) == F.col("__rn"), "left")
    guess = F.when((F.col("__n_roster") == 0) | F.col("__rp").isNotNull(), F.col("player_name"))
    stated = F.col("__d").isNotNull()
    out = out.withColumns(
        {
            "player_name": F.when(stated, F.col("__d.player")).when(F.col("__n_declared") == 0, guess),
            "is_pc": F.coalesce("is_pc", F.lit(False)) | stated,
            "pronouns": F.coalesce("__d.pronouns", empty("string")),
            "is_roster_name": F.col("__rn").isNotNull(),
        }
    )
    return out.drop("__d", "__n_roster", "__n_declared", "__rp", "__rn")


def prompt_view(entities: DataFrame) -> DataFrame:
    """What a deciding model sees of an entity: facts and aliases as bare texts, no sources, prose or pronouns."""
    seen = entities.drop("name_sources", "prose", "pronouns")
    return seen.withColumns({c: F.transform(c, lambda x: x["text"]) for c in ("details", "aliases") if c in seen.columns})


def flag_subject_bleed(characters: DataFrame, id_col: str) -> DataFrame:
    """Details that begin with the name of another character: ``id_col``, ``pos``, ``detail``, ``surface``, ``owners``.

    The longest name or alias that a detail begins with, as a whole word, decides; the character's own one is no flag.
    Surfaces are looked up by equality, by the starts that a detail has of the lengths that surfaces have.
    """
    surfaces = characters.select(id_col, "name", F.explode(F.concat(F.array("name"), F.transform("aliases", lambda a: a["text"]))).alias("__s"))
    surfaces = surfaces.select(id_col, "name", F.lower(strip_ws("__s")).alias("surface")).where("length(surface) >= 2")
    owners = surfaces.groupBy("surface").agg(F.array_sort(F.collect_set("name")).alias("owners"))
    sizes = owners.agg(F.collect_set(F.length("surface")).alias("__sizes"))  # distinct lengths alone: few
    facts = characters.select(id_col, F.posexplode("details").alias("pos", "__f")).select(id_col, "pos", F.col("__f.text").alias("detail"))
    facts = facts.withColumn("__t", F.lower(strip_ws("detail"))).join(F.broadcast(sizes))
    starts = facts.select(id_col, "pos", "detail", "__t", F.explode("__sizes").alias("__n")).where("length(__t) >= __n")
    ends = F.substring("__t", F.col("__n") + 1, F.lit(1))
    starts = starts.where(~ends.rlike(r"[\p{L}\p{N}]")).withColumn("surface", F.left("__t", F.col("__n")))
    longest = starts.join(owners, "surface").groupBy(id_col, "pos").agg(F.max_by(F.struct("detail", "surface", "owners"), "__n").alias("__b")).select(id_col, "pos", "__b.*")
    return longest.join(surfaces.select(id_col, "surface"), [id_col, "surface"], "left_anti").select(id_col, "pos", "detail", "surface", "owners")
