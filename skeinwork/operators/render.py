"""Anchors, links, footnotes and the rendered document."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skeinwork.functions.text import alpha_key, code_span, join_details, sentence_shaped, slug, squeeze, strip_ws, title_case

SECTIONS = ("locations", "history", "people", "organizations", "characters", "items")
_NAME = r"\w'’\-"
#: Regions of a document that links leave alone: code, links, anchors, footnote marks.
PROTECTED = r"```.*?```|`+[^`]*`+|\[[^\]]*\]\([^)]*\)|<a id=\"[^\"]*\"></a>|\[\^\d+\]"
MAX_SURFACES = 200_000


def assign_anchors(names: DataFrame, base: str, order: list[str], fallback: Column) -> DataFrame:
    """Adds ``anchor``: rows in order take their base, or if it is taken base-2, base-3 and so on up to the first free one; an
    empty base takes ``fallback``.

    Only a base that is another one with a number can meet its numbers. So bases that share what is left without such
    endings are probed together, in order; all other rows are numbered by a window. Clusters of names that differ by
    numbers alone are small; each is one group.
    """
    from skeinwork.operators.resolve import written

    rows = written(names.withColumn("__b", F.when(F.col(base) != "", F.col(base)).otherwise(fallback)), "anchors")
    stem = F.regexp_replace("__b", r"(-[0-9]+)+$", "")
    mixed = rows.select("__b", stem.alias("__stem")).distinct().groupBy("__stem").agg(F.count("*").alias("n")).where("n > 1").select("__stem")
    rows = rows.withColumn("__stem", stem).join(mixed.withColumn("__mixed", F.lit(True)), "__stem", "left")
    nth = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    plain = rows.where("__mixed IS NULL").withColumn("__k", nth)
    plain = plain.withColumn("anchor", F.when(F.col("__k") == 1, F.col("__b")).otherwise(F.concat_ws("-", "__b", F.col("__k").cast("string")))).drop("__k")
    schema = T.StructType([*rows.schema.fields, T.StructField("anchor", T.StringType())])

    def probe(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        taken, out, following = set(), [], {}
        for b in part["__b"]:
            k, name = following.get(b, 1), b
            while k > 1 or name in taken:
                k = max(k, 2)
                name = f"{b}-{k}"
                if name not in taken:
                    break
                k += 1
            following[b] = k + 1 if k > 1 else 2
            taken.add(name)
            out.append(name)
        return part.assign(anchor=out)

    probed = rows.where("__mixed").groupBy("__stem").applyInPandas(probe, schema)
    return plain.select(*schema.names).unionByName(probed).select(*names.columns, "anchor")


def link_pool(claims: DataFrame, surface: str = "surface", anchor: str = "anchor", kind: str = "kind", is_name: str = "is_name") -> DataFrame:
    """``surface`` to ``anchor``: names beat aliases; a surface of several anchors is dropped, but for one that a location
    and an organization share by name, which goes to the location; sentence-shaped surfaces are dropped."""
    rows = claims.select(F.col(surface).alias("surface"), F.col(anchor).alias("anchor"), F.col(kind).alias("kind"), F.col(is_name).alias("is_name"))
    best = rows.groupBy("surface").agg(F.max("is_name").alias("__named"))
    kept = rows.join(best, "surface").where(F.col("is_name") == F.col("__named"))
    one = kept.groupBy("surface").agg(
        F.count_distinct("anchor").alias("n"), F.min("anchor").alias("any"), F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.min(F.when(F.col("kind") == "Location", F.col("anchor"))).alias("place"), F.max("__named").alias("named"),
    )
    dual = F.col("named") & (F.col("n") == 2) & (F.col("kinds") == F.array(F.lit("Location"), F.lit("Organization")))
    target = F.when(F.col("n") == 1, F.col("any")).when(dual, F.col("place"))
    return one.withColumn("anchor", target).where(F.col("anchor").isNotNull() & ~sentence_shaped("surface")).select("surface", "anchor")


def mentions(blocks: DataFrame, block_id: str, text: str, pool: DataFrame) -> DataFrame:
    """The first mention of each pool anchor in a block, by single words: ``block_id``, ``anchor``, ``word_pos`` from 0."""
    words = blocks.select(block_id, F.posexplode(F.split(F.regexp_replace(text, r"[^\w'’-]+", " "), " ")).alias("word_pos", "surface"))
    return words.join(pool, "surface").groupBy(block_id, "anchor").agg(F.min("word_pos").alias("word_pos"))


class Linker:
    """Finds the surfaces of a pool in prose: from left to right, the longest one at a place, on word boundaries.

    Surfaces lie in tries of their characters, so a text is read once however many there are. A surface that may be found in
    any case lies in a trie of lower-cased characters; a mention all in lower case is none of these.
    """

    def __init__(self, rows: tuple[tuple[str, str, bool, bool], ...]) -> None:
        self.target = {s: (anchor, needs_article) for s, anchor, needs_article, _ in rows}
        self.exact: dict = {}
        self.loose: dict = {}
        for s, _, _, any_case in rows:
            for trie, text in ((self.exact, s), (self.loose, s.lower())) if any_case else ((self.exact, s),):
                for ch in text:
                    trie = trie.setdefault(ch, {})
                trie[""] = s
        self.guard = re.compile(PROTECTED, re.S)
        self.inside = re.compile(rf"[{_NAME}]").match
        self.article = re.compile(rf"(?<![{_NAME}])[Tt]he\s+\Z").search

    def _longest(self, text: str, at: int, trie: dict, lower: bool) -> tuple[int, str]:
        best, k = (at, ""), at
        while k < len(text):
            trie = trie.get(text[k].lower() if lower else text[k])
            if trie is None:
                break
            k += 1
            if "" in trie and not (k < len(text) and self.inside(text[k])):
                best = k, trie[""]
        return best

    def _weave(self, part: str, seen: set[str]) -> str:
        out, last, at = [], 0, 0
        while at < len(part):
            if at and self.inside(part[at - 1]):
                at += 1
                continue
            end, surface = max(self._longest(part, at, self.exact, False), self._longest(part, at, self.loose, True), key=lambda x: x[0])
            if not surface:
                at += 1
                continue
            anchor, needs_article = self.target[surface]
            said = part[at:end]
            the = self.article(part[last:at])
            skip = anchor in seen or (needs_article and not the) or (said != surface and said.islower())
            if not skip:
                seen.add(anchor)
                out += [part[last:at], f"[{surface}](#{anchor})"]
                last = end
            at = end
        return "".join([*out, part[last:]])

    def link(self, text: str, own: str | None) -> str:
        """``text`` with the first mention of every anchor but ``own`` as a link."""
        seen, out, at = {own} if own else set(), [], 0
        for m in self.guard.finditer(text):
            out += [self._weave(text[at : m.start()], seen), m[0]]
            at = m.end()
        return "".join([*out, self._weave(text[at:], seen)])


@lru_cache(maxsize=2)
def _linker(rows: tuple) -> Linker:
    return Linker(rows)


def case_safe(surface: Column | str, common_words: tuple[str, ...] = ()) -> Column:
    """Whether a surface may be found in any case: several words, or one of four characters or more that is not common."""
    s = strip_ws(surface)
    one = (F.length(s) >= 4) & s.rlike(r"\p{L}")
    common = F.lower(s).isin(*common_words) if common_words else F.lit(False)
    return (s != "") & (s.rlike(r"(?U)\s") | (one & ~common))


def weave_links(blocks: DataFrame, text: str, own_anchor: str, pool: DataFrame, article_words: tuple[str, ...] = (), any_case: bool = False, common_words: tuple[str, ...] = ()) -> DataFrame:
    """``text`` with the first mention of each anchor as a link, the longest surface first, none to the block itself.

    ``article_words`` are linked after an article alone, which stays outside the link. ``any_case``: surfaces that are
    :func:`case_safe`, and no other's in another case, are found in any case and written as the pool has them.

    Rewriting from left to right keeps state, so it is an Arrow function. The pool is broadcast; one of more than
    ``MAX_SURFACES`` surfaces is refused.
    """
    twin = F.count("*").over(Window.partitionBy(F.lower("surface")))
    free = case_safe("surface", common_words) & (twin == 1) if any_case else F.lit(False)
    rows = tuple(sorted((r.surface, r.anchor, r.surface in article_words, r.free) for r in pool.select("surface", "anchor", free.alias("free")).limit(MAX_SURFACES + 1).collect()))
    if len(rows) > MAX_SURFACES:
        raise ValueError(f"the link pool holds more than {MAX_SURFACES} surfaces")
    shared = blocks.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(T.StringType())
    def run(parts: pd.Series, own: pd.Series) -> pd.Series:
        linker = _linker(shared.value)
        return pd.Series([x if x is None else linker.link(x, o) for x, o in zip(parts, own, strict=True)])

    return blocks.withColumn(text, run(F.col(text), F.col(own_anchor)))


def number_footnotes(quotes: DataFrame, text: str, speaker: str, source: str, order: list[str]) -> DataFrame:
    """``n`` from 1 for each distinct (squeezed text, speaker, source) in the order of first appearance, blank ones none.

    Keys are range-partitioned by their place and numbered within a partition from the sizes of those before, so no task
    sees them all.
    """
    keys = quotes.groupBy(squeeze(text).alias("quote"), F.col(speaker).alias("speaker"), F.col(source).alias("source")).agg(F.min(F.struct(*order)).alias("__p"))
    keys = keys.where("quote <> ''")
    from skeinwork.operators.resolve import written

    placed = written(keys.repartitionByRange("__p").withColumn("__part", F.spark_partition_id()), "footnotes")
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("__part", before.alias("__first"))
    rn = F.row_number().over(Window.partitionBy("__part").orderBy("__p"))
    return placed.join(F.broadcast(first), "__part").withColumn("n", (rn + F.col("__first")).cast("bigint")).select("n", "quote", "speaker", "source")


def footnote_lines(notes: DataFrame) -> DataFrame:
    """Definition lines of numbered footnotes."""
    line = F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]: "), code_span("quote"), F.lit(" — "), F.col("speaker"), F.lit(", "), F.col("source"))
    return notes.select("n", line.alias("line"))


# The headings of the sections, and the notes of a timeline.
TITLES = {"locations": "Locations", "history": "History", "people": "People & Cultures", "organizations": "Organizations", "characters": "Characters", "items": "Items"}
SYSTEMS_NOTE = (
    "**Important Note:** This campaign uses more than one timekeeping system. Each is listed separately below, and events in "
    "different systems can't be reliably ordered against one another — so their relative timing may need a human eye to reconcile."
)
UNPLACED_NOTE = (
    "**Important Note:** None of these events have a stated date or any clue to their order, so they couldn't be placed in a "
    "timeline. They're listed alphabetically — not chronologically — and putting them in sequence would need a human eye."
)


def _joined(parts: Column, order: list[str], glue: str = "\n\n") -> Column:
    """The parts of a group in order; they are the document, so they meet in one row."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, parts.alias("t")))), lambda x: x["t"]), glue)


def render(entries: DataFrame, sections: tuple[str, ...] = SECTIONS, footnotes: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row ``document``: entries (section, sort_key, anchor, name, body) as anchored headings under their section, in the
    fixed section order, then the ``footnotes`` (n, line) under a heading of their own. ``history`` (one row, ``block``) is that
    section as :func:`render_history` makes it. Sections without entries are left out, no entries give an empty text."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    title = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv]), F.col("section")), F.initcap("section"))
    heading = F.concat(F.lit('### <a id="'), F.col("anchor"), F.lit('"></a>'), F.col("name"))
    refs = F.coalesce(F.col("refs"), F.lit("")) if "refs" in entries.columns else F.lit("")
    block = F.when(F.coalesce("body", F.lit("")) == "", F.concat(heading, refs)).otherwise(F.concat(heading, F.lit("\n\n"), F.col("body"), refs))
    parts = entries.groupBy("section").agg(_joined(block, ["sort_key", "anchor"]).alias("__t"), F.max(rank).alias("__r"))
    blocks = parts.select("__r", F.concat(F.lit("## "), title, F.lit("\n\n"), F.col("__t")).alias("b"))
    if history is not None:
        blocks = blocks.unionByName(history.where("block <> ''").select(F.lit(sections.index("history") + 1).cast("bigint").alias("__r"), F.col("block").alias("b")))
    if footnotes is not None:
        notes = footnotes.agg(_joined(F.col("line"), ["n"], "\n").alias("b"), F.count("*").alias("k")).where("k > 0")
        blocks = blocks.unionByName(notes.select(F.lit(len(sections) + 1).cast("bigint").alias("__r"), F.concat(F.lit("## Footnotes\n\n"), F.col("b")).alias("b")))
    return blocks.agg(_joined(F.col("b"), ["__r"]).alias("document"))


def flatten(text: Column | str) -> Column:
    """A text as one line."""
    return squeeze(text)


def event_bullets(events: DataFrame) -> DataFrame:
    """Events (``name``, ``anchor`` or null, ``date_text``, ``body``, ``refs``) with ``bullet``, their line in a list."""
    anchor = F.coalesce(F.concat(F.lit('<a id="'), F.col("anchor"), F.lit('"></a>')), F.lit(""))
    date = F.when(F.coalesce("date_text", F.lit("")) != "", F.concat(F.lit(" — "), flatten("date_text"))).otherwise("")
    return events.withColumn("bullet", F.concat(F.lit("- "), anchor, F.lit("**"), F.col("name"), F.lit("**"), date, F.lit(". "), F.col("body"), F.coalesce("refs", F.lit(""))))


def render_history(events: DataFrame) -> DataFrame:
    """One row ``block``: the timeline of events (``bullet``, ``name``, ``calendar_system``, ``chronological_position``, ``index``).

    Dated systems stand first, those with most events before others, with headings if there are two or more; then events
    ordered among themselves, then what has no place, by name. Without dates an ordered sequence makes it a "Timeline".
    No events: an empty text.
    """
    system, position = F.col("calendar_system"), F.col("chronological_position")
    bucket = F.when(system.isNotNull(), 0).when(position.isNotNull(), 1).otherwise(2)
    key = F.when(bucket == 2, alpha_key("name")).otherwise("")
    rows = events.withColumns({"__bucket": bucket, "__key": key, "__pos": F.when(bucket < 2, position).otherwise(0)})
    lists = rows.groupBy("__bucket", "calendar_system").agg(_joined(F.col("bullet"), ["__pos", "__key", "index"], "\n").alias("t"), F.count("*").alias("n"))
    kinds = lists.agg(F.count_if(F.col("__bucket") == 0).alias("systems"), F.max(F.col("__bucket") == 1).alias("ordered"), F.max(F.col("__bucket") == 2).alias("loose"), F.count("*").alias("lists"))
    lists = lists.join(kinds)
    many, alone = F.col("systems") >= 2, (F.col("systems") == 0) & ~F.col("ordered")
    head = F.when((F.col("__bucket") == 0) & many, F.col("calendar_system")).when((F.col("__bucket") == 1) & (F.col("systems") > 0), "Undated Events").when((F.col("__bucket") == 2) & ~alone, "Could Not Place")
    block = F.concat(F.coalesce(F.concat(F.lit("### "), head, F.lit("\n\n")), F.lit("")), F.col("t"))
    body = lists.withColumn("less", -F.col("n")).agg(_joined(block, ["__bucket", "less", "calendar_system"]).alias("b"))
    top = F.when((F.col("systems") == 0) & F.col("ordered"), "## Timeline").otherwise("## History")
    note = F.when(F.col("systems") >= 2, SYSTEMS_NOTE).when((F.col("systems") == 0) & ~F.col("ordered"), UNPLACED_NOTE)
    out = body.join(kinds)
    return out.select(F.when(F.coalesce("lists", F.lit(0)) == 0, "").otherwise(F.concat_ws("\n\n", top, note, "b")).alias("block"))


def renderable(entities: DataFrame) -> DataFrame:
    """Entities with anything to show: prose, a fact or a quote."""
    return entities.where((F.coalesce("prose", F.lit("")) != "") | (F.size("details") > 0) | (F.size("quotes") > 0))


def display_cased(entities: DataFrame) -> DataFrame:
    """Names and aliases in their display form."""
    return entities.withColumns({"name": title_case("name"), "aliases": F.transform("aliases", lambda a: F.struct(title_case(a["text"]).alias("text"), a["source_files"].alias("source_files")))})


def render_world(entities: DataFrame, events: DataFrame, article_words: tuple[str, ...] = (), never_link: tuple[str, ...] = (), common_words: tuple[str, ...] = ()) -> DataFrame:
    """The whole document (one row ``document``) of entities and events (tables of :mod:`reconcile`, with ``index`` and ``prose``;
    events with ``calendar_system`` and ``chronological_position``).

    Names get their display form, entities without anything to show go, then anchors are given: to entities in the order of
    sections, then to events that do not read like a sentence. Bodies (prose, else facts) are linked, quotes numbered in the
    order of the page.
    """
    from skeinwork.operators.resolve import written

    cased = renderable(display_cased(entities))
    kinds = [s for s in SECTIONS if s != "history"]
    rank = F.array_position(F.array(*[F.lit(s) for s in kinds]), F.col("entity_type")).cast("int")
    told = display_cased(events)
    nouns = cased.select(rank.alias("rank"), F.col("entity_type").alias("section"), "index", "name", "aliases", "quotes", F.coalesce(F.when(F.col("prose") != "", F.col("prose")), join_details(F.transform("details", lambda d: d["text"]))).alias("body"))
    bare = lambda c: F.regexp_replace(c, r"(?i)^the\s+(?=.)", "")
    happened = told.select(
        F.lit(len(kinds) + 1).alias("rank"), F.lit("history").alias("section"), "index", "name", "aliases", "quotes", flatten(F.coalesce(F.when(F.col("prose") != "", F.col("prose")), "description")).alias("body")
    )
    rows = written(nouns.unionByName(happened).withColumn("gated", (F.col("section") == "history") & sentence_shaped(bare(F.col("name")))), "world")
    named = rows.where("NOT gated").withColumn("__slug", slug("name"))
    fallback = F.concat(F.when(F.col("section") == "history", "event-").otherwise("entity-"), F.col("index").cast("string"))
    anchored = written(assign_anchors(named, "__slug", ["rank", "index"], fallback).select("section", "index", "anchor"), "anchored")
    rows = rows.join(anchored, ["section", "index"], "left")
    kind = F.when(F.col("section") == "locations", "Location").when(F.col("section") == "organizations", "Organization").otherwise(F.col("section"))
    claims = rows.where("anchor IS NOT NULL").select("anchor", kind.alias("kind"), F.explode(F.concat(F.array(F.struct(F.col("name").alias("t"), F.lit(True).alias("n"))), F.transform("aliases", lambda a: F.struct(a["text"].alias("t"), F.lit(False).alias("n"))))).alias("c"))
    claims = claims.select(bare(F.col("c.t")).alias("surface"), "anchor", "kind", F.col("c.n").alias("is_name")).where(strip_ws("surface") != "")
    pool = link_pool(claims)
    pool = pool.where(~F.col("surface").isin(*never_link)) if never_link else pool
    rows = weave_links(rows, "body", "anchor", written(pool, "pool"), article_words, True, common_words)
    place = F.when(F.col("section") == "history", F.lit(1.5)).otherwise(F.col("rank").cast("double"))
    sort_key = F.when(F.col("section") == "history", F.lit("")).otherwise(alpha_key("name"))
    rows = rows.withColumns({"place": place, "sort_key": sort_key})
    system, position = told.select("index", "calendar_system", "chronological_position", "date_text"), F.col("chronological_position")
    sizes = told.groupBy("calendar_system").agg(F.count("*").alias("__n"))
    system = system.join(sizes, system["calendar_system"].eqNullSafe(sizes["calendar_system"]), "left").drop(sizes["calendar_system"])
    rows = written(rows.join(system.withColumn("section", F.lit("history")), ["section", "index"], "left"), "woven")
    bucket = F.when(F.col("calendar_system").isNotNull(), 0).when(position.isNotNull(), 1).otherwise(2)
    shown = F.struct(
        "place", bucket.alias("b"), F.when(bucket == 0, -F.col("__n")).otherwise(0).alias("n"), F.coalesce("calendar_system", F.lit("")).alias("s"),
        F.when(bucket < 2, position).otherwise(0).alias("p"), F.when((F.col("section") == "history") & (bucket == 2), alpha_key("name")).otherwise(F.col("sort_key")).alias("k"), F.coalesce("anchor", F.lit("")).alias("a"), F.col("index").alias("i"),
    )
    quoted = rows.select("section", "index", shown.alias("page"), F.posexplode("quotes").alias("qpos", "q")).select("section", "index", "page", "qpos", "q.text", "q.speaker", "q.source_file")
    notes = written(number_footnotes(quoted, "text", "speaker", "source_file", ["page", "qpos"]), "notes")
    known = notes.select("n", F.col("quote").alias("__q"), F.col("speaker").alias("__by"), F.col("source").alias("__in"))
    cited = quoted.join(known, (squeeze("text") == F.col("__q")) & F.col("speaker").eqNullSafe(F.col("__by")) & F.col("source_file").eqNullSafe(F.col("__in")))
    refs = cited.groupBy("section", "index").agg(_joined(F.concat(F.lit("[^"), F.col("n").cast("string"), F.lit("]")), ["qpos"], "").alias("refs"))
    rows = rows.join(refs, ["section", "index"], "left")
    block = render_history(event_bullets(rows.where("section = 'history'")))
    return render(rows.where("section <> 'history'"), SECTIONS, footnote_lines(notes), block)


def polish(entities: DataFrame, bodies: DataFrame, batch: list[str]) -> DataFrame:
    """Entities (with ``batch`` columns and ``local_id``) with ``prose``: the body that was written for them, null for a missing or
    blank one."""
    said = bodies.select(*batch, "local_id", F.when(strip_ws("body") != "", strip_ws("body")).alias("__body")).dropDuplicates([*batch, "local_id"])
    return entities.drop("prose").join(said, [*batch, "local_id"], "left").withColumnRenamed("__body", "prose")


def history_order(events: DataFrame, system: str, position: str, name_key: str, ord_col: str) -> DataFrame:
    """Adds ``shown``: dated systems by size and name, rows by position; then undated ones, then what has no place."""
    size = F.count("*").over(Window.partitionBy(system))
    bucket = F.when(F.col(system).isNotNull(), 0).when(F.col(position).isNotNull(), 1).otherwise(2)
    out = events.withColumns({"__size": F.when(bucket == 0, size).otherwise(0), "__bucket": bucket})
    return out.orderBy("__bucket", F.col("__size").desc(), system, position, name_key, ord_col).drop("__size", "__bucket")


def deconflated(text: Column, mapping: dict[str, str]) -> Column:
    """``text`` with whole words of ``mapping`` (keys lower-case) replaced whatever their case, longest first, then "X's
    character" and "X's PC" of a name X that was put in as X alone. An apostrophe ends a word."""
    keys = sorted(mapping, key=lambda k: (-len(k), k))
    find = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, keys)) + r")(?!\w)", re.I) if keys else None
    put = sorted({v for v in mapping.values() if v and v.strip()}, key=lambda k: (-len(k), k))
    own = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, put)) + r")'s\s+(?:character|pc)\b", re.I) if put else None

    @F.pandas_udf(T.StringType())
    def run(parts: pd.Series) -> pd.Series:
        def swap(x: str) -> str:
            x = find.sub(lambda m: mapping[m[0].lower()], x) if find else x
            return own.sub(r"\1", x) if own else x

        return parts.map(lambda x: x if x is None else swap(x))

    return run(text)


def deconflate(df: DataFrame, text: str, mapping: dict[str, str]) -> Column:
    """:func:`deconflated` of a column."""
    return deconflated(df[text], mapping)


def deconflate_entities(entities: DataFrame, mapping: dict[str, str], key: list[str]) -> DataFrame:
    """Names, aliases, facts and descriptions with players' names replaced by their characters'; quotes stay as they were
    said. Arrays are taken apart and put together again by ``key``, so every text passes as a row."""
    out = entities.withColumn("name", deconflated(F.col("name"), mapping))
    out = out.withColumn("description", deconflated(F.col("description"), mapping)) if "description" in out.columns else out
    for c in ("aliases", "details"):
        tall = entities.select(*key, F.posexplode(c).alias("k", "x")).withColumn("t", deconflated(F.col("x.text"), mapping))
        fact = F.struct(F.col("t").alias("text"), F.col("x.source_files").alias("source_files"))
        again = tall.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", fact.alias("f")))), lambda x: x["f"]).alias("__new"))
        out = out.join(again, key, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return out
