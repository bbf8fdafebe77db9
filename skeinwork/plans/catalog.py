"""Registered queries of the library's operators over the driver's tables, each with its SQL where SQL can express it.

How the tables stand in: documents are facts (source = source file, lang = entity type), conversations are messages,
benchmark passages are quotes, labels are decisions, events are dated events, part names are entity names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions import text as X
from skeinwork.operators import document, extract, grade, graders, ground, mask, reconcile, render, resolve, timeline
from skeinwork.sources import chatlog

FLAGSHIP = "public_facts"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EXCLUDED = ["src0", "src1"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- labels, batches, grounding -----------------------------------------------------------------------------------

_LABELLED = """
WITH l AS (SELECT doc_id, max_by(CASE WHEN toxic = 1 THEN 'noise' WHEN quality = 1 THEN 'lore' ELSE 'mechanic' END, quality) AS label FROM labels GROUP BY doc_id),
labelled AS (SELECT d.doc_id, d.source, d.lang, d.text, coalesce(l.label, 'ambiguous') AS label FROM documents d LEFT JOIN l USING (doc_id))
"""


def _labelled(spark, d):
    docs = table(spark, d, "documents")
    raw = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, " Noise ").when(F.col("quality") == 1, "lore").otherwise("MECHANIC").alias("label"), F.col("quality").alias("pos"))
    return ground.attach_labels(docs, raw, ["doc_id"])


@query(_LABELLED + "SELECT doc_id, label FROM labelled WHERE label IN ('lore', 'ambiguous')")
def label_select(spark, d):
    return ground.select_for_extraction(_labelled(spark, d)).select("doc_id", "label")


@query(
    _LABELLED
    + """, facts AS (SELECT trim(text) AS fact, source, min(doc_id) AS o FROM labelled WHERE label IN ('lore', 'ambiguous') AND text IS NOT NULL GROUP BY 1, 2),
merged AS (SELECT fact, list(source) AS sources FROM facts GROUP BY fact)
SELECT s AS source, count(*) AS n_facts FROM (SELECT fact, unnest(list_filter(sources, lambda x: x NOT IN ('src0', 'src1'))) AS s FROM merged) GROUP BY s"""
)
def public_facts(spark, d):
    """Public facts per source after hiding two sources: label, select, lineage union, mask, count."""
    picked = ground.select_for_extraction(_labelled(spark, d)).where("text IS NOT NULL")
    facts = resolve.dedup_lineage(picked, [], "text", "source", "doc_id")
    return mask.mask_facts(facts, "sources", EXCLUDED).select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n_facts"))


@query("SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS batch, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 3 AS BIGINT) AS local_id FROM conversations")
def batch_ids_file_pure(spark, d):
    return ground.batches(table(spark, d, "conversations"), 3, ["turn"], ["conv_id"]).select("conv_id", "turn", "batch", "local_id")


@query("SELECT conv_id, turn, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) // 50 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY conv_id, turn) - 1) % 50 AS BIGINT) AS local_id FROM conversations")
def batch_ids_global(spark, d):
    rows = table(spark, d, "conversations").withColumn("chunk", F.floor(F.col("conv_id") / 1000))
    rows = rows.withColumn("ord", F.col("conv_id") * 100000 + F.col("turn"))
    return ground.global_batches(rows, 50, "ord", "chunk").select("conv_id", "turn", "batch", "local_id")


_NORM = "trim(regexp_replace(regexp_replace(replace(translate({0}, '‘’“”—–', '''''\"\"--'), '…', '...'), '-{{2,}}', '-', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_NORM.format('text')}) AS norm_sha256 FROM documents")
def norm_for_match(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.norm_for_match("text"), 256).alias("norm_sha256"))


_PAIRS = f"""WITH q AS (SELECT item_id, {_NORM.format('text')} AS q FROM benchmark), t AS (SELECT doc_id, {_NORM.format('text')} AS t FROM documents),
pairs AS (SELECT item_id, doc_id FROM q, t WHERE q <> '' AND contains(t, q))"""


def _pairs(spark, d):
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    texts = table(spark, d, "documents").select("doc_id", "text")
    return ground.containment_join(quotes, "quote", texts, "text")


@query(_PAIRS + " SELECT item_id, doc_id FROM pairs")
def verbatim_join(spark, d):
    return _pairs(spark, d).select("item_id", "doc_id")


@query(_PAIRS + " SELECT item_id, arg_min(doc_id, (CASE WHEN doc_id = item_id * 25 THEN 0 ELSE 1 END) * 10000000000 + doc_id) AS doc_id, bool_or(doc_id = item_id * 25) AS is_cited, count(DISTINCT doc_id) > 1 AS ambiguous FROM pairs GROUP BY item_id")
def verbatim_priority_pick(spark, d):
    pairs = _pairs(spark, d).withColumn("cited", F.col("item_id") * 25)
    return ground.pick_support(pairs, "item_id", "cited", "doc_id")


@query(
    """WITH q AS (SELECT item_id, 'as is' AS form, text AS quote FROM benchmark UNION ALL SELECT item_id, 'upper', translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') FROM benchmark UNION ALL SELECT item_id, 'reversed', array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM benchmark),
t AS (SELECT text, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS s, """
    + _NORM.format("text")
    + """ AS n FROM documents),
k AS (SELECT item_id, form, regexp_replace(lower(quote), '[^0-9a-z]', '', 'g') AS s, """
    + _NORM.format("quote")
    + """ AS n FROM q),
hit AS (SELECT k.item_id, k.form, bool_or(contains(t.n, k.n)) AS here FROM k JOIN t ON k.s <> '' AND contains(t.s, k.s) GROUP BY ALL)
SELECT k.item_id, k.form, CASE WHEN hit.here IS NULL THEN 'reword' WHEN hit.here THEN 'unknown' ELSE 'cosmetic' END AS triage FROM k LEFT JOIN hit USING (item_id, form)"""
)
def quote_triage(spark, d):
    """Why a quote was dropped: its skeleton is nowhere (reword), or only the strict form is not (cosmetic)."""
    b = table(spark, d, "benchmark")
    forms = {"as is": F.col("text"), "upper": F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "reversed": F.array_join(F.reverse(F.split("text", " ")), " ")}
    quotes = None
    for name, c in forms.items():
        one = b.select("item_id", F.lit(name).alias("form"), c.alias("quote"))
        quotes = one if quotes is None else quotes.unionByName(one)
    k = quotes.withColumn("norm", X.norm_for_match("quote"))
    pairs = ground.skeleton_join(k, "quote", table(spark, d, "documents").select("text"), "text")
    hit = pairs.groupBy("item_id", "form").agg(F.max(F.contains(X.norm_for_match("text"), F.col("norm"))).alias("here"))
    out = k.select("item_id", "form").join(hit, ["item_id", "form"], "left")
    return out.select("item_id", "form", F.when(F.col("here").isNull(), "reword").when(F.col("here"), "unknown").otherwise("cosmetic").alias("triage"))


_CACHE_KEY = "sha256('model' || chr(0) || coalesce(lang, '') || chr(0) || coalesce(text, ''))"


@query(f"SELECT doc_id, {_CACHE_KEY} AS key FROM documents WHERE {_CACHE_KEY} NOT IN (SELECT {_CACHE_KEY} FROM documents WHERE lang = 'de' OR source = 'src3')")
def cache_anti_join(spark, d):
    """Requests that a cache of some of them does not answer."""
    asked = table(spark, d, "documents").withColumn("key", X.cache_key(F.lit("model"), "lang", "text"))
    return ground.cache_misses(asked, asked.where("lang = 'de' OR source = 'src3'").select("key"), "key").select("doc_id", "key")


_TURNS = """m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS local_id, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
q AS (SELECT conv_id, local_id AS entry, text AS detail, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS quote, (local_id + 1) % n AS source_id FROM m),
p AS (SELECT q.*, m.local_id AS message, m.role FROM q JOIN m USING (conv_id) WHERE {0} <> '' AND contains({1}, {0})),
best AS (SELECT conv_id, entry, any_value(detail) AS detail, any_value(quote) AS quote, arg_min(message, (CASE WHEN message = source_id THEN 0 ELSE 1 END) * 100000 + message) AS message, arg_min(role, (CASE WHEN message = source_id THEN 0 ELSE 1 END) * 100000 + message) AS role, count(*) AS n_texts FROM p GROUP BY conv_id, entry)
""".format(_NORM.format("quote"), _NORM.format("m.text"))


def _batches(spark, d):
    """Conversations as batches: messages, and a claim per message that cites the next one for its own first words."""
    by = Window.partitionBy("conv_id")
    rows = table(spark, d, "conversations").withColumns({"local_id": F.row_number().over(by.orderBy("turn")) - 1, "n": F.count("*").over(by)})
    messages = rows.select("conv_id", "local_id", F.col("role").alias("sender"), F.concat(F.lit("f"), F.col("conv_id").cast("string")).alias("source_file"), F.col("text").alias("content"))
    quote = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    claims = rows.select("conv_id", F.col("local_id").alias("entry"), F.col("text").alias("detail"), quote.alias("quote"), ((F.col("local_id") + 1) % F.col("n")).cast("bigint").alias("source_id"))
    return messages, claims


@query(f"WITH {_TURNS} SELECT conv_id, CAST(entry AS INTEGER) AS entry, CAST(message AS INTEGER) AS message, n_texts FROM best")
def quote_in_batch(spark, d):
    messages, claims = _batches(spark, d)
    return extract.resolve_quotes(claims, messages, ["conv_id"], ["conv_id", "entry"]).select("conv_id", "entry", F.col("at").alias("message"), "n_texts")


@query(
    f"""WITH {_TURNS} SELECT conv_id, CAST(entry AS INTEGER) AS entry, CASE WHEN entry % 2 = 0 THEN 'items' ELSE 'history' END AS entity_type,
CASE WHEN entry % 2 = 0 THEN left(detail, 80) ELSE 'said' END AS name, role AS speaker, CASE WHEN entry % 4 = 1 THEN 'regional' WHEN entry % 2 = 1 THEN 'world' END AS scope
FROM best"""
)
def typed_entries(spark, d):
    """Entities without a name and events from JSON replies; both keep only what their batch holds."""
    messages, claims = _batches(spark, d)
    fact = F.struct("detail", "quote", "source_id")
    item = F.to_json(F.struct(F.array(fact).alias("details")))
    event = F.to_json(F.struct(F.lit("said").alias("name"), F.col("detail").alias("description"), F.when(F.col("entry") % 4 == 1, " Regional ").otherwise("?").alias("scope"), F.array(fact).alias("quotes")))
    even = F.col("entry") % 2 == 0
    raw = claims.select("conv_id", "entry", F.when(even, "items").otherwise("history").alias("entity_type"), F.when(even, item).otherwise(event).alias("raw"))
    made = extract.build_entries(raw, messages, ["conv_id"]).where("size(quotes) > 0")
    return made.select("conv_id", "entry", "entity_type", "name", F.get("quotes", F.lit(0))["speaker"].alias("speaker"), "scope")


# --- chat logs -----------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(i AS INTEGER) AS lineno, sha256(line) AS line_sha256 FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) AS i FROM documents)")
def line_split(spark, d):
    return chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", "lineno", F.sha2("line", 256).alias("line_sha256"))


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS lineno FROM documents)"


@query(
    f"WITH {_LINES}, r AS (SELECT doc_id, lineno, sum(CASE WHEN regexp_matches(line, '^[A-Z][a-z]{{1,3}} ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lineno) AS record FROM lines) "
    "SELECT doc_id, CAST(record AS BIGINT) AS record, count(*) AS n_lines, CAST(min(lineno) AS INTEGER) AS first_line FROM r WHERE record > 0 GROUP BY doc_id, record"
)
def record_islands(spark, d):
    lines = chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"])
    rows = chatlog.islands(lines, ["doc_id"], "lineno", F.col("line").rlike("^[A-Z][a-z]{1,3} ")).where("record > 0")
    return rows.groupBy("doc_id", "record").agg(F.count("*").alias("n_lines"), F.min("lineno").alias("first_line"))


@query(
    f"WITH {_LINES}, m AS (SELECT doc_id, lineno, coalesce(last_value(CASE WHEN regexp_matches(line, '^[A-M]') THEN 1 WHEN length(line) < 80 THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY lineno ROWS UNBOUNDED PRECEDING), 0) AS s FROM lines) "
    "SELECT doc_id, count(*) AS n_kept FROM m WHERE s = 0 GROUP BY doc_id"
)
def state_filter(spark, d):
    lines = chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"])
    state = chatlog.block_state(lines, ["doc_id"], "lineno", F.col("line").rlike("^[A-M]"), F.length("line") < 80)
    return lines.withColumn("s", state).where("s = 0").groupBy("doc_id").agg(F.count("*").alias("n_kept"))


@query(
    f"WITH {_LINES}, m AS (SELECT doc_id, lineno, regexp_matches(line, '^[A-D]') AS f, sum(CASE WHEN regexp_matches(line, '^[A-D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lineno) AS n FROM lines) "
    "SELECT doc_id, count(*) FILTER (WHERE n % 2 = 1 AND NOT f) AS n_inside FROM m GROUP BY doc_id"
)
def toggle_mask(spark, d):
    lines = chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"])
    rows = chatlog.islands(lines, ["doc_id"], "lineno", F.col("line").rlike("^[A-D]"))
    return rows.groupBy("doc_id").agg(F.count_if((F.col("record") % 2 == 1) & ~F.col("line").rlike("^[A-D]")).alias("n_inside"))


@query(
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations),
b AS (SELECT conv_id, turn, trim(string_agg(trim(line), chr(10) ORDER BY i), chr(10)) AS content FROM l GROUP BY conv_id, turn), k AS (SELECT * FROM b WHERE content <> '')
SELECT CAST(conv_id AS VARCHAR) AS source_file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS msg_ord, role AS sender_raw, sha256(content) AS content_sha256 FROM k JOIN conversations USING (conv_id, turn)"""
)
def chat_messages(spark, d):
    """Conversations written as chat logs, with notices and reactions between the lines, and parsed again."""
    turns = table(spark, d, "conversations")
    head = F.concat(F.lit("May 17, 2022  5:29:42 PM (Read by you)\r\r\n"), F.col("role"), F.lit("\r\r\n"))
    noise = F.lit("\n/Users/x/a.png\nThis message responded to an earlier message.\nTapbacks:\n    Loved by Ash\n")
    log = turns.groupBy(F.col("conv_id").cast("string").alias("source_file")).agg(resolve.in_order(F.concat(head, F.col("text"), noise), "turn").alias("t"))
    lines = chatlog.to_lines(log.select("source_file", F.array_join("t", "\n").alias("text")), "text", ["source_file"])
    return chatlog.parse_messages(lines).select("source_file", "msg_ord", "sender_raw", F.sha2("content", 256).alias("content_sha256"))


_HANDLES = [("exporter", "Dana"), ("+16305550100", "Ash"), ("user0", "Robin")]


@query(
    """WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN ' Me ' WHEN role = 'system' THEN '+1 (630) 555-0100' ELSE role || CAST(conv_id % 3 AS VARCHAR) END AS raw FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(trim(raw)) = 'me' THEN 'Dana' WHEN trim(raw) = 'user0' THEN 'Robin' WHEN raw LIKE '+1%' THEN 'Ash' ELSE trim(raw) END AS sender,
CASE WHEN lower(trim(raw)) = 'me' THEN 'self' WHEN trim(raw) = 'user0' THEN 'exact' WHEN raw LIKE '+1%' THEN 'phone' ELSE 'name' END AS how FROM m"""
)
def sender_resolution(spark, d):
    raw = F.when(F.col("role") == "assistant", " Me ").when(F.col("role") == "system", "+1 (630) 555-0100").otherwise(F.concat("role", (F.col("conv_id") % 3).cast("string")))
    messages = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("sender_raw"))
    return chatlog.resolve_senders(messages, spark.createDataFrame(_HANDLES, "handle string, name string")).select("conv_id", "turn", "sender", "how")


@query("SELECT role, count(*) AS n_messages FROM conversations GROUP BY role")
def sender_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n_messages"))


# --- names ---------------------------------------------------------------------------------------------------------

_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-')"


@query(f"SELECT p_partkey, replace({_SLUG.format('p_name')}, '-', ' ') AS name_key FROM part")
def name_key_fold(spark, d):
    return table(spark, d, "part").select("p_partkey", X.name_key_ascii("p_name").alias("name_key"))


# A text's key is as long as the text, so its digest is what comes out.


@query(f"SELECT doc_id, sha256({_SLUG.format('text')}) AS slug_sha256 FROM documents")
def slug_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.slug_ascii("text"), 256).alias("slug_sha256"))


@query(f"SELECT doc_id, sha256({_SLUG.format('strip_accents(text)')}) AS slug_sha256 FROM documents")
def slug_fold_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.slug("text"), 256).alias("slug_sha256"))


@query(f"SELECT doc_id, sha256(regexp_replace(replace({_SLUG.format('text')}, '-', ' '), '^(the|a|an) ', '')) AS article_key_sha256 FROM documents")
def article_strip(spark, d):
    """Keys of the texts of every language."""
    return table(spark, d, "documents").select("doc_id", F.sha2(X.strip_article(X.name_key_ascii("text")), 256).alias("article_key_sha256"))


@query(
    """WITH n AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT DISTINCT p_name FROM part)
SELECT DISTINCT name, CASE WHEN regexp_matches(name, '[A-Za-z]{4}') AND (upper(name) = name OR lower(name) = name)
THEN array_to_string(list_transform(string_split(name, ' '), lambda t: upper(left(t, 1)) || lower(substr(t, 2))), ' ') ELSE name END AS display FROM n"""
)
def display_title_case(spark, d):
    names = table(spark, d, "region").select(F.col("r_name").alias("name"))
    names = names.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"))).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name")))
    return names.distinct().select("name", X.title_case("name").alias("display"))


# --- merging -------------------------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, trim(line) AS key, CAST(min(lineno) AS INTEGER) AS first_ord, arg_min(line, lineno) AS first_value FROM lines GROUP BY doc_id, trim(line)")
def ordered_distinct(spark, d):
    lines = chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"])
    return resolve.ordered_distinct(lines, ["doc_id"], "line", "lineno").select("doc_id", "key", "first_ord", "first_value")


@query(
    """WITH f AS (SELECT lang, trim(text) AS fact, source, min(doc_id) AS o FROM documents GROUP BY ALL)
SELECT lang, sha256(fact) AS fact_sha256, min(o) AS first_ord, string_agg(source, ',' ORDER BY o, source) AS sources FROM f GROUP BY lang, fact"""
)
def detail_dedup_lineage(spark, d):
    facts = resolve.dedup_lineage(table(spark, d, "documents"), ["lang"], "text", "source", "doc_id")
    return facts.select("lang", F.sha2("fact", 256).alias("fact_sha256"), "first_ord", F.array_join("sources", ",").alias("sources"))


@query("SELECT text AS quote, role AS speaker, min(conv_id * 100000 + turn) AS first_ord, count(*) AS n_times FROM conversations GROUP BY text, role")
def quote_dedup(spark, d):
    rows = table(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 100000 + F.col("turn"))
    return rows.groupBy(F.col("text").alias("quote"), F.col("role").alias("speaker")).agg(F.min("ord").alias("first_ord"), F.count("*").alias("n_times"))


@query("SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, lower(p_name)) AS group_id FROM part")
def identical_merge(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.concat_ws("|", "p_brand", X.name_key_ascii("p_name")))
    return resolve.merge_by_key(parts, "key", "p_partkey", "p_partkey").select("p_partkey", "group_id")


@query(
    """WITH g AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, lower(p_name)) AS group_id, CASE WHEN p_size > 30 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END AS r FROM part)
SELECT group_id, count(*) AS n_members, bool_or(p_size > 40) AS is_pc, CASE max(r) WHEN 2 THEN 'world' WHEN 1 THEN 'regional' ELSE 'personal' END AS scope,
arg_min(p_type, p_partkey) AS first_type FROM g GROUP BY group_id"""
)
def combine_group(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.concat_ws("|", "p_brand", X.name_key_ascii("p_name")))
    parts = parts.withColumn("scope", F.when(F.col("p_size") > 30, "world").when(F.col("p_size") > 10, "regional").otherwise("personal"))
    merged = resolve.merge_by_key(parts, "key", "p_partkey", "p_partkey")
    return merged.groupBy("group_id").agg(
        F.count("*").alias("n_members"), F.max(F.col("p_size") > 40).alias("is_pc"), resolve.broadest_scope("scope").alias("scope"),
        resolve.first_stated("p_type", "p_partkey").alias("first_type"),
    )


_ENTITIES = "e AS (SELECT p_partkey AS o, min(p_partkey) OVER (PARTITION BY p_brand, lower(p_name)) AS g, p_name, p_type, 's' || p_size AS src FROM part)"


def _part_entities(spark, d):
    p = table(spark, d, "part")
    src = F.array(F.concat(F.lit("s"), F.col("p_size").cast("string")))
    fact = F.array(F.struct(F.col("p_type").alias("text"), src.alias("source_files")))
    none = lambda kind: F.lit(None).cast(kind)
    return p.select(
        F.col("p_brand").alias("brand"), F.lit("items").alias("entity_type"), F.array("p_partkey").alias("ord"), F.col("p_partkey").alias("index"), F.col("p_name").alias("name"), src.alias("name_sources"),
        fact.alias("aliases"), fact.alias("details"), F.array(F.struct(F.col("p_type").alias("text"), F.col("p_brand").alias("speaker"), src[0].alias("source_file"))).alias("quotes"),
        none("boolean").alias("is_pc"), none("string").alias("player_name"), none("array<string>").alias("pronouns"), none("string").alias("description"), none("string").alias("scope"), none("string").alias("date_text"),
    )


def _spelled(facts):
    return F.array_join(F.transform(facts, lambda x: F.concat(x["text"], F.lit("@"), F.array_join(x["source_files"], "+"))), "|")


@query(
    f"""WITH {_ENTITIES}, f AS (SELECT g, p_type AS t, src, min(o) AS o FROM e GROUP BY ALL), one AS (SELECT g, t, min(o) AS o, string_agg(src, '+' ORDER BY o) AS s FROM f GROUP BY g, t),
d AS (SELECT g, string_agg(t || '@' || s, '|' ORDER BY o) AS facts FROM one GROUP BY g), q AS (SELECT g, count(*) AS n_quotes FROM (SELECT DISTINCT g, p_type, src FROM e) GROUP BY g),
h AS (SELECT g, string_agg(src, '+' ORDER BY o) AS heading_sources FROM (SELECT g, src, min(o) AS o FROM e GROUP BY g, src) GROUP BY g)
SELECT g AS group_id, arg_min(p_name, o) AS name, heading_sources, count(*) AS n_members, facts AS aliases, facts AS details, CAST(n_quotes AS INTEGER) AS n_quotes FROM e JOIN d USING (g) JOIN q USING (g) JOIN h USING (g) GROUP BY ALL"""
)
def combine_entities(spark, d):
    """The whole merge of entities of a brand with one name: aliases, facts and headings with the union of their sources."""
    e = _part_entities(spark, d).withColumn("key", F.concat_ws("|", "brand", X.name_key_ascii("name")))
    members = resolve.merge_by_key(e, "key", "index", "index").withColumns({"pos": F.col("index"), "canonical": F.upper("name")})
    out = reconcile.combine(members, ["entity_type", "group_id"])
    return out.select("group_id", "name", F.array_join("name_sources", "+").alias("heading_sources"), "n_members", _spelled("aliases").alias("aliases"), _spelled("details").alias("details"), F.size("quotes").alias("n_quotes"))


_PARTY = [(0, "Kim", "Green Red", ["green red", "hot pink"], []), (1, "small blue", "Small", ["small"], []), (2, "Ash", "Cold Steel", ["cold steel", "cold"], []), (3, "Ash", "Other", ["other"], [])]


@query(
    """WITH k AS (SELECT * FROM (VALUES (0, 'green red'), (0, 'hot pink'), (1, 'small'), (2, 'cold steel'), (2, 'cold'), (3, 'other')) t(grp, known)), n AS (SELECT p_partkey, p_name AS name FROM part),
m AS (SELECT p_partkey, grp, CASE WHEN name = known THEN 0 WHEN length(name) >= 4 AND length(known) >= 4 AND levenshtein(name, known) = 1 THEN 1 WHEN length(known) >= 4 AND NOT contains(known, ' ') AND list_contains(string_split(name, ' '), known) THEN 2 END AS tier FROM n, k
UNION ALL SELECT p_partkey, 1, 3 FROM n WHERE name = 'small blue')
SELECT p_partkey, CAST(arg_min(grp, tier * 10 + grp) AS INTEGER) AS "group", ['exact', 'typo', 'token', 'player'][min(tier) + 1] AS tier FROM m WHERE tier IS NOT NULL GROUP BY p_partkey"""
)
def declared_party(spark, d):
    people = _part_entities(spark, d).withColumn("aliases", extract.empty("struct<text:string,source_files:array<string>>"))
    declared = spark.createDataFrame(_PARTY, "group int, player string, main_name string, recognition array<string>, pronouns array<string>")
    return reconcile.declared_tiers(people, declared).select(F.get("ord", F.lit(0)).alias("p_partkey"), "group", "tier")


@query(
    """WITH t AS (SELECT 'locations' AS kind, 1 AS r, n_nationkey AS i, lower(n_name) AS k FROM nation UNION ALL SELECT 'organizations', 2, n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT 'people', 3, n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 3 = 0), c AS (SELECT k, count(DISTINCT kind) AS n, bool_and(kind IN ('locations', 'organizations')) AS realm, min(r * 1000 + i) AS spot FROM t GROUP BY k),
x AS (SELECT k, row_number() OVER (ORDER BY spot) - 1 AS cluster FROM c WHERE n > 1 AND NOT realm)
SELECT CAST(cluster AS INTEGER) AS cluster, k AS key, kind AS entity_type FROM x JOIN t USING (k)"""
)
def type_conflicts(spark, d):
    """Names that several types have, numbered as they are shown; a place and its government may share one."""
    n = table(spark, d, "nation").select(F.array(big("n_nationkey")).alias("ord"), F.concat(F.lit("The "), F.col("n_name")).alias("name"), F.expr("array()").alias("details"), F.expr("array()").alias("quotes"))
    kinds = {"locations": "true", "organizations": "ord[0] % 2 = 0", "people": "ord[0] % 3 = 0"}
    rows = None
    for kind, cond in kinds.items():
        one = n.where(cond).withColumn("entity_type", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    return reconcile.type_conflicts(rows).select("cluster", F.regexp_replace("key", "^nation(?=[0-9])", "nation_").alias("key"), "entity_type")


@query(
    """WITH e AS (SELECT p_partkey AS id, p_brand, p_size, list_distinct(CASE WHEN p_partkey % 3 = 0 THEN [string_split(p_name, ' ')[1]] ELSE string_split(p_name, ' ') END) AS t FROM part),
s AS (SELECT a.p_brand, a.p_size, a.id AS frag, min(b.id) AS target, count(*) AS n FROM e a JOIN e b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id <> b.id AND list_has_all(b.t, a.t) AND len(b.t) > len(a.t) GROUP BY ALL),
f AS (SELECT * FROM s WHERE n = 1)
SELECT p_brand, p_size, frag, target FROM f WHERE frag NOT IN (SELECT target FROM f)"""
)
def subset_fold_unique(spark, d):
    toks = F.when(F.col("p_partkey") % 3 == 0, F.slice(F.split("p_name", " "), 1, 1)).otherwise(F.split("p_name", " "))
    return resolve.subset_folds(table(spark, d, "part").withColumn("toks", toks), ["p_brand", "p_size"], "p_partkey", "toks")


@query(
    """WITH e AS (SELECT n_nationkey AS o, replace(lower(n_name), '_', '') AS k FROM nation UNION ALL SELECT CAST(1000 + min(p_partkey) AS INTEGER), p_name FROM part GROUP BY p_name),
t AS (SELECT o, k, list_distinct(string_split(k, ' ')) AS t FROM e), w AS (SELECT o, unnest(t) AS w FROM t), rare AS (SELECT w FROM w WHERE length(w) >= 4 GROUP BY w HAVING count(*) <= 3)
SELECT CAST(a.o AS BIGINT) AS i, CAST(b.o AS BIGINT) AS j, CASE WHEN length(a.k) >= 4 AND length(b.k) >= 4 AND levenshtein(a.k, b.k) BETWEEN 1 AND 2 THEN 'edit'
WHEN (list_has_all(b.t, a.t) AND len(a.t) < len(b.t)) OR (list_has_all(a.t, b.t) AND len(b.t) < len(a.t)) THEN 'subset'
WHEN EXISTS (SELECT 1 FROM rare WHERE list_contains(a.t, rare.w) AND list_contains(b.t, rare.w)) THEN 'token' END AS reason
FROM t a JOIN t b ON a.o < b.o AND a.k <> b.k WHERE reason IS NOT NULL ORDER BY i, j LIMIT 50"""
)
def candidate_pairs(spark, d):
    names = table(spark, d, "nation").select(big("n_nationkey").alias("o"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("")).alias("k"))
    parts = table(spark, d, "part").groupBy(F.col("p_name").alias("k")).agg((F.min("p_partkey") + 1000).alias("o")).select("o", "k")
    return resolve.candidate_pairs(names.unionByName(parts), "o", "k")


@query(
    """WITH dec AS (SELECT * FROM (VALUES (1, 'green red', 'green'), (2, 'small blue', 'small'), (3, 'hot pink', 'hot')) t(declared, full_name, token)),
m AS (SELECT p.p_partkey, d.declared, CASE WHEN p.p_name = d.full_name THEN 0 WHEN levenshtein(p.p_name, d.full_name) = 1 THEN 1 WHEN string_split(p.p_name, ' ')[1] = d.token THEN 2 END AS tier FROM part p, dec d),
b AS (SELECT p_partkey, arg_min(declared, tier * 100 + declared) AS declared, min(tier) AS tier FROM m WHERE tier IS NOT NULL GROUP BY p_partkey)
SELECT p.p_partkey, b.declared, CAST(b.tier AS INTEGER) AS tier FROM part p LEFT JOIN b USING (p_partkey)"""
)
def declared_priority_join(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    dec = F.broadcast(spark.createDataFrame([(1, "green red", "green"), (2, "small blue", "small"), (3, "hot pink", "hot")], "declared int, full_name string, token string"))
    tiers = [
        parts.join(dec, F.col("p_name") == F.col("full_name")),
        parts.join(dec, F.levenshtein("p_name", "full_name", 1) == 1),
        parts.join(dec, F.get(F.split("p_name", " "), F.lit(0)) == F.col("token")),
    ]
    return resolve.priority_join(parts, "p_partkey", tiers).select("p_partkey", "declared", "tier")


@query()
def merge_components(spark, d):
    """Both groupings over all parts. All pairs of a component are too many for SQL; a union-find tests it."""
    parts = table(spark, d, "part")
    a = parts.select(F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("grp"), F.col("p_partkey").alias("m"))
    b = parts.select(F.concat_ws("|", "p_name", F.expr("p_partkey div 400").cast("string")).alias("grp"), F.col("p_partkey").alias("m"))
    return resolve.merge_components(a.unionByName(b), "grp", "m")


@query(
    """WITH e AS (SELECT p_brand || '|' || p_size AS grp, p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN left(p_name, 2) ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN [left(p_name, 2), 'x'] ELSE [p_name] END AS al FROM part)
SELECT grp, bool_or(length(trim(name)) <= 3) AND count(DISTINCT lower(trim(name))) > 1 AND NOT EXISTS (SELECT 1 FROM e a JOIN e b ON a.grp = b.grp AND a.id <> b.id WHERE a.grp = e.grp AND list_contains(list_transform(b.al, lambda x: lower(trim(x))), lower(trim(a.name)))) AS vetoed FROM e GROUP BY grp"""
)
def short_name_veto(spark, d):
    p = table(spark, d, "part")
    members = p.select(
        F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("grp"), "p_partkey",
        F.when(F.col("p_partkey") % 4 == 0, F.left("p_name", F.lit(2))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_partkey") % 6 == 0, F.array(F.left("p_name", F.lit(2)), F.lit("x"))).otherwise(F.array("p_name")).alias("al"),
    )
    return resolve.short_name_veto(members, "grp", "p_partkey", "name", "al")


@query(
    """WITH c AS (SELECT o_custkey, lower(trim(o_orderpriority)) AS k, count(*) AS n, arg_min(o_orderpriority, o_orderkey) AS v FROM orders GROUP BY ALL),
m AS (SELECT o_custkey, max(n) AS top, count(*) AS nv FROM c GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(v) END AS winner, count(*) > 1 AS vetoed, max(top) AS n_votes, max(nv) AS n_values FROM c JOIN m USING (o_custkey) WHERE n = top GROUP BY o_custkey"""
)
def player_majority(spark, d):
    return resolve.majority(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


_SCOPED = "SELECT *, CASE o_orderstatus WHEN 'F' THEN 'world' WHEN 'O' THEN 'regional' ELSE 'personal' END AS scope, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS r FROM orders"


@query(f"SELECT o_custkey, CASE max(r) WHEN 2 THEN 'world' WHEN 1 THEN 'regional' ELSE 'personal' END AS scope FROM ({_SCOPED}) GROUP BY o_custkey")
def scope_broadest(spark, d):
    scope = F.when(F.col("o_orderstatus") == "F", "world").when(F.col("o_orderstatus") == "O", "regional").otherwise("personal")
    return table(spark, d, "orders").withColumn("scope", scope).groupBy("o_custkey").agg(resolve.broadest_scope("scope").alias("scope"))


@query("SELECT o_custkey, arg_min(trim(p), o_orderkey) FILTER (WHERE trim(p) <> '') AS stated FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS p FROM orders) GROUP BY o_custkey")
def first_stated(spark, d):
    rows = table(spark, d, "orders").withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")))
    return rows.groupBy("o_custkey").agg(resolve.first_stated("p", "o_orderkey").alias("stated"))


@query(
    """WITH t AS (SELECT c_custkey AS k, 'characters' AS kind, c_nationkey AS f FROM customer UNION ALL SELECT s_suppkey, 'organizations', s_nationkey + 3 FROM supplier UNION ALL SELECT p_partkey, 'items', p_size FROM part),
p AS (SELECT k, kind, sum(f) AS f, CASE kind WHEN 'organizations' THEN 1 WHEN 'characters' THEN 2 ELSE 3 END AS r FROM t GROUP BY ALL)
SELECT k, string_agg(kind, ',' ORDER BY kind) AS kinds, arg_max(kind, f * 10 - r) AS winner, CAST(sum(f) AS BIGINT) AS n_facts FROM p GROUP BY k HAVING count(*) >= 2"""
)
def cross_type_cluster(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("characters").alias("kind"), big("c_nationkey").alias("f"))
    t = t.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("organizations").alias("kind"), big(F.col("s_nationkey") + 3).alias("f")))
    t = t.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lit("items").alias("kind"), big("p_size").alias("f")))
    out = resolve.cross_type_clusters(t, "k", "kind", "f", ["organizations", "characters", "items"], ("locations", "organizations"))
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT map_key, map_value FROM (SELECT lower(trim(p_type)) || p_size AS map_key, min(p_name) AS map_value, count(DISTINCT p_name) AS n FROM part GROUP BY 1) WHERE n = 1 AND map_key NOT IN (SELECT lower(p_type) || p_size FROM part WHERE p_partkey % 7 = 0)")
def deconflation_guard(spark, d):
    p = table(spark, d, "part").withColumn("k", F.concat("p_type", F.col("p_size").cast("string")))
    return resolve.guarded_map(p, "k", "p_name", p.where("p_partkey % 7 = 0"), "k")


# --- timeline ------------------------------------------------------------------------------------------------------


def _dated(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", big("user_id").alias("user_id"), "event_type", F.array(F.year("ts"), F.month("ts"), F.dayofmonth("ts")).alias("parts"))


_RANKED = "ranked AS (SELECT event_id, user_id, event_type, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY year(ts), month(ts), day(ts)) - 1 AS BIGINT) AS rank FROM events {0})"


@query(f"WITH {_RANKED.format('')} SELECT event_id, user_id, rank FROM ranked")
def timeline_spine(spark, d):
    return timeline.spine(_dated(spark, d), "user_id", "parts").select("event_id", "user_id", "rank")


@query(
    f"""WITH {_RANKED.format("WHERE event_type <> 'click'")}, m AS (SELECT user_id, max(rank) + 1 AS m FROM ranked GROUP BY user_id),
placed AS (SELECT event_id, CASE WHEN m IS NULL THEN '(undated)' ELSE CAST(e.user_id AS VARCHAR) END AS system, coalesce(e.event_id % (m + 1), 0) AS k FROM events e LEFT JOIN m USING (user_id) WHERE event_type = 'click'),
a AS (SELECT event_id, CAST(user_id AS VARCHAR) AS system, rank AS k, 1 AS kind FROM ranked UNION ALL SELECT event_id, system, k, 0 FROM placed)
SELECT event_id, system, CAST(row_number() OVER (PARTITION BY system ORDER BY k, kind, event_id) - 1 AS BIGINT) AS position FROM a"""
)
def timeline_weave(spark, d):
    """Every click is placed; those of a user without dated events stand in the undated system."""
    every = _dated(spark, d).withColumn("system", F.col("user_id").cast("string"))
    ranked = timeline.spine(every.where("event_type <> 'click'"), "system", "parts")
    known = timeline.gaps(ranked, "system")
    m = ranked.groupBy("system").agg((F.max("rank") + 2).alias("n"))
    wish = every.where("event_type = 'click'").join(m, "system", "left").select(
        "event_id",
        F.when(F.col("n").isNull(), timeline.UNDATED).otherwise(F.col("system")).alias("system"),
        F.coalesce(F.col("event_id") % F.col("n"), F.lit(0)).alias("gap"),
        F.col("event_id").alias("placement_pos"),
    )
    placed = timeline.valid_placements(wish, known, ranked, "event_id", ["placement_pos"])
    return timeline.weave(ranked, placed, "system", "event_id", "event_id")


@query("SELECT event_id, len(regexp_extract_all(props, '\\d+')) = 0 OR list_has_any([month(ts), day(ts)], list_transform(regexp_extract_all(props, '\\d+'), lambda x: CAST(TRY_CAST(x AS INTEGER) AS BIGINT))) AS usable FROM events")
def date_guard(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.coalesce(timeline.date_guard(F.array(F.month("ts"), F.dayofmonth("ts")), "props", F.lit(False)), F.lit(False)).alias("usable"))


@query("SELECT o_custkey, count(*) AS n_ranked, CAST((SELECT count(*) FROM orders b JOIN orders c ON b.o_custkey = c.o_custkey AND b.o_orderkey < c.o_orderkey AND b.o_orderpriority > c.o_orderpriority WHERE b.o_custkey = a.o_custkey) AS BIGINT) AS inversions FROM orders a GROUP BY o_custkey")
def inversion_count(spark, d):
    return timeline.inversions(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderpriority")


@query("SELECT source, count(*) FILTER (WHERE b IS NOT NULL) AS n_pairs, count(*) FILTER (WHERE k < b) AS n_violations FROM (SELECT source, k, lag(k) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM (SELECT source, doc_id, lower(text) AS k FROM documents)) GROUP BY source HAVING count(*) FILTER (WHERE b IS NOT NULL) > 0")
def alpha_order_violations(spark, d):
    """Order violations by whole texts: equal beginnings do not make a pair ordered."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.lower("text").alias("k"))
    return timeline.order_violations(docs, ["source"], ["doc_id"], "k")


@query("SELECT l_orderkey, count(*) AS n_pairs, count(*) FILTER (WHERE l_partkey <= b) AS n_violations FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY l_orderkey")
def ascending_violations(spark, d):
    return timeline.order_violations(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey", "l_partkey"], "l_partkey", strict=True)


# --- masking -------------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT trim(text) AS fact, source, min(doc_id) AS o FROM documents GROUP BY ALL)
SELECT sha256(fact) AS fact_sha256, string_agg(source, ',' ORDER BY o, source) FILTER (WHERE source NOT IN ('src0', 'src1')) AS sources FROM f GROUP BY fact HAVING bool_or(source NOT IN ('src0', 'src1'))"""
)
def mask_facts(spark, d):
    facts = resolve.dedup_lineage(table(spark, d, "documents"), [], "text", "source", "doc_id")
    return mask.mask_facts(facts, "sources", EXCLUDED).select(F.sha2("fact", 256).alias("fact_sha256"), F.array_join("sources", ",").alias("sources"))


@query(
    """SELECT min(doc_id) AS entity, CASE WHEN arg_min(source, doc_id) NOT IN ('src0', 'src1') THEN 'n' || min(doc_id) ELSE 'n' || min(doc_id) FILTER (WHERE source NOT IN ('src0', 'src1')) END AS name,
count(*) FILTER (WHERE source NOT IN ('src0', 'src1')) AS n_details FROM documents GROUP BY doc_id // 4 HAVING bool_or(source NOT IN ('src0', 'src1'))"""
)
def mask_rehead(spark, d):
    docs = table(spark, d, "documents").withColumn("e", F.expr("doc_id div 4"))
    one = F.struct("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("text"), F.array("source").alias("source_files"))
    e = docs.groupBy("e").agg(F.array_sort(F.collect_list(one)).alias("all"), F.min("doc_id").alias("entity"))
    bare = F.transform("all", lambda x: F.struct(x["text"].alias("text"), x["source_files"].alias("source_files")))
    quotes = F.expr("array()").cast("array<struct<text:string,speaker:string,source_file:string>>")
    e = e.select("entity", F.get("all", F.lit(0))["text"].alias("name"), F.get("all", F.lit(0))["source_files"].alias("name_sources"), F.slice(bare, F.lit(2), F.greatest(F.size(bare), F.lit(1))).alias("aliases"), bare.alias("details"), quotes.alias("quotes"), F.lit("p").alias("prose"))
    return mask.mask_entities(e, EXCLUDED).select("entity", "name", big(F.size("details")).alias("n_details"))


@query("SELECT source AS name, 'duplicate' AS problem FROM documents GROUP BY source HAVING count(*) > 1 UNION ALL SELECT x, 'unknown' FROM (VALUES ('src1'), ('nowhere')) t(x) WHERE x NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def exclusion_validate(spark, d):
    return mask.check_exclusions(table(spark, d, "documents").select("source"), "source", ["src1", "nowhere"])


# --- rendering -----------------------------------------------------------------------------------------------------


@query(
    """SELECT row_number() OVER (ORDER BY o) AS n, quote, speaker, source FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS quote, role AS speaker, CAST(conv_id % 5 AS VARCHAR) AS source, min(conv_id * 100000 + turn) AS o
FROM conversations GROUP BY ALL) WHERE quote <> ''"""
)
def footnote_numbering(spark, d):
    rows = table(spark, d, "conversations").withColumn("source", (F.col("conv_id") % 5).cast("string"))
    return render.number_footnotes(rows, "text", "role", "source", ["conv_id", "turn"])


@query("SELECT p_partkey, CASE WHEN k = 1 THEN b ELSE b || '-' || k END AS anchor FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS b, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def slug_suffixing(spark, d):
    parts = table(spark, d, "part").withColumn("base", X.slug_ascii("p_name"))
    out = render.assign_anchors(parts, "base", ["p_partkey"], F.concat(F.lit("entity-"), F.col("p_partkey").cast("string")))
    return out.select("p_partkey", "anchor")


_CLAIMS = """claims AS (SELECT split_part(p_name, ' ', 1) AS surface, 'p' || p_partkey AS anchor, CASE WHEN p_partkey % 2 = 0 THEN 'Location' ELSE 'Organization' END AS kind, p_size > 45 AS is_name FROM part
UNION ALL SELECT 'c' || c_custkey // 2, 'c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Location' ELSE 'Organization' END, true FROM customer)"""


@query(
    f"""WITH {_CLAIMS}, b AS (SELECT surface, max(is_name) AS named FROM claims GROUP BY surface),
o AS (SELECT surface, count(DISTINCT anchor) AS n, min(anchor) AS one, list_sort(list_distinct(list(kind))) AS kinds, min(anchor) FILTER (WHERE kind = 'Location') AS place, max(named) AS named FROM claims JOIN b USING (surface) WHERE is_name = named GROUP BY surface)
SELECT surface, CASE WHEN n = 1 THEN one ELSE place END AS anchor FROM o WHERE n = 1 OR (named AND n = 2 AND kinds = ['Location', 'Organization'])"""
)
def link_claims(spark, d):
    p = table(spark, d, "part").select(F.get(F.split("p_name", " "), F.lit(0)).alias("surface"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("anchor"), F.when(F.col("p_partkey") % 2 == 0, "Location").otherwise("Organization").alias("kind"), (F.col("p_size") > 45).alias("is_name"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.expr("c_custkey div 2").cast("string")).alias("surface"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"), F.when(F.col("c_custkey") % 3 == 0, "Location").otherwise("Organization").alias("kind"), F.lit(True).alias("is_name"))
    return render.link_pool(p.unionByName(c))


_POOL = [("the", "a-the"), ("and", "a-and"), ("of", "a-of"), ("que", "a-que")]


@query(
    """WITH w AS (SELECT doc_id, unnest(string_split(t, ' ')) AS s, generate_subscripts(string_split(t, ' '), 1) - 1 AS i FROM (SELECT doc_id, regexp_replace(text, '[^0-9A-Za-z_''’-]+', ' ', 'g') AS t FROM documents))
SELECT doc_id, 'a-' || s AS anchor, CAST(min(i) AS INTEGER) AS word_pos FROM w WHERE s IN ('the', 'and', 'of', 'que') GROUP BY ALL"""
)
def mention_first_per_block(spark, d):
    pool = F.broadcast(spark.createDataFrame(_POOL, "surface string, anchor string"))
    return render.mentions(table(spark, d, "documents"), "doc_id", "text", pool)


@query()
def link_weave_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("own"))
    return render.weave_links(docs, "text", "own", spark.createDataFrame(_POOL, "surface string, anchor string")).select("doc_id", "text")


@query(
    """WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS slug FROM pages), a AS (SELECT DISTINCT lower(slug) AS slug FROM h WHERE page_id % 2 = 0)
SELECT page_id, count(*) AS n_links, count(*) FILTER (WHERE a.slug IS NULL) AS n_broken FROM h LEFT JOIN a USING (slug) GROUP BY page_id"""
)
def links_resolve(spark, d):
    h = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("slug"))
    anchors = h.where("page_id % 2 = 0").select(F.lower("slug").alias("slug")).distinct().withColumn("ok", F.lit(True))
    return h.join(anchors, "slug", "left").groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_if(F.col("ok").isNull()).alias("n_broken"))


@query("SELECT replace(p_name, ' ', '-') AS id, count(*) - 1 AS n_extra FROM part GROUP BY 1 HAVING count(*) > 1")
def anchors_duplicates(spark, d):
    return table(spark, d, "part").groupBy(X.slug_ascii("p_name").alias("id")).agg((F.count("*") - 1).alias("n_extra")).where("n_extra > 0")


@query(
    f"""WITH {_LINES}, h AS (SELECT doc_id, lineno, lead(lineno) OVER (PARTITION BY doc_id ORDER BY lineno) AS nxt FROM lines WHERE length(line) < 60)
SELECT h.doc_id, CAST(h.lineno AS INTEGER) AS entry, count(l.lineno) AS n_lines FROM h LEFT JOIN lines l ON l.doc_id = h.doc_id AND l.lineno > h.lineno AND (h.nxt IS NULL OR l.lineno < h.nxt) GROUP BY ALL"""
)
def entry_span_range_join(spark, d):
    """Lines inside each entry's span: the entry is the last head above a line, so no range join is needed."""
    lines = chatlog.to_lines(table(spark, d, "documents"), "text", ["doc_id"])
    head = F.length("line") < 60
    w = Window.partitionBy("doc_id").orderBy("lineno").rowsBetween(Window.unboundedPreceding, 0)
    owned = lines.withColumn("entry", F.last(F.when(head, F.col("lineno")), ignorenulls=True).over(w)).where("entry IS NOT NULL")
    return owned.groupBy("doc_id", "entry").agg((F.count("*") - 1).alias("n_lines"))


# --- grading -------------------------------------------------------------------------------------------------------


def _votes(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    name = lambda c: F.when(c, "pass").otherwise("fail")
    three = F.array(name(F.col("quality") == 1), name(F.col("toxic") == 0), F.when(F.col("n_chars") > 4000, "odd").otherwise(name(F.col("n_chars") > 1000)))
    return lab.select("doc_id", F.posexplode(three).alias("vote", "label"))


_VOTES = """v AS (SELECT doc_id, unnest([0, 1, 2]) AS vote, unnest([CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END, CASE WHEN toxic = 0 THEN 'pass' ELSE 'fail' END,
CASE WHEN n_chars > 4000 THEN 'odd' WHEN n_chars > 1000 THEN 'pass' ELSE 'fail' END]) AS label FROM labels JOIN documents USING (doc_id))"""


@query(
    f"""WITH {_VOTES}, c AS (SELECT doc_id, count(*) FILTER (WHERE label = 'pass') AS p, count(*) FILTER (WHERE label = 'fail') AS f FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN p > f THEN 'pass' ELSE 'fail' END AS label, p = f AS split, p + f AS n_votes FROM c"""
)
def vote_majority(spark, d):
    return grade.vote_majority(_votes(spark, d), ["doc_id"], "label", ["pass", "fail"], "fail")


@query(
    f"""WITH {_VOTES}, c AS (SELECT doc_id, count(*) FILTER (WHERE label = 'pass') AS p, count(*) FILTER (WHERE label <> 'odd') AS u FROM v GROUP BY doc_id)
SELECT doc_id, CASE WHEN 2 * p > u THEN 'pass' ELSE 'fail' END AS label, u AS usable FROM c"""
)
def strict_majority(spark, d):
    votes = _votes(spark, d).withColumn("label", F.when(F.col("label") != "odd", F.col("label")))
    return grade.strict_majority(votes, ["doc_id"], "label", "fail")


@query(
    f"""WITH {_VOTES} SELECT doc_id, 2 * count(*) FILTER (WHERE label = 'pass') > count(*) AS decision, count(*) FILTER (WHERE label = 'pass') BETWEEN 1 AND count(*) - 1 AS split,
CASE WHEN 2 * count(*) FILTER (WHERE label = 'pass') > count(*) THEN min(vote) FILTER (WHERE label = 'pass') ELSE min(vote) FILTER (WHERE label <> 'pass') END AS companion FROM v GROUP BY doc_id"""
)
def bool_fold(spark, d):
    votes = _votes(spark, d).withColumns({"flag": F.col("label") == "pass", "own": F.col("vote")})
    return grade.fold_bool(votes, ["doc_id"], "flag", "vote", "own")


@query(
    f"""WITH {_VOTES}, c AS (SELECT doc_id, vote, label FROM v), l AS (SELECT doc_id, vote, CASE label WHEN 'pass' THEN 'pass' WHEN 'fail' THEN CASE WHEN vote = 0 THEN 'partial' ELSE 'fail' END END AS label FROM c),
n AS (SELECT doc_id, label, count(*) AS k FROM l WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT doc_id, sum(k) AS s, max(k) AS m FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN 2 * m > s THEN max(label) FILTER (WHERE k = m) ELSE 'fail' END AS status FROM t JOIN n USING (doc_id) GROUP BY doc_id, m, s"""
)
def claim_verdicts(spark, d):
    """Two verdicts per vote: affirmed ones pass, an omitted one makes it partial, a contradicted one fails, an odd one abstains."""
    second = F.when(F.col("label") == "pass", " Affirmed").when(F.col("label") == "odd", "maybe").when(F.col("vote") == 0, "omitted").otherwise("contradicted")
    claims = _votes(spark, d).select("doc_id", "vote", F.explode(F.array(F.lit("affirmed"), second)).alias("verdict"))
    return graders.faithfulness(claims, ["doc_id"])


@query(
    """WITH v AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 2 AS choice FROM orders), n AS (SELECT o_custkey, choice, count(*) AS k FROM v WHERE choice >= 0 GROUP BY ALL),
t AS (SELECT o_custkey, max(k) AS m FROM n GROUP BY o_custkey), w AS (SELECT o_custkey, CASE WHEN count(*) = 1 THEN min(choice) END AS choice FROM n JOIN t USING (o_custkey) WHERE k = m GROUP BY o_custkey)
SELECT o_custkey, choice FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN w USING (o_custkey)"""
)
def index_majority(spark, d):
    votes = table(spark, d, "orders").select("o_custkey", (F.left("o_orderpriority", F.lit(1)).cast("int") - 2).alias("choice"))
    return graders.majority_index(votes, ["o_custkey"])


_STATUS = "s AS (SELECT lang, CASE WHEN quality IS NULL THEN 'na' WHEN toxic = 1 THEN 'fail' WHEN quality = 1 THEN 'pass' ELSE 'partial' END AS status FROM documents LEFT JOIN labels USING (doc_id))"


def _statuses(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    status = F.when(F.col("quality").isNull(), "na").when(F.col("toxic") == 1, "fail").when(F.col("quality") == 1, "pass").otherwise("partial")
    return docs.select("lang", status.alias("status"))


_SCORE = f"""WITH {_STATUS}, c AS (SELECT lang, count(*) FILTER (WHERE status = 'pass') AS n_pass, count(*) FILTER (WHERE status = 'partial') AS n_partial, count(*) FILTER (WHERE status = 'fail') AS n_fail,
count(*) FILTER (WHERE status = 'na') AS n_na, count(*) FILTER (WHERE status = 'skipped') AS n_skipped FROM s GROUP BY lang)
SELECT *, n_pass + n_partial + n_fail AS applicable, CASE WHEN n_pass + n_partial + n_fail > 0 THEN round((n_pass + {{0}} * n_partial) / CAST(n_pass + n_partial + n_fail AS DOUBLE), 4) END AS score, n_skipped = 0 AS complete FROM c"""


@query(_SCORE.format("0.0::DOUBLE"))
def score_block(spark, d):
    return grade.score_block(_statuses(spark, d), ["lang"], "status")


@query(_SCORE.format("0.5::DOUBLE"))
def weighted_subscore(spark, d):
    return grade.score_block(_statuses(spark, d), ["lang"], "status", partial_weight=0.5)


@query(
    f"""WITH {_STATUS}, c AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE status = 'fail') AS violations FROM s GROUP BY lang)
SELECT lang, total, violations, CASE WHEN violations = 0 THEN 'pass' WHEN violations <= greatest(1, total // 10) THEN 'partial' ELSE 'fail' END AS status FROM c"""
)
def lint_status(spark, d):
    c = _statuses(spark, d).groupBy("lang").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "fail").alias("violations"))
    return c.withColumn("status", grade.status_from_counts("total", "violations"))


_FOLDED = f"CASE WHEN {_SLUG.format('text')} <> '' THEN sha256({_SLUG.format('text')}) END"


@query(
    f"""WITH l AS (SELECT doc_id AS a, sha256(text) AS k1, {_FOLDED} AS k2 FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS b, sha256(text) AS k1, {_FOLDED} AS k2 FROM documents WHERE doc_id % 2 = 1),
s0 AS (SELECT a, b FROM (SELECT k1, min(a) AS a FROM l GROUP BY k1 HAVING count(*) = 1) JOIN (SELECT k1, min(b) AS b FROM r GROUP BY k1 HAVING count(*) = 1) USING (k1)),
s1 AS (SELECT a, b FROM (SELECT k2, min(a) AS a FROM l WHERE a NOT IN (SELECT a FROM s0) GROUP BY k2 HAVING count(*) = 1) JOIN (SELECT k2, min(b) AS b FROM r WHERE b NOT IN (SELECT b FROM s0) GROUP BY k2 HAVING count(*) = 1) USING (k2))
SELECT a, b, 0 AS stage FROM s0 UNION ALL SELECT a, b, 1 FROM s1"""
)
def unique_locks(spark, d):
    """Locks by whole texts: equal ones, then those equal but for letter case, punctuation and spacing."""
    slug = X.slug_ascii("text")
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k1"), F.when(slug != "", F.sha2(slug, 256)).alias("k2"))
    return grade.unique_locks(docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "a"), docs.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "b"), ["k1", "k2"], "a", "b")


@query(
    """WITH l AS (SELECT p_partkey AS a, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 1), r AS (SELECT p_partkey AS b, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 2 = 0)
SELECT a, b FROM l JOIN r USING (p_name, n)"""
)
def greedy_match_phase1(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return grade.greedy_equal(p.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "a"), p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "b"), "p_name", "a", "b")


@query()
def greedy_match_full(spark, d):
    """Names first, then a shared first word within a brand: the second phase is order-dependent."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.get(F.split("p_name", " "), F.lit(0)).alias("t"))
    left, right = p.where("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "a"), p.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "b")
    first = resolve.written(grade.greedy_equal(left, right, "p_name", "a", "b"))
    rest = left.join(first, "a", "left_anti").select("a", "p_brand", "t").join(right.join(first, "b", "left_anti").select("b", "p_brand", "t"), ["p_brand", "t"])
    return first.select("a", "b", F.lit(1).alias("phase")).unionByName(grade.greedy_pairs(rest, "a", "b").select("a", "b", F.lit(2).alias("phase")))


@query("SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE lang END AS lang, count(*) FILTER (WHERE doc_id % 2 = 0) AS n_baseline, count(*) FILTER (WHERE doc_id % 2 = 1) AS n_candidate, count(*) FILTER (WHERE doc_id % 2 = 1) - count(*) FILTER (WHERE doc_id % 2 = 0) AS delta FROM documents GROUP BY ROLLUP (lang)")
def coverage_rollup(spark, d):
    runs = table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 2 == 0, "baseline").otherwise("candidate").alias("run"))
    return grade.coverage(runs, "lang", "run", "baseline", "candidate")


# --- documents -----------------------------------------------------------------------------------------------------


def _wiki(spark, d):
    """All texts in documents of 64 ids of a source at most, in the documents' format: languages are sections, texts entries."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    docs = docs.withColumn("source", F.concat_ws("/", "source", F.expr("doc_id div 64").cast("string")))
    entry = F.concat(F.lit('### <a id="d'), F.col("doc_id").cast("string"), F.lit('"></a>'), F.regexp_replace(F.get(F.split("text", r"\s+"), F.lit(0)), r"[#<>*]", ""), F.lit("\n"), F.regexp_replace("text", r"(?m)^[#\-*+\[]+", ""), F.lit("[^1]\n"))
    parts = docs.groupBy("source", "lang").agg(F.array_join(resolve.in_order(entry, "doc_id"), "\n").alias("t"))
    section = F.concat(F.lit("---\n## "), F.col("lang"), F.lit("\n"), F.col("t"))
    whole = parts.groupBy(F.col("source").alias("doc_id")).agg(F.array_join(resolve.in_order(section, "lang"), "\n").alias("t"))
    return whole.select("doc_id", F.concat(F.lit("# World\nAll of it.\n\n"), F.col("t"), F.lit("\n---\n## Footnotes\n[^1]: `said` — Ash, log.txt\n")).alias("text"))


@query()
def lint_all(spark, d):
    """The 24 checks and the judged ones of each document; the parser and the checks are held against fixtures."""
    items = graders.grade_format(document.stored(document.parse(_wiki(spark, d))))
    return items.select("doc_id", "id", "status", "detail", F.size("lines").alias("n_lines"))


@query("SELECT source || '/' || (doc_id // 64) AS doc_id, lang AS section, count(*) AS n_entries FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL")
def document_entries(spark, d):
    """Documents made of all texts and taken apart again: every text is an entry of its section."""
    p = document.parse(_wiki(spark, d))
    return graders.real_entries(p).groupBy("doc_id", "section").agg(F.count("*").alias("n_entries"))
