"""Configuration files as small tables: speakers, the declared party, link words, checklists, ranks.

Such files are read whole by Spark's reader, so any store will do, and checked on the driver: what has the wrong shape is
an error, as a silent one would switch a feature off. They are dimensions of a few rows.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.text import strip_ws

# The pronouns of a party member without stated ones, and the categories of a checklist.
DEFAULT_PRONOUNS = ("they", "them")
CATEGORIES = ("sections", "locations", "characters", "organizations", "people_and_cultures", "events")
#: A configuration file beyond so many bytes is refused: it is read into the driver.
MAX_BYTES = 16 << 20

PARTY = "group int, player string, main_name string, last_name string, aliases array<string>, pronouns array<string>, recognition array<string>"


def read_whole(spark: SparkSession, path: str) -> str | None:
    """The text of a file, None if there is none."""
    try:
        rows = spark.read.text(path, wholetext=True).where(F.length("value") <= MAX_BYTES).limit(2).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if len(rows) != 1:
        raise ValueError(f"{path}: one file of {MAX_BYTES} characters at most is wanted")
    return rows[0].value


def _missing(path: str) -> str:
    raise FileNotFoundError(path)


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """``handle``, ``name`` of a JSON object from handles to names; a missing file or another shape is an error."""
    text = read_whole(spark, path)
    data = json.loads(_missing(path) if text is None else text)
    if not isinstance(data, dict) or not all(isinstance(v, str) for v in data.values()):
        raise ValueError(f"{path}: an object from handles to names is wanted")
    return spark.createDataFrame(list(data.items()), "handle string, name string")


def _texts(value: Any, what: str) -> list[str]:
    if not isinstance(value or [], list):
        raise ValueError(f"{what} must be a list")
    return [x.strip() for x in value or [] if isinstance(x, str) and x.strip()]


def party_entries(data: Any) -> list[dict]:
    """One object per character from any of the four forms: a list of objects, or an object from players to objects, lists
    of names (the first is the main one) or a name."""
    if not data:
        return []
    if isinstance(data, list):
        if not all(isinstance(x, dict) for x in data):
            raise ValueError("the party's entries must be objects")
        return data
    if not isinstance(data, dict):
        raise ValueError("the party must be a list or an object")
    out = []
    for player, value in data.items():
        if not player.strip():
            raise ValueError("a player has no name")
        if isinstance(value, dict):
            out.append({**value, "player": player})
            continue
        names = [value] if isinstance(value, str) else value
        if not isinstance(names, list) or not all(isinstance(x, str) for x in names):
            raise ValueError(f"{player}: an object, a name or a list of names is wanted")
        names = [x for x in names if x.strip()]
        if names:
            out.append({"player": player, "main_name": names[0], "aliases": names[1:]})
    return out


def recognition(main: str, aliases: list[str], last: str | None) -> list[str]:
    """The lower-case names that a party member goes by: the names, then each with the last name; never that alone."""
    bases = list(dict.fromkeys(x.strip().lower() for x in (main, *aliases) if x.strip()))
    return list(dict.fromkeys(bases + ([f"{b} {last.strip().lower()}" for b in bases] if last and last.strip() else [])))


def party_rows(data: Any) -> list[tuple]:
    """Rows of the declared party in the order of the file; an entry without a main name is an error."""
    rows = []
    for k, e in enumerate(party_entries(data)):
        main, last = e.get("main_name"), e.get("last_name")
        if not isinstance(main, str) or not main.strip():
            raise ValueError("a declared character needs a main_name")
        last = last.strip() if isinstance(last, str) and last.strip() else None
        aliases, said = _texts(e.get("aliases"), "aliases"), _texts(e.get("pronouns"), "pronouns")
        player = e.get("player")
        rows.append((k, player.strip() if isinstance(player, str) else "", main.strip(), last, aliases, said or list(DEFAULT_PRONOUNS), recognition(main.strip(), aliases, last)))
    return rows


def party(spark: SparkSession, path: str) -> DataFrame:
    """The declared party; a missing file is an empty one, a wrong shape an error."""
    text = read_whole(spark, path)
    return spark.createDataFrame(party_rows(json.loads(text)) if text is not None else [], PARTY)


def party_names(declared: DataFrame) -> DataFrame:
    """``name``, ``player``, ``pronouns``, ``ord`` of every name of the party, as :func:`extract.assign_players` takes them."""
    return declared.select(F.explode("recognition").alias("name"), "player", "pronouns", F.col("group").alias("ord"))


def roster(named: DataFrame, ord_col: str = "handle") -> DataFrame:
    """The real people of a speaker table: distinct without case, in their first spelling, blanks left out."""
    name = strip_ws("name")
    return named.where(name != "").groupBy(F.lower(name).alias("__k")).agg(F.min_by(name, ord_col).alias("name"), F.min(ord_col).alias("ord")).drop("__k")


def upsert_party(declared: DataFrame, answers: DataFrame) -> DataFrame:
    """The party after ``answers`` (``name``, ``player``, ``ord``): who is known by a name gets that player, an unknown one is
    added under its name; a name goes to the last answer that gave it and leaves the aliases of others."""
    name = strip_ws("name")
    said = answers.where((name != "") & (strip_ws("player") != "")).groupBy(F.lower(name).alias("key")).agg(F.max_by(F.struct(name.alias("name"), strip_ws("player").alias("player")), "ord").alias("a"))
    said = said.select("key", "a.name", "a.player")
    known = declared.select("group", F.explode("recognition").alias("key")).groupBy("key").agg(F.min("group").alias("group"))
    hits = said.join(known, "key", "left")
    player = hits.where("group IS NOT NULL").groupBy("group").agg(F.min_by("player", "key").alias("__player"), F.collect_set("key").alias("__keys"))
    taken = said.agg(F.collect_set("key").alias("__taken"))  # answers that a person typed
    out = declared.join(player, "group", "left").join(taken)
    mine = F.coalesce("__keys", F.expr("array()").cast("array<string>"))
    foreign = lambda a: F.array_contains("__taken", F.lower(a)) & ~F.array_contains(mine, F.lower(a)) & (F.lower(a) != F.lower("main_name"))
    out = out.withColumns({"player": F.coalesce("__player", "player"), "aliases": F.filter("aliases", lambda a: ~foreign(a))})
    top = declared.agg(F.coalesce(F.max("group"), F.lit(-1)).alias("__top"))
    number = F.dense_rank().over(_by_key()).cast("int")
    fresh = hits.where("group IS NULL").join(top).select(
        (F.col("__top") + number).alias("group"), "player", F.col("name").alias("main_name"), F.lit(None).cast("string").alias("last_name"),
        F.expr("array()").cast("array<string>").alias("aliases"), F.array(*[F.lit(x) for x in DEFAULT_PRONOUNS]).alias("pronouns"), F.array("key").alias("recognition"),
    )
    columns = [c.split()[0] for c in PARTY.split(", ")]
    return out.select(*columns).unionByName(fresh.select(*columns))


def _by_key():
    from pyspark.sql.window import Window

    return Window.orderBy("key")


def link_words(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``require_article`` and ``never_link``; a missing file has neither, an unknown key is an error."""
    text = read_whole(spark, path)
    data = {} if text is None else json.loads(text)
    known = ("require_article", "never_link")
    if not isinstance(data, dict) or set(data) - set(known):
        raise ValueError(f"{path}: an object with no keys but {', '.join(known)} is wanted")
    return {k: list(data.get(k, [])) for k in known}


def _yaml(text: str) -> Any:
    """YAML if its library is there; JSON, which is YAML as well, at any rate."""
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text) if text.strip() else None
    return yaml.safe_load(text)


def checklist(spark: SparkSession, path: str) -> DataFrame:
    """``category``, ``k`` (from 0), ``name``, ``aliases``, ``pc`` of a checklist; a bare text is a name. A missing file, an
    unknown key or another type is an error."""
    text = read_whole(spark, path)
    data = _yaml(_missing(path) if text is None else text) or {}
    if not isinstance(data, dict) or set(data) - set(CATEGORIES):
        raise ValueError(f"{path}: lists under {', '.join(CATEGORIES)} are wanted")
    rows = []
    for category in CATEGORIES:
        for k, item in enumerate(data.get(category) or []):
            item = {"name": item} if isinstance(item, str) else item
            if not isinstance(item, dict) or set(item) - {"name", "aliases", "pc"}:
                raise ValueError(f"{path}: {category} {k} has an unknown shape")
            name, aliases, pc = item.get("name"), item.get("aliases", []), item.get("pc", False)
            if not isinstance(name, str) or not isinstance(pc, bool) or not isinstance(aliases, list) or not all(isinstance(a, str) for a in aliases):
                raise ValueError(f"{path}: {category} {k} has a field of the wrong type")
            rows.append((category, k, name, aliases, pc))
    return spark.createDataFrame(rows, "category string, k int, name string, aliases array<string>, pc boolean")


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """``slug``, ``rank`` of a mapping from slugs to whole numbers; true and false are none. A missing file is an error."""
    text = read_whole(spark, path)
    data = _yaml(_missing(path) if text is None else text)
    if not isinstance(data or {}, dict):
        raise ValueError(f"{path}: a mapping from slugs to ranks is wanted")
    rows = []
    for slug, rank in (data or {}).items():
        if not str(slug).strip() or isinstance(rank, bool) or not isinstance(rank, int):
            raise ValueError(f"{path}: {slug!r} has the rank {rank!r}")
        rows.append((str(slug).strip(), rank))
    return spark.createDataFrame(rows, "slug string, rank long")


def split_list(c: Column | str) -> Column:
    """Comma-separated text as trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), ","), strip_ws), lambda x: x != "")


def split_pronouns(c: Column | str) -> Column:
    """Pronouns parted by white space, slashes or commas; none: the default ones."""
    parts = F.filter(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?U)[\s/,]+"), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(*[F.lit(x) for x in DEFAULT_PRONOUNS]))
