"""Typed rows from decisions, and the reconcile chain, on small fixtures with expected rows worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import extract, reconcile

ENTITY = (
    "entity_type string, index long, name string, name_sources array<string>, aliases array<struct<text:string,source_files:array<string>>>, "
    "details array<struct<text:string,source_files:array<string>>>, quotes array<struct<text:string,speaker:string,source_file:string>>, "
    "is_pc boolean, player_name string, pronouns array<string>, description string, scope string, date_text string"
)
MERGE = "entity_type string, group long, pos int, index long, canonical string"


def entity(kind, index, name, aliases=(), details=(), quotes=(), src="a", **more):
    event = kind == "history"
    return (
        kind, index, name, [src], [(x, [src]) for x in aliases], None if event else [(x, [src]) for x in details], [(x, "Ann", src) for x in quotes],
        more.get("is_pc", False) if kind == "characters" else None, more.get("player"), [] if kind == "characters" else None,
        more.get("description"), more.get("scope"), more.get("date"),
    )


def tables(spark, rows, merges=(), possible=(), pairs=()):
    e = spark.createDataFrame(rows, ENTITY)
    flat = [(t, g, k, i, c) for t, g, members, c in merges for k, i in enumerate(members)]
    m = spark.createDataFrame(flat, MERGE)
    p = spark.createDataFrame([(t, n, i) for t, n, members in possible for i in members], "entity_type string, item long, index long")
    return e, m, spark.createDataFrame(list(pairs), "entity_type string, i long, j long"), p


def names(df, kind=None):
    return [r.name for r in df.orderBy("ord").collect() if kind in (None, r.entity_type)]


def facts(rows):
    return [(x.text, list(x.source_files)) for x in rows]


def with_ord(e):
    return e.withColumn("ord", F.array(F.col("index")))


def test_combine_unions_lineage_and_keeps_losing_names(spark):
    rows = [
        entity("locations", 0, "Harrow Lake", ["the lake"], ["It is deep.", "It is cold."], ["deep water"], "a"),
        entity("locations", 1, "Lake Harrow", ["Harrow Lake", "The Lake"], [" It is deep. ", "It is wide."], ["deep water", "wide"], "b"),
        entity("locations", 2, "harrow lake", [], ["It is cold."], [], "c"),
    ]
    members = with_ord(tables(spark, rows)[0]).withColumns({"group": F.lit(1), "pos": F.col("index"), "canonical": F.lit("lake HARROW")})
    r = reconcile.combine(members, ["entity_type", "group"]).first()
    assert (r.name, list(r.name_sources)) == ("Lake Harrow", ["b"])
    assert facts(r.aliases) == [("the lake", ["a"]), ("Harrow Lake", ["a", "b"]), ("The Lake", ["b"]), ("harrow lake", ["c"])]
    assert facts(r.details) == [("It is deep.", ["a", "b"]), ("It is cold.", ["a", "c"]), ("It is wide.", ["b"])]
    assert [(q.text, q.source_file) for q in r.quotes] == [("deep water", "a"), ("deep water", "b"), ("wide", "b")]
    assert r.n_members == 3 and not r.vetoed and r.is_pc is None


def test_combine_events_and_players(spark):
    rows = [
        entity("history", 0, "Fall", description="It fell.", scope="personal"),
        entity("history", 1, "The Fall", description=" It fell. ", scope="world", date=" 12 AR "),
        entity("history", 2, "Fall!", description="All of it.", scope="regional", date="13 AR"),
        entity("characters", 0, "Oda", player="Kim", is_pc=True),
        entity("characters", 1, "Oda", player="kim"),
        entity("characters", 2, "Oda", player="Lee"),
    ]
    e = with_ord(tables(spark, rows)[0]).withColumns({"group": F.lit(1), "pos": F.col("index"), "canonical": F.when(F.col("entity_type") == "history", "Fall").otherwise("Oda")})
    got = {r.entity_type: r for r in reconcile.combine(e, ["entity_type", "group"], allow_majority=True).collect()}
    h = got["history"]
    assert (h.description, h.scope, h.date_text, h.details) == ("It fell.\n\nAll of it.", "world", "12 AR", None)
    assert (got["characters"].player_name, got["characters"].is_pc, got["characters"].vetoed) == ("Kim", True, False)
    strict = {r.entity_type: r.vetoed for r in reconcile.combine(e, ["entity_type", "group"]).collect()}
    assert strict == {"history": False, "characters": True}


def test_merge_problems_and_salvage(spark):
    rows = [entity("items", k, n) for k, n in enumerate(["Axe", "Ax", "Bow", "Long Bow", "Cup"])]
    merges = [("items", 0, [0, 1], "Ax"), ("items", 1, [1, 2], "Bow"), ("items", 2, [2, 3], "Long bow"), ("items", 3, [4], "Cup"), ("items", 4, [3, 9], "Bow"), ("items", 5, [2, 4], "Spoon"), ("items", 6, [4, 4], "Cup")]
    e, m, _, _ = tables(spark, rows, merges)
    got = {(r.group, r.problem) for r in reconcile.merge_problems(m, e).collect()}
    assert got == {(1, "reused"), (2, "reused"), (3, "members"), (4, "range"), (4, "reused"), (5, "reused"), (6, "reused")}
    kept = {r.group for r in reconcile.salvage_merges(m, e).collect()}
    assert kept == {0, 2}  # 1 goes and frees 2 for the group after it
    assert reconcile.salvage_merges(m.limit(0), e).count() == 0


def test_overlapping_groups_are_joined(spark):
    rows = [entity("items", k, f"n{k}") for k in range(20)]
    merges = [("items", 0, [0, 1], "n0"), ("items", 1, [5, 4], "n4"), ("items", 2, [1, 2, 3], "n2"), ("items", 3, [2, 99], "n2")]
    merges += [("items", 10 + k, [8 + k, 9 + k], f"n{8 + k}") for k in range(9)]
    e, m, _, _ = tables(spark, rows, merges)
    out = {}
    for r in reconcile.coalesce_groups(m, e).orderBy("group", "pos").collect():
        out.setdefault((r.group, r.canonical), []).append(r["index"])
    assert out == {(0, "n2"): [0, 1, 2, 3], (1, "n4"): [5, 4], (3, "n2"): [2, 99]}  # the chain of ten is a runaway


def test_chain(spark):
    rows = [
        entity("locations", 0, "The Mill"), entity("locations", 1, "Gate", quotes=["at the gate"]), entity("locations", 2, "mill"),
        entity("locations", 3, "East Gate", quotes=["at the gate"]), entity("locations", 4, "Old Bridge"), entity("locations", 5, "Bridge", ["Old Bridge"]),
        entity("locations", 6, "Tower"), entity("locations", 7, "White Tower"), entity("locations", 8, "old bridge"),
        entity("characters", 0, "CJ"), entity("characters", 1, "DJ"), entity("characters", 2, "Orlen", player="Kim"), entity("characters", 3, "Orlenn"),
        entity("characters", 4, "Kim", is_pc=False), entity("characters", 5, "Orlen Voss"), entity("characters", 6, "Orlan"),
        entity("items", 0, "Cup"), entity("items", 1, "cup"),
    ]
    e, m, pairs, possible = tables(
        spark, rows, [("characters", 0, [0, 1], "CJ"), ("locations", 0, [6, 7], "White Tower")],
        [("characters", 0, [2, 6])], [("locations", 4, 5)],
    )
    declared = spark.createDataFrame([(0, "Kim", "Orlen", ["orlen"], ["she", "her"])], "group int, player string, main_name string, recognition array<string>, pronouns array<string>")
    out = reconcile.written(reconcile.reconcile(e, m, pairs, possible, declared, undecided=("items",)))
    assert names(out, "locations") == ["White Tower", "The Mill", "East Gate", "Old Bridge", "Bridge"]  # the bridge pair was declined
    assert names(out, "items") == ["Cup"]
    assert names(out, "characters") == ["CJ", "DJ", "Orlen", "Orlan"]
    orlen = out.where("name = 'Orlen'").first()
    assert orlen.pronouns == ["she", "her"] and orlen.player_name == "Kim"
    assert [a.text for a in orlen.aliases] == ["Orlenn", "Orlen Voss"]  # not the player's own name
    assert [a.text for a in out.where("name = 'East Gate'").first().aliases] == ["Gate"]


def test_declared_tiers(spark):
    people = ["Bran", "Brann", "Bran Ode", "Tess", "Ivo", "Sam", "X"]
    e = with_ord(tables(spark, [entity("characters", k, n, ["Bran"] if n == "X" else []) for k, n in enumerate(people)])[0])
    declared = spark.createDataFrame([(0, "Tess", "Bran", ["bran"], []), (1, "Sam", "Ivor", ["ivor"], []), (2, "Sam", "Mo", ["mo"], [])], "group int, player string, main_name string, recognition array<string>, pronouns array<string>")
    flagged = spark.createDataFrame([("ivo",)], "key string")
    got = {people[r.ord[0]]: (r.group, r.tier) for r in reconcile.declared_tiers(e, declared, flagged).collect()}
    assert got == {"Bran": (0, "exact"), "X": (0, "exact"), "Brann": (0, "typo"), "Bran Ode": (0, "token"), "Tess": (0, "player")}


def test_resolve_types(spark):
    rows = [
        entity("locations", 0, "The Iron Hand", details=["a", "b"]), entity("organizations", 0, "Iron Hand", details=["c"], quotes=["q"]),
        entity("people", 0, "iron hand", ["Hands"], details=["a"]), entity("locations", 1, "Vale"), entity("organizations", 1, "Vale"),
        entity("items", 0, "Orb"), entity("characters", 0, "Orb", details=["d"]),
    ]
    e = with_ord(tables(spark, rows)[0])
    conflicts = reconcile.type_conflicts(e)
    assert {(r.cluster, r.entity_type) for r in conflicts.collect()} == {(0, "locations"), (0, "organizations"), (0, "people"), (1, "items"), (1, "characters")}
    choices = spark.createDataFrame([(0, ["organizations", "nonsense"]), (1, ["places"]), (7, ["items"])], "cluster int, keep_types array<string>")
    assert {(r.cluster, r.problem) for r in reconcile.choice_problems(conflicts, choices).collect()} == {(1, "types"), (7, "unknown")}
    out = {(r.entity_type, r.name): r for r in reconcile.resolve_types(e, choices).collect()}
    assert set(out) == {("organizations", "Iron Hand"), ("locations", "Vale"), ("organizations", "Vale"), ("items", "Orb"), ("characters", "Orb")}
    kept = out["organizations", "Iron Hand"]
    assert [d.text for d in kept.details] == ["c", "a", "b"] and [a.text for a in kept.aliases] == ["Hands"] and len(kept.quotes) == 1


MESSAGES = [(1, 0, "Ann", "f", "We saw the  old — mill"), (1, 1, "Bob", "f", "The mill burned"), (1, 2, "Cy", "f", "The mill burned"), (2, 0, "Di", "g", "The mill burned")]


@pytest.fixture()
def messages(spark):
    return spark.createDataFrame(MESSAGES, "batch int, local_id int, sender string, source_file string, content string")


def built(spark, messages, objects, **more):
    raw = spark.createDataFrame([(b, t, k, x if isinstance(x, str) else json.dumps(x)) for k, (b, t, x) in enumerate(objects)], "batch int, entity_type string, entry int, raw string")
    return {r.entry: r for r in extract.build_entries(raw, messages, ["batch"], **more).collect()}


def test_entries_from_decisions(spark, messages):
    burned = {"detail": "It burned.", "quote": "mill burned", "source_id": 1}
    got = built(
        spark, messages,
        [
            (1, "locations", {"name": "Mill", "aliases": ["M", 5, None], "details": [burned, {"detail": "Old.", "quote": "old - mill", "source_id": 2}, {"detail": "Bad", "quote": "nowhere", "source_id": 0}, {"detail": "It burned twice.", "quote": "mill burned", "source_id": 1}, 7]}),
            (1, "locations", {"name": " ", "details": [burned]}),
            (1, "items", {"name": 5, "aliases": "x", "details": [{"detail": "y" * 100, "quote": "mill burned", "source_id": 0}]}),
            (1, "items", {"details": []}),
            (1, "characters", {"name": "Bob", "is_pc": "yes", "player_name": "Ann", "details": 4}),
            (1, "history", {"description": "The mill burned. Twice.", "scope": " World ", "date_text": " 3 AR ", "quotes": [{"quote": "mill burned", "source_id": True}, {"quote": "mill burned", "source_id": 2}]}),
            (1, "history", {"name": "Fire", "scope": "huge", "quotes": []}),
            (1, "history", {"name": "Fire", "description": "x", "scope": "huge"}),
            (2, "people", {"name": "Millers", "details": [{"detail": "d", "quote": "the old", "source_id": 0}]}),
            (1, "people", "not json"),
            (1, "people", "[1]"),
        ],
    )
    assert set(got) == {0, 2, 4, 5, 7, 8}
    mill = got[0]
    assert [d.text for d in mill.details] == ["It burned.", "Old.", "It burned twice."] and [a.text for a in mill.aliases] == ["M"]
    assert [(q.text, q.speaker) for q in mill.quotes] == [("mill burned", "Bob"), ("old - mill", "Ann")]
    assert got[2].name == "y" * 80 and got[2].aliases == [] and got[2].quotes[0].speaker == "Bob"
    assert (got[4].is_pc, got[4].player_name, got[4].details) == (False, "Ann", [])
    fire = got[5]
    assert (fire.name, fire.scope, fire.date_text, fire.details) == ("The mill burned", "world", "3 AR", None)
    assert [(q.text, q.speaker) for q in fire.quotes] == [("mill burned", "Cy")]
    assert (got[7].scope, got[7].quotes) == ("world", []) and got[8].details == []


def test_players_and_bleed(spark, messages):
    objects = [(1, "characters", {"name": n, "aliases": a, "is_pc": False, "player_name": p, "details": [{"detail": d, "quote": "mill", "source_id": 1}]}) for n, a, p, d in [
        ("Oda", ["Odd"], "Nobody", "Rex the Red left."), ("Rex", ["Rex the Red"], "Bob", "Rex left."), ("Kim", ["Odd"], "Bob", "Odd is odd."), ("Bob", [], "Bob", "Rexford came.")]]
    raw = spark.createDataFrame([(b, t, k, json.dumps(x)) for k, (b, t, x) in enumerate(objects)], "batch int, entity_type string, entry int, raw string")
    people = extract.build_entries(raw, messages, ["batch"])
    roster = spark.createDataFrame([("bob",), ("Ann",)], "name string")
    none = spark.createDataFrame([], "name string, player string, pronouns array<string>, ord int")
    declared = spark.createDataFrame([("odd", "Zed", ["it"], 0), ("kim", "Ann", ["she"], 1), ("ODD", "Ann", ["they"], 2)], none.schema)
    free = {r.name: (r.player_name, r.is_pc, r.is_roster_name) for r in extract.assign_players(people, roster, none).collect()}
    assert free == {"Oda": (None, False, False), "Rex": ("Bob", False, False), "Kim": ("Bob", False, False), "Bob": ("Bob", False, True)}
    bound = {r.name: (r.player_name, r.is_pc, r.pronouns) for r in extract.assign_players(people, roster, declared).collect()}
    assert bound == {"Oda": ("Ann", True, ["they"]), "Rex": (None, False, []), "Kim": ("Ann", True, ["she"]), "Bob": (None, False, [])}
    assert {r.name: r.player_name for r in extract.assign_players(people, roster.limit(0), none).collect()}["Oda"] == "Nobody"
    flags = {(r.entry, r.surface, tuple(r.owners)) for r in extract.flag_subject_bleed(people, "entry").collect()}
    assert flags == {(0, "rex the red", ("Rex",))}
    seen = extract.prompt_view(people).first()
    assert "name_sources" not in seen and all(isinstance(x, str) for x in seen.details)
