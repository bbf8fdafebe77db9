"""Graders, configuration files, sinks and the rendered document on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import document, graders, render
from skeinwork.sinks import emit
from skeinwork.sources import config

DOC = """# Gazetteer
A subtitle

---
## Places
### <a id="alder-lake"></a>Alder Lake
About 40 boats. ~30 huts, 1,200 [^1] people. 40 boats.
### <a id="mill"></a>Mill *
Old.
### Could Not Place
- <a id="well"></a>**Well** — deep [^2]

---
## Timeline
### <a id="fall"></a>The Fall
It fell.
### <a id="rise"></a>Rise
It rose.

---
## Footnotes
[^1]: `big` — Ash, log.txt
[^2]: `deep` — Ash, log.txt
"""
GOLD = DOC.replace("Alder Lake", "Lake Alder").replace('id="mill"', 'id="the-mill"').replace('id="rise"', 'id="dawn"').replace("### <a id=\"dawn\"></a>Rise", "### <a id=\"dawn\"></a>Dawn")


@pytest.fixture(scope="module")
def parsed(spark):
    return document.stored(document.parse(spark.createDataFrame([("d1", DOC), ("d2", "plain")], "doc_id string, text string")))


def statuses(items):
    return {(r.doc_id, r.id): r.status for r in items.collect()}


def test_candidates(spark, parsed):
    groups = graders.grouping_candidates(parsed).collect()
    assert [(r.label, r.beneath, r.section) for r in groups] == [("Could Not Place", ["Well"], "Places")]
    figures = graders.numbered(graders.figure_candidates(parsed), ("lineno", "k", "i")).orderBy("n").collect()
    assert [(r.label, r.sentence) for r in figures] == [("40", "About 40 boats."), ("1,200", "~30 huts, 1,200  people."), ("40", "40 boats.")]
    assert {r.label for r in graders.stub_candidates(parsed).collect()} == {"Alder Lake", "Mill *", "Well", "The Fall", "Rise"}
    assert {r.slug for r in graders.real_entries(parsed).collect()} == {"alder-lake", "mill", "well", "fall", "rise"}
    marks = spark.createDataFrame([("!!",)], "t string").select(graders.entry_slug("t")).first()[0]
    assert marks == "unnamed-" + hashlib.sha1(b"!!").hexdigest()[:8]


def test_format_grade_with_votes(spark, parsed):
    rows = [("d1", v, n, label) for v, labels in enumerate([["exact_ok", "approximate_unmarked", "exact_ok"], ["exact_ok", "approximate_unmarked", "odd"], ["exact_ok"]]) for n, label in enumerate(labels)]
    votes = spark.createDataFrame(rows, "doc_id string, vote int, n int, label string")
    failed = spark.createDataFrame([("d1",)], "doc_id string")
    items = graders.grade_format(parsed, {"fc.list-entries.approx-tilde": votes, "fc.markers.tbd": votes.limit(0)}, {"fc.markers.tbd": failed})
    got = statuses(items)
    assert got["d1", "fc.list-entries.approx-tilde"] == "fail" and got["d2", "fc.list-entries.approx-tilde"] == "na"
    assert got["d1", "fc.markers.tbd"] == "skipped" and got["d1", "fc.entries.grouping-no-anchor"] == "skipped"
    tilde = items.where("doc_id = 'd1' AND id = 'fc.list-entries.approx-tilde'").first()
    assert (tilde.found, tilde.lines) == ("1,200", [7])
    order = [r.id for r in items.where("doc_id = 'd1'").orderBy("ord").collect()]
    assert len(order) == 27 and order[0] == "fc.title.single-h1" and order[-1] == "fc.markers.tbd"


def test_checklist_grade(spark, parsed):
    rows = [("sections", 0, "Places & Sites", ["places and  sites", "Locations"], False), ("sections", 1, "History", [], False), ("sections", 2, "Items", [], False), ("locations", 0, "Alder Lake", [], False), ("locations", 1, "Mill", [], False), ("locations", 2, "Fort", [], False), ("characters", 0, "Ash", [], True), ("events", 0, "Fall", [], False)]
    checklist = spark.createDataFrame(rows, "category string, k int, name string, aliases array<string>, pc boolean")
    assert len(graders.checklist_criteria(checklist).collect()) == 3 + 2 * 5 + 2
    sections = spark.createDataFrame([("d1", v, k, p, m) for v in range(3) for k, p, m in [(0, True, 1), (1, v > 0, 2), (2, True, 9)]], "doc_id string, vote int, k int, present boolean, match long")
    presence = spark.createDataFrame(
        [("d1", "locations", v, k, p, m) for v in range(3) for k, p, m in [(0, True, 1), (1, True, 2), (2, True, None)]] + [("d1", "events", 0, 0, True, 1)],
        "doc_id string, category string, vote int, k int, present boolean, match long",
    )
    support = spark.createDataFrame([("d1", "locations", 0, 0, True)], "doc_id string, category string, k int, vote int, supported boolean")
    got = statuses(graders.grade_checklist(parsed, checklist, sections, presence, None, support).where("doc_id = 'd1'"))
    assert got == {
        ("d1", "rubric.sections.places-sites"): "pass", ("d1", "rubric.sections.history"): "pass", ("d1", "rubric.sections.items"): "fail",
        ("d1", "rubric.presence.locations.alder-lake"): "pass", ("d1", "rubric.presence.locations.mill"): "pass", ("d1", "rubric.presence.locations.fort"): "fail",
        ("d1", "rubric.presence.characters.ash"): "fail", ("d1", "rubric.presence.events.fall"): "pass",
        ("d1", "rubric.sourcing.locations.alder-lake"): "pass", ("d1", "rubric.sourcing.locations.mill"): "fail", ("d1", "rubric.sourcing.locations.fort"): "na",
        ("d1", "rubric.sourcing.characters.ash"): "na", ("d1", "rubric.sourcing.events.fall"): "fail", ("d1", "rubric.pc-stated.ash"): "na", ("d1", "rubric.pc-marked.ash"): "na",
    }
    assert set(statuses(graders.grade_checklist(parsed, checklist, None, None, None, None)).values()) == {"skipped"}


def test_reference_grade(spark, parsed):
    gold = document.stored(document.parse(spark.createDataFrame([("g", GOLD)], "doc_id string, text string")))
    g = {r.slug: r.lineno for r in graders.real_entries(gold).collect()}
    own = {r.slug: r.lineno for r in graders.real_entries(parsed).where("doc_id = 'd1'").collect()}
    ranks = spark.createDataFrame([("fall", 2), ("dawn", 1)], "slug string, rank long")
    residual = spark.createDataFrame([("d1", v, g["dawn"], c) for v, c in enumerate([own["rise"], own["rise"], -1])], "doc_id string, vote int, gold int, choice int")
    claims = spark.createDataFrame(
        [("d1", g["fall"], 0, "affirmed"), ("d1", g["fall"], 0, "Omitted "), ("d1", g["fall"], 1, "affirmed"), ("d1", g["fall"], 1, "omitted"), ("d1", g["the-mill"], 0, "junk"), ("d1", g["the-mill"], 0, "contradicted"), ("d1", g["well"], 0, "affirmed"), ("d1", g["well"], 1, "junk")],
        "doc_id string, gold int, vote int, verdict string",
    )
    got = statuses(graders.grade_reference(parsed, gold, ranks, claims, residual))
    assert {k[1]: v for k, v in got.items() if k[0] == "d1"} == {
        "gbf.faithfulness.alder-lake": "skipped", "gbf.faithfulness.the-mill": "fail", "gbf.faithfulness.well": "pass", "gbf.faithfulness.fall": "partial",
        "gbf.faithfulness.dawn": "skipped", "gbf.ordering": "partial",
    }
    assert {v for k, v in got.items() if k[0] == "d2"} == {"na"}
    lost = spark.createDataFrame([("d2",)], "doc_id string")
    assert {v for k, v in statuses(graders.grade_reference(parsed, gold, ranks, claims, residual, lost)).items() if k[0] == "d2"} == {"skipped"}
    assert set(statuses(graders.grade_reference(parsed, gold, ranks, None)).values()) == {"skipped"}


def test_index_votes(spark):
    v = spark.createDataFrame([(1, 4), (1, 4), (1, 2), (2, 1), (2, 2), (3, -1), (3, None)], "i int, choice int")
    assert {r.i: r.choice for r in graders.majority_index(v, ["i"]).collect()} == {1: 4, 2: None, 3: None}


def test_results_as_json(spark, parsed, tmp_path):
    items = graders.grade_format(parsed).withColumns({"description": F.lit(None).cast("string"), "expected": F.lit(None).cast("string")})
    at = F.lit("2024-01-02T03:04:05Z")
    out = emit.result_json(items, "fc", at, ("lint", "1"), emit.model_json("m", "p", 0, False, 0))
    got = {r.doc_id: json.loads(r.json) for r in out.collect()}
    assert [g["engine"] for g in got["d1"]["graders"]] == ["mechanical"] and len(got["d1"]["items"]) == 27
    s = got["d1"]["summary"]
    assert s["skipped"] == 3 and not s["complete"] and s["score_display"] == f"{s['pass']}/{s['applicable']}" and s["score"] == round(s["pass"] / s["applicable"], 4)
    assert "description" not in got["d1"]["items"][0] and got["d2"]["summary"]["score"] is None
    both = {"faithfulness": ~F.startswith("id", F.lit("gbf.ordering")), "ordering": F.startswith("id", F.lit("gbf.ordering"))}
    rows = [("d", 1, "gbf.faithfulness.a", "partial"), ("d", 2, "gbf.faithfulness.b", "pass"), ("d", 3, "gbf.ordering", "na")]
    flat = spark.createDataFrame(rows, "doc_id string, ord int, id string, status string").withColumns({"engine": F.lit("model"), "lines": F.array(F.lit(1)), "detail": F.lit('say "x"')} | {c: F.lit(None).cast("string") for c in ("description", "expected", "found")})
    one = json.loads(emit.result_json(flat, "gbf", at, None, emit.model_json("m", "p", 0, False, 5), both, 0.5).first().json)
    assert one["summary"]["faithfulness"] == {"pass": 1, "partial": 1, "fail": 0, "na": 0, "applicable": 2, "score": 0.75, "score_display": "1.5/2"}
    assert one["summary"]["ordering"]["score"] is None and one["graders"][0]["votes"] == 5 and one["items"][0]["evidence"]["detail"] == 'say "x"'
    emit.write_results(out, f"{tmp_path}/r")
    back = spark.read.text(f"{tmp_path}/r").where("doc = 'd1'").first().value
    assert json.loads(back) == got["d1"]


def test_documents_and_cache(spark, tmp_path):
    assert emit.restricted_path("out/world.md") == "out/world_restricted.md" and emit.restricted_path("x/world") == "x/world_restricted"
    full, none = spark.createDataFrame([("# A\n\nb",)], "document string"), spark.createDataFrame([("",)], "document string")
    places = emit.write_documents(full, none, f"{tmp_path}/w.md")
    assert spark.read.text(places[0], wholetext=True).first().value == "# A\n\nb\n" and len(places) == 2 and len(emit.write_documents(full, None, f"{tmp_path}/v.md")) == 1
    asked = spark.createDataFrame([("m", 0.0, 10, "s", "u", "yes", True), ("m", 0.0, 10, "s", "v", "bad", False)], "model string, temperature double, max_tokens int, system string, user string, reply string, usable boolean")
    emit.put_replies(asked, f"{tmp_path}/cache")
    got = {r.user: r.reply for r in emit.cached(asked.drop("reply", "usable"), spark.read.parquet(f"{tmp_path}/cache")).collect()}
    assert got == {"u": "yes", "v": None}


def test_configuration(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_text(data if isinstance(data, str) else json.dumps(data), encoding="utf-8")
        return str(tmp_path / name)

    assert {(r.handle, r.name) for r in config.speakers(spark, put("s.json", {"+1": "Ash", "exporter": "ash "})).collect()} == {("+1", "Ash"), ("exporter", "ash ")}
    assert [r.name for r in config.roster(config.speakers(spark, str(tmp_path / "s.json"))).collect()] == ["Ash"]
    with pytest.raises(FileNotFoundError):
        config.speakers(spark, str(tmp_path / "no.json"))
    with pytest.raises(ValueError):
        config.speakers(spark, put("s2.json", ["x"]))
    want = (0, "Kim", "Oda", "Voss", ["Odd"], ["they", "them"], ["oda", "odd", "oda voss", "odd voss"])
    for data in ([{"player": "Kim", "main_name": "Oda", "last_name": "Voss", "aliases": ["Odd"]}], {"Kim": {"main_name": "Oda", "last_name": "Voss", "aliases": ["Odd", " "], "pronouns": []}}):
        assert tuple(config.party(spark, put("p.json", data)).first()) == want
    for data in ({"Kim": ["Oda", "Odd"]}, {"Kim": "Oda"}):
        r = config.party(spark, put("p.json", data)).first()
        assert (r.main_name, r.recognition[0]) == ("Oda", "oda")
    assert config.party(spark, str(tmp_path / "none.json")).count() == 0
    for bad in ([1], {"Kim": 5}, [{"player": "Kim"}], 7, {" ": "x"}):
        with pytest.raises(ValueError):
            config.party(spark, put("bad.json", bad))
    party = config.party(spark, put("p.json", [{"player": "Kim", "main_name": "Oda", "aliases": ["Bo"]}, {"player": "Lee", "main_name": "Rex", "aliases": []}]))
    answers = spark.createDataFrame([("oda", "Ash", 0), ("Bo", "Lee", 1), ("Nu", "Zed", 2), (" ", "x", 3)], "name string, player string, ord int")
    got = {r.main_name: (r.player, r.aliases) for r in config.upsert_party(party, answers).collect()}
    assert got["Nu"] == ("Zed", []) and got["Rex"] == ("Lee", []) and got["Oda"][0] in ("Ash", "Lee")
    emit.write_party(party, f"{tmp_path}/party")
    assert [x["main_name"] for x in json.loads(spark.read.text(f"{tmp_path}/party").first().value)] == ["Oda", "Rex"]
    assert config.link_words(spark, str(tmp_path / "none.json")) == {"require_article": [], "never_link": []}
    with pytest.raises(ValueError):
        config.link_words(spark, put("w.json", {"neverlink": []}))
    rows = config.checklist(spark, put("c.yaml", json.dumps({"sections": ["A", {"name": "B", "aliases": ["b"]}], "characters": [{"name": "C", "pc": True}]}))).collect()
    assert [(r.category, r.k, r.name, r.pc) for r in rows] == [("sections", 0, "A", False), ("sections", 1, "B", False), ("characters", 0, "C", True)]
    for bad in ({"rooms": []}, {"sections": [5]}, {"sections": [{"name": 5}]}):
        with pytest.raises(ValueError):
            config.checklist(spark, put("c2.yaml", bad))
    assert {r.slug: r["rank"] for r in config.ranks(spark, put("r.yaml", {"a": 1, "b": 1})).collect()} == {"a": 1, "b": 1}
    for bad in ({"a": True}, {"": 1}, {"a": "x"}, [1]):
        with pytest.raises(ValueError):
            config.ranks(spark, put("r2.yaml", bad))
    one = spark.createDataFrame([(" a, ,b", "she/her, it")], "l string, p string").select(config.split_list("l"), config.split_pronouns("p"), config.split_pronouns(F.lit(" "))).first()
    assert list(one) == [["a", "b"], ["she", "her", "it"], ["they", "them"]]


FACT = "array<struct<text:string,source_files:array<string>>>"
QUOTE = "array<struct<text:string,speaker:string,source_file:string>>"


def test_world(spark):
    q = lambda *t: [(x, "Ann", "f") for x in t]
    nouns = [
        ("locations", 0, "the MILL", [("Old Mill", ["f"])], [("It burned", ["f"]), ("Oda saw it!", ["f"])], q("mill  burned"), None),
        ("characters", 0, "Oda", [], [("She left the mill and the Old Mill", ["f"])], q("she left", "mill burned"), None),
        ("items", 0, "Empty", [], [], [], None),
    ]
    entities = spark.createDataFrame(nouns, f"entity_type string, index int, name string, aliases {FACT}, details {FACT}, quotes {QUOTE}, prose string")
    happened = [(0, "Fire", [], "The Old mill\nburned.", "3 AR", "AR", 0, q("mill burned"), None), (1, "Dawn", [], "x", None, "AR", 1, [], None), (2, "Well then. It fell", [], "y", None, None, None, [], "Oda fell.")]
    events = spark.createDataFrame(happened, f"index int, name string, aliases {FACT}, description string, date_text string, calendar_system string, chronological_position int, quotes {QUOTE}, prose string")
    text = render.render_world(entities, events).first().document
    assert text == "\n\n".join(
        [
            "## Locations", '### <a id="the-mill"></a>the Mill', "It burned. [Oda](#oda) saw it![^1]",
            "## History", '- <a id="fire"></a>**Fire** — 3 AR. The [Old Mill](#the-mill) burned.[^1]\n- <a id="dawn"></a>**Dawn**. x',
            "### Could Not Place", "- **Well then. It fell**. [Oda](#oda) fell.",
            "## Characters", '### <a id="oda"></a>Oda', "She left the mill and the [Old Mill](#the-mill).[^2][^1]",
            "## Footnotes", "[^1]: `mill burned` — Ann, f\n[^2]: `she left` — Ann, f",
        ]
    )
    assert render.render_world(entities.limit(0), events.limit(0)).first().document == ""
    only = events.where("index = 2")
    assert render.render_world(entities.limit(0), only).first().document.startswith("## History\n\n**Important Note:** None")
    loose = events.where("index < 2").withColumn("calendar_system", F.lit(None).cast("string"))
    assert render.render_world(entities.limit(0), loose).first().document.startswith("## Timeline\n\n- ")
    two = events.where("index < 2").withColumn("calendar_system", F.when(F.col("index") == 0, "B").otherwise("A"))
    assert "### A\n\n- " in render.render_world(entities.limit(0), two).first().document


def test_names_of_players_become_their_characters(spark):
    rows = [(1, "Sam", [("Sammy", ["f"])], [("sam's character ran; Sam's PC hid; samovar", ["f"]), ("SAM", ["g"])], [("Sam ran", "Ann", "f")])]
    e = spark.createDataFrame(rows, f"id int, name string, aliases {FACT}, details {FACT}, quotes {QUOTE}")
    r = render.deconflate_entities(e, {"sam": "Oda"}, ["id"]).first()
    assert (r.name, r.aliases[0].text, r.quotes[0].text) == ("Oda", "Sammy", "Sam ran")
    assert [d.text for d in r.details] == ["Oda ran; Oda hid; samovar", "Oda"]
    bodies = spark.createDataFrame([(0, 0, " body "), (0, 1, " ")], "batch int, local_id int, body string")
    batched = e.withColumns({"batch": F.lit(0), "local_id": F.lit(0), "prose": F.lit("old")})
    assert render.polish(batched, bodies, ["batch"]).first().prose == "body"
    assert render.polish(batched.withColumn("local_id", F.lit(1)), bodies, ["batch"]).first().prose is None
