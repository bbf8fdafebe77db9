"""Operators on small fixtures, with the edge cases that the tables do not hold."""

from datetime import datetime

from pyspark.sql import functions as F

from skeinwork.functions import text as X
from skeinwork.operators import document, grade, ground, mask, render, resolve, timeline
from skeinwork.sources import chatlog


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_slugs(spark):
    names = ["Rénault", "Ver'duun  Half-Orc", "!!", None, "The Harbour"]
    assert values(spark, names, X.slug("x")) == ["renault", "verduun-half-orc", "", None, "the-harbour"]
    assert values(spark, names, X.name_key("x")) == ["renault", "verduun half orc", "", None, "the harbour"]
    assert values(spark, ["Børge’s (Deep) Shaft", "Norn–Vale"], X.slug_keep_accents("x")) == ["børges-deep-shaft", "nornvale"]
    assert values(spark, ["harbour-2"], X.anchor_matches("x", F.lit("The Harbour"))) == [True]


def test_display_names(spark):
    names = ["MILLER'S REST", "the guild of bakers", "FBI", "Port ASTER", "half-blind duke", "McAllister"]
    assert values(spark, names, X.title_case("x")) == ["Miller's Rest", "The Guild of Bakers", "FBI", "Port Aster", "Half-Blind Duke", "McAllister"]


def test_verbatim(spark):
    assert values(spark, ["“It’s”—so…", " ", "IT'S"], X.is_verbatim("x", F.lit("he said \"It's\" -- so... \n yes"))) == [False, False, False]
    assert values(spark, ["“It’s” —\nso…"], X.is_verbatim("x", F.lit("he said \"It's\" -- so... yes"))) == [True]
    assert values(spark, ["a ``b`` c", "x"], X.code_span("x")) == ["```a ``b`` c```", "`x`"]


LOG = (
    "junk\r\r\nMay 17, 2022  5:29:42 PM\r\r\nMe\r\r\nhello\r\r\n\r\r\nworld\r\r\n"
    "Xyz 17, 2022 5:29:42 PM\r\r\nTapbacks:\r\r\n    Loved by Ash\r\r\n"
    "May 24, 2020 10:15:11 AM (Read by you after 1 minute)\n+1 (630) 555-0100\n/Users/x/Library/a.png\nTapbacks:\n    Liked by Me\n"
    "Feb 3, 2021 1:00:00 AM\nRobin\nlast"
)


def test_chat_log(spark, tmp_path):
    (tmp_path / "log.txt").write_bytes(LOG.encode())
    lines = chatlog.read_lines(spark, str(tmp_path))
    rows = chatlog.parse_messages(lines)
    speakers = spark.createDataFrame([("exporter", "Dana"), ("+16305550100", "Ash")], "handle string, name string")
    got = chatlog.resolve_senders(rows, speakers).orderBy("msg_ord").collect()
    assert [(r.sender, r.content) for r in got] == [("Dana", "hello\n\nworld\nXyz 17, 2022 5:29:42 PM"), ("Robin", "last")]
    assert got[0].timestamp == datetime(2022, 5, 17, 17, 29, 42)
    assert chatlog.parse_messages(lines.where("false")).count() == 0


def test_annotations_go_and_talk_about_them_stays(spark):
    kept = ["This message was deleted from the archive, said Ash", "(Read by candle light", "foo/bar and baz", "Tapbacks", "a/b/c"]
    gone = [
        "This message was deleted from the conversation!", "This message responded to an earlier message.", "(Read by you after 2 minutes)", "foo/Attachments/pic",
        "aa/bb/cc/Zq9Zq9Zq9Zq9Zq9Zq9", "My Files/x y/z/photo.jpeg", "Ash unsent this message part!", "Transcription: la la", "May 1, 2020 1:00:00 PM Ash named the conversation X",
    ]
    rows = [("f", k + 3, x) for k, x in enumerate(kept + gone)] + [("f", 1, "Feb 3, 2021 1:00:00 AM"), ("f", 2, "Robin")]
    got = chatlog.parse_messages(spark.createDataFrame(rows, "source_file string, lineno int, line string")).collect()
    assert [r.content for r in got] == ["\n".join(kept)]


def test_labels_never_lose_a_message(spark):
    m = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    labels = spark.createDataFrame([(1, 1, "lore"), (1, 2, " NOISE "), (2, 1, "odd"), (9, 1, "lore")], "id int, pos int, label string")
    assert {r.id: r.label for r in ground.attach_labels(m, labels, ["id"]).collect()} == {1: "noise", 2: "ambiguous", 3: "ambiguous"}


def test_containment_finds_short_and_long_quotes(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h"), (2, "xa b c d e f gy"), (3, None), (4, "")], "t int, text string")
    quotes = spark.createDataFrame([(1, "a b c d e f g"), (2, "b c"), (3, " "), (4, None), (5, "g h")], "q int, quote string")
    got = {(r.q, r.t) for r in ground.containment_join(quotes, "quote", texts, "text").collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 2), (5, 1)}
    more = ground.containment_join(quotes, "quote", texts, "text", max_broadcast=0)
    assert {(r.q, r.t) for r in more.collect()} == got and "Cartesian" not in more._jdf.queryExecution().toString()


def test_lineage_and_masking(spark):
    facts = spark.createDataFrame([(1, " x ", "a"), (2, "x", "b"), (3, "x", "a"), (4, "y", "a")], "o int, t string, s string")
    merged = resolve.dedup_lineage(facts, [], "t", "s", "o")
    assert {r.fact: (r.text, r.sources) for r in merged.collect()} == {"x": (" x ", ["a", "b"]), "y": ("y", ["a"])}
    assert [(r.fact, r.sources) for r in mask.mask_facts(merged, "sources", ["a"]).collect()] == [("x", ["b"])]
    schema = "name string, name_sources array<string>, aliases array<struct<text:string,source_files:array<string>>>, details array<struct<text:string,source_files:array<string>>>, quotes array<struct<text:string,speaker:string,source_file:string>>, prose string"
    rows = [
        ("Secret", ["a"], [("Known", ["b"]), ("Hidden", ["a"])], [("f", ["a", "b"]), ("g", ["a"]), ("h", [])], [("q", "s", "a")], "p"),
        ("Gone", ["b"], [], [("g", ["a"])], [], None),
        ("Unnamed", [], [], [("f", ["b"])], [], None),
    ]
    got = mask.mask_entities(spark.createDataFrame(rows, schema), ["a"]).collect()
    assert [(r.name, [d.text for d in r.details], len(r.quotes), r.aliases, r.prose) for r in got] == [("Known", ["f"], 0, [], None)]


def test_components_and_pairs(spark):
    groups = spark.createDataFrame([("g", 1), ("g", 2), ("h", 2), ("h", 3), ("k", 7), ("k", 8)] + [("z", 100 + i) for i in range(9)], "grp string, m int")
    got = {r.node: (r.root, r.merged) for r in resolve.merge_components(groups, "grp", "m").collect()}
    assert got[3] == (1, True) and got[8] == (7, True) and got[105] == (105, False)
    names = spark.createDataFrame([(0, "harlan house"), (1, "harlin house"), (2, "port aster"), (3, "aster"), (4, ""), (5, "cj"), (6, "dj")], "o int, k string")
    got = {(r.i, r.j): r.reason for r in resolve.candidate_pairs(names, "o", "k").collect()}
    assert got == {(0, 1): "edit", (2, 3): "subset"}


def test_timeline(spark):
    e = spark.createDataFrame([(1, "a", [2]), (2, "a", [2, 1]), (3, "a", [0]), (4, "a", [2])], "e int, s string, parts array<int>")
    ranked = timeline.spine(e, "s", "parts")
    assert {r.e: r["rank"] for r in ranked.collect()} == {3: 0, 1: 1, 4: 1, 2: 2}
    placed = spark.createDataFrame([(9, "a", 1, 0), (9, "a", 2, 1), (1, "a", 1, 0), (8, "x", 0, 0)], "e int, system string, gap bigint, placement_pos int")
    ok = timeline.valid_placements(placed, timeline.gaps(ranked, "s"), e, "e", ["placement_pos"])
    woven = timeline.weave(ranked, ok, "s", "e", "e").orderBy("position").collect()
    assert [r.e for r in woven] == [3, 9, 1, 4, 2]


def test_votes_and_scores(spark):
    v = spark.createDataFrame([(1, 0, "pass"), (1, 1, "fail"), (2, 0, "pass"), (2, 1, "odd"), (3, 0, "odd")], "i int, vote int, label string")
    got = {r.i: (r.label, r.split) for r in grade.vote_majority(v, ["i"], "label", ["pass", "fail"], "fail").collect()}
    assert got == {1: ("fail", True), 2: ("pass", False), 3: ("fail", True)}
    s = spark.createDataFrame([("pass",), ("partial",), ("fail",), ("na",)], "s string").withColumn("g", F.lit(1))
    r = grade.score_block(s, ["g"], "s", 0.5).first()
    assert (r.applicable, r.score, r.complete) == (3, 0.5, True)


DOC = """# Title
A subtitle

---
## Locations
### <a id="lake"></a>Lake
Big. [^1] See [Lake](#lake) and [Gone](#gone)
- detail
### Could Not Place
- <a id="well"></a>**Well** — deep [^2]
- plain

---
## Footnotes
[^1]: `big` — Ash, log.txt
[^2]: `deep` — Ash, log.txt
```
# not a heading
```
"""


def test_document_tables_and_lint(spark):
    docs = spark.createDataFrame([(1, DOC), (2, ""), (3, None)], "doc_id int, text string")
    p = document.stored(document.parse(docs))
    assert [(r.name, r.anchor_id, r.is_bullet, r.is_grouping) for r in p.entries.orderBy("lineno").collect()] == [
        ("Lake", "lake", False, False), ("Could Not Place", None, False, True), ("Well", "well", True, False), ("plain", None, True, False),
    ]
    assert [(r.name, r.n) for r in document.cited(p).orderBy("n").collect()] == [("Lake", 1), ("Well", 2)]
    got = {r.id: (r.status, r.lines) for r in document.lint(p).where("doc_id = 1").collect()}
    assert len(got) == 24
    assert got["links.resolve"] == ("partial", [7]) and got["list-entries.anchor-bold"] == ("partial", [11])
    assert got["title.single-h1"][0] == got["title.subtitle-present"][0] == got["fndef.collected"][0] == got["layout.hr-separators"][0] == "pass"
    assert {r.status for r in document.lint(p).where("doc_id = 2").collect()} == {"na"}


def test_anchors_links_and_render(spark):
    names = spark.createDataFrame([(0, "oakford"), (1, "oakford-2"), (2, "oakford"), (3, "")], "o int, b string")
    got = {r.o: r.anchor for r in render.assign_anchors(names, "b", ["o"], F.concat(F.lit("entity-"), F.col("o"))).collect()}
    assert got == {0: "oakford", 1: "oakford-2", 2: "oakford-3", 3: "entity-3"}
    names = spark.createDataFrame([(0, "oakford"), (1, "oakford"), (2, "oakford-2"), (3, "oakford"), (4, "elm"), (5, "elm")], "o int, b string")
    got = {r.o: r.anchor for r in render.assign_anchors(names, "b", ["o"], F.lit("x")).collect()}
    assert got == {0: "oakford", 1: "oakford-2", 2: "oakford-2-2", 3: "oakford-3", 4: "elm", 5: "elm-2"}
    pool = spark.createDataFrame([("Aldine", "k"), ("Aldine League", "ki")], "surface string, anchor string")
    blocks = spark.createDataFrame([("The Aldine League and Aldine; Aldine `Aldine` Aldines", None), ("Aldine", "k"), (None, None)], "t string, own string")
    got = [r.t for r in render.weave_links(blocks, "t", "own", pool).collect()]
    assert got == ["The [Aldine League](#ki) and [Aldine](#k); Aldine `Aldine` Aldines", "Aldine", None]
    entries = spark.createDataFrame([("items", "b", "b", "B", "x"), ("locations", "a", "a", "A", "y")], "section string, sort_key string, anchor string, name string, body string")
    assert render.render(entries).first().document.startswith('## Locations\n\n### <a id="a"></a>A\n\ny\n\n## Items')
