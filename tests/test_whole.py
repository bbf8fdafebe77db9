"""Queries over whole texts and whole tables on planted rows that the narrower ones of the same operators cut off."""

import hashlib
import random

import duckdb
import pytest

from skeinwork.operators import ground
from skeinwork.plans import catalog

HEAD = "The same words stand at the head of all of these texts, for more than sixty characters: "


def planted(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    tails = ["zebra", "Émile", "apple", "Apple!", "unlike", "zebra"]
    rows = [(k, HEAD + t, "de" if k else "en", "src0") for k, t in enumerate(tails)]
    return planted(spark, tmp_path_factory.mktemp("texts"), documents=(rows, "doc_id long, text string, lang string, source string"))


def test_names_of_whole_texts(spark, texts):
    head = "the-same-words-stand-at-the-head-of-all-of-these-texts-for-more-than-sixty-characters-"
    got = {r.doc_id: r.slug_sha256 for r in catalog.QUERIES["slug_ascii"](spark, texts).collect()}
    assert got == {k: digest(head + t) for k, t in enumerate(["zebra", "mile", "apple", "apple", "unlike", "zebra"])}
    got = {r.doc_id: r.slug_sha256 for r in catalog.QUERIES["slug_fold_accents"](spark, texts).collect()}
    assert got[1] == digest(head + "emile")
    got = {r.doc_id: r.article_key_sha256 for r in catalog.QUERIES["article_strip"](spark, texts).collect()}
    assert got[4] == digest((head + "unlike").replace("-", " ").removeprefix("the ")) and len(got) == 6


def test_order_and_locks_of_whole_texts(spark, texts):
    r = catalog.QUERIES["alpha_order_violations"](spark, texts).first()
    # zebra, émile, apple, apple!, unlike, zebra: é is above all ASCII letters, so only apple after émile is below.
    assert (r.n_pairs, r.n_violations) == (5, 1)
    got = {(r.a, r.b, r.stage) for r in catalog.QUERIES["unique_locks"](spark, texts).collect()}
    assert got == {(0, 5, 0), (2, 3, 1)}


def test_exclusions_of_every_row(spark, tmp_path):
    rows = [(k, f"s{k}") for k in range(30)] + [(40, "late"), (41, "late"), (42, "src1")]
    d = planted(spark, tmp_path, documents=(rows, "doc_id long, source string"))
    got = {(r.name, r.problem) for r in catalog.QUERIES["exclusion_validate"](spark, d).collect()}
    assert got == {("late", "duplicate"), ("nowhere", "unknown")}


def test_every_event_is_woven(spark, tmp_path):
    rows = [(k, u, kind, f"2024-01-{day:02d} 00:00:00") for k, u, kind, day in [(1, 7, "view", 2), (2, 7, "view", 5), (3, 7, "click", 1), (6, 7, "click", 1), (8, 7, "click", 9), (9, 8, "click", 1), (10, 8, "click", 1)]]
    events = spark.createDataFrame(rows, "event_id long, user_id int, event_type string, t string").selectExpr("event_id", "user_id", "event_type", "to_timestamp(t) AS ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: (r.system, r.position) for r in catalog.QUERIES["timeline_weave"](spark, str(tmp_path)).collect()}
    assert got == {3: ("7", 0), 6: ("7", 1), 1: ("7", 2), 2: ("7", 3), 8: ("7", 4), 9: ("(undated)", 0), 10: ("(undated)", 1)}


def test_components_of_all_parts_against_union_find(spark):
    sf = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    root = {r.p_partkey: r.p_partkey for r in parts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for r in parts:
        for g in ((r.p_brand, r.p_size), (r.p_name, r.p_partkey // 400)):
            x, y = find(r.p_partkey), find(first.setdefault(g, r.p_partkey))
            root[max(x, y)] = min(x, y)
    ends = [find(r.p_partkey) for r in parts]
    want = {r.p_partkey: (x if 2 <= ends.count(x) <= 8 else r.p_partkey, 2 <= ends.count(x) <= 8) for r, x in zip(parts, ends, strict=True)}
    got = {r.node: (r.root, r.merged) for r in catalog.QUERIES["merge_components"](spark, sf).collect()}
    assert got == want and any(r.p_size > 12 for r in parts)


def test_triage_sees_other_word_breaks(spark, tmp_path):
    texts = [
        "It was, so they say, a well-known house on the river; nobody had lived there since the flood of that year.",
        "They sent an e mail to everyone — even to the keeper of the old light—house at the far end of the bay, and waited.",
        "Send e-mail.",
        None,
    ]
    quotes = [
        "a well known house on the river; nobody had lived there since the flood",
        "to the keeper of the old light-house at the far end of the bay",
        "to the keeper of the old lighthouse at the far end of the bay, and waited",
        "even to the keeper of the old light — house at the far",
        "e mail",
        "send e mail",
        "nobody had lived there since the flood of that year",
        "nobody had ever lived there since the flood of that year",
        "- - -",
    ]
    d = planted(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"), benchmark=(list(enumerate(quotes)), "item_id long, text string"))
    got = {(r.item_id, r.form): r.triage for r in catalog.QUERIES["quote_triage"](spark, d).collect()}
    assert [got[k, "as is"] for k in range(len(quotes))] == ["cosmetic", "unknown", "cosmetic", "cosmetic", "unknown", "cosmetic", "unknown", "reword", "reword"]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    assert got == {(k, form): v for k, form, v in con.execute(catalog.SQL["quote_triage"]).fetchall()}


def test_skeleton_join_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab- ", k=rng.randint(0, 90))) for _ in range(60)] + ["ab" * 60, "a" * 50]
    quotes = [t[i : i + rng.randint(1, 30)] for t in texts for i in (0, rng.randint(0, 40))] + ["a" * 45]
    bare = lambda s: s.replace("-", "").replace(" ", "")
    want = {(i, k) for i, x in enumerate(quotes) for k, t in enumerate(texts) if bare(x) and bare(x) in bare(t)}
    q = spark.createDataFrame(list(enumerate(quotes)), "i long, quote string")
    t = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    for size in (1, 3, 8):
        rows = ground.skeleton_join(q, "quote", t, "text", size).select("i", "k").collect()
        assert len(rows) == len(want) and {(r.i, r.k) for r in rows} == want
