"""The training-data operators on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinwork.llm import bpe, decontaminate, licenses, near_dedup, pii, quality_classifier, quality_rules, queries, sharding, url_filter, warc

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n", "a", "the same words again", "the same words again", "ünï ☃ text " * 30, "long " * 60_000]


def table(spark, texts=TEXTS):
    """Documents with a repeated id, a null id and a column named like results."""
    rows = [(k, t, "odd") for k, t in enumerate(texts)] + [(5, texts[5], "odd"), (None, "loose text here", "odd")]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Words string")


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.SQL[name])
    cols = [c[0] for c in found.description]
    want = sorted(found.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def brute_hits(words, items, window=10):
    hit, found = set(), set()
    for key, item in items:
        size = min(window, len(item))
        for k in range(len(item) - size + 1) if item else []:
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[k : k + size]:
                    hit |= set(range(i, i + size))
                    found.add(key)
    return hit, found


def test_suffix_automaton_against_brute_force():
    rng = random.Random(5)
    for window in (3, 10):
        for _ in range(150):
            items = [(str(k), [rng.choice("abc") for _ in range(rng.randint(0, 14))]) for k in range(5)]
            words = [rng.choice("abcd") for _ in range(rng.randint(0, 60))]
            m = decontaminate.Matcher(tuple((k, " ".join(w).encode()) for k, w in items), window)
            mask, found, _ = m.scan([w.encode() for w in words])
            want, ids = brute_hits(words, items, window)
            assert {i for i, x in enumerate(mask or b"") if x} == want and found == ids
            assert not m.scan(decontaminate.alnum_words(decontaminate.cut(" ".join(words).encode(), m)))[0]


def test_decontaminate_edges(spark):
    items = spark.createDataFrame([(1, "The same WORDS again"), (2, None), (3, ""), (None, "loose text"), (1, "a")], "item_id long, text string")
    for block in (1, 1 << 20):
        got = decontaminate.decontaminate(table(spark), items, clean=True, block_bytes=block)
        rows = {(r.doc_id, r.text): r for r in got.collect()}
        assert got.columns.count("n_words") == 1 and "N_Words" not in got.columns and got.count() == 10
        assert rows[4, TEXTS[4]].item_ids == ["1"] and rows[4, TEXTS[4]].clean_text == ""
        assert rows[None, "loose text here"].n_hit == 2 and rows[None, "loose text here"].clean_text == "here"
        assert rows[0, None].n_words == 0 and rows[0, None].clean_text is None and not rows[1, ""].contaminated
    assert decontaminate.decontaminate(table(spark).limit(0), items).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(table(spark), items.limit(0)).collect())


def test_warc_round_trip(spark):
    pages = [(k, f"http://x/{k}\r\nEvil: 1" if k else None, t) for k, t in enumerate([None, "", "same", "same", "ü" * 9, "x" * 200_000] + [f"<p>{k} words of a page</p>" * 40 for k in range(300)])]
    df = spark.createDataFrame(pages + [(3, "u", "same"), (None, None, "same")], "page_id long, url string, html string")
    got = warc.archive_round_trip(df).collect()
    assert len(got) == df.count()
    for r in got:
        body = b"same" if r.page_id is None else (pages[int(r.page_id)][2] or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.record_type == "revisit" or r.payload == body
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {("2", "revisit", "3"), ("3", "response", None), ("0", "revisit", "1"), ("1", "response", None), (None, "revisit", "3")} <= kinds
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_warc_dictionary_and_damage():
    import io

    out = io.BytesIO()
    writer = warc.Writer(out, [f"record number {k} of the archive {k * k}".encode() * 40 for k in range(400)])
    for k in range(20):
        writer.add(warc.make_record(k, "http://x", f"record number {k}".encode()))
    raw = out.getvalue()
    assert struct.unpack("<I", raw[:4])[0] == warc.DICT_MAGIC
    assert [r.payload for r in warc.read_bytes(raw)] == [f"record number {k}".encode() for k in range(20)]
    for bad in (raw[:-3], raw[:-20] + b"0" * 20, raw + b"tail tail"):
        with pytest.raises(warc.WarcError):
            warc.read_bytes(bad)
    good = warc.make_record(1, "u", b"abc")
    for bad in (good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good.replace(b"abc\r\n\r\n", b"abd\r\n\r\n"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_pii_against_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b@", "@c.d", ".", "1", "22", "0255", "+", "-", " ", "4111111111111111", "é", "😀", "+1 (234) 555-1234", "x@y.z", " 4111 1111 1111 1111"]
    texts = [None, "", "1" * 30_000, "a." * 20_000 + "@b" + ".c" * 9_000, "1.2.3.4 " * 700, "DE89 3704 0044 0532 0130 00 my iban GB82WEST12345698765433"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_spans", F.lit(1))
    got = pii.redact(pii.find_spans(df).withColumn("own", F.col("text")), "own").collect()
    for r in got:
        assert [(s.start, s.ord, s.end) for s in r.pii_spans if s.ord < 4] == brute_spans(r.text or "")
        if r.own is not None and r.doc_id != 5:
            assert not [s for s in brute_spans(r.own) if s[1] in (0,)] or "<PII>" in r.own
    assert [(s.kind, s.start, s.end) for s in next(r for r in got if r.doc_id == 5).pii_spans] == [("iban", 0, 27)]
    assert pii.find_spans(df.limit(0)).count() == 0


def test_iban_ends_and_context_after(spark):
    texts = [
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX",
        "GB82 WEST 1234 5698 7654 32 AND NO9386011117947 TODAY",
        "123-45-6789 is my social security number",
        "my ssn: 123-45-6789",
        "123-45-6789 is a part number",
        "DE89 3704 0044 0532 0130 01 BIC",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[(s.kind, t[s.start : s.end]) for s in r.pii_spans if s.kind in ("iban", "ssn")] for t, r in zip(texts, pii.find_spans(df).orderBy("doc_id").collect(), strict=True)]
    ssn = [("ssn", "123-45-6789")]
    assert got == [[("iban", "DE89 3704 0044 0532 0130 00")], [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "NO9386011117947")], ssn, ssn, [], []]


def test_redact_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "a@b.cc", "x 1.2.3.4 y", "é" * 5000 + " mail a@b.cc," * 900 + "😀" * 5000]
    texts += ["".join(rng.choices(["a@b.cc", " 10.0.0.1", " +49 30 1234567", "4111 1111 1111 1111", " ", "é", "word "], k=rng.randint(0, 30))) for _ in range(150)]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)) + [(2, "a@b.cc")], "doc_id long, text string"))
    after = sorted((r.doc_id, r.text) for r in pii.redact(found, placeholder="<X>").collect() if r.doc_id)
    want = []
    for r in found.collect():
        out, at = [], 0
        for s in r.pii_spans:
            if s["start"] >= at:
                out += [r.text[at : s["start"]], "<X>"]
            at = max(at, s["end"])
        want.append((r.doc_id, r.text if not r.pii_spans else "".join(out) + r.text[at:]))
    assert after == sorted(w for w in want if w[0])
    assert pii.redact(found).where("doc_id = 0").first().text is None and pii.redact(found.limit(0)).count() == 0


def test_near_dedup_edges_and_tokens(spark):
    base = [f"w{k}" for k in range(40)]
    texts = TEXTS + [" ".join(base), " ".join([*base[:39], "other"]), " ".join(base).upper(), " ".join(base[:20]), "w0 w1", "W0  w1"]
    rows = {(r.doc_id): r for r in near_dedup.near_duplicates(table(spark, texts)).where("doc_id IS NOT NULL").collect()}
    assert [rows[k].n_shingles for k in (0, 1, 2, 3, 8, 9, 12)] == [0, 0, 0, 1, 36, 36, 1]
    assert (rows[9].component_id, rows[10].component_id, rows[11].component_id, rows[13].component_id) == (8, 8, 11, 12)
    assert rows[5].component_id == 4 and rows[0].kept and rows[1].kept and not rows[5].kept
    left = near_dedup.drop_duplicates(table(spark, texts))
    assert left.columns == ["doc_id", "text", "N_Words"] and left.count() == len(texts) - 4 + 1
    assert near_dedup.near_duplicates(table(spark).limit(0)).count() == 0
    assert near_dedup.word_hashes(b"b a b")[0] == near_dedup.word_hashes("üü b".encode())[1]


def test_near_dedup_clashing_columns_and_long_words(spark):
    df = table(spark).withColumns({"component_id": F.lit("x"), "KEPT": F.lit("y"), "n_shingles": F.lit("z"), "__set": F.lit(1)})
    want = {repr(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark)).collect()}
    got = near_dedup.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {repr(r.doc_id): (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want
    assert near_dedup.drop_duplicates(df).columns == df.columns
    rng = random.Random(2)
    words = ["".join(rng.choices("abé☃", k=rng.randint(1, 9))) for _ in range(50_000)]
    words[7], words[9] = "y" * (near_dedup.PIECE + 5), "z" * near_dedup.PIECE
    whole = near_dedup.word_hashes(" ".join(words).encode())
    assert len(whole) == len(words) and list(whole) == [near_dedup.word_hashes(w.encode())[0] for w in words]
    assert list(near_dedup.word_hashes(("\n".join(words) + "\t ").encode())) == list(whole)


def test_groups_with_one_id_in_common_stay_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (2, a + " more"), (1, b), (3, b + " more"), (1, b)]
    left = near_dedup.drop_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, a), (1, b)]


def test_odd_sketches_keep_similar_pairs():
    rng = np.random.default_rng(1)
    for n in (8, 60, 700, 9000):
        lost = unlike = 0
        for _ in range(60):
            every = rng.integers(0, 2**64, 3 * n, dtype=np.uint64)
            shared = int(0.76 * 2 * n / 1.76)
            for overlap, near in ((shared, True), (n // 4, False)):
                a, b = np.unique(every[:n]), np.unique(np.concatenate((every[:overlap], every[n : 2 * n - overlap])))
                x, y = near_dedup.bin_samples(a), near_dedup.bin_samples(b)
                ok = near_dedup.close(np.array([n]), np.array([len(x)]), near_dedup.odd_sketch(x)[None], np.array([n]), np.array([len(y)]), near_dedup.odd_sketch(y)[None])[0]
                lost += near and not ok and near_dedup.similar(a, b)
                unlike += not near and ok
        assert lost == 0 and (n < 60 or unlike == 0)


def test_cross_component_pairs_are_found(spark):
    """A chain of versions: ends are unlike, each is like the next; every link must be found."""
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[12 * k : 12 * k + 160]) for k in range(20)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(df).collect()} == {0}


def versions(n, words, changed, seed):
    """Versions of one text, each with other words in a few places: most pairs are just below the threshold."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    return [" ".join(f"x{v}y{k}" if k in own else w for k, w in enumerate(base)) for v in range(n) for own in [set(rng.sample(range(words), changed))]]


def test_training_leaves_no_memory_in_the_driver(spark):
    def held():
        found = re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read())
        return sum(map(int, found)) / 1024

    text = F.expr("concat_ws(' ', transform(sequence(1, 800), k -> substr(md5(concat(id, ':', k)), 1, 2 + k % 3)))")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    quality_classifier.train(docs.limit(50), labels)
    before = held()
    quality_classifier.train(docs, labels)
    assert held() - before < 30


def test_candidates_across_components_follow_the_nodes():
    """One cell of texts that are all close and mostly not similar: its rows are its nodes, not their pairs, and its links
    join what is similar."""
    import pyarrow as pa

    sets = [near_dedup.shingles(t.encode()) for t in versions(200, 190, 3, 7)]
    n, samples = len(sets), [near_dedup.bin_samples(s) for s in sets]
    cell = {"key": ["c"] * n, "side": [2] * n, "band": [1] * n, "node": range(n), "root": range(n), "n_shingles": map(len, sets), "__samples": map(len, samples)}
    cell |= {"__sketch": [near_dedup.odd_sketch(s).tolist() for s in samples], "__bands": [[1]] * n}
    rows = list(near_dedup._cross_cells(iter([pa.RecordBatch.from_pydict({k: list(v) for k, v in cell.items()})])))
    assert 0 < sum(r.num_rows for r in rows) <= n
    held = [r.append_column("__items", pa.array([sets[k].tobytes() for k in r.column("node").to_pylist()])) for r in rows]
    links = [x for r in near_dedup._similar_groups(iter(held)) for x in zip(*r.to_pydict().values(), strict=True)]
    similar = [(i, k) for i in range(n) for k in range(i) if near_dedup.similar(sets[i], sets[k])]
    mine, want = list(range(n)), list(range(n))
    for root, edges in ((mine, links), (want, similar)):
        for i, k in edges:
            root[:] = [root[k] if x == root[i] else x for x in root]
    assert 0 < len(links) < n <= len(similar) < n * n / 5
    assert all((mine[i] == mine[k]) == (want[i] == want[k]) for i in range(n) for k in range(i))


def test_groups_are_cut_and_join_components(monkeypatch):
    """Each similar pair of a group is joined over the links that come out, however small the groups."""
    monkeypatch.setattr(near_dedup, "GROUP_ITEMS", 1000)
    sets = [near_dedup.shingles(t.encode()) for t in versions(60, 140, 2, 3)]
    nodes, sizes = np.arange(60) * 7 % 61, np.array(list(map(len, sets)))
    i, k = np.triu_indices(60, 1)
    root, links, own = {int(x): int(x) for x in nodes}, [], dict(zip(nodes.tolist(), sets, strict=True))
    groups = list(near_dedup._grouped((nodes, nodes, sizes), (nodes, nodes, sizes), i, k, "x"))
    assert len(groups) > 20 and sum(len(o) for g in groups for o in g.column("others").to_pylist()) == len(i)
    for g in groups:
        at = g.column("node").to_numpy()
        a, b = near_dedup._joining(at, g.column("root").to_numpy(), [np.array(o, dtype=np.int64) for o in g.column("others").to_pylist()], [own[x] for x in at.tolist()])
        assert all(near_dedup.similar(own[x], own[y]) for x, y in zip(a, b, strict=True)) and len(a) < len(at)
        links += zip(a, b, strict=True)
    for a, b in links:
        root = {n: root[b] if x == root[a] else x for n, x in root.items()}
    similar = [(int(nodes[x]), int(nodes[y])) for x, y in zip(i, k, strict=True) if near_dedup.similar(sets[x], sets[y])]
    assert similar and all(root[a] == root[b] for a, b in similar) and len(set(groups[0].column("key").to_pylist())) == 1


def test_sharding(spark):
    df = table(spark)
    rows = sharding.shard_rows(df, 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((k % 4, k // 4) for k in range(10))
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} >= {(0, 1, 0), (1, 1, 0), (4, 21, zlib.crc32(TEXTS[4].encode()))}
    again = sharding.shard_rows(df.repartition(7), 4).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    places = spark.createDataFrame([(r.shard, r.slot) for r in rows], "shard int, slot long")
    assert {(r.shard, r.slot): r.row_no for r in sharding.row_numbers(places, 10, 4).collect()} == {(r.shard, r.slot): r.row_no for r in rows}
    assert sharding.shard_rows(df.limit(0)).count() == 0


def same_crc():
    """Two texts of one length with one crc32."""
    seen = {}
    rng = random.Random(1)
    while True:
        t = "".join(rng.choices("abcdefghijklmnop", k=12))
        if seen.setdefault(zlib.crc32(t.encode()), t) != t:
            return seen[zlib.crc32(t.encode())], t


def test_write_shards_keeps_every_text(spark, tmp_path):
    a, b = same_crc()
    assert a != b and zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(None, a), (None, b), (1, None), (1, ""), (2, "x"), (2, "x"), *((k, f"text {k}") for k in range(10, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("odd"))
    sharding.write_shards(docs, f"{tmp_path}/out", 4, rows_a_file=3)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, rows))
    places = sorted((r.doc_id or -1, r.shard, r.slot) for r in sharding.shard_rows(docs, 4).collect())
    assert sorted((r.doc_id or -1, r.shard, r.slot) for r in back) == places
    assert sorted(r.slot for r in back if r.shard == 0) == list(range(9))


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 7, 97, 1000, 4097):
        walk = sharding.longest_walk(spark, n, 3)
        got = sorted(r.x for r in sharding.permute(spark.range(n).withColumnRenamed("id", "x"), "x", n, 3, walk).collect())
        assert got == list(range(n))


def test_bpe_against_the_library(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = queries.tokenizer_path(), public_tokenizers.PATTERN
    ranks = bpe.load_ranks(path)
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choices("aabcthe  \n\t's12!?ñé中😀\x1c\x85", k=rng.randint(0, 200))) for _ in range(400)] + ["<|endoftext|> x"]
    texts += ["".join(rng.choices(["th", "er", "ing", "日本", "é", "q"], k=20_000)), "a\nb\nc d\n\ne", "one line\nnext line. And\nmore"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("N_tokens", F.lit("x"))
    for r in bpe.encode_decode(df, path, pattern, with_ids=True).collect():
        ids = want.encode_ordinary(r.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids), r.text[:80]
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    small = bpe.Transducer(ranks, max_states=3)
    for word in (" unbelievably", "ñandú中", "aaaaaaaaab"):
        assert small.encode(word.encode()) == want.encode_ordinary(word)
    empty = bpe.encode_decode(df.limit(0), path, pattern, with_ids=True)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]
    long = ("".join(rng.choices(["an", "ti", "dis", "est", "ab"], k=3 * bpe.LOOKAHEAD))).encode()
    kept = bpe.Transducer(ranks)
    assert kept.encode(long) == want.encode_ordinary(long.decode()) and kept.encode(long[:5]) == want.encode_ordinary(long[:5].decode())
    stream = bpe.StreamDecoder(bpe.token_table(ranks))
    assert "".join([stream.feed([k]) for k in want.encode_ordinary("ñ😀中")]) + stream.end() == "ñ😀中"
    many = bpe.Codec(ranks, pattern)
    text = "ñ😀中 und so weiter\n" * 3000
    parts = list(many.decode(many.encode(text)))
    assert len(parts) > 3 and "".join(parts) == text


def test_chunk_stores_are_bounded_by_bytes():
    asked = []
    store = bpe._Chunks(lambda x: asked.append(x) or x.encode(), limit=100_000)
    for k in range(3000):
        assert store[f"chunk {k}"] == f"chunk {k}".encode()
    assert len(store) + len(store.older) < 1300
    n = len(asked)
    assert store["x" * 5000] == b"x" * 5000 == store["x" * 5000] and len(asked) == n + 2  # a long chunk is not kept


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_quality_rules(spark):
    rng = random.Random(3)
    texts = [*TEXTS, "a b c\n\n a b c\na b c\n#*", *["".join(rng.choices("ab \n\t#é", k=rng.randint(0, 120))) for _ in range(200)]]
    for r in quality_rules.quality_rules(table(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    noise = base64.b85encode(rng.randbytes(60_000)).decode()
    odd = spark.createDataFrame([(1, " ".join(noise[k : k + 9] for k in range(0, 70_000, 9))), (2, "\n".join(f"line {k % 7} again and again" for k in range(900)))], "doc_id long, text string")
    assert [r.in_bands for r in quality_rules.quality_rules(odd).orderBy("doc_id").collect()] == [False, False]
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def prose(rng, n_bytes):
    """Sentences of invented words, some far more frequent than others, cut at ``n_bytes``."""
    lexicon = ["".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "n", "r", "s"]) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(3000)]
    weights = [1 / (k + 3) for k in range(len(lexicon))]
    out, size = [], 0
    while size < n_bytes:
        s = " ".join(rng.choices(lexicon, weights, k=rng.randint(6, 16))).capitalize() + ". "
        out.append(s)
        size += len(s)
    return "".join(out)[:n_bytes]


def in_words(s, size):
    return " ".join(s[k : k + size] for k in range(0, len(s), size))


def verdicts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.base_failed, r.in_bands) for r in quality_rules.quality_rules(rows).orderBy("doc_id").collect()]


def test_bands_decide_beyond_the_base_rule(spark):
    rng = random.Random(11)
    good = [prose(rng, n) for n in (400, 700, 1500, 3000, 6000, 12_000, 40_000, 90_000)]
    packed = [in_words(base64.b64encode(rng.randbytes(n)).decode(), 9) for n in (450, 600, 1500, 3000, 12_000, 60_000)]
    packed += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz" + " " * 5, k=n)) for n in (6000, 12_000, 60_000)]
    half = [prose(rng, n * 11 // 20) + "subscribe " * (n * 9 // 200) for n in (1500, 3000, 7000, 20_000, 90_000)]
    assert verdicts(spark, good) == [(False, True)] * len(good)
    assert verdicts(spark, packed) == [(False, False)] * len(packed)
    assert verdicts(spark, half) == [(False, False)] * len(half)


def test_chunks_of_short_texts_tails_and_stretches(spark):
    rng = random.Random(12)
    noise = lambda n: in_words(base64.b64encode(rng.randbytes(n)).decode(), 9)[:n]
    good = [prose(rng, n) for n in (4096, 4100, 8191, 8192, 12_500, 90_000)]
    good += [prose(rng, 50_000) + noise(4096) + prose(rng, 50_000)]  # one odd chunk in a long text is no reason
    bad = [
        prose(rng, 60_000) + "spam " * 6000,
        prose(rng, 60_000) + noise(14_000) + prose(rng, 60_000),
        prose(rng, 150_000) + "spam " * 2600 + prose(rng, 150_000),
        prose(rng, 4200) + "spam " * 500,
        prose(rng, 9000) + noise(4090),
        noise(3900) + prose(rng, 4200),
    ]
    assert verdicts(spark, good) == [(False, True)] * len(good)
    assert verdicts(spark, bad) == [(False, False)] * len(bad)
    # By the chunks themselves: the band of whole texts takes no part.
    wide = quality_rules.Bands(whole=((0, 0.0, 1e9),))
    rows = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = [r.in_bands for r in quality_rules.quality_rules(rows, bands=wide).orderBy("doc_id").collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def test_url_filter(spark):
    urls = ["HTTP://WWW.Example.COM/en/1?q#f", "x://example.com/en/", "http://a.example.com/en/x", "http://example.com", "http://b.net/es/1", "nonsense", None, "http://www.spam-farm.example.org/en/1", "http://com/", "http://h.org/a://b?c"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("Rule", F.lit(1))
    got = url_filter.filter_urls(df, url_filter.train()).orderBy("page_id").collect()
    assert [r.rule for r in got] == ["www.example.com/en/", "example.com/en/", "example.com/en/", None, "net/es/", None, None, None, "com/", None]
    assert [r.verdict for r in got][:3] == ["allow", "block", "block"] and got[7].verdict == "block" and got[6].verdict == "allow"
    assert [(r.host, r.path) for r in got] == [url_filter.split_url(u) for u in urls]


def test_url_model_on_urls_it_has_not_seen():
    rows, right = list(url_filter.TRAINING), 0
    for fold in range(6):
        model = url_filter.train([r for k, r in enumerate(rows) if k % 6 != fold])
        right += sum((model.score(url_filter.ngrams(*url_filter.split_url(u))) >= 0.5) == bool(y) for k, (u, y) in enumerate(rows) if k % 6 == fold)
    assert right / len(rows) >= 0.8


def test_url_filter_edges(spark):
    long = "http://a.example.net/" + "x" * 300_000
    df = spark.createDataFrame([(1, long), (2, long), (3, "http://b.c/en/"), (3, "http://b.c/en/")], "page_id long, url string")
    model = url_filter.train()
    got = url_filter.filter_urls(df, model, rules=(("block", "b.c", "/en/"), ("allow", "b.c", "/en/"), ("allow", "c", "/"))).collect()
    assert len(got) == 4 and {(r.verdict, r.rule) for r in got if r.page_id == 3} == {("block", "b.c/en/")}  # the earlier of equal rules
    assert len({r.block_score for r in got if r.page_id < 3}) == 1 and all(len(r.path) == 300_001 for r in got if r.page_id < 3)
    assert url_filter.filter_urls(df.limit(0), model).count() == 0


def test_classifier_edges(spark):
    text = "good words " * 3
    rows = [(k, text + "!" * (k % 2) * 40) for k in range(60)] + [(7, text), (None, text), (90, "w" * 200_000), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"SCORE": F.lit("x"), "Predicted": F.lit("y")})
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.classify(docs, model)
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "predicted", "score"] and got.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in got.collect())
    assert quality_classifier.classify(docs.limit(0), model).count() == 0
    assert quality_classifier.train(docs, labels, max_bytes=0).scores([quality_classifier.features(b"x")])[0] == 0.5
    assert quality_classifier.shapes(b"aa11!! " + b"x!" * 30) == [b"a0!", b"a!" * 30]


def test_classifier_learns_and_ignores_the_held_out(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    docs, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        docs.append((k, " ".join(word() + ("" if good else "!!") for _ in range(60))))
        labels.append((k, int(good)))
    d = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(d, quality_classifier.train(d, lab)).collect()}
    assert np.mean([got[k].predicted == y for k, y in labels]) > 0.99 and 0 <= got[900].score <= 1 and got[900].score == got[901].score
    flipped = lab.withColumn("quality", F.when(quality_classifier.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.classify(d, quality_classifier.train(d, flipped)).collect()}
    assert all(again[k] == got[k].score for k in again)
    assert {r.score for r in quality_classifier.classify(d, quality_classifier.train(d, lab.limit(0))).collect()} == {0.5}


def test_licenses(spark):
    texts = [None, "", "MIT License mit license", "x GNU general-public\nlicense y apache license", "cc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "license " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("LABELS", F.lit("x"))
    got = licenses.scan_licenses(df).orderBy("doc_id").collect()
    for r in got:
        words = alnum(r.text)
        places = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    assert licenses.scan_licenses(df.limit(0)).count() == 0
    assert got[3].labels == "apache,gpl" and got[5].labels == "mit" and got[6].labels == "" and got[5].score > 0.6


def brute_licenses(words):
    """Labels and best score by trying every start of every template, and every place of every key phrase."""
    best, places = {}, []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    for label, text, phrases in licenses.TEMPLATES:
        t, keys = alnum(text), [alnum(x) for x in phrases]
        at = [next(k for k in range(len(t)) if t[k : k + len(p)] == p) for p in keys]
        stands = [[k - a for k in range(len(words)) if words[k : k + len(p)] == p] for p, a in zip(keys, at, strict=True)]
        for start in {x for own in stands for x in own}:
            if all(any(abs(x - start) <= licenses.SLACK for x in own) for own in stands):
                near = lambda w, i: any(0 <= j < len(words) and words[j] == w for j in range(max(start - licenses.SLACK, start + i - licenses.SLACK), min(start + len(t) + licenses.SLACK, start + i + licenses.SLACK + 1)))  # noqa: B023, E731
                score = sum(near(w, i) for i, w in enumerate(t)) / len(t)
                if score >= licenses.LEAST_SCORE:
                    best[label] = max(best.get(label, 0), score)
    for _, label in places:
        best[label] = 1.0
    return ",".join(sorted(best)), max(best.values(), default=0.0), len(places)


def test_licenses_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, t, _ in licenses.TEMPLATES for w in alnum(t)})
    texts = []
    for _ in range(300):
        words = []
        for _, t, _ in rng.choices(licenses.TEMPLATES, k=rng.randint(1, 3)):
            own = alnum(t)
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = ["name"] * rng.randint(0, 5)
            words += own + rng.choices(vocabulary, k=rng.randint(0, 12))
        texts.append(" ".join(words))
    texts += ["reserved " * 30_000, "", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = 0
    for r in licenses.scan_licenses(df).collect():
        labels, score, n = brute_licenses(alnum(r.text))
        assert (r.labels, r.n_base) == (labels, n) and abs(r.score - score) < 1e-9
        hits += bool(labels)
    assert hits > 200
