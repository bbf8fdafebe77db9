"""The pipeline over the smallest tables against its stages' own rules and against plain Python."""

import re

import corpus_pipeline
from skeinwork.llm import decontaminate, near_dedup, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == columns
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in at.collect())
    assert 0.6 * docs.count() < len(rows) < docs.count()
    assert decontaminate.decontaminate(at, items).where("contaminated").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert near_dedup.near_duplicates(kept).where("NOT kept").count() == 0
    assert at.where("text RLIKE '[a-z]@[a-z0-9]+[.]example'").count() == 0


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def alnum(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))


def least_of_each_group(texts):
    """Ids that are the least of their near-duplicate group, by all pairs of full shingle sets."""
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in texts if find(k) == k}


def windows(items, size=10):
    return {tuple(w[k : k + size]) for w in map(alnum, items) if w for k in range(max(1, len(w) - size + 1))}


def hits(words, known):
    at = set()
    for n in {len(g) for g in known}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in known:
                at |= set(range(k, k + n))
    return at


def test_pipeline_against_plain_python(spark):
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = windows([r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    good = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    alone = least_of_each_group(good)
    want = {k for k in alone if 2 * len(hits(alnum(good[k]), known)) <= len(alnum(good[k]))}
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(rows) == want
    from skeinwork.llm import bpe

    own = tiktoken.Encoding("own", pat_str=queries.tokenizer_pattern(), mergeable_ranks=bpe.load_ranks(queries.tokenizer_path()), special_tokens={})
    for k, r in rows.items():
        text = own.decode(r.token_ids)
        assert own.encode_ordinary(text) == r.token_ids and len(text) == r.n_chars
        assert not hits(alnum(text.replace("<PII>", " ")), known)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
        if not hits(alnum(good[k]), known) and "<PII>" not in text:
            assert text == good[k]
