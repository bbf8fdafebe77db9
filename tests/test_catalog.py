"""Every registered query against its SQL over the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from skeinwork.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted((tuple(plain(dict(zip(names, row, strict=True))[c]) for c in cols) for row in found.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=repr)
    assert got == want


def test_greedy_full_is_the_serial_outcome(spark):
    rows = catalog.QUERIES["greedy_match_full"](spark, SF).collect()
    assert len({r.a for r in rows}) == len({r.b for r in rows}) == len(rows)
    parts = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    first = {r.a: r.b for r in rows if r.phase == 1}
    free = sorted(k for k in parts if k % 2 == 0 and k not in set(first.values()))
    want = {}
    for a in sorted(k for k in parts if k % 2 == 1 and k not in first):
        for b in free:
            if b not in want.values() and parts[a].p_brand == parts[b].p_brand and parts[a].p_name.split()[0] == parts[b].p_name.split()[0]:
                want[a] = b
                break
    assert {r.a: r.b for r in rows if r.phase == 2} == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "n_facts"]
    assert set(catalog.SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
