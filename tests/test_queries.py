"""Every query with SQL beside it gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import registry
from millrace.session import TABLES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    return int(x) if isinstance(x, bool) else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in values), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize(
    ("policy", "want"), [("greedy", [0, 1, 0, 1, 2]), ("best_fit", [1, 0, 1, 0, 2]), ("long_context", [1, 0, 1, 0, 2])]
)
def test_bins(policy, want):
    from millrace.plans.packing import fill

    assert fill([5, 8, 4, 2, 3], policy, 10) == want


@pytest.mark.parametrize("policy", ["greedy", "best_fit", "structure", "long_context"])
def test_policies_place_whole_documents(spark, policy):
    """Each document's tokens are placed once, but for a tail under 16 tokens."""
    from millrace.plans.packing import items

    size = {r.doc_id: r.n for r in items(spark, SF).collect()}
    spans = {}
    for r in registry.QUERIES[f"pack_{policy}"](spark, SF).collect():
        assert not r.truncated
        spans.setdefault(r.doc_id, []).append((r.off, r.off + r.tokens))
    assert any(n > 256 for n in size.values()) and spans.keys() == size.keys()
    for i, n in size.items():
        own = sorted(spans[i])
        assert own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:])) and (own[-1][1] == n or n > 256 and 0 < n - own[-1][1] < 16)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
