"""Every query against its SQL, on the smallest test tables."""

import difflib
import os
import random

import duckdb
import pytest

from tieout.operators import trace
from tieout.plans import oracle, parts, queries

DATA = "/root/testdata/sf0.001"
QUERIES = queries.queries() | parts.queries()
SQL = oracle.oracle_sql() | parts.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(value):
    return None if value is None else f"{value:.10g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in SQL])
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(shown(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert got or name == "q06b_skipped_checks"


def suggested(spark, unknown, known, **kw):
    rows = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    found = {}
    for r in sorted(trace.suggestions(rows(unknown), rows(known), **kw).collect(), key=lambda r: r["nth"]):
        found.setdefault(r["key"], []).append(r["suggestion"])
    return found


@pytest.mark.parametrize("sent", [trace.SENT_LETTERS, 0])
def test_suggestions_are_those_of_the_standard_library(spark, monkeypatch, sent):
    monkeypatch.setattr(trace, "SENT_LETTERS", sent)
    rng = random.Random(3)
    known = sorted({k for _, k, _ in parts.allowed_keys()}) + ["aab", "aba", "baa", "x" * 300, "é"]
    unknown = [k.replace("e", "") for k in known] + ["".join(rng.choice("aeinorst_") for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["x" * 250 + "y"]
    want = {k: difflib.get_close_matches(k, known, 6, 0.4) for k in unknown}
    assert suggested(spark, [*unknown, unknown[0], None], known) == {k: v for k, v in want.items() if v}
    want = {k: difflib.get_close_matches(k, known, 2, 0.7) for k in unknown}
    assert suggested(spark, unknown, known, n=2, cutoff=0.7) == {k: v for k, v in want.items() if v}
    assert suggested(spark, [], known) == suggested(spark, unknown, []) == {}
