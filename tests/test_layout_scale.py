"""Layout of long pages: the work grows with the lines, and no item is cut off."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from tieout.operators import layout

KNOWN = "doc_id string, page int, row_no int, label string, raw_text string, x0 double, values map<string, double>, section_title string, source_line string"


def stacked(rows):
    """The rule itself: a heading stays above while no later one stands as far left."""
    above, made = [], []
    for row_no, x0, is_heading in rows:
        if is_heading:
            above = [h for h in above if h[0] < x0] + [(x0, f"H{row_no}")]
        made.append([t for _, t in above])
    return made


def test_headings_against_the_rule(spark):
    rng = random.Random(3)
    pages = {(d, p): [(i, float(rng.randint(1, 6)), rng.random() < 0.6) for i in range(300)] for d in "ab" for p in (1, 2)}
    rows = [(d, p, i, f"H{i}" if h else f"I{i}", f"H{i}:" if h else f"I{i}", x, None if h else {"Q": 1.0}, "t", "s") for (d, p), page in pages.items() for i, x, h in page]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = layout.roles(spark.createDataFrame(rows, KNOWN)).orderBy("doc_id", "page", "row_no").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["section_path"] for r in got] == [p for key in sorted(pages) for p in stacked(pages[key])]


def test_no_frame_is_read_again_for_each_line(spark):
    plan = layout.roles(spark.createDataFrame([], KNOWN))._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("name, items", [("q45_layout_cases", 17_000), ("q22_layout_wraps", 34_000)])
def test_a_page_beyond_a_million_points(spark, tmp_path, name, items):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT k AS p_partkey, 'a ring' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 3::INT AS p_size, 900.0::DOUBLE AS p_retailprice FROM range({items}) t(k)")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    made = entry.queries()[name](spark, str(tmp_path))
    made.write.parquet(f"{tmp_path}/out")
    columns = ", ".join(made.columns)
    con.execute(f"CREATE TABLE got AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    con.execute(f"CREATE TABLE want AS SELECT {columns} FROM ({entry.oracle_sql()[name]}) s")
    counts = [con.execute(f"SELECT count(*) FROM ({q})").fetchone()[0] for q in ("FROM got", "FROM want", "FROM got EXCEPT ALL FROM want")]
    assert counts[0] == counts[1] > items - 1 and counts[2] == 0


def test_a_page_is_told_its_rows_as_its_words_pass(spark):
    rng = random.Random(6)
    pages = {(d, p): [rng.randint(0, 900) / 10 for _ in range(200)] for d in "ab" for p in (1, 2)}
    rows = [(d, p, k, top) for (d, p), tops in pages.items() for k, top in enumerate(tops)]
    rng.shuffle(rows)
    words = spark.createDataFrame(rows, "doc_id string, page int, word_seq int, top double")
    assert "collect_list" not in layout.cluster(words)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = layout.cluster(words).orderBy("doc_id", "page", "word_seq").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["bucket"] for r in got] == [b for key in sorted(pages) for b in layout.buckets(pages[key], 5.0)]
