import json

import pytest

from tests.test_checks_metrics import DDL, filing
from tests.test_layout import Page
from tieout import schemas
from tieout.operators import layout, metrics
from tieout.sources import readers, writers


def test_views_by_name(spark):
    metrics.create_views(spark.createDataFrame(filing(), DDL), ["company"])
    got = writers.records(spark.sql("SELECT period, delta_assets FROM funding_mix WHERE delta_assets IS NOT NULL ORDER BY period_sort"))
    assert len(got) == 7 and got[0]["period"] == "Q2 2024"
    assert spark.sql("SELECT count(*) AS n FROM facts JOIN growth_efficiency USING (company, period)").first()["n"] == 8


def test_orphan_values_are_told(spark):
    words = spark.createDataFrame(Page().text("Cash", 120).values(120, "1", "2", "3", "4").values(150, "5", "6", "7", "8").words, schemas.WORDS)
    assert [r["source_line"] for r in layout.orphan_values(layout.lines(words, "X")).collect()] == ["5 6 7 8"]


def test_saved_reports_and_company(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"Rows": {"Row": [{"ColData": [{"value": "Cash"}]}]}}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"CompanyName": "Acme", "Country": "X"}, indent=1))
    (row,) = readers.reports_json(spark, str(tmp_path / "r")).collect()
    assert row["report_id"].endswith("a.json") and json.loads(row["body"])["Rows"]
    assert readers.company_json(spark, str(tmp_path / "c.json")).first()["CompanyName"] == "Acme"


def test_pages_come_from_a_parser(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"one two")

    def parser(name, data):
        for k, w in enumerate(data.decode().split()):
            yield {"doc_id": name.rsplit("/", 1)[-1], "page": 1, "word_seq": k, "text": w, "x0": 1.0, "x1": 2.0, "top": 3.0, "page_height": 9.0}

    got = readers.pdf_words(spark, str(tmp_path / "x.pdf"), parser)
    assert got.schema.simpleString() == schemas.schema(schemas.WORDS).simpleString()
    assert [(r["doc_id"], r["word_seq"], r["text"]) for r in got.collect()] == [("x.pdf", 0, "one"), ("x.pdf", 1, "two")]


def test_mappings_append_and_tables_rebuild(spark, tmp_path):
    row = spark.createDataFrame([("h", "goodwill")], "request_hash string, canonical_key string")
    for _ in range(2):
        writers.append_mappings(row, f"{tmp_path}/m")
        writers.rebuild({"t": row, "empty": row.limit(0)}, f"{tmp_path}/db")
    assert readers.mappings_parquet(spark, f"{tmp_path}/m").count() == 2
    assert spark.read.parquet(f"{tmp_path}/db/t").count() == 1 and spark.read.parquet(f"{tmp_path}/db/empty").count() == 0


def test_html_is_escaped_and_reports_are_bounded(spark):
    df = spark.createDataFrame([("<b>", None), ("x", 1.0)], "a string, b double")
    page = writers.html_table(df)
    assert "&lt;b&gt;" in page and "<td></td>" in page
    with pytest.raises(ValueError, match="more than 1 rows"):
        writers.records(df, 1)
