import pytest

from tieout import schemas
from tieout.operators import checks, normalize, rules

BALANCE, INCOME, METRICS, RECONCILIATION = "Consolidated Balance Sheets", "Consolidated Statements of Operations", "Calculations of Key and Other Selected Metrics", "GAAP to Non-GAAP Reconciliations"


def rows(spark, *labels):
    """(page, title, path, label)."""
    data = [("d", page, i, title, list(path), label, {"Q1 2024": 1000.0, "Q2 2024": None}, label) for i, (page, title, path, label) in enumerate(labels)]
    return spark.createDataFrame(data, schemas.RAW_ROWS)


def run(spark, *labels):
    accepted, held = normalize.normalize(rows(spark, *labels), normalize.by_alias(rules.dim_alias(spark)))
    return {r["row_ord"]: (r["statement"], r["canonical_key"]) for r in accepted.collect()}, {r["row_ord"]: r["reason"] for r in held.collect()}


def test_longest_needle_priority_and_footnotes(spark):
    stock = "(1) Includes stock-based compensation expense as follows:"
    got, held = run(
        spark,
        (1, INCOME, [], "Total operating expenses"),
        (1, INCOME, [], "Weighted-average shares used in computing net loss per share attributable to common stockholders, basic and diluted"),
        (1, INCOME, [stock], "Cost of revenue"),
        (1, INCOME, [stock], "Gross profit"),
        (1, INCOME, [], "Cost of revenue"),
    )
    assert got == {0: ("income_statement", "total_operating_expenses"), 1: ("income_statement", "wavg_shares_basic"), 2: ("income_statement", "sbc_cost_of_revenue"), 4: ("income_statement", "cost_of_revenue")}
    assert held == {3: "not mapped"}


def test_closed_sets_rerouting_and_repeats(spark):
    got, held = run(
        spark,
        (1, METRICS, [], "Revenue by region US"),
        (1, METRICS, [], "Net cash provided by operating activities"),
        (1, METRICS, [], "Total headcount"),
        (1, METRICS, [], "Total headcount again"),
        (2, "Letter", [], "Goodwill"),
        (3, RECONCILIATION, [], "Weighted-average shares used in computing net income"),
        (3, RECONCILIATION, [], "Goodwill"),
    )
    assert got == {0: ("segment", "revenue_us"), 2: ("key_metrics", "total_headcount"), 5: ("reconciliation", "wavg_shares_diluted")}
    assert held == {1: "key not allowed", 3: "key repeated", 4: "unknown statement", 6: "not mapped"}


def test_nothing_is_dropped_and_mappings_count_once(spark):
    raw = rows(spark, (1, BALANCE, [], "a"), (1, BALANCE, [], "b"), (1, BALANCE, [], "c"))
    mapping = spark.createDataFrame([("d", 1, 0, "goodwill", "thousands_usd", 1.0, "m"), ("d", 1, 0, "total_assets", "thousands_usd", 1.0, "m"), ("d", 1, 1, "no_such", "count", 1.0, "m"), ("d", 1, 99, "goodwill", "count", 1.0, "m")], "doc_id string, page int, row_ord int, canonical_key string, unit string, confidence double, method string")
    accepted, held = normalize.normalize(raw, normalize.by_mapping(mapping))
    assert [(r["row_ord"], r["canonical_key"]) for r in accepted.collect()] == [(0, "goodwill")]
    assert {r["row_ord"]: r["reason"] for r in held.collect()} == {1: "key not allowed", 2: "not mapped"}


def test_line_items_keep_nil_and_first_value_is_null_preserving(spark):
    from pyspark.sql import functions as F

    accepted, held = normalize.normalize(rows(spark, (1, BALANCE, [], "Goodwill")), normalize.by_alias(rules.dim_alias(spark)))
    items = normalize.line_items(accepted, F.lit("C"), F.lit("T"), F.lit("f"))
    assert {f.name: f.dataType for f in items.schema} == {f.name: f.dataType for f in schemas.schema(schemas.LINE_ITEMS)}
    got = {r["period"]: r for r in items.collect()}
    assert got["Q2 2024"]["value"] is None and got["Q1 2024"]["period_sort"] == 20241
    assert normalize.quarantine_rows(held, F.lit("C")).count() == 0
    pairs = spark.createDataFrame([("k", 1, None), ("k", 2, 5.0), ("j", 1, 3.0)], "k string, o int, value double")
    assert {r["k"]: r["value"] for r in normalize.first_value(pairs, ["k"], "o").collect()} == {"k": None, "j": 3.0}


def test_requests_hash_everything(spark):
    a = normalize.requests(rows(spark, (1, BALANCE, [], "Goodwill"))).first()
    b = normalize.requests(rows(spark, (1, BALANCE, ["Assets"], "Goodwill"))).first()
    assert a["request_hash"] != b["request_hash"] and a["lines"][0]["samples"] == [1000.0]


@pytest.mark.parametrize("statement, n", [("income_statement", 31), ("balance_sheet", 34), ("cash_flow", 43), ("key_metrics", 12), ("segment", 8), ("reconciliation", 32)])
def test_key_counts(statement, n):
    assert len(set(schemas.KEYS[statement])) == n


def test_compare_keys_on_rows(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "z")], "page int, row_ord int, canonical_key string")
    b = spark.createDataFrame([(1, 0, "x"), (1, 1, "w"), (1, 3, "v")], "page int, row_ord int, canonical_key string")
    compared = checks.compare_normalizers(a, b, ["page", "row_ord"])
    assert {r["verdict"]: r["n"] for r in checks.comparison_report(compared).collect()} == {"agree": 1, "disagree": 1, "left_only": 1, "right_only": 1}
