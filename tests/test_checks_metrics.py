import pytest

from tieout.operators import checks, metrics, trace
from tieout.sources.writers import exit_code

PERIODS = [(f"Q{q} {y}", y * 10 + q) for y in (2024, 2025) for q in (1, 2, 3, 4)]


def filing():
    """(key, statement, period, sort, value) of a company whose identities all hold."""
    rows = []
    retained = 1000.0
    for i, (period, sort) in enumerate(PERIODS):
        revenue, cost = 1000.0 + 50 * i, 300.0 + 7 * i
        v = {"revenue": revenue, "cost_of_revenue": cost, "gross_profit": revenue - cost, "sales_and_marketing": 200.0, "research_and_development": 150.0, "general_and_administrative": 90.0}
        v["total_operating_expenses"] = 440.0
        v["operating_income_loss"] = v["gross_profit"] - 440
        v["total_non_operating_income_net"] = 12.0
        v["pretax_income_loss"] = v["operating_income_loss"] + 12
        v["income_tax_provision"] = 20.0
        v["net_income_loss"] = v["pretax_income_loss"] - 20
        retained += v["net_income_loss"]
        v |= {f"sbc_{k}": 10.0 for k in ("cost_of_revenue", "sales_and_marketing", "research_and_development", "general_and_administrative")} | {"sbc_total": 40.0}
        v |= {"accumulated_deficit": retained, "total_stockholders_equity": retained + 500, "total_liabilities": 2000.0 + 30 * i}
        v["total_assets"] = v["total_liabilities"] + v["total_stockholders_equity"]
        v["total_liabilities_and_equity"] = v["total_assets"]
        v |= {"net_cash_from_operating": 100.0, "net_cash_from_investing": -60.0, "net_cash_from_financing": 5.0, "net_change_in_cash": 45.0, "cash_beginning_of_period": 10.0, "cash_end_of_period": 55.0}
        v |= {"purchases_of_ppe": -20.0, "capitalized_internal_use_software": -5.0, "free_cash_flow": 75.0}
        v |= {"revenue_us": revenue - 60, "revenue_emea": 30.0, "revenue_apac": 20.0, "revenue_other": 10.0, "revenue_channel_partners": 100.0, "revenue_direct_customers": revenue - 100}
        rows += [("C", k, "income_statement", period, sort, x, 1) for k, x in v.items()]
    return rows


DDL = "company string, canonical_key string, statement string, period string, period_sort int, value double, ord int"


def run(spark, rows, **kw):
    return checks.run_checks(spark.createDataFrame(rows, DDL), ["company"], "ord", **kw)


def test_all_families_pass(spark):
    got = run(spark, filing()).collect()
    assert len(got) == 13 * 8 + 2 * 7 == 118
    assert all(r["passed"] for r in got) and len({r["name"] for r in got}) == 15
    assert exit_code(run(spark, filing()), strict=True) == 0


def test_one_wrong_cell_fails_the_checks_that_read_it(spark):
    rows = [r[:5] + (r[5] + 2, 1) if r[1] == "gross_profit" and r[4] == 20243 else r for r in filing()]
    results = run(spark, rows)
    failed = {(r["name"], r["period_sort"]) for r in results.where("not passed").collect()}
    assert failed == {("gross_profit", 20243), ("operating_result", 20243)}
    assert exit_code(results, strict=True) == 1 and exit_code(results, strict=False) == 0
    total = {r["name"]: r for r in checks.summarize(results).collect()}[None]
    assert (total["n_passed"], total["n_failed"], total["n_checks"]) == (116, 2, 118)


def test_within_tolerance_passes_and_missing_skips(spark):
    rows = [r[:5] + (r[5] + 1.5, 1) if r[1] == "total_liabilities_and_equity" and r[4] == 20241 else r for r in filing()]
    assert run(spark, rows).where("not passed").isEmpty()
    without = [r for r in filing() if (r[1], r[4]) != ("revenue_emea", 20252)]
    nil = [r[:5] + (None, 1) if (r[1], r[4]) == ("sbc_total", 20251) else r for r in without]
    got = run(spark, nil)
    assert got.count() == 116
    skipped = run(spark, nil, skipped=True).where("passed is null").collect()
    assert {(r["name"], r["period_sort"]) for r in skipped} == {("revenue_by_region_foots", 20252), ("sbc_components_foot", 20251)}


def test_entities_do_not_blend(spark):
    other = [("D", *r[1:5], r[5] * 3 if r[5] is not None else None, 1) for r in filing()]
    got = run(spark, filing() + other)
    assert got.count() == 236 and got.where("not passed").isEmpty()
    view = metrics.metric_view(metrics.facts(spark.createDataFrame(filing() + other, DDL), ["company"]), ["company"], "funding_mix")
    assert view.where("delta_assets is null").count() == 2


def test_views_by_hand(spark):
    items = spark.createDataFrame([("C", "revenue", "income_statement", p, s, 100.0 + 10 * i, 1) for i, (p, s) in enumerate(PERIODS)] + [("C", "total_assets", "balance_sheet", p, s, 1000.0 + 100 * i, 1) for i, (p, s) in enumerate(PERIODS)], DDL)
    facts = metrics.facts(items, ["company"])
    growth = {r["period_sort"]: r for r in metrics.metric_view(facts, ["company"], "growth_efficiency").collect()}
    assert growth[20241]["asset_turnover"] == 0.4 and growth[20241]["revenue_growth_yoy_pct"] is None
    assert growth[20251]["revenue_growth_yoy_pct"] == 40.0 and growth[20251]["asset_growth_yoy_pct"] == 40.0
    assert growth[20251]["asset_turnover_ex_cash"] == 0.4 and growth[20251]["sbc_pct_of_revenue"] is None
    row = facts.first()
    assert row["total_debt"] == 0.0 and row["total_debt_reported"] is False


def test_rows_back_and_quarters_back(spark):
    gap = [r for r in [("C", "revenue", "income_statement", p, s, 100.0 + 10 * i, 1) for i, (p, s) in enumerate(PERIODS)] if r[4] != 20242]
    facts = metrics.facts(spark.createDataFrame(gap, DDL), ["company"])
    by_row = {r["period_sort"]: r["revenue_growth_yoy_pct"] for r in metrics.metric_view(facts, ["company"], "growth_efficiency").collect()}
    by_quarter = {r["period_sort"]: r["revenue_growth_yoy_pct"] for r in metrics.metric_view(facts, ["company"], "growth_efficiency", calendar=True).collect()}
    assert by_row[20252] == 50.0 and by_quarter[20252] is None and by_quarter[20253] == 33.3


def test_every_column_has_lineage_and_the_other_way_round(spark):
    facts = metrics.facts(spark.createDataFrame(filing(), DDL), ["company"])
    views = {"facts": facts} | {v: metrics.metric_view(facts, ["company"], v) for v in ("funding_mix", "growth_efficiency")}
    have = {(v, c) for v, df in views.items() for c in df.columns if c not in ("company", "period", "period_sort") and not c.endswith("_reported")}
    assert have == {(v, c) for v, c, _ in metrics.lineage_rows()}
    deps = [r["dependent"] for r in metrics.dependents_of(metrics.lineage(spark), "proceeds_from_option_exercises").collect()]
    assert deps == ["facts.option_proceeds"]
    fed = trace.dependents(metrics.lineage(spark), views, ["company"], "additional_paid_in_capital")
    assert {(r["view"], r["column"]) for r in fed.collect()} == {("facts", "apic"), ("funding_mix", "delta_apic"), ("funding_mix", "pct_equity_funded")}


def test_chart_span(spark):
    view = spark.createDataFrame([(5.0, -7.0, 3.0), (10.0, 20.0, None), (1.0, None, -9.0)], "a double, b double, t double")
    assert metrics.chart_span(view, ["a", "b"], "t").first()["span"] == 9.0


def test_metrics_over_metrics_trace_to_their_keys(spark):
    chain = [metrics.Metric("v0", "m", "revenue - prev(apic)")] + [metrics.Metric(f"v{i}", "m", f"v{i - 1}.m + total_assets") for i in range(1, 8)]
    rows = {(r["view"], r["canonical_key"]): r["level"] for r in metrics.deep_lineage(spark, metrics=chain).where("column = 'm'").collect()}
    assert {k for v, k in rows if v == "v7"} == {"revenue", "additional_paid_in_capital", "total_assets"}
    assert rows["v7", "revenue"] == 9 and rows["v7", "total_assets"] == 2
    assert {(v, c, k) for v, c, k in metrics.lineage_rows(metrics=chain)} == {tuple(r) for r in metrics.lineage(spark, metrics=chain).collect()}
    table = spark.createDataFrame([("c", f"Q{q} 2024", 20240 + q, 10.0 * q, 1.0 * q, 100.0) for q in (1, 2, 3)], "company string, period string, period_sort int, revenue double, apic double, total_assets double")
    views = metrics.all_views(table, ["company"], chain)
    assert [r["m"] for r in views["v7"].orderBy("period_sort").collect()] == [None, 20.0 - 1 + 700, 30.0 - 2 + 700]


def test_circles_and_unknown_names_are_errors(spark):
    circle = [metrics.Metric("a", "x", "b.y"), metrics.Metric("b", "y", "a.x")]
    with pytest.raises(ValueError, match="wait"):
        metrics.all_views(spark.range(0), [], circle)
    with pytest.raises(Exception, match="(?i)recursion"):
        metrics.deep_lineage(spark, metrics=circle).collect()
    with pytest.raises(ValueError, match="no fact"):
        metrics.edges(metrics=[metrics.Metric("a", "x", "nothing + revenue")])
