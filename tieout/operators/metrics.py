"""Facts and the metrics over them, from one registry that also gives their lineage.

A fact is an aggregate over line items of one entity and period; a metric is an expression over facts and over facts some
rows back. Both name the keys they come from, so columns and lineage cannot drift apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.functions.text import nil_to_zero, ratio, round_half_away


@dataclass(frozen=True)
class Fact:
    """The largest value of keys, or the sum of such values where a missing part counts as zero."""

    name: str
    keys: tuple[str, ...]
    statement: str | None = None
    composite: bool = False


# Facts as name = keys [of a statement]; several keys are added.
FACTS_TEXT = """
revenue = revenue of income_statement
cost_of_revenue = cost_of_revenue of income_statement
gaap_operating_income = operating_income_loss of income_statement
non_gaap_operating_income = operating_income_loss of income_statement_non_gaap
net_income = net_income_loss of income_statement
total_assets = total_assets
total_liabilities = total_liabilities
total_equity = total_stockholders_equity
apic = additional_paid_in_capital
accumulated_deficit = accumulated_deficit
aoci = accumulated_oci
total_debt = convertible_notes_current + convertible_notes_noncurrent
deferred_revenue = deferred_revenue_current + deferred_revenue_noncurrent
cash_and_investments = cash_and_equivalents + available_for_sale_securities
sbc_cash_flow = stock_based_compensation
option_proceeds = proceeds_from_option_exercises
free_cash_flow = free_cash_flow
"""
# End of fixed values.


def parse_facts(text: str) -> list[Fact]:
    facts = []
    for line in text.strip().splitlines():
        name, _, rest = line.partition(" = ")
        keys, _, statement = rest.partition(" of ")
        parts = tuple(keys.split(" + "))
        facts.append(Fact(name, parts, statement or None, len(parts) > 1))
    return facts


FACTS = parse_facts(FACTS_TEXT)


def facts(items: DataFrame, entity: list[str], registry: list[Fact] = FACTS) -> DataFrame:
    """AG1: one row for each entity and period, by conditional maxima in one aggregate."""

    def largest(key: str, statement: str | None) -> Column:
        hit = F.col("canonical_key") == key
        return F.max(F.when(hit & (F.col("statement") == statement) if statement else hit, F.col("value")))

    def made(fact: Fact) -> Column:
        parts = [largest(k, fact.statement) for k in fact.keys]
        return sum((nil_to_zero(p) for p in parts[1:]), nil_to_zero(parts[0])) if fact.composite else parts[0]

    reported = [F.coalesce(*[largest(k, f.statement) for k in f.keys]).isNotNull().alias(f"{f.name}_reported") for f in registry if f.composite]
    return items.groupBy(*entity, "period", "period_sort").agg(*[made(f).alias(f.name) for f in registry], *reported)


@dataclass(frozen=True)
class Metric:
    """view.name: a SQL expression over facts, where prev(x) and year(x) are x one and four rows back."""

    view: str
    name: str
    expression: str
    round_to: int | None = None
    #: A ratio is (expression) over this, null over zero.
    over: str | None = None
    percent: bool = False


# What each column of the two views is.
METRICS = [
    Metric("funding_mix", "delta_assets", "total_assets - prev(total_assets)"),
    Metric("funding_mix", "delta_debt", "total_debt - prev(total_debt)"),
    Metric("funding_mix", "delta_deferred_revenue", "deferred_revenue - prev(deferred_revenue)"),
    Metric("funding_mix", "delta_apic", "apic - prev(apic)"),
    Metric("funding_mix", "retained_earnings_change", "net_income"),
    Metric("funding_mix", "delta_aoci", "aoci - prev(aoci)"),
    Metric("funding_mix", "pct_debt_funded", "total_debt - prev(total_debt)", 1, "total_assets - prev(total_assets)", True),
    Metric("funding_mix", "pct_equity_funded", "apic - prev(apic)", 1, "total_assets - prev(total_assets)", True),
    Metric("funding_mix", "pct_customer_funded", "deferred_revenue - prev(deferred_revenue)", 1, "total_assets - prev(total_assets)", True),
    Metric("growth_efficiency", "asset_turnover", "4 * revenue", 3, "total_assets"),
    Metric("growth_efficiency", "asset_turnover_ex_cash", "4 * revenue", 3, "total_assets - cash_and_investments"),
    Metric("growth_efficiency", "revenue_growth_yoy_pct", "revenue - year(revenue)", 1, "year(revenue)", True),
    Metric("growth_efficiency", "asset_growth_yoy_pct", "total_assets - year(total_assets)", 1, "year(total_assets)", True),
    Metric("growth_efficiency", "incremental_op_margin_pct", "non_gaap_operating_income - year(non_gaap_operating_income)", 1, "revenue - year(revenue)", True),
    Metric("growth_efficiency", "current_op_margin_pct", "non_gaap_operating_income", 1, "revenue", True),
    Metric("growth_efficiency", "gaap_gross_margin_pct", "revenue - cost_of_revenue", 1, "revenue", True),
    Metric("growth_efficiency", "sbc_pct_of_revenue", "sbc_cash_flow", 1, "revenue", True),
]
# End of fixed values.

STEPS = {"prev": 1, "year": 4}


def names_in(expression: str) -> set[str]:
    """Facts, and view.name of other metrics."""
    return set(re.findall(r"[A-Za-z_][\w.]*", expression)) - set(STEPS)


def metric_view(table: DataFrame, entity: list[str], view: str, metrics: list[Metric] = METRICS, calendar: bool = False) -> DataFrame:
    """WN1-WN3: the columns of one view. Rows back are rows of the same entity; with calendar they are quarters, and a gap
    gives null."""
    own = [m for m in metrics if m.view == view]
    used = sorted(set().union(*[names_in(m.expression) | names_in(m.over or "") for m in own]))
    by_time = Window.partitionBy(*entity).orderBy("period_sort")
    quarter = F.floor(F.col("period_sort") / 10) * 4 + F.col("period_sort") % 10
    backs = {}
    for step, n in STEPS.items():
        for c in used:
            if any(f"{step}({c})" in text for m in own for text in (m.expression, m.over or "")):
                before = F.lag(c, n).over(by_time)
                if calendar:
                    before = F.max(F.col(c)).over(Window.partitionBy(*entity).orderBy(quarter).rangeBetween(-n, -n))
                backs[f"_{step}_{c}"] = before
    wide = table.withColumns(backs)

    def made(text: str) -> Column:
        for step in STEPS:
            for c in used:
                text = text.replace(f"{step}({c})", f"_{step}_{c}")
        return F.expr(text)

    def column(m: Metric) -> Column:
        value = made(m.expression)
        if m.over:
            value = ratio((100 * value if m.percent else value).cast("double"), made(m.over).cast("double"))
        return (round_half_away(value, m.round_to) if m.round_to is not None else value).alias(m.name)

    return wide.select(*entity, "period", "period_sort", *[column(m) for m in own])


def sources_of(metric: Metric) -> set[str]:
    return names_in(metric.expression) | names_in(metric.over or "")


def all_views(table: DataFrame, entity: list[str], metrics: list[Metric] = METRICS, calendar: bool = False) -> dict[str, DataFrame]:
    """facts and every view over it, by name; a view may be over metrics of other views, to any depth, as view.name.

    A view waits for those that it names; views that wait for each other are an error.
    """
    made = {"facts": table}
    ids = [*entity, "period", "period_sort"]
    waiting = {m.view: {n.split(".")[0] for o in metrics if o.view == m.view for n in sources_of(o) if "." in n} for m in metrics}
    while waiting:
        ready = [v for v, needs in waiting.items() if needs <= set(made)]
        if not ready:
            raise ValueError(f"views that wait for each other, or for none: {sorted(waiting)}")
        for view in ready:
            own = [m for m in metrics if m.view == view]
            plain = lambda text: re.sub(r"(?<=\w)\.(?=[A-Za-z_])", "__", text) if text else text
            used = sorted({n for m in own for n in sources_of(m) if "." in n})
            wide = reduce(
                lambda left, v: left.join(made[v].select(*ids, *[F.col(n.split(".")[1]).alias(plain(n)) for n in used if n.split(".")[0] == v]), ids, "left"),
                sorted(waiting[view]),
                table,
            )
            made[view] = metric_view(wide, entity, view, [replace(m, expression=plain(m.expression), over=plain(m.over)) for m in own], calendar)
            del waiting[view]
    return made


def edges(registry: list[Fact] = FACTS, metrics: list[Metric] = METRICS) -> list[tuple[str, str, str]]:
    """(view, column, source) of what each column is made of at first hand: keys for facts, view.name for metrics."""
    facts_of = {f.name for f in registry}
    rows = [("facts", f.name, k) for f in registry for k in f.keys]
    for m in metrics:
        unknown = [n for n in sources_of(m) if "." not in n and n not in facts_of]
        if unknown:
            raise ValueError(f"{m.view}.{m.name} names no fact: {unknown}")
        rows += [(m.view, m.name, n if "." in n else f"facts.{n}") for n in sorted(sources_of(m))]
    return rows


#: Levels of metrics over metrics.
MOST_LEVELS = 100
CLOSURE = """
WITH RECURSIVE up(view, column, source, level) MAX RECURSION LEVEL {most} AS (
  SELECT view, column, source, 1 FROM {edges}
  UNION ALL SELECT u.view, u.column, e.source, u.level + 1 FROM up u JOIN {edges} e ON u.source = concat(e.view, '.', e.column)
)
SELECT view, column, source AS canonical_key, min(level) AS level FROM up WHERE NOT contains(source, '.') GROUP BY view, column, source
"""


def deep_lineage(spark: SparkSession, registry: list[Fact] = FACTS, metrics: list[Metric] = METRICS) -> DataFrame:
    """(view, column, canonical_key, level) of every key that a column comes from, through metrics over metrics, and how many
    steps away it first stands. A circle ends with Spark's error about levels."""
    own = spark.createDataFrame(edges(registry, metrics), "view string, column string, source string")
    return spark.sql(CLOSURE.replace("{most}", str(MOST_LEVELS)), edges=own)


def lineage(spark: SparkSession, registry: list[Fact] = FACTS, metrics: list[Metric] = METRICS) -> DataFrame:
    """(view, column, canonical_key) of every column of facts and of the metric views."""
    return deep_lineage(spark, registry, metrics).drop("level")


def lineage_rows(registry: list[Fact] = FACTS, metrics: list[Metric] = METRICS) -> list[tuple[str, str, str]]:
    """The same of the registry alone."""
    direct: dict[str, list[str]] = {}
    for view, column, source in edges(registry, metrics):
        direct.setdefault(f"{view}.{column}", []).append(source)

    def keys(name: str) -> set[str]:
        return set().union(*[keys(s) if "." in s else {s} for s in direct.get(name, ())])

    return [(*name.split("."), k) for name in direct for k in sorted(keys(name))]


def dependents_of(table: DataFrame, key: Column | str) -> DataFrame:
    """Columns that depend on a key, as view.column, sorted."""
    return table.where(F.col("canonical_key") == key).select(F.concat_ws(".", "view", "column").alias("dependent")).distinct().orderBy("dependent")


def create_views(items: DataFrame, entity: list[str]) -> None:
    """SNK4: temporary views facts, funding_mix and growth_efficiency; facts is shared by both."""
    table = facts(items, entity)
    items.createOrReplaceTempView("line_items")
    table.createOrReplaceTempView("facts")
    for view in ("funding_mix", "growth_efficiency"):
        metric_view(table, entity, view).createOrReplaceTempView(view)


def chart_span(funding: DataFrame, positive: list[str], total: str) -> DataFrame:
    """AG8: the longest bar: stacked gains, stacked losses or the total."""
    gains = sum((F.greatest(nil_to_zero(F.col(c)), F.lit(0.0)) for c in positive[1:]), F.greatest(nil_to_zero(F.col(positive[0])), F.lit(0.0)))
    losses = sum((F.least(nil_to_zero(F.col(c)), F.lit(0.0)) for c in positive[1:]), F.least(nil_to_zero(F.col(positive[0])), F.lit(0.0)))
    return funding.where(F.col(total).isNotNull()).agg(F.max(F.greatest(gains, F.abs(losses), F.abs(F.col(total)))).alias("span"))
