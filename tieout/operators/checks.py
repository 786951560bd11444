"""Accounting identities as data, evaluated by one join and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.operators.normalize import first_value

#: Largest difference of a check that passes, in the statement's unit.
TOLERANCE = 1.5
# Name: left-hand key = signed right-hand keys; "delta" compares with the period before.
IDENTITIES = """
balance_sheet_balances: total_assets = total_liabilities + total_stockholders_equity
assets_equal_stated_total: total_liabilities_and_equity = total_assets
gross_profit: gross_profit = revenue - cost_of_revenue
total_opex: total_operating_expenses = sales_and_marketing + research_and_development + general_and_administrative
operating_result: operating_income_loss = gross_profit - total_operating_expenses
pretax_result: pretax_income_loss = operating_income_loss + total_non_operating_income_net
net_result: net_income_loss = pretax_income_loss - income_tax_provision
sbc_components_foot: sbc_total = sbc_cost_of_revenue + sbc_sales_and_marketing + sbc_research_and_development + sbc_general_and_administrative
net_change_in_cash: net_change_in_cash = net_cash_from_operating + net_cash_from_investing + net_cash_from_financing
cash_rollforward: cash_end_of_period = cash_beginning_of_period + net_change_in_cash
free_cash_flow: free_cash_flow = net_cash_from_operating + purchases_of_ppe + capitalized_internal_use_software
revenue_by_region_foots: revenue = revenue_us + revenue_emea + revenue_apac + revenue_other
revenue_by_customer_type_foots: revenue = revenue_channel_partners + revenue_direct_customers
clean_surplus: delta accumulated_deficit = net_income_loss
delta_identity: delta total_assets = delta total_liabilities + delta total_stockholders_equity
"""
# End of fixed values.
DIM_CHECKS = "name string, side string, canonical_key string, sign int, delta boolean"


def identity_terms(text: str = IDENTITIES) -> list[tuple[str, str, str, int, bool]]:
    """(name, side, key, sign, delta) of every term."""
    terms = []
    for line in text.strip().splitlines():
        name, _, formula = line.partition(": ")
        left, _, right = formula.partition(" = ")
        for side, part in (("actual", left), ("expected", right)):
            sign, delta = 1, False
            for word in part.split():
                if word in "+-":
                    sign, delta = (1 if word == "+" else -1), False
                elif word == "delta":
                    delta = True
                else:
                    terms.append((name, side, word, sign, delta))
    return terms


def dim_checks(spark: SparkSession, text: str = IDENTITIES) -> DataFrame:
    return spark.createDataFrame(identity_terms(text), DIM_CHECKS)


def run_checks(
    items: DataFrame, entity: list[str], order: str, checks: DataFrame | None = None, tolerance: float = TOLERANCE, skipped: bool = False
) -> DataFrame:
    """Rows (entity, name, period, period_sort, passed, expected, actual, diff).

    A check is skipped, not failed, where a term is missing or nil; with skipped those rows come too, passed being null. Deltas
    are against the entity's previous period. Sums are of decimals, so that the order of rows doesn't matter.
    """
    terms = dim_checks(items.sparkSession) if checks is None else checks
    time = ["period", "period_sort"]
    values = first_value(items, [*entity, "canonical_key", *time], order)
    periods = items.select(*entity, *time).distinct()
    before = Window.partitionBy(*entity).orderBy("period_sort")
    steps = periods.withColumn("_before", F.lag("period_sort").over(before))
    amounts = values.withColumn("_amount", F.col("value").cast("decimal(30,6)")).drop("value")
    previous = amounts.select(*entity, "canonical_key", F.col("period_sort").alias("_before"), F.col("_amount").alias("_last"))
    moved = amounts.join(steps, [*entity, *time]).join(previous, [*entity, "canonical_key", "_before"], "left")
    needed = F.broadcast(terms)
    got = moved.join(needed, "canonical_key").withColumn(
        "_term", F.col("sign") * F.when(F.col("delta"), F.col("_amount") - F.col("_last")).otherwise(F.col("_amount"))
    )
    sizes = terms.groupBy("name").agg(F.count(F.lit(1)).alias("_terms"), F.max("delta").alias("_from_second"))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("_term")))
    summed = got.groupBy(*entity, *time, "name").agg(F.count("_term").alias("_found"), side("expected").alias("_expected"), side("actual").alias("_actual"))
    if skipped:
        all_checks = steps.join(F.broadcast(sizes)).where(~F.col("_from_second") | F.col("_before").isNotNull())
        summed = all_checks.drop("_terms", "_from_second", "_before").join(summed, [*entity, *time, "name"], "left")
    judged = summed.join(F.broadcast(sizes), "name").withColumn("_whole", F.coalesce(F.col("_found") == F.col("_terms"), F.lit(False)))
    if not skipped:
        judged = judged.where("_whole")
    only = lambda c: F.when(F.col("_whole"), F.col(c))
    return judged.select(
        *entity,
        "name",
        *time,
        only("_actual").alias("_a"),
        only("_expected").alias("_e"),
    ).select(
        *entity,
        "name",
        *time,
        (F.abs(F.col("_a") - F.col("_e")) <= F.lit(tolerance)).alias("passed"),
        F.col("_e").cast("double").alias("expected"),
        F.col("_a").cast("double").alias("actual"),
        (F.col("_a") - F.col("_e")).cast("double").alias("diff"),
    )


def summarize(results: DataFrame) -> DataFrame:
    """AG3: passed and failed by check, and in total (name null)."""
    return results.rollup("name").agg(
        F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.count("passed").alias("n_checks")
    )


def compare_normalizers(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left_key, right_key, verdict) by a full outer join; verdict is agree, disagree, left_only or right_only.
    Keys of page and row tell repeated labels apart; keys of page and label give the collapsed view."""
    a = left.select(*keys, F.col("canonical_key").alias("left_key"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col("canonical_key").alias("right_key"), F.lit(True).alias("_r"))
    verdict = (
        F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("left_key") == F.col("right_key"), "agree").otherwise("disagree")
    )
    return a.join(b, keys, "full_outer").withColumn("verdict", verdict).drop("_l", "_r")


def comparison_report(compared: DataFrame) -> DataFrame:
    return compared.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
