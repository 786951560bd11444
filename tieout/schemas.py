"""Tables, closed sets and their dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

WORDS = "doc_id string, page int, word_seq int, text string, x0 double, x1 double, top double, page_height double"
RAW_ROWS = (
    "doc_id string, page int, row_ord int, section_title string, section_path array<string>, raw_label string, "
    "values map<string,double>, source_line string"
)
LINE_ITEMS = (
    "company string, ticker string, source_file string, statement string, canonical_key string, label string, "
    "period string, period_sort int, value double, unit string, page int, source_line string, confidence double, method string"
)
QUARANTINE = "company string, page int, section string, raw_label string, source_line string, reason string, row_ord int"
GENERAL_LEDGER = "gl_date date, amount decimal(18,2), main_memo string, line_memo string"
BANK = "posted_date date, posted_amount decimal(18,2), messy_memo string"
#: Longest memos.
MEMO_LENGTHS = {"main_memo": 100, "line_memo": 150, "messy_memo": 250}

# Statements, units and the closed set of keys of each statement.
STATEMENTS = (
    "income_statement income_statement_non_gaap balance_sheet cash_flow reconciliation key_metrics segment"
).split()
UNITS = "thousands_usd millions_usd usd_per_share thousands_shares percent count".split()
INCOME_KEYS = """
revenue cost_of_revenue gross_profit sales_and_marketing research_and_development general_and_administrative
total_operating_expenses operating_income_loss interest_income interest_expense other_income_expense_net
total_non_operating_income_net pretax_income_loss income_tax_provision net_income_loss eps_basic eps_diluted
wavg_shares_basic wavg_shares_diluted sbc_cost_of_revenue sbc_sales_and_marketing sbc_research_and_development
sbc_general_and_administrative sbc_total intangible_amortization_total acquisition_related_expenses
lease_impairment_charges legal_reserve_and_settlements debt_issuance_cost_amortization
intangible_amortization_cost_of_revenue intangible_amortization_sales_and_marketing
""".split()
BALANCE_KEYS = """
cash_and_equivalents available_for_sale_securities accounts_receivable_net contract_assets restricted_cash_current
prepaid_and_other_current_assets total_current_assets property_and_equipment_net goodwill acquired_intangibles_net
operating_lease_rou_assets deferred_contract_acquisition_costs_noncurrent restricted_cash_noncurrent
other_noncurrent_assets total_assets accounts_payable accrued_expenses_and_other_current_liabilities
accrued_compensation operating_lease_liabilities_current deferred_revenue_current convertible_notes_current
total_current_liabilities convertible_notes_noncurrent operating_lease_liabilities_noncurrent
deferred_revenue_noncurrent other_noncurrent_liabilities total_liabilities common_stock_class_a common_stock_class_b
additional_paid_in_capital accumulated_deficit accumulated_oci total_stockholders_equity total_liabilities_and_equity
""".split()
CASH_FLOW_KEYS = """
cf_net_income_loss depreciation_and_amortization non_cash_operating_lease_costs
amortization_of_deferred_contract_costs stock_based_compensation amortization_of_debt_issuance_costs
accretion_discounts_afs deferred_income_taxes provision_for_bad_debt other_operating_adjustments
chg_accounts_receivable chg_contract_assets chg_deferred_contract_costs chg_prepaid_and_other_current
chg_other_noncurrent_assets chg_accounts_payable chg_accrued_expenses chg_accrued_compensation
chg_operating_lease_liabilities chg_deferred_revenue chg_other_noncurrent_liabilities net_cash_from_operating
purchases_of_ppe capitalized_internal_use_software acquisitions_net_of_cash purchases_of_afs_securities
maturities_of_afs_securities other_investing net_cash_from_investing proceeds_capped_call_settlement
proceeds_convertible_notes purchases_of_capped_calls debt_issuance_costs_paid credit_facility_issuance_costs
proceeds_from_option_exercises proceeds_from_early_option_exercises proceeds_from_espp taxes_paid_on_rsu_settlement
payment_of_indemnity_holdback net_cash_from_financing net_change_in_cash cash_beginning_of_period cash_end_of_period
""".split()
METRIC_KEYS = """
free_cash_flow free_cash_flow_margin ocf_pct_of_revenue ppe_pct_of_revenue capsw_pct_of_revenue
paying_customers_over_100k customers_over_100k_yy_growth customers_over_100k_pct_of_revenue
dollar_based_net_retention remaining_performance_obligations current_rpo_pct_of_total total_headcount
""".split()
SEGMENT_KEYS = """
revenue_us revenue_emea revenue_apac revenue_other revenue_channel_partners revenue_direct_customers
revenue_total_by_region revenue_total_by_customer_type
""".split()
ADJUSTMENT_KEY = "non_gaap_adjustment"
# End of fixed values.

KEYS = {
    "income_statement": INCOME_KEYS,
    "income_statement_non_gaap": INCOME_KEYS,
    "balance_sheet": BALANCE_KEYS,
    "cash_flow": CASH_FLOW_KEYS,
    "reconciliation": [*INCOME_KEYS, ADJUSTMENT_KEY],
    "key_metrics": METRIC_KEYS,
    "segment": SEGMENT_KEYS,
}


def allowed_keys() -> list[tuple[str, str, str]]:
    """(statement of the page, key, statement it is stored under): pages of key metrics carry segment keys too."""
    own = [(s, k, s) for s, keys in KEYS.items() for k in keys]
    return own + [("key_metrics", k, "segment") for k in SEGMENT_KEYS]


def dim_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(allowed_keys(), "statement string, canonical_key string, stored_statement string")


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
