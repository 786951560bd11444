"""DuckDB SQL for the queries, written from their meaning and not from their plans."""

from __future__ import annotations

from tieout.operators import rules
from tieout.operators.metrics import lineage_rows
from tieout.plans import tables
from tieout.plans.queries import FIRST_SQL, NUMBER_SQL, ROWS_SQL, TITLES, TOKENS, UNITS, _quoted, alias_rows_sql
from tieout.schemas import KEYS, allowed_keys

duck = tables.duck


def half_away(x: str, n: int) -> str:
    return f"(round({x}, {n}) + 0.0::DOUBLE)"


def percent(x: str, over: str, n: int = 1) -> str:
    return half_away(f"((100 * ({x})) / nullif({over}, 0))", n)


def key(name: str, statement: str | None = None) -> str:
    where = f"canonical_key = '{name}'" + (f" AND statement = '{statement}'" if statement else "")
    return f"MAX(CASE WHEN {where} THEN value END)"


def both(a: str, b: str) -> str:
    return f"coalesce({key(a)}, 0) + coalesce({key(b)}, 0)"


def known(a: str, b: str) -> str:
    return f"count(value) FILTER (canonical_key IN ('{a}', '{b}')) > 0"


FACTS = f"""
SELECT company, period, period_sort,
  {key("revenue", "income_statement")} AS revenue,
  {key("cost_of_revenue", "income_statement")} AS cost_of_revenue,
  {key("operating_income_loss", "income_statement")} AS gaap_operating_income,
  {key("operating_income_loss", "income_statement_non_gaap")} AS non_gaap_operating_income,
  {key("net_income_loss", "income_statement")} AS net_income,
  {key("total_assets")} AS total_assets, {key("total_liabilities")} AS total_liabilities,
  {key("total_stockholders_equity")} AS total_equity, {key("additional_paid_in_capital")} AS apic,
  {key("accumulated_deficit")} AS accumulated_deficit, {key("accumulated_oci")} AS aoci,
  {both("convertible_notes_current", "convertible_notes_noncurrent")} AS total_debt,
  {both("deferred_revenue_current", "deferred_revenue_noncurrent")} AS deferred_revenue,
  {both("cash_and_equivalents", "available_for_sale_securities")} AS cash_and_investments,
  {key("stock_based_compensation")} AS sbc_cash_flow, {key("proceeds_from_option_exercises")} AS option_proceeds,
  {key("free_cash_flow")} AS free_cash_flow,
  {known("convertible_notes_current", "convertible_notes_noncurrent")} AS total_debt_reported,
  {known("deferred_revenue_current", "deferred_revenue_noncurrent")} AS deferred_revenue_reported,
  {known("cash_and_equivalents", "available_for_sale_securities")} AS cash_and_investments_reported
FROM items GROUP BY company, period, period_sort
"""


def with_facts(entity: str = "'All'", joins: str = "") -> str:
    return f"{tables.items_sql(entity, joins)}, facts AS ({FACTS})"


def prev(x: str) -> str:
    return f"({x} - lag({x}) OVER w)"


def year(x: str) -> str:
    return f"lag({x}, 4) OVER w"


FUNDING = f"""
SELECT company, period, period_sort, {prev("total_assets")} AS delta_assets, {prev("total_debt")} AS delta_debt,
  {prev("deferred_revenue")} AS delta_deferred_revenue, {prev("apic")} AS delta_apic, net_income AS retained_earnings_change,
  {prev("aoci")} AS delta_aoci, {percent(prev("total_debt"), prev("total_assets"))} AS pct_debt_funded,
  {percent(prev("apic"), prev("total_assets"))} AS pct_equity_funded,
  {percent(prev("deferred_revenue"), prev("total_assets"))} AS pct_customer_funded
FROM facts WINDOW w AS (PARTITION BY company ORDER BY period_sort)
"""
GROWTH = f"""
SELECT company, period, period_sort, {half_away("(4 * revenue / nullif(total_assets, 0))", 3)} AS asset_turnover,
  {half_away("(4 * revenue / nullif(total_assets - cash_and_investments, 0))", 3)} AS asset_turnover_ex_cash,
  {percent(f"revenue - {year('revenue')}", year("revenue"))} AS revenue_growth_yoy_pct,
  {percent(f"total_assets - {year('total_assets')}", year("total_assets"))} AS asset_growth_yoy_pct,
  {percent(f"non_gaap_operating_income - {year('non_gaap_operating_income')}", f"revenue - {year('revenue')}")} AS incremental_op_margin_pct,
  {percent("non_gaap_operating_income", "revenue")} AS current_op_margin_pct,
  {percent("revenue - cost_of_revenue", "revenue")} AS gaap_gross_margin_pct,
  {percent("sbc_cash_flow", "revenue")} AS sbc_pct_of_revenue
FROM facts WINDOW w AS (PARTITION BY company ORDER BY period_sort)
"""
BROKEN = (
    ", broken AS (SELECT company, period, period_sort, statement, canonical_key, CASE WHEN canonical_key = 'gross_profit' AND period_sort % 10 = 3 THEN value + 2 ELSE value END AS value "
    "FROM items WHERE statement <> 'income_statement_non_gaap'), v AS (PIVOT_PLACEHOLDER)"
)


def pivoted(source: str) -> str:
    """Amounts with six decimals, one column for each key."""
    keys = dict.fromkeys(k for s, k, _ in tables.LINE_ITEM_SPEC if s != "income_statement_non_gaap")
    return f"SELECT company, period, period_sort, {', '.join(f'MAX(CASE WHEN canonical_key = {chr(39)}{k}{chr(39)} THEN CAST(value AS DECIMAL(30,6)) END) AS {k}' for k in keys)} FROM {source} GROUP BY 1, 2, 3"


def check(name: str, actual: str, expected: str) -> str:
    return f"SELECT company, '{name}' AS name, period, period_sort, {actual} AS a, {expected} AS e FROM v"


CHECKED = (
    "SELECT company, name, period, period_sort, abs(a - e) <= 1.5 AS passed, CAST(e AS DOUBLE) AS expected, CAST(a AS DOUBLE) AS actual, CAST(a - e AS DOUBLE) AS diff "
    "FROM c WHERE a IS NOT NULL AND e IS NOT NULL"
)
IDENTITIES = " UNION ALL ".join(
    [
        check("gross_profit", "gross_profit", "revenue - cost_of_revenue"),
        check("total_opex", "total_operating_expenses", "sales_and_marketing + research_and_development + general_and_administrative"),
        check("balance_sheet_balances", "total_assets", "total_liabilities + total_stockholders_equity"),
        check("notes", "convertible_notes_noncurrent", "convertible_notes_current * 2"),
    ]
)
step = lambda k: f"({k} - lag({k}) OVER (PARTITION BY company ORDER BY period_sort))"
DELTAS = " UNION ALL ".join(
    [
        check("clean_surplus", step("accumulated_deficit"), "research_and_development"),
        check("delta_identity", step("total_assets"), f"{step('total_liabilities')} + {step('total_stockholders_equity')}"),
    ]
)


def checked(identities: str, last: str, broken: bool = True) -> str:
    source = BROKEN.replace("PIVOT_PLACEHOLDER", pivoted("broken"))
    if not broken:
        source = f", v AS ({pivoted('(SELECT * FROM items WHERE statement <> ' + chr(39) + 'income_statement_non_gaap' + chr(39) + ')')})"
    return f"{tables.items_sql()}{source}, c AS ({identities}), r AS ({CHECKED}) {last}"


def by_rest(column: str, values: list[str | None]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


def values(rows: list[tuple]) -> str:
    show = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


ALIAS = f"""
WITH x AS (SELECT p_partkey, lower(trim(label)) AS label, lower(context) AS context, statement FROM ({duck(alias_rows_sql())})),
a AS (SELECT * FROM {values(rules.alias_rules())} t(tier, scope, needle, canonical_key, ord)),
b AS (SELECT p_partkey, min(scope) AS block FROM x JOIN a ON tier = 0 AND starts_with(context, scope) GROUP BY 1),
m AS (
  SELECT x.p_partkey, canonical_key, row_number() OVER (PARTITION BY x.p_partkey ORDER BY tier, CASE WHEN tier = 1 THEN ord ELSE -length(needle) END, ord) AS n
  FROM x LEFT JOIN b USING (p_partkey) JOIN a ON contains(label, needle)
    AND CASE WHEN block IS NOT NULL THEN tier = 0 AND scope = block ELSE tier = 1 OR (tier = 2 AND scope = statement) END
)
SELECT x.p_partkey, m.canonical_key FROM x LEFT JOIN m ON x.p_partkey = m.p_partkey AND n = 1
"""
QUARANTINE = f"""
WITH p AS ({duck(ROWS_SQL)}),
f AS (SELECT doc_id, page, arg_min(section_title, row_ord) AS title FROM p GROUP BY 1, 2),
s AS (SELECT p.*, CASE title WHEN 'Consolidated Balance Sheets' THEN 'balance_sheet' WHEN 'Calculations of Key and Other Selected Metrics' THEN 'key_metrics' WHEN 'Consolidated Statements of Operations' THEN 'income_statement' END AS statement FROM p JOIN f USING (doc_id, page)),
k AS (SELECT * FROM {values(allowed_keys())} t(statement, canonical_key, stored)),
j AS (SELECT s.*, CASE WHEN s.statement IS NOT NULL THEN mapped END AS canonical_key, stored FROM s LEFT JOIN k ON k.statement = s.statement AND k.canonical_key = mapped),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, canonical_key, stored IS NULL ORDER BY row_ord) AS nth FROM j)
SELECT doc_id, page, row_ord, CASE WHEN stored IS NOT NULL AND nth = 1 THEN stored ELSE statement END AS statement, canonical_key,
  CASE WHEN statement IS NULL THEN 'unknown statement' WHEN canonical_key IS NULL THEN 'not mapped' WHEN stored IS NULL THEN 'key not allowed' WHEN nth > 1 THEN 'key repeated' ELSE 'accepted' END AS verdict
FROM n
"""
LONG_VIEWS = (
    f"{with_facts()}, funding_mix AS ({FUNDING}), growth_efficiency AS ({GROWTH}) "
    "SELECT company, period, period_sort, 'facts' AS view, 'revenue' AS column, revenue AS value FROM facts"
    + "".join(
        f" UNION ALL SELECT company, period, period_sort, 'growth_efficiency', '{c}', {c} FROM growth_efficiency"
        for c in "asset_turnover asset_turnover_ex_cash revenue_growth_yoy_pct incremental_op_margin_pct current_op_margin_pct gaap_gross_margin_pct sbc_pct_of_revenue".split()
    )
).replace("AS column,", 'AS "column",')

ITEMS = f"({duck(tables.ITEM_SQL)}) i"
PERIODS = [f"{q} {y}" for _, q, y, _ in tables.COLUMNS]
LEDGER, BANK = f"({duck(tables.LEDGER_SQL)})", f"({duck(tables.BANK_SQL)})"
PAIRS = f"SELECT g.id AS gl_id, b.id AS bank_id FROM {LEDGER} g JOIN {BANK} b ON "
DAYS = "abs(date_diff('day', g.day, b.day))"
CORE = "ltrim(regexp_replace({}.memo, '^(Inv |I|#)', ''), '0')"


def groups(many: str, one: str) -> str:
    return f"WITH s AS (SELECT day, memo, sum(cents) AS cents FROM {many} GROUP BY 1, 2 HAVING count(*) > 1) SELECT m.id AS many_id, o.id AS one_id FROM s JOIN {one} o USING (day, memo, cents) JOIN {many} m USING (day, memo)"


def waterfall() -> str:
    """By construction each order is one case, so the sets follow from its number."""
    scenario = "CASE WHEN m <= 4 OR m >= 17 THEN 'exact' WHEN m <= 6 THEN 'shift' WHEN m = 7 THEN 'wide' WHEN m = 8 THEN 'similar' WHEN m = 9 THEN 'similar_date' WHEN m = 10 THEN 'many_gl' WHEN m = 11 THEN 'many_bank' WHEN m = 12 THEN 'near' WHEN m IN (13, 14) THEN 'void' ELSE 'unmatched' END"
    status = "CASE WHEN m IN (7, 12) THEN 'review' WHEN m IN (13, 14) THEN 'void' WHEN m IN (15, 16) THEN 'open' ELSE 'matched' END"
    rows = f"SELECT 'gl' AS side, id FROM {LEDGER} UNION ALL SELECT 'bank', id FROM {BANK}"
    return f"SELECT side, id, {scenario} AS scenario, {status} AS status, CASE WHEN m NOT IN (15, 16) THEN k * 10 END AS match_id FROM (SELECT side, id, id // 10 AS k, (id // 10) % 20 AS m FROM ({rows})) x"


def violations() -> str:
    inside = "coalesce(day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31', FALSE)"
    part = lambda side, source, rule, ok: f"SELECT '{side}' AS side, '{rule}' AS rule, count(*) FILTER (NOT {ok}) AS violations FROM {source}"
    return " UNION ALL ".join(
        [
            part("ledger", LEDGER, "date", inside),
            part("ledger", LEDGER, "cents", "(id % 13 <> 0)"),
            part("ledger", LEDGER, "main_memo", "(10 * length(memo) <= 100)"),
            part("ledger", LEDGER, "line_memo", "(14 * length(memo) <= 150)"),
            part("bank", BANK, "date", inside),
            part("bank", BANK, "cents", "(id % 13 <> 0)"),
            part("bank", BANK, "messy_memo", "(25 * length(memo) <= 250)"),
        ]
    )


def oracle_sql() -> dict[str, str]:
    items = tables.items_sql()
    source_line = "concat(canonical_key, ' ', period)"
    joined = lambda x: f"array_to_string(list_sort(list(DISTINCT {x})), '|')"
    lineage = values(lineage_rows())
    return {
        "q01_line_items": f"{items} SELECT * FROM items",
        "q02_facts": f"{with_facts()} SELECT * FROM facts",
        "q03_funding_mix": f"{with_facts()} {FUNDING}",
        "q04_growth_efficiency": f"{with_facts()} {GROWTH}",
        "q05_entity_views": f"{with_facts('r_name', duck(tables.BY_REGION))} {FUNDING}",
        "q06_identity_checks": checked(IDENTITIES, "SELECT * FROM r"),
        "q06b_skipped_checks": checked(IDENTITIES, "SELECT company, name, period FROM c WHERE a IS NULL OR e IS NULL"),
        "q07_check_summary": checked(IDENTITIES, "SELECT name, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed, count(*) AS n_checks FROM r GROUP BY ROLLUP (name)"),
        "q08_period_delta_checks": checked(DELTAS, "SELECT * FROM r", broken=False),
        "q09_first_value_lookup": f"SELECT o_custkey, value FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM ({duck(FIRST_SQL)})) WHERE n = 1",
        "q10_clean_number": "SELECT c_custkey, CASE m " + " ".join(f"WHEN {i} THEN {t}" for i, (t, _) in enumerate(TOKENS)) + " END AS token, CASE m " + " ".join(f"WHEN {i} THEN {v}" for i, (_, v) in enumerate(TOKENS)) + f" END AS value, m NOT IN (8, 9, 10) AS is_value FROM ({duck(NUMBER_SQL)}) x",
        "q11_clean_label": r"SELECT p_partkey, concat(regexp_replace(trim(p_name), '\s+', ' ', 'g'), ' of the holder''s (net)') AS label FROM part",
        "q12_unit_rules": f"SELECT p_partkey, {by_rest('p_partkey', [u[3] for u in UNITS])} AS unit FROM part",
        "q13_statement_rules": f"SELECT p_partkey, {by_rest('p_partkey', [t[1] for t in TITLES])} AS statement FROM part",
        "q14_alias_map": ALIAS,
        "q15_quarantine": QUARANTINE,
        "q16_unpivot_values": "SELECT s_suppkey, 'Q1 2024' AS period, s_acctbal AS value, CAST(20241 AS INT) AS period_sort FROM supplier UNION ALL SELECT s_suppkey, 'Q2 2024', CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 2 END, 20242 FROM supplier",
        "q17_compare_normalizers": "WITH l AS (SELECT p_partkey, concat('key', p_partkey % 2) AS left_key FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 12 = 0), r AS (SELECT p_partkey, concat('key', p_partkey % 5) AS right_key FROM part WHERE p_partkey % 4 <> 0) SELECT p_partkey, left_key, right_key, CASE WHEN right_key IS NULL THEN 'left_only' WHEN left_key IS NULL THEN 'right_only' WHEN left_key = right_key THEN 'agree' ELSE 'disagree' END AS verdict FROM l FULL JOIN r USING (p_partkey)",
        "q18_lineage_dependents": f"{items} SELECT k.canonical_key, array_to_string(list_sort(list(DISTINCT concat(t.view, '.', t.col))), ',') AS dependents FROM {lineage} t(view, col, canonical_key) JOIN (SELECT DISTINCT canonical_key FROM items) k USING (canonical_key) GROUP BY 1",
        "q19_trace": LONG_VIEWS,
        "q19b_provenance": f"{items} SELECT company, canonical_key, {joined('statement')} AS statements, {joined('unit')} AS units, 'alias' AS methods, {joined(source_line)} AS source_lines, 1.0::DOUBLE AS least_confidence, count(*) AS n_values FROM items GROUP BY 1, 2",
        "q20_layout_cluster": f"SELECT doc_id, page, 3 + count(*) + count(*) FILTER (nth % 4 = 0) + count(*) FILTER (k % 3 = 1) AS n_rows, 10 + sum(5 - (k % 5 = 0)::INT) + count(*) FILTER (nth % 4 = 0) + count(*) FILTER (k % 3 = 1) AS n_words FROM {ITEMS} GROUP BY 1, 2".replace("10 + sum", "10::BIGINT + sum"),
        "q21_layout_assign": " UNION ALL ".join(f"SELECT doc_id, page, {tables.label_of()} AS raw_label, '{p}' AS period, {tables.cell_value(c[0])} AS value FROM {ITEMS}" for c, p in zip(tables.COLUMNS, PERIODS)),
        "q22_layout_wraps": f"SELECT doc_id, page, CAST(nth + 1 AS INT) AS row_ord, 'Consolidated Balance Sheets' AS section_title, concat('Section ', nth - nth % 4) AS section_path, {tables.label_of()} AS raw_label FROM {ITEMS}",
        "q23_tree_flatten": """
            WITH n AS (SELECT r_name, n_name, n_nationkey, c_mktsegment, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
            p AS (SELECT *, dense_rank() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS i, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_mktsegment) - 1 AS j FROM n)
            SELECT DISTINCT r_name AS report_id, lpad(i::VARCHAR, 4, '0') AS path, n_name AS "Account", '' AS "Customers" FROM p
            UNION ALL SELECT r_name, concat(lpad(i::VARCHAR, 4, '0'), '.', lpad(j::VARCHAR, 4, '0')), c_mktsegment, c::VARCHAR FROM p""",
        "q24_recon_exact": f"{PAIRS} g.day = b.day AND g.cents = b.cents AND g.memo = b.memo",
        "q25_recon_shift": f"{PAIRS} g.cents = b.cents AND g.memo = b.memo AND {DAYS} BETWEEN 1 AND 3",
        "q26_recon_wide": f"{PAIRS} g.cents = b.cents AND g.memo = b.memo AND {DAYS} >= 14",
        "q27_recon_similar": f"{PAIRS} g.day = b.day AND g.cents = b.cents AND g.memo <> b.memo AND {CORE.format('g')} = {CORE.format('b')}",
        "q28_recon_similar_date": f"{PAIRS} g.cents = b.cents AND g.memo <> b.memo AND {CORE.format('g')} = {CORE.format('b')} AND {DAYS} BETWEEN 1 AND 20",
        "q29_recon_many_gl": groups(LEDGER, BANK),
        "q30_recon_many_bank": groups(BANK, LEDGER),
        "q31_recon_unmatched": f"SELECT side, id FROM ({waterfall()}) w WHERE scenario = 'unmatched'",
        "q32_recon_void": " UNION ALL ".join(f"SELECT a.id, least(a.id, b.id) AS void_id, '{s}' AS side FROM {t} a JOIN {t} b ON a.day = b.day AND a.memo = b.memo AND a.cents = -b.cents AND a.cents <> 0" for s, t in (("gl", LEDGER), ("bank", BANK))),
        "q33_recon_near_amount": f"{PAIRS} g.day = b.day AND g.memo = b.memo AND abs(g.cents - b.cents) BETWEEN 1 AND 9",
        "q34_recon_waterfall": waterfall(),
        "q35_chart_span": f"{with_facts()}, f AS ({FUNDING}) SELECT max(greatest(" + ", ".join("+".join(f"{g}(coalesce({c}, 0), 0)" for c in "delta_debt delta_deferred_revenue delta_apic retained_earnings_change delta_aoci".split()) if g == "greatest" else "abs(" + "+".join(f"{g}(coalesce({c}, 0), 0)" for c in "delta_debt delta_deferred_revenue delta_apic retained_earnings_change delta_aoci".split()) + ")" for g in ("greatest", "least")) + ", abs(delta_assets))) AS span FROM f WHERE delta_assets IS NOT NULL",
        "q36_series": f"{items} SELECT company, canonical_key, period, arg_min(value, statement) AS value FROM items WHERE NOT (canonical_key = 'operating_income_loss' AND statement = 'income_statement_non_gaap') AND value IS NOT NULL GROUP BY 1, 2, 3",
        "q37_corpus_rules": violations(),
        "q38_closed_keys": f"{items}, s AS (SELECT CASE WHEN period_sort % 10 = 1 THEN 'balance_sheet' ELSE statement END AS statement, canonical_key, period FROM items) SELECT s.* FROM s LEFT JOIN {values([(s, k) for s, ks in KEYS.items() for k in ks])} t(statement, canonical_key) ON s.statement = t.statement AND s.canonical_key = t.canonical_key WHERE t.canonical_key IS NULL",
    }


