"""The test tables as statements, labels, printed pages and two sides of transactions.

Each is SQL that Spark and DuckDB both run: {name} stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: What an order line is of: decimals of few digits, whose products stay whole numbers of 64 bits.
PARTS = {c: f"CAST(l_{name} AS DECIMAL({digits},2))" for c, name, digits in (("p", "extendedprice", 9), ("d", "discount", 3), ("t", "tax", 3), ("q", "quantity", 9))}
#: All amounts are sums of these six, so each is summed once.
SUMS = {"p": "p", "pd": "p * d", "pt": "p * t", "q": "q", "d": "d", "t": "t"}

#: (statement, key, amount over the sums of the order lines); nil stays null.
LINE_ITEM_SPEC = [
    ("income_statement", "revenue", "p"),
    ("income_statement", "cost_of_revenue", "pd"),
    ("income_statement", "gross_profit", "p - pd"),
    ("income_statement", "sales_and_marketing", "pt"),
    ("income_statement", "research_and_development", "q"),
    ("income_statement", "general_and_administrative", "d"),
    ("income_statement", "total_operating_expenses", "pt + q + d"),
    ("income_statement", "operating_income_loss", "p - pd - pt - q - d"),
    ("income_statement", "net_income_loss", "pt - q"),
    ("income_statement_non_gaap", "operating_income_loss", "p - pd - pt"),
    ("balance_sheet", "total_assets", "p + q * 100"),
    ("balance_sheet", "total_liabilities", "q * 100"),
    ("balance_sheet", "total_stockholders_equity", "p"),
    ("balance_sheet", "convertible_notes_current", "q * 10"),
    ("balance_sheet", "convertible_notes_noncurrent", "CASE WHEN quarter = 2 THEN NULL ELSE q * 20 END"),
    ("balance_sheet", "deferred_revenue_current", "t * 1000"),
    ("balance_sheet", "deferred_revenue_noncurrent", "CASE WHEN quarter = 3 THEN NULL ELSE t * 500 END"),
    ("balance_sheet", "cash_and_equivalents", "q * 5"),
    ("balance_sheet", "available_for_sale_securities", "d * 100"),
    ("balance_sheet", "additional_paid_in_capital", "pd"),
    ("balance_sheet", "accumulated_deficit", "q - pt"),
    ("balance_sheet", "accumulated_oci", "d - t"),
    ("cash_flow", "stock_based_compensation", "q * 3"),
    ("cash_flow", "proceeds_from_option_exercises", "q * 2"),
    ("key_metrics", "free_cash_flow", "p - q"),
]

#: One row for each entity and quarter, one column for each key; entity is an expression.
WIDE_SQL = (
    "SELECT company, CAST(10 * year + quarter AS INT) AS period_sort, concat('Q', quarter, ' ', year) AS period, {sums} FROM ("
    f"SELECT company, year, quarter, {', '.join(f'CAST(SUM({e}) AS DECIMAL(28,4)) AS {c}' for c, e in SUMS.items())} FROM ("
    f"SELECT {{entity}} AS company, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, {', '.join(f'{e} AS {c}' for c, e in PARTS.items())} "
    "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey {joins}) x GROUP BY 1, 2, 3) y"
)
BY_REGION = "JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"


def wide_sql(entity: str = "'All'", joins: str = "") -> str:
    sums = ", ".join(f"CAST({e} AS DOUBLE) AS {s}__{k}" for s, k, e in LINE_ITEM_SPEC)
    return WIDE_SQL.replace("{entity}", entity).replace("{joins}", joins).replace("{sums}", sums)


#: Ledger and bank: sets by the order's number, so that each order is one case.
CASE = "o_orderkey % 20"
BASE = "CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS day"


def _later(days: int) -> str:
    return f"CAST(day + INTERVAL '{days}' DAYS AS DATE)"


Parts = list[tuple[str, str, str, str, str]]
CASES = f"(SELECT o_orderkey AS k, {CASE} AS m, {BASE} FROM {{orders}}) x"


def one_pass(parts: Parts) -> str:
    """(condition, number, day, cents, memo) of each kind of row, by one scan of the orders. Kinds of one number exclude each other, as ids
    are told by it, so each order and number is one row at most, made only where its kind's condition holds. For Spark alone."""

    holds = [f"n = {n} AND ({where})" for where, n, _, _, _ in parts]

    def of_kind(values: list[str]) -> str:
        """Each value once, the commonest for all other kinds: the JVM does not compile what is longer."""
        rest = max(values, key=values.count)
        cases = {v: " OR ".join(h for h, x in zip(holds, values) if x == v) for v in values if v != rest}
        return f"CASE {' '.join(f'WHEN {c} THEN {v}' for v, c in cases.items())} ELSE {rest} END" if cases else rest

    numbers = ", ".join(sorted({n for _, n, _, _, _ in parts}))
    day, cents, memo = (of_kind([part[i] for part in parts]) for i in (2, 3, 4))
    rows = f"SELECT k, m, cents, day, explode(array({numbers})) AS n FROM {CASES}"
    return f"SELECT CAST(k * 10 + n AS BIGINT) AS id, {day} AS day, CAST({cents} AS BIGINT) AS cents, {memo} AS memo FROM ({rows}) y WHERE {' OR '.join(holds)}"


def by_kind(parts: Parts) -> str:
    """The same, kind by kind."""
    base = CASES
    return " UNION ALL ".join(f"SELECT CAST(k * 10 + {n} AS BIGINT) AS id, {day} AS day, CAST({cents} AS BIGINT) AS cents, {memo} AS memo FROM {base} WHERE {where}" for where, n, day, cents, memo in parts)


INVOICE = "concat('Inv ', CAST(k AS STRING))"
LEDGER_PARTS = [
    ("m <= 7 OR m >= 17", "0", "day", "cents", INVOICE),
    ("m IN (8, 9)", "0", "day", "cents", "concat('Inv 000', CAST(k AS STRING))"),
    ("m = 10", "0", "day", "cents - 700", INVOICE),
    ("m = 10", "1", "day", "700", INVOICE),
    ("m = 11", "0", "day", "cents", INVOICE),
    ("m = 12", "0", "day", "cents", INVOICE),
    ("m = 13", "0", "day", "10000", INVOICE),
    ("m = 13", "1", "day", "-10000", INVOICE),
    ("m = 15", "0", "day", "cents", "concat('Retrac', CAST(k AS STRING))"),
]
BANK_PARTS = [
    ("m <= 4 OR m >= 17", "0", "day", "cents", INVOICE),
    ("m = 5", "0", _later(2), "cents", INVOICE),
    ("m = 6", "0", _later(-3), "cents", INVOICE),
    ("m = 7", "0", _later(20), "cents", INVOICE),
    ("m = 8", "0", "day", "cents", "concat('I', CAST(k AS STRING))"),
    ("m = 9", "0", _later(5), "cents", "concat('#', CAST(k AS STRING))"),
    ("m = 10", "0", "day", "cents", INVOICE),
    ("m = 11", "0", "day", "cents - 1100", INVOICE),
    ("m = 11", "1", "day", "500", INVOICE),
    ("m = 11", "2", "day", "600", INVOICE),
    ("m = 12", "0", "day", "cents + 5", INVOICE),
    ("m = 14", "0", "day", "30000", INVOICE),
    ("m = 14", "1", "day", "-30000", INVOICE),
    ("m = 16", "0", "day", "cents", "concat('Revooh', CAST(k AS STRING))"),
]
LEDGER_SQL, BANK_SQL = by_kind(LEDGER_PARTS), by_kind(BANK_PARTS)

#: Printed pages: a document for each brand, three pages, an item for each part, four quarters; some cells are empty, some
#: labels wrap and some items stand under a heading. Items are 30 points apart.
ITEM_SQL = (
    "SELECT p_brand AS doc_id, CAST(p_size % 3 AS INT) AS page, CAST(p_partkey AS BIGINT) AS k, "
    "CAST(row_number() OVER (PARTITION BY p_brand, p_size % 3 ORDER BY p_partkey) - 1 AS INT) AS nth, p_retailprice AS price FROM {part}"
)
COLUMNS = [(1, "Q1", "2024", 300.0), (2, "Q2", "2024", 360.0), (3, "Q3", "2024", 420.0), (4, "Q4", "2024", 480.0)]


def cell_value(column: int) -> str:
    """Of an item's column; the third is empty for every fifth part, and nil for every seventh."""
    value = f"CAST(k * 10 + {column} AS DOUBLE)"
    value = f"CASE WHEN k % 2 = 0 THEN -{value} ELSE {value} END"
    return f"CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL ELSE {value} END" if column == 3 else value


def words_sql() -> str:
    """Words in an order of their own, so that rows have to be found: one pass over the items, each giving its own words, and
    the first of a page those of the page. For Spark alone."""
    top = "200 + 30 * nth"
    parts = []

    def add(text: str, x0: float, x1: float, at: str, seq: str, where: str = "TRUE") -> None:
        parts.append(f"named_struct('ok', {where}, 'text', {text}, 'x0', {x0:.1f}D, 'x1', {x1:.1f}D, 'top', CAST({at} AS DOUBLE), 'seq', {seq})")

    first = "nth = 0"
    add("'ISSUER'", 40, 80, "20", "1", first)
    add("'Consolidated Balance Sheets'", 40, 200, "40", "2", first)
    add("'7'", 300, 306, "999990", "9", first)
    for k, quarter, year, edge in COLUMNS:
        add(f"'{quarter}'", edge - 40, edge - 25, "100", str(10 + 2 * k), first)
        add(f"'{year}'", edge - 22, edge, "100", str(11 + 2 * k), first)
    add("concat('Section ', nth, ':')", 38.6, 90, f"{top} - 14", "100 + 100 * nth", "nth % 4 = 0")
    add("concat('Item', k)", 44.6, 90, f"{top} - 4", "101 + 100 * nth")
    add("'and more'", 44.6, 120, f"{top} + 5", "102 + 100 * nth", "k % 3 = 1")
    for k, _, _, edge in COLUMNS:
        token = f"CASE WHEN k % 2 = 0 THEN concat('(', k * 10 + {k}, ')') ELSE concat(k * 10 + {k}) END"
        if k == 3:
            token = f"CASE WHEN k % 7 = 0 THEN '—' ELSE {token} END"
        add(token, edge - 30, edge - 1, top, f"{110 + k} + 100 * nth", "k % 5 <> 0" if k == 3 else "TRUE")
    return f"SELECT doc_id, page, w.text, w.x0, w.x1, w.top, w.seq FROM (SELECT doc_id, page, explode(filter(array({', '.join(parts)}), w -> w.ok)) AS w FROM ({ITEM_SQL}) i) x"


def label_of() -> str:
    return "CASE WHEN k % 3 = 1 THEN concat('Item', CAST(k AS STRING), ' and more') ELSE concat('Item', CAST(k AS STRING)) END"


def duck(sql: str) -> str:
    """For DuckDB, where the tables are views of their names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def line_items(spark: SparkSession, sf_dir: str, entity: str = "'All'", joins: str = "") -> DataFrame:
    """The long model; the wide table is one aggregate, unpivoted where it is."""
    wide = run(spark, sf_dir, wide_sql(entity, joins))
    ids = ["company", "period", "period_sort"]
    long = wide.unpivot(ids, [c for c in wide.columns if c not in ids], "_name", "value")
    return long.selectExpr(*ids, "split(_name, '__')[0] AS statement", "split(_name, '__')[1] AS canonical_key", "value", "'thousands_usd' AS unit")


def items_sql(entity: str = "'All'", joins: str = "") -> str:
    parts = [f"SELECT company, period, period_sort, '{s}' AS statement, '{k}' AS canonical_key, {s}__{k} AS value, 'thousands_usd' AS unit FROM wide" for s, k, _ in LINE_ITEM_SPEC]
    return f"WITH wide AS ({duck(wide_sql(entity, joins))}), items AS ({' UNION ALL '.join(parts)})"
