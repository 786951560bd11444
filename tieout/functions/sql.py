"""The scalar functions for SQL: temporary functions whose bodies are the column expressions of functions/text.py, written out.

    sql.register(spark)
    spark.sql("SELECT clean_number('(1,234)'), statement_for(title) FROM pages")

No Python runs when they are called; they are inlined into the plan as the columns are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tieout.functions import text as fn

#: name, parameters, the expression of them.
FUNCTIONS: list[tuple[str, str, Callable[..., Column]]] = [
    ("is_value", "token STRING", fn.is_value),
    ("clean_number", "token STRING", fn.clean_number),
    ("clean_label", "label STRING", fn.clean_label),
    ("collapse_spaces", "label STRING", fn.collapse_spaces),
    ("period_sort", "period STRING", fn.period_sort),
    ("is_quarter", "token STRING", fn.is_quarter),
    ("is_year", "token STRING", fn.is_year),
    ("statement_for", "title STRING", fn.statement_for),
    ("guess_unit", "label STRING, source_line STRING, amounts MAP<STRING, DOUBLE>", fn.guess_unit),
    ("starts_lowercase", "label STRING", fn.starts_lowercase),
    ("format_amount", "amount DOUBLE, decimals INT", fn.format_amount),
    ("trace_number", "amount DOUBLE", fn.trace_number),
    ("escape_markup", "label STRING", fn.escaped),
    ("request_hash", "model STRING, request STRING", fn.request_hash),
    ("difference", "actual DOUBLE, expected DOUBLE", fn.difference),
    ("round_half_away", "amount DOUBLE, places INT", fn.round_half_away),
    ("ratio", "part DOUBLE, whole DOUBLE", fn.ratio),
    ("nil_to_zero", "amount DOUBLE", fn.nil_to_zero),
    ("from_cents", "cents BIGINT", fn.from_cents),
    ("to_cents", "amount DECIMAL(18,2)", fn.to_cents),
    ("invoice_core", "memo STRING", fn.invoice_core),
    ("reversed_name", "name STRING", fn.reversed_name),
    ("zero_pad", "digits STRING, width INT", fn.zero_pad),
]


def body(spark: SparkSession, parameters: str, made: Callable[..., Column]) -> str:
    """The expression of a function's parameters, as SQL: what the analyzer makes of it over a table that has them as columns."""
    table = spark.createDataFrame([], parameters)
    if made is fn.request_hash:  # the analyzer's text leaves out options
        return f"substring(sha2(to_json(struct({', '.join(table.columns)}), map('ignoreNullFields', 'false')), 256), 1, 20)"
    plan = table.select(made(*map(F.col, table.columns)).alias("result"))._jdf.queryExecution().analyzed()
    return plan.projectList().head().child().sql()


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the functions known to a session, and give their names."""
    for name, parameters, made in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURN {body(spark, parameters, made)}")
    return [prefix + name for name, _, _ in FUNCTIONS]
