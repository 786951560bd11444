"""The SQL functions give what the columns give."""

import math

import pytest
from pyspark.sql import functions as F

from tieout.functions import sql
from tieout.functions import text as fn

ROWS = [
    ("$1,234.50", 1234.5, 2, {"Q1": 5.0, "Q2": None}),
    ("(12)%", -0.5, 0, {"Q1": None}),
    ("—", None, 1, {}),
    ("  Gross margin’s (net)(1)(2) :", 4.0935, 3, {"Q1": -100.0}),
    ("INV 00042", -1e12, 2, {"Q1": 99.9, "Q2": -99.9}),
    ("Condensed Consolidated Balance Sheets", 0.0, None, None),
    ("Q3 2024", 2.5, 0, {"Q1": 1.0}),
    ("'<a & \"b\">' \\d", 1e-9, 4, {"Q1": math.nan}),
    ("per share", 7.0, 1, {"Q1": 1000.0}),
    ("é x", 100.0, 2, {"Q1": 100.0}),
    (None, None, None, None),
    ("", -7.25, 1, {"Q1": 0.0}),
]
KINDS = {"STRING": "s", "DOUBLE": "d", "INT": "i", "BIGINT": "CAST(i AS BIGINT)", "DECIMAL(18,2)": "CAST(i AS DECIMAL(18,2))", "MAP<STRING, DOUBLE>": "m"}


@pytest.mark.parametrize("name, parameters, made", sql.FUNCTIONS)
def test_equal_to_the_column(spark, name, parameters, made):
    sql.register(spark)
    rows = spark.createDataFrame(ROWS, "s string, d double, i int, m map<string, double>")
    rows.createOrReplaceTempView("sql_rows")
    kinds = [p.strip().split(" ", 1)[1] for p in parameters.replace("STRING, DOUBLE>", "STRING; DOUBLE>").split(",") if " " in p.strip()]
    args = [KINDS[k.replace(";", ",")] for k in (kinds if "DECIMAL" not in parameters else ["DECIMAL(18,2)"])]
    names = [p.split()[0] for p in parameters.replace("<STRING, DOUBLE>", "").replace("(18,2)", "").split(", ")]
    columns = rows.select(*[F.expr(a).alias(n) for a, n in zip(args, names)])
    want = [r[0] for r in columns.select(made(*map(F.col, names))).collect()]
    got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(args)}) FROM sql_rows").collect()]
    assert list(map(str, got)) == list(map(str, want))
    assert any(x is not None for x in want)


def test_small_values_are_told_without_nil_ones(spark):
    values = spark.createDataFrame(ROWS, "s string, d double, i int, m map<string, double>").where("m is not null")
    got = [r[0] for r in values.select(fn.guess_unit(F.lit("x"), F.lit("x"), F.col("m"))).collect()]
    plain = lambda m: "usd_per_share" if (v := [x for x in m.values() if x is not None]) and all(abs(x) < 100 for x in v) else "thousands_usd"
    assert got == [plain(m) for *_, m in ROWS if m is not None]


def test_no_python_when_called(spark):
    sql.register(spark, "t_")
    plan = spark.sql("SELECT t_clean_number(id), t_guess_unit(id, id, map('a', 1D)) FROM (SELECT CAST(id AS STRING) AS id FROM range(3))")._jdf.queryExecution().toString()
    assert "Python" not in plan and "regexp_replace" in plan
