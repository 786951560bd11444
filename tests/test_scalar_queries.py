"""The scalar queries against their SQL on customers that small tables do not have."""

import duckdb
import pytest

import __spark_entry__ as entry

CUSTOMERS = """SELECT * FROM (VALUES (1, 'Customer#1', -0.0::DOUBLE), (2, 'Customer#2', 0.0::DOUBLE), (3, 'Customer#3 of old', -0.001::DOUBLE),
  (4, 'Customer#4', NULL), (7, 'Customer#7', 1.0::DOUBLE), (14, 'Customer#14', NULL), (900001, 'Customer#900001', -1234.5::DOUBLE)) t(c_custkey, c_name, c_acctbal)"""


@pytest.mark.parametrize("name", ["q39_scalar_functions", "q72_sql_scalars"])
def test_odd_balances(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT c_custkey::BIGINT AS c_custkey, c_name, c_acctbal FROM ({CUSTOMERS}) c")
    con.execute(f"COPY customer TO '{tmp_path}/customer.parquet'")
    made = entry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({entry.oracle_sql()[name]}) s ORDER BY 1").fetchall()
    assert [tuple(r) for r in made.orderBy("c_custkey").collect()] == want
