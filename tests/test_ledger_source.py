import json
import os

import pytest

from tieout.sources import ledger

MARKS = "/tmp"


def flaky(report):
    """Fails once for each report that names a folder, then answers."""
    if report.startswith("/"):
        mark = f"{report}/asked"
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("not now")
    return f"body of {report}"


def empty(report):
    return None if report == "b" else report * 3


def never(report):
    raise ConnectionError(f"no answer for {report}")


def load(spark, client, reports, **options):
    ledger.register(spark)
    read = spark.read.format(ledger.NAME).option("client", f"tests.test_ledger_source:{client}").option("reports", json.dumps(reports)).option("wait", 0.01)
    return read.options(**options).load()


def test_a_partition_that_fails_once_is_read_again(spark, tmp_path):
    reports = ["x", str(tmp_path), "y"]
    got = load(spark, "flaky", reports)
    assert got.rdd.getNumPartitions() == 3
    assert {(r["report_id"], r["body"]) for r in got.collect()} == {(x, f"body of {x}") for x in reports}
    assert os.path.exists(f"{tmp_path}/asked")


def test_partitions_nulls_and_no_reports(spark):
    got = load(spark, "empty", ["a", "b", "c", "a"], per_partition=3)
    assert got.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "aaa"), ("a", "aaa"), ("b", None), ("c", "ccc")]
    assert load(spark, "empty", []).collect() == []


def test_a_service_that_stays_away_fails_the_read(spark):
    with pytest.raises(Exception, match="no answer for z"):
        load(spark, "never", ["z"], attempts=2).collect()
    with pytest.raises(Exception, match="client"):
        spark.read.format(ledger.NAME).option("client", "nothing").load().collect()
