"""Feeds in any order give the pairs of the batch operator, and leave no state."""

import random
from datetime import timedelta

import pytest

from tests.test_recon_scale import FIRST, SIDE
from tieout.operators import recon
from tieout.streaming import matching

BOTH = "side string, " + SIDE


@pytest.mark.parametrize("lists", [1, matching.LISTS])
def test_files_in_any_order(spark, tmp_path, lists):
    rng = random.Random(12)
    side = lambda first: [(first + i, FIRST + timedelta(rng.randint(0, 120)), rng.choice([100, 200]), rng.choice("ab")) for i in range(150)]
    gl, bank = side(0), side(1000)
    gl.append((500, FIRST, 900, "alone"))
    odd = [("gl", 600, None, 1, "a"), ("bank", 1600, FIRST, None, "a"), ("bank", 1601, FIRST, 1, None)]
    rows = [("gl", *r) for r in gl] + [("bank", *r) for r in bank] + odd
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], BOTH).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(BOTH).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    matching.run_to_end(stream, str(tmp_path), "200 days", lists=lists)
    first = spark.read.schema(matching.MATCHES).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    assert not first  # rows may still come
    spark.createDataFrame([(matching.END, -1, FIRST + timedelta(900), 0, "")], BOTH).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = matching.run_to_end(stream, str(tmp_path), "200 days", lists=lists)
    got = spark.read.schema(matching.MATCHES).parquet(f"{tmp_path}/out").collect()
    want = sorted(map(tuple, recon.shifted(spark.createDataFrame(gl, SIDE), spark.createDataFrame(bank, SIDE)).collect()))
    assert sorted((r["gl_id"], r["bank_id"]) for r in got if r["gap"] is not None) == want
    ids = [(s, r[f"{s}_id"]) for r in got for s in ("gl", "bank") if r[f"{s}_id"] is not None]
    assert sorted(ids) == sorted([("gl", r[0]) for r in gl] + [("bank", r[0]) for r in bank])
    days = {r[0]: r[1] for r in gl + bank}
    assert all((days[r["bank_id"]] - days[r["gl_id"]]).days == r["gap"] for r in got if r["gap"] is not None)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
