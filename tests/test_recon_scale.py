"""Reconciliation where many rows are alike: places are paired, not rows, in a fixed number of jobs."""

import random
from datetime import date, timedelta

from tieout.operators import recon

SIDE = "id long, day date, cents long, memo string"
FIRST = date(2024, 1, 1)


def greedy(gl, bank, low, high):
    """Nearest first, the later bank day before the earlier, then by ledger day; rows of a place in order of id."""
    made = []
    for key in {r[2:] for r in gl}:
        g, b = ([r for r in side if r[2:] == key] for side in (gl, bank))
        gaps = sorted({(abs((y[1] - x[1]).days), y[1] < x[1], x[1], y[1]) for x in g for y in b})
        for gap, _, p, q in gaps:
            if gap >= low and (high is None or gap <= high):
                while (x := min((r for r in g if r[1] == p), default=None)) and (y := min((r for r in b if r[1] == q), default=None)):
                    made.append((x[0], y[0]))
                    g.remove(x)
                    b.remove(y)
    return sorted(made)


def test_shifts_against_a_greedy_pairing(spark):
    rng = random.Random(4)
    rows = lambda first: [(first + i, FIRST + timedelta(rng.randint(0, 40)), rng.choice([100, 200]), rng.choice("ab")) for i in range(150)]
    gl, bank = rows(0), rows(1000)
    a, b = spark.createDataFrame(gl, SIDE), spark.createDataFrame(bank, SIDE)
    for low, high in ((1, 3), (14, None), (1, 20)):
        assert sorted(map(tuple, recon.shifted(a, b, low, high).collect())) == greedy(gl, bank, low, high)


def test_both_ways_to_order_places_agree(monkeypatch):
    rng = random.Random(5)
    for _ in range(50):
        places = [{"at": at, "gl": rng.randint(0, 3), "bank": rng.randint(0, 3)} for at in sorted(rng.sample(range(90), 25))]
        listed = recon.allocate(places, 14, None)
        monkeypatch.setattr(recon, "LISTED_PAIRS", 0)
        assert recon.allocate(places, 14, None) == listed
        monkeypatch.undo()


def test_thousands_of_equal_fees_pair_in_one_pass(spark):
    gl = spark.range(1000).selectExpr("id", "DATE'2024-01-01' AS day", "100L AS cents", "'fee' AS memo")
    bank = spark.range(1000, 2000).selectExpr("id", "DATE'2024-01-02' AS day", "100L AS cents", "'fee' AS memo")
    assert sorted(map(tuple, recon.shifted(gl, bank).collect())) == [(i, 1000 + i) for i in range(1000)]
    assert recon.shifted(gl, bank, 2, 3).isEmpty()
    near = recon.near(gl, bank.selectExpr("id", "DATE'2024-01-01' AS day", "cents + 4 AS cents", "memo"))
    assert near.count() == 1000


def test_a_hot_group_sums_to_one_row(spark):
    many = spark.range(3000).selectExpr("id", "DATE'2024-01-01' AS day", "1L AS cents", "'batch' AS memo")
    one = spark.createDataFrame([(9000, FIRST, 3000, "batch")], SIDE)
    got = recon.waterfall(many, one).collect()
    assert len(got) == 3001 and {r["scenario"] for r in got} == {"many_gl"} and {r["match_id"] for r in got} == {0}
