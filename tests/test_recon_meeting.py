"""What cannot match is left out before places are made and groups are summed, by counts of keys."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tieout.operators import recon

SIDE = "id long, day date, cents long, memo string"
DAY = date(2024, 1, 1)


def written(monkeypatch, pairs):
    """Rows of pairs(), and the sizes of the tables written on the way."""
    sizes = {}

    def settle(df, name, own=recon.settle):
        table = own(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(recon, "settle", settle)
    return sorted(map(tuple, pairs().collect())), sizes


def test_places_are_made_of_keys_that_meet(spark, monkeypatch):
    gl = spark.createDataFrame([(i, DAY, 100 + i, f"m{i}") for i in range(50)] + [(60, DAY, 500, "near")], SIDE)
    bank = spark.createDataFrame([(i, DAY, 100 + i, f"m{i}") for i in range(25)] + [(i, DAY, 100 + i, f"n{i}") for i in range(25, 50)] + [(60, DAY, 504, "near")], SIDE)
    pairs, sizes = written(monkeypatch, lambda: recon.near(gl, bank))
    assert pairs == [(60, 60)] and sizes["recon_all_places"] == 2


def test_keys_of_any_span_meet(spark):
    gl = spark.createDataFrame([(1, DAY, -(2**62) - 9, "far"), (2, DAY, 5, "far")], SIDE)
    bank = spark.createDataFrame([(1, DAY, 2**62 + 9, "far"), (2, DAY, 8, "far"), (3, DAY, 8, None)], SIDE)
    assert [tuple(r) for r in recon.near(gl, bank).collect()] == [(2, 2)]


def test_groups_are_summed_where_they_meet(spark, monkeypatch):
    many = spark.createDataFrame([(i, DAY, 100, f"m{i // 2}") for i in range(50)] + [(60, DAY, 1, None), (61, DAY, 2, None)], SIDE)
    one = spark.createDataFrame([(1, DAY, 200, "m3"), (2, DAY, 100, "alone"), (3, DAY, 3, None)], SIDE)
    pairs, sizes = written(monkeypatch, lambda: recon.groups_to_one(many, one))
    assert pairs == [(6, 1), (7, 1)] and sizes["recon_meeting"] == 3


def test_lone_rows_are_judged_as_the_steps_judge_them(spark, monkeypatch):
    rng = random.Random(7)
    memos = [*[f"{form}{n}" for n in range(60) for form in ("Inv ", "#", "I00")], *[f"m{n}" for n in range(60)], None]
    row = lambda i: (i, rng.choice([None, *[DAY + timedelta(d) for d in (0, 0, 0, 2, 5, 18)]]), rng.choice([None, 100, 100, 100, 104, 120]), rng.choice(memos))
    lone = {"exact": (0, 0, "Inv "), "shift": (2, 0, "Inv "), "wide": (30, 0, "Inv "), "similar": (0, 0, "I0"), "similar_date": (9, 0, "#"), "near": (0, 4, "Inv "), "unmatched": (9, 4, "#")}
    at = lambda n, days, cents, form: (1000 + n, DAY + timedelta(days), 100 + cents, f"{form}{1000 + n}")
    gl = spark.createDataFrame([row(i) for i in range(150)] + [at(n, 0, 0, "Inv ") for n in range(len(lone))], SIDE)
    bank = spark.createDataFrame([row(i) for i in range(150)] + [at(n, *x) for n, x in enumerate(lone.values())], SIDE)
    got = sorted(map(tuple, recon.waterfall(gl, bank).collect()), key=str)
    left = [sorted(r["id"] for r in x.collect()) for x in recon.left_for("similar_date", gl, bank)]
    whole = both_sides(gl, bank)
    judged = {(r["side"], r["id"] - 1000): r["scenario"] for r in recon.lone(whole).where("id >= 1000").collect()}
    assert judged == {(s, n): name for s in recon.SIDES for n, name in enumerate(lone)}
    monkeypatch.setattr(recon, "ROWS_TOGETHER", 0)  # every block is crowded: all rows go through the steps
    assert recon.lone(whole).where("scenario is not null and memo is not null").isEmpty()
    assert sorted(map(tuple, recon.waterfall(gl, bank).collect()), key=str) == got
    assert [sorted(r["id"] for r in x.collect()) for x in recon.left_for("similar_date", gl, bank)] == left


def both_sides(gl, bank):
    both = gl.withColumn("side", F.lit("gl")).unionByName(bank.withColumn("side", F.lit("bank")))
    return both.withColumn("block", recon.block_of(F.col("memo")))
