"""Steps by invoices: one row of either side is judged by counts, only the others go through the steps before."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tieout.functions.text import invoice_core
from tieout.operators import recon
from tieout.plans import queries

SIDE = "id long, day date, cents long, memo string"
DAY = date(2024, 1, 1)
#: The JVM does not compile longer methods.
LONGEST_METHOD = 8000


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("scenario", ["similar", "similar_date"])
def test_found_pairs_are_those_of_the_steps(spark, scenario):
    rng = random.Random(11)
    forms = ["Inv ", "#", "I00", "", "inv\t\t\t\t ", " Inv 00"]
    day = lambda: rng.choice([None, *[DAY + timedelta(d) for d in (0, 0, 0, 1, 2, 5, 9, 18, 21)]])
    few = lambda: (rng.choice([None, 100, 100, 100, -100, 120]), rng.choice([*[f"{f}{n}" for n in range(40) for f in forms], *[f"m{n}" for n in range(9)], None]))
    many = lambda: (rng.choice([500, 500, -500]), f"{rng.choice(forms[:2])}{rng.choice([7000, 7001])}")
    side = lambda: [(i, day(), *(few() if i < 300 else many())) for i in range(360)]
    lone = [(f"{rng.choice(forms)}{n}", f"{rng.choice(forms)}{n}", rng.choice([0, 0, 1, 3, 4, 14, 20, 21])) for n in range(8000, 8060)]
    least = -(2**63)
    gl = spark.createDataFrame(side() + [(n, DAY, least if n % 9 == 0 else -n, x) for n, (x, _, _) in enumerate(lone, 1000)], SIDE)
    bank = spark.createDataFrame(side() + [(n, DAY + timedelta(d), least if n % 9 == 0 else n if n % 9 == 1 else -n, y) for n, (_, y, d) in enumerate(lone, 1000)], SIDE)
    want = pairs(recon.PAIRED[scenario](*recon.left_for(scenario, gl, bank)))
    assert len([x for x in want if x[0] >= 1000]) > 5 and len([x for x in want if x[0] < 1000]) > 5
    assert pairs(recon.found_by(scenario, gl, bank)) == want


def test_rows_alone_in_their_invoice_take_no_step(spark, monkeypatch):
    gl = spark.createDataFrame([(i, DAY, 100 + i, f"Inv 00{i}") for i in range(1, 60)], SIDE)
    bank = spark.createDataFrame([(i, DAY + timedelta(5 * (i % 2)), 100 + i, f"#{i}") for i in range(1, 50)], SIDE)
    monkeypatch.setattr(queries, "sides", lambda *_: (gl, bank))
    monkeypatch.setattr(recon, "left_for", lambda *_: pytest.fail("rows go through the steps"))
    assert pairs(queries.q27_recon_similar(spark, "")) == [(i, i) for i in range(2, 50, 2)]
    assert pairs(queries.q28_recon_similar_date(spark, "")) == [(i, i) for i in range(1, 50, 2)]


def test_only_rows_that_can_match_take_the_steps(spark, monkeypatch):
    one, other = [(1, DAY, 100, "Inv 1"), (2, DAY, 100, "Inv 1"), (3, DAY, 200, "Inv 2"), (4, DAY, 200, "#2"), (5, DAY, 300, "Inv 3"), (6, DAY, 300, "Inv 3")], [(1, DAY, 100, "Inv 1"), (3, DAY, 200, "#02"), (5, DAY + timedelta(4), 300, "Inv 3")]
    gl, bank = spark.createDataFrame(one, SIDE), spark.createDataFrame(other, SIDE)
    asked, own = [], recon.left_for
    monkeypatch.setattr(recon, "left_for", lambda s, *sides: asked.append([sorted(r["id"] for r in x.collect()) for x in sides]) or own(s, *sides))
    assert pairs(recon.found_by("similar", gl, bank)) == [(3, 3)]
    assert pairs(recon.found_by("similar_date", gl, bank)) == [(5, 5)]
    assert asked == [[[3, 4], [3]], [[5, 6], [5]]]


def test_forms_tell_memos_of_one_core_apart(spark):
    heads = ["", "0", "00", "I", "i", "#", "#0", "Inv ", "Inv 0", "Inv  ", "inv ", "INV", " Inv ", "  #", "0" * 40, "Inv " + "0" * 40]
    known = [h + n for h in heads for n in ("42", "10", "0", "500500")]
    unknown = ["Inv 42 ", "Inv    42", "Inv" + " " * 40 + "42", "#" + "0" * 40_000 + "42", "Inv 42\n", "Retrac42", None]
    rows = spark.createDataFrame([(m,) for m in known + unknown], "memo string").withColumn("core", invoice_core(F.col("memo")))
    got = [tuple(r) for r in rows.select("memo", "core", recon.memo_form(F.col("memo"), F.col("core"))).collect()]
    assert {m for m, _, form in got if form is None} == set(unknown)
    assert len({(core, form) for m, core, form in got if m in known}) == len(set(known))


def test_what_tells_the_rows_is_compiled(spark, monkeypatch):
    sizes, own = [], recon.settle

    def settle(df, name):
        stages = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(df._jdf.queryExecution().executedPlan())
        sizes.extend(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
        return own(df, name)

    monkeypatch.setattr(recon, "settle", settle)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan has no stages until it runs
    try:
        for query in (queries.q27_recon_similar, queries.q28_recon_similar_date):
            query(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(sizes) >= 6 and max(sizes) <= LONGEST_METHOD
