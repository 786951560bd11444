"""Keys of many places: dealt by islands, with the same result as whole."""

import random
from datetime import timedelta

import pytest

from tests.test_recon_scale import FIRST, SIDE, greedy
from tieout.operators import islands, recon


def told(at, reach):
    """The island of each place of a key."""
    found, last, first = {}, None, None
    for x in sorted(at):
        if last is None or x - last > reach:
            first = x
        found[x], last = first, x
    return found


@pytest.mark.parametrize("reaches", [1, 2, 7, 1024])
def test_against_one_walk_along_each_key(spark, monkeypatch, reaches):
    monkeypatch.setattr(islands, "REACHES_A_STRETCH", reaches)
    rng = random.Random(reaches)
    keys = {f"k{i}": {x + rng.choice((-500, 0)) for x in rng.sample(range(-400, 400), n)} for i, n in enumerate((1, 2, 30, 200, 500))}
    keys["dense"], keys[None] = set(range(-50, 300)), {1, 2, 30}
    for reach in (0, 1, 3, 20):
        places = spark.createDataFrame([(k, x, "extra") for k, own in keys.items() for x in own], "k string, at long, island_of string").repartition(3)
        got = islands.islands(places.where("k is not null"), ["k"], reach).collect()
        assert sorted((r["k"], r["at"], r["island"]) for r in got) == sorted((k, x, i) for k, own in keys.items() if k for x, i in told(own, reach).items())
    assert islands.islands(places.limit(0), ["k"], 3).count() == 0


def test_matches_do_not_change(spark, monkeypatch):
    rng = random.Random(9)
    rows = lambda first: [(first + i, FIRST + timedelta(rng.choice((rng.randint(0, 30), rng.randint(200, 500)))), rng.choice([100, 100, 200]), "a") for i in range(250)]
    gl, bank = rows(0), rows(1000)
    a, b = spark.createDataFrame(gl, SIDE), spark.createDataFrame(bank, SIDE)
    monkeypatch.setattr(islands, "PLACES_TOGETHER", 5)
    monkeypatch.setattr(islands, "REACHES_A_STRETCH", 2)
    for low, high in ((1, 3), (1, 20), (14, None)):
        assert sorted(map(tuple, recon.shifted(a, b, low, high).collect())) == greedy(gl, bank, low, high)
    near = [(i, FIRST, 7 * i + rng.randint(0, 3) * 40, "m") for i in range(300)]
    other = [(1000 + i, FIRST, 7 * i + rng.randint(-5, 5), "m") for i in range(300)]
    with_islands = sorted(map(tuple, recon.near(spark.createDataFrame(near, SIDE), spark.createDataFrame(other, SIDE)).collect()))
    monkeypatch.undo()
    assert with_islands == sorted(map(tuple, recon.near(spark.createDataFrame(near, SIDE), spark.createDataFrame(other, SIDE)).collect())) != []


def test_one_key_of_a_million_places(spark):
    """Amounts of one day and memo, in pairs 5 cents apart and 100 from the next: a task gets two places at a time."""
    gl = spark.range(500_000).selectExpr("id", "DATE'2024-01-01' AS day", "id * 100 AS cents", "'fees' AS memo")
    bank = spark.range(500_000).selectExpr("id + 1000000 AS id", "DATE'2024-01-01' AS day", "id * 100 + 5 AS cents", "'fees' AS memo")
    places = gl.selectExpr("day", "memo", "cents AS at").unionByName(bank.selectExpr("day", "memo", "cents AS at"))
    most = islands.dealt(recon.settle(places, "places"), ["day", "memo"], 9).groupBy("island").count().agg({"count": "max"}).first()[0]
    assert most == 2
    got = recon.near(gl, bank).selectExpr("bank_id - gl_id AS d").groupBy("d").count().collect()
    assert [tuple(r) for r in got] == [(1_000_000, 500_000)]
