import random
from itertools import combinations

from tests.test_recon_scale import FIRST, SIDE
from tieout.operators import recon, subsets


def plain(rows, total):
    for n in range(2, len(rows) + 1):
        for chosen in combinations(sorted(rows), n):
            if sum(c for _, c in chosen) == total:
                return tuple(i for i, _ in chosen)
    return None


def test_against_all_subsets():
    rng = random.Random(2)
    for _ in range(400):
        rows = [(i, rng.randint(-6, 12)) for i in rng.sample(range(50), rng.randint(0, 9))]
        total = rng.randint(-10, 40)
        assert subsets.best_subset(sorted(rows), total) == plain(rows, total), (rows, total)


def test_two_batches_under_one_memo(spark):
    """Three and five rows of one day and memo; a row that belongs to none; a single row is no batch."""
    cents = [100, 250, 375, 1000, 2000, 4100, 8200, 16400, 77]
    gl = [(i, FIRST, c, "Inv 12") for i, c in enumerate(cents)] + [(50, FIRST, 500, "alone"), (51, FIRST, 1, "alone"), (52, FIRST, 2, "alone"), (53, None, 3, "x"), (54, FIRST, 3, None)]
    bank = [(100, FIRST, 725, "Inv 12"), (101, FIRST, 31700, "Inv 12"), (102, FIRST, 77, "Inv 12"), (103, FIRST, 500, "alone")]
    a, b = spark.createDataFrame(gl, SIDE), spark.createDataFrame(bank, SIDE)
    want = [(i, 100) for i in range(3)] + [(i, 101) for i in range(3, 8)]
    assert sorted(map(tuple, recon.groups_to_one(a, b).collect())) == want
    rows = {(r["side"], r["id"]): (r["scenario"], r["match_id"]) for r in recon.waterfall(a, b).collect()}
    assert all(rows[("gl", i)] == ("many_gl", 0 if m == 100 else 3) for i, m in want)
    assert rows[("bank", 101)] == ("many_gl", 3) and rows[("gl", 8)] == ("exact", 8) and rows[("gl", 50)] == ("exact", 50)
    mirrored = {(r["side"], r["id"]): (r["scenario"], r["match_id"]) for r in recon.waterfall(b, a).collect()}
    assert mirrored[("bank", 7)] == ("many_bank", 101) and len(rows) == len(mirrored) == 18


def test_groups_beyond_the_bound_are_matched_as_a_whole(spark):
    many = spark.range(40).selectExpr("id", "DATE'2024-01-01' AS day", "1L AS cents", "if(id < 30, 'big', 'small') AS memo")
    one = spark.createDataFrame([(100, FIRST, 30, "big"), (101, FIRST, 4, "small"), (102, FIRST, 4, "small")], SIDE)
    got = {}
    for r in recon.groups_to_one(many, one).collect():
        got.setdefault(r["one_id"], []).append(r["many_id"])
    assert {k: sorted(v) for k, v in got.items()} == {100: list(range(30)), 101: [30, 31, 32, 33], 102: [34, 35, 36, 37]}
