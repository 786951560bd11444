"""Groups of any number of rows and totals are split, and each method finds what trying all subsets finds."""

import random
from itertools import combinations

import pytest

from tests.test_recon_scale import FIRST, SIDE
from tieout.operators import fewest, recon, subsets


def plain(values, total):
    for n in range(2, len(values) + 1):
        for chosen in combinations(range(len(values)), n):
            if sum(values[i] for i in chosen) == total:
                return list(chosen)
    return None


DRAWS = [
    lambda rng: rng.randint(-6, 12),
    lambda rng: rng.randint(0, 3),
    lambda rng: 100 * rng.randint(1, 20),
    lambda rng: rng.randint(-(2**62), 2**62),  # sums beyond a long
]


@pytest.mark.parametrize("listed, bits, few", [(1 << 21, 1 << 30, 1 << 10), (1 << 21, 1 << 30, 0), (0, 1 << 30, 0), (4, 1 << 12, 0), (0, -1, 0)])
def test_all_methods_against_all_subsets(monkeypatch, listed, bits, few):
    """By halves, by bits, by one row after the other, and by quarters in wide and narrow ranges."""
    for name, value in (("MOST_LISTED", listed), ("MOST_BITS", bits), ("FEW_LISTED", few)):
        monkeypatch.setattr(fewest, name, value)
    rng, hits = random.Random(3), 0
    for _ in range(300):
        values = [rng.choice(DRAWS)(rng)] * rng.randint(0, 2) + list(map(DRAWS[rng.randrange(4)], [rng] * rng.randint(4, 8)))
        total = sum(rng.sample(values, rng.randint(0, len(values)))) if rng.random() < 0.8 else rng.randint(-20, 60)
        want = plain(values, total)
        hits += want is not None
        assert fewest.fewest(values, total) == want, (values, total)
        assert fewest.by_quarters(values, total) == want, (values, total)
    assert hits > 150


def test_many_rows():
    rng = random.Random(6)
    for n, size in ((30, 10**12), (40, 10**12), (120, 10**6), (3000, 10**6)):
        values = [rng.randint(1, size) for _ in range(n)]
        for k in (2, 3, 5, n // 2):
            chosen = rng.sample(range(n), k)
            got = fewest.fewest(values, total := sum(values[i] for i in chosen))
            assert sum(values[i] for i in got) == total and got == sorted(set(got)) and 2 <= len(got) <= k
        assert fewest.fewest([100 * x for x in values], 100 * total + 1) is None


def test_more_rows_and_totals_than_were_split(spark):
    """30 rows of three batches and one that belongs to none; 60 rows of 30 batches; only one choice of rows has each sum."""
    parts = [range(0, 3), range(3, 13), range(13, 29)]
    many = [(i, FIRST, 1 << i, "Inv 12") for i in range(30)] + [(100 + i, FIRST, 1 << i, "Inv 13") for i in range(60)]
    one = [(1000 + j, FIRST, sum(1 << i for i in p), "Inv 12") for j, p in enumerate(parts)] + [(1100 + j, FIRST, 3 << 2 * j, "Inv 13") for j in range(30)]
    want = sorted([(i, 1000 + j) for j, p in enumerate(parts) for i in p] + [(100 + i, 1100 + i // 2) for i in range(60)])
    a, b = spark.createDataFrame(many, SIDE), spark.createDataFrame(one, SIDE)
    assert sorted(map(tuple, recon.groups_to_one(a, b).collect())) == want
    found = {(r["side"], r["id"]): (r["scenario"], r["match_id"]) for r in recon.waterfall(b, a).collect()}
    assert {(i, found["bank", i]) for i, _ in want} == {(i, ("many_bank", j)) for i, j in want}
    assert {found["gl", j] for _, j in want} == {("many_bank", j) for _, j in want} and found["bank", 29] == ("unmatched", None)


def test_no_setting_makes_a_difference(monkeypatch):
    """Pairs are found in order of id, rows too large for a total left out, ids twice taken together."""
    rng = random.Random(8)
    ids = lambda n: rng.sample(range(90), n) if n > 8 else [rng.randrange(6) for _ in range(n)]
    groups = [([(i, rng.randint(least, 30)) for i in ids(n)], [(j, rng.randint(0, 80)) for j in range(6)]) for n in (6, 12, 20) for least in (-3, 0, 3) for _ in range(9)]

    def plainly(rows, totals):
        left = sorted(rows)
        for total_id, total in sorted(totals):
            if found := plain([c for _, c in left], total):
                gone = {left[at][0] for at in found}
                yield from [(left[at][0], total_id) for at in found]
                left = [r for r in left if r[0] not in gone]

    want = [list(plainly(*x)) for x in groups]
    for listed, passed_by in ((24, 1000), (0, 1000), (0, 1), (24, 1)):
        monkeypatch.setattr(subsets, "LISTED_ROWS", listed)
        monkeypatch.setattr(subsets, "PASSED_BY", passed_by)
        assert [list(subsets.served(*x)) for x in groups] == want
    assert sum(map(len, want)) > 100


def test_totals_that_a_large_group_does_not_hold_cost_little():
    """Twenty thousand rows, as many totals below their two least."""
    rows = [(i, 1000 + i % 500) for i in range(20_000)]
    assert list(subsets.served(rows, [(j, 1999 - j % 900) for j in range(20_000)] + [(90_000, 2001)])) == [(0, 90_000), (1, 90_000)]
