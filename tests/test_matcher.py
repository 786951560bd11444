import random
import time

import pytest

from tieout.operators import matcher, normalize, rules


def plain(table, label, context, statement):
    """Every rule put to a label."""
    if label is None:
        return None
    ranked = sorted((t, -len(n), o, s or "", n, k) for t, s, n, k, o in table)
    block = next((s for t, _, _, s, _, _ in ranked if t == 0 and context is not None and context.startswith(s)), None)
    fits = []
    for t, s, n, k, o in table:
        if n in label and ((t == 0 and s == block) if block is not None else t == 1 or (t == 2 and s == statement)):
            fits.append((t, o if t == 1 else -len(n), o, k))
    return min(fits, default=(None,))[-1]


def test_against_every_rule(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    table = []
    for i in range(400):
        tier = rng.choice((0, 1, 2, 2))
        table.append((tier, [f"({i % 3}) {'x' * (i % 2)}", None, f"s{i % 4}"][tier], some(rng.randint(0 if i % 50 == 0 else 2, 6)), f"k{i}", i % 40))
    own = [t for t in table if t[0] == 2 or t[2]]
    match = matcher.RuleMatcher(own)
    for _ in range(3000):
        row = (some(rng.randint(0, 12)), rng.choice((None, "", "(1) x more", "(1) ", "(2) xx", "other")), rng.choice((None, "s1", "s2", "none")))
        assert match.best(*row) == plain(own, *row), row
    assert match.best(None, "(1) x", "s1") is None
    assert matcher.RuleMatcher([]).best("a", None, None) is None
    got = normalize.alias_map(spark.createDataFrame([(1, " Revenue ", None, "income_statement"), (1, " Revenue ", None, "income_statement"), (2, None, None, None)], "id int, raw_label string, context string, statement string"), rules.dim_alias(spark), ["id"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "revenue"), (1, "revenue"), (2, None)]


def test_time_does_not_grow_with_the_needles():
    """20,000 needles against 200: the same labels take about as long; one by one they would take a hundred times."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12))
    labels = [" ".join(word() for _ in range(6)) for _ in range(20_000)]
    took = []
    for n in (200, 20_000):
        match = matcher.RuleMatcher([(2, "s", word(), f"k{i}", i) for i in range(n)] + [(2, "s", labels[0][5:30], "hit", 0)])
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            found = [match.best(x, None, "s") for x in labels]
            best = min(best, time.perf_counter() - began)
        took.append(best)
        assert found[0] == "hit"
    assert took[1] < 8 * took[0]


def test_rules_of_any_size_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(matcher, "MOST_RULE_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        normalize.alias_map(spark.createDataFrame([(1, "a", "c", "s")], "id int, raw_label string, context string, statement string"), rules.dim_alias(spark), ["id"])
