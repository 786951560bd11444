"""Repeats among windows whose hashes clash."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_quality_rules import by_hand
from tieout.llm import quality_rules


@pytest.mark.parametrize("low", [False, True])
def test_repeats_among_clashing_hashes(spark, monkeypatch, low):
    """All hashes share one of three values in their upper bits; in the lower ones they do or do not differ."""
    whole = F.xxhash64
    top = lambda *c: F.shiftleft(F.pmod(whole(*c), F.lit(3)), 60)
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: top(*c).bitwiseOR(F.pmod(whole(*c), F.lit(7))) if low else top(*c))
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 2, 3, 4, 5, 20, 40, 60, 80, 120, 200)] + ["a b c d a b c e a b c"]
    got = quality_rules.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_repeat_words"]) for r in got) == [(i, by_hand(t)[4]) for i, t in enumerate(texts)]
