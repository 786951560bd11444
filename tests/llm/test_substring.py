import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import common, substring


def by_hand(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), kept))
    return out


def digests(rows):
    return sorted(((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in rows), key=str)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [rng.choice(words) for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 20)
                w += p[a : a + rng.randint(20, 80)]
        rows.append((i, " ".join(w)))
    return rows + [(500, " ".join(["on"] * 90)), (501, " ".join(["a", "b"] * 40)), (502, " ".join(["once"] * 35)), (503, rows[0][1])]


def test_rolling_hash_is_of_the_words_alone():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    own = substring.rolling(np.concatenate([h, h[:20], h]), 10)
    assert (own[:41] == own[70:111]).all() and len(set(own[:41].tolist())) == 41
    assert (own[50:61] == own[:11]).all()


def test_query_against_brute_force(spark):
    for seed in range(3):
        rows = random_rows(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + 4 * seed)
        got = substring.query(docs, in_bucket=1 << 22 if seed == 0 else 500).collect()
        assert digests(by_hand(rows)) == sorted((tuple(r) for r in got), key=str)


def test_small_gatherings(spark, monkeypatch):
    monkeypatch.setattr(substring, "GATHERED", 200)
    rows = random_rows(7, 60)
    (batch,) = spark.createDataFrame(rows, "doc_id long, text string").select(*substring.identity(), "text").toArrow().combine_chunks().to_batches()
    packed = [b for b in substring._probe_batches(iter([batch]), 2, 35)]
    assert len(packed) > 5 and sum(b.num_rows for b in packed) > 10


def test_hard_rows(spark):
    rows = [r[:2] for r in hard_rows()]
    got = substring.query(hard_docs(spark)).collect()
    assert digests(by_hand(rows)) == sorted((tuple(r) for r in got), key=str)
    assert substring.query(no_docs(spark)).count() == 0


def test_remove_repeats(spark):
    docs = hard_docs(spark)
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    want = Counter((d, k if r else t) for (d, t), (_, _, r, k) in zip([x[:2] for x in hard_rows()], by_hand([x[:2] for x in hard_rows()])))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_remove_repeats_beside_columns_of_any_name(spark):
    docs = hard_docs(spark).withColumns({c: F.lit(k) for k, c in enumerate(["_key", "_print", "_kept", "row", "hit", "print", "kept", "copies", "_bits", "_filter"])})
    got = substring.remove_repeats(docs)
    assert got.columns == docs.columns
    plain = substring.remove_repeats(hard_docs(spark))
    assert Counter(r["text"] for r in got.collect()) == Counter(r["text"] for r in plain.collect())
    assert {tuple(r[-10:]) for r in got.collect()} == {tuple(range(10))}


def test_a_filter_of_keys_holds_all_of_them(spark):
    rng = random.Random(17)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    others = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(500)]
    made = common.key_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    tested = common.passes(spark.createDataFrame([(k,) for k in keys + others], "k long"), made, "k", "hit").collect()
    assert {r["k"] for r in tested if r["hit"]} >= set(keys)
    assert sum(r["hit"] for r in tested) < len(keys) + 10
    assert not any(r["hit"] for r in common.passes(spark.createDataFrame([(1,)], "k long"), common.key_filter(spark.createDataFrame([], "k long"), "k"), "k", "hit").collect())


def test_hot_keys_join_like_others(spark):
    left = spark.createDataFrame([(k % 7 if k < 5000 else k, k) for k in range(9000)] + [(None, -1)], "k long, v long")
    right = left.where("k is not null and k % 2 = 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("w"))
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), "k", how)
        got = common.join_hot(left, right, ["k"], "n", how)
        assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
