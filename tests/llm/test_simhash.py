import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import common, simhash


def by_hand(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = sorted(parent)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    groups = defaultdict(set)
    for f in own:
        groups[root(f)].add(f)
    return {f: frozenset(g) for g in groups.values() for f in g}


def planted(rng, n=300):
    fps = [rng.getrandbits(64) for _ in range(n)]
    fps += [0, (1 << 64) - 1, 1 << 63]
    for f in list(fps[:80]):
        for _ in range(rng.randint(1, 4)):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            fps.append(f)
    hot = rng.getrandbits(64)
    fps += [hot ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(150)]
    return sorted(set(fps))


def test_links_give_the_components_of_all_pairs(spark):
    rng = random.Random(10)
    fps = planted(rng)
    want = components_by_hand(fps)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for most in (simhash.MOST_IN_LIST, 20, 4):  # the second and third deal long lists again, and cut blocks
        edges = simhash.link(nodes, most)
        assert all((np.uint64(r["a"] & (1 << 64) - 1) ^ np.uint64(r["b"] & (1 << 64) - 1)).bit_count() <= 4 for r in edges.collect())
        found = {r["node"]: r["component"] for r in common.connected_components(edges, "t").collect()}
        got = defaultdict(set)
        for f in fps:
            got[found.get(simhash._signed(f), simhash._signed(f))].add(f)
        assert {frozenset(g) for g in got.values()} == set(want.values())


def test_every_four_positions_hold_a_triple():
    assert len(simhash.POSITIONS) == 20
    assert all(any(set(t) <= set(four) for t in simhash.POSITIONS) for four in combinations(range(8), 4))


def test_the_count_filter_drops_pairs_of_a_list(spark):
    rng = random.Random(12)
    shared = rng.getrandbits(64) & simhash.MASKS[0]
    fps = np.array([shared | rng.getrandbits(64) & ~simhash.MASKS[0] for _ in range(400)], np.uint64)  # one list, the other bytes at random
    differ = (fps[:, None] ^ fps[None, :])[np.triu_indices(len(fps), 1)]
    kept = simhash.retained(differ)
    by_bytes = [sum((int(x) >> 8 * p & 255) == 0 for p in range(8)) >= 4 for x in differ[:5000]]
    assert kept[:5000].tolist() == by_bytes
    assert 0 < kept.sum() < len(differ) * 0.05
    assert {i for i, x in enumerate(differ) if int(x).bit_count() <= 4} == set(simhash.linked(differ).tolist())
    nodes = spark.createDataFrame([(simhash._signed(int(f)),) for f in set(fps.tolist())], "fp long")
    lists = simhash.postings(nodes).groupBy("part", "key").count()
    assert lists.count() > 400 and lists.where("count = 400").count() == 1


def test_components_of_chains_and_stars(spark):
    rng = random.Random(11)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)], [(1, 1)]):
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
        assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_query(spark):
    base = " ".join(f"token{i}" for i in range(400))
    near = [base.replace("token7 ", "changed "), base + " more", base.upper()]
    rows = hard_rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate([base, *near, "a b", "A  b", "a b c d"])]
    got = simhash.query(spark.createDataFrame(rows, hard_docs(spark).schema)).collect()
    fps = {r[0]: by_hand(r[1]) for r in rows}
    want = components_by_hand({by_hand(r[1]) for r in rows})
    least = {f: min((r[0] for r in rows if r[0] is not None and by_hand(r[1]) in g), default=None) for f, g in want.items()}
    assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], f"{by_hand(r[1]):016x}", least[by_hand(r[1])]) for r in rows), key=str)
    assert fps[1000] == fps[1003]
    assert simhash.query(no_docs(spark)).count() == 0


def test_keep_one(spark):
    docs = hard_docs(spark)
    kept = simhash.keep_one(docs).collect()
    groups = components_by_hand({by_hand(r[1]) for r in hard_rows()})
    assert len(kept) == len(set(groups.values()))
    assert len({groups[by_hand(r["text"])] for r in kept}) == len(kept)
    assert kept[0].asDict().keys() == set(docs.columns)
    named = docs.withColumns({"_row": F.lit(1), "_ROW_": F.lit(2), "times": F.lit(3), "stays": F.lit(4), "fp": F.lit(5)})
    again = simhash.keep_one(named)
    assert again.columns == named.columns and again.count() == len(kept)
    assert simhash.keep_one(no_docs(spark)).count() == 0
