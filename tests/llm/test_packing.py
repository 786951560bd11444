import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import bpe, packing


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(3, 4) == [(0, 3)]


def laid_out(runs):
    for length, first, n, per, sequence, offset in runs:
        for seat in range(n):
            yield length, first + seat, sequence + seat // per, offset + seat % per * length


def test_plan_places_all_once_and_nearly_fills():
    rng = random.Random(3)
    for capacity, top, n in ((64, 64, 500), (64, 9, 300), (100, 40, 1000), (64, 1, 130), (50, 50, 0)):
        histogram = Counter(rng.randint(1, top) for _ in range(n))
        seats, ranks = defaultdict(list), defaultdict(list)
        for length, rank, sequence, offset in laid_out(packing.plan(histogram, capacity)):
            seats[sequence].append((offset, length))
            ranks[length].append(rank)
        assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(c)) for x, c in histogram.items()}
        for items in seats.values():
            end = 0
            for offset, length in sorted(items):
                assert offset == end
                end += length
            assert end <= capacity
        least = -(-sum(x * c for x, c in histogram.items()) // capacity)
        big = sum(c for x, c in histogram.items() if 2 * x > capacity)
        assert len(seats) <= max(least, big) * 1.03 + 1


def test_exact_complement_is_taken_first():
    assert len({r[4] for r in packing.plan({60: 1, 50: 1, 40: 1, 30: 1, 20: 1}, 100)}) == 2


def packed_by_hand(histogram, capacity):
    """One sequence after the other: the longest opens, then one, two or three lengths that fill the gap exactly, found by trying
    all, else the longest that fits."""
    left, made = Counter(histogram), Counter()
    while +left:
        own = [max(+left)]
        left[own[0]] -= 1
        while gap := capacity - sum(own):
            lengths = sorted((x for x in +left if x <= gap), reverse=True)
            ways = [c for n in (1, 2, 3) for c in combinations_with_replacement(lengths, n) if sum(c) == gap and not Counter(c) - left]
            tail = ways[0] if ways else lengths[:1]
            if not tail:
                break
            own += tail
            left -= Counter(tail)
        made[tuple(sorted(own))] += 1
    return made


def test_plan_against_trying_all_combinations():
    rng = random.Random(19)
    for capacity, top, n in ((30, 30, 60), (30, 12, 80), (50, 40, 60), (24, 5, 50), (40, 20, 1)):
        for _ in range(8):
            histogram = Counter(rng.randint(1, top) for _ in range(n))
            seats = defaultdict(list)
            for length, _, sequence, _ in laid_out(packing.plan(histogram, capacity)):
                seats[sequence].append(length)
            assert Counter(tuple(sorted(x)) for x in seats.values()) == packed_by_hand(histogram, capacity)


def test_query(spark):
    docs = hard_docs(spark)
    got = packing.query(docs).collect()
    pieces = Counter()
    for r in hard_rows():
        ids = np.append(bpe.codec(bpe.VOCABULARY).encode(r[1] or ""), 0).astype("<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            pieces[(r[0], k, start, length, zlib.crc32(ids[start : start + length].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        ends = [0]
        for offset, length in sorted(items):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= packing.CAPACITY
    assert len(by) <= -(-sum(r["length"] for r in got) // packing.CAPACITY) + 1
    assert packing.query(no_docs(spark)).count() == 0
