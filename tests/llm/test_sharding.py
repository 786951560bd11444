import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import common, sharding


def test_law_slots_and_columns(spark):
    got = sharding.query(hard_docs(spark)).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in hard_rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(sharding.SHARDS))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = {len(x) for x in slots.values()}
    assert max(counts) - min(counts) <= 1
    assert sharding.query(no_docs(spark)).count() == 0


def test_order_against_brute_force(spark, monkeypatch):
    """Shuffled ranks within sources, fractional ranks, one order, equal cuts: by hand from the seeded hashes."""
    monkeypatch.setattr(sharding, "SORTED_TOGETHER", 7)
    monkeypatch.setattr(common, "SLICES_TOGETHER", 3)
    docs = hard_docs(spark).unionByName(spark.range(300).selectExpr("1000 + id as doc_id", "concat('t', id % 50) as text", "if(id < 200, 'hot', concat('one', id div 2)) as source"), allowMissingColumns=True)
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(sharding.SEED), "doc_id", "text_crc32", "size"), 2).alias("shuffled")
    got = sharding.shard(docs).select("*", hashed, sharding.phase(sharding.SEED).alias("phase")).collect()
    phases = {r["source_key"]: r["phase"] for r in got}
    assert all(0 <= x < 1 for x in phases.values())
    own = lambda r: (r["shuffled"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"])
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source_key"]].append(own(r))
    order = sorted(((rank + phases[source]) / len(rows), source, *row) for source, rows in by_source.items() for rank, row in enumerate(sorted(rows)))
    n = len(order)
    want = Counter()
    for at, (_, source, *row) in enumerate(order):
        shard = at * sharding.SHARDS // n
        want[(source, *row, shard, at - -(-shard * n // sharding.SHARDS))] += 1
    assert Counter((r["source_key"], *own(r), r["shard"], r["slot"]) for r in got) == want


def test_every_shard_has_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SORTED_TOGETHER", 50)  # several slices
    docs = spark.range(1200).selectExpr("id as doc_id", "concat('t', id) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    rows = sharding.shard(docs).collect()
    overall = Counter(r["source_key"] for r in rows)
    by = defaultdict(Counter)
    for r in rows:
        by[r["shard"]][r["source_key"]] += 1
    for own in by.values():
        for source, n in overall.items():
            assert abs(own[source] - n / sharding.SHARDS) <= 2
    again = sharding.shard(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_sources_are_spread(spark):
    """One source of half the rows, and as many sources of one row each."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat('t', id) as text", "if(id < 20000, 'hot', concat('s', id)) as source")
    small = Counter(r["shard"] for r in sharding.shard(docs).where("source_key <> 'vhot'").select("shard").collect())
    assert set(small) == set(range(sharding.SHARDS))
    assert max(small.values()) < 1.1 * 20_000 / sharding.SHARDS and min(small.values()) > 0.9 * 20_000 / sharding.SHARDS
