"""What the operators share: scratch tables, exact distributed ranks, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.session import bounded_batches
from tieout.sources.scratch import discard
from tieout.sources.scratch import settle as write_table

__all__ = ["bounded_batches", "connected_components", "crc32_of_bytes", "discard", "exact_rank", "free_name", "group_key", "join_hot", "key_filter", "lower", "passes", "slices_for", "text_or_empty", "write_table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc32_of_bytes(df: DataFrame) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of text (null: of no bytes)."""
    return F.crc32(F.encode(text_or_empty(), "UTF-8"))


def group_key(name: str) -> Column:
    """A never-null string for grouping and joining, null apart from every value."""
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(name).cast("string")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name like base that df does not have, in any spelling."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key is hot if it has more than one in so many of the rows; so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner", merge: bool = False) -> DataFrame:
    """left joined with right, which has one row for each key and in count the number of left's rows of that key.

    Hot keys, fewer than HOT_SHARE whatever the input, are sent to all tasks, so their rows stay where they are; only the
    others are dealt by key; with merge at every size, not only where right looks large. Both sides are read twice: right should be a
    written table, and left one, or cheap to make.
    """
    rows = right.select(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) * HOT_SHARE > rows
    few = left.join(F.broadcast(right.where(hot)), keys)
    others = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti").join(right.where(~hot).hint("merge") if merge else right.where(~hot), keys, how)
    return few.unionByName(others).drop(count)


#: Bits of one row of a filter of keys, as bitmap_construct_agg makes them.
ROW_BITS = 1 << 15
#: Bits of a filter, whatever the number of its keys: not quite 8 MB. It is full, and lets all pass, where keys are many more than bits.
FILTER_BITS = 1900 * ROW_BITS


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A filter of a table's keys (long) of one size for any table: FILTER_BITS / ROW_BITS rows at most."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    made = keys.groupBy(F.floor(place / ROW_BITS).cast("int").alias("_filter")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(ROW_BITS))).alias("_bits"))
    return write_table(made.coalesce(1), "key_filter")


def passes(df: DataFrame, made: DataFrame, key: str, name: str) -> DataFrame:
    """df with the boolean column name: false where a filter is sure not to hold the key."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    at = F.pmod(place, F.lit(ROW_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    row = df.withColumn("_filter", F.floor(place / ROW_BITS).cast("int")).withColumn("_at", at)
    joined = row.join(F.broadcast(made), "_filter", "left")
    return joined.withColumn(name, F.coalesce(F.call_function("shiftright", byte, F.pmod(F.col("_at"), F.lit(8))).bitwiseAND(1) == 1, F.lit(False))).drop("_filter", "_at", "_bits")


def slices_for(rows: int, per_slice: int) -> int:
    """Slices so that one holds about per_slice rows, whatever the number of rows."""
    return max(1, -(-rows // per_slice))


#: Slices whose counts are summed up together.
SLICES_TOGETHER = 4096


def exact_rank(df: DataFrame, groups: list[str], slice_col: str, order: list[str], rank: str, total: str) -> DataFrame:
    """Add rank (from 0 in its group, ordered by slice_col and then order) and total (rows of the group).

    slice_col must follow the order. No group meets in one task: only a slice of one is sorted together. The slices' counts
    are summed up by blocks of slices, so not even they meet in one task, and give the offsets.
    """
    keys, block = [*groups, slice_col], [*groups, "_block"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col(slice_col) / SLICES_TOGETHER))
    blocks = counts.groupBy(*block).agg(F.sum("_n").alias("_of_block"))
    before = Window.partitionBy(*groups).orderBy("_block")
    placed = blocks.select(*block, (F.sum("_of_block").over(before) - F.col("_of_block")).alias("_blocks_before"), F.sum("_of_block").over(Window.partitionBy(*groups)).alias(total))
    before = Window.partitionBy(*block).orderBy(slice_col)
    summed = counts.select(*keys, "_block", (F.sum("_n").over(before) - F.col("_n")).alias("_in_block"))
    offsets = summed.join(placed, block).select(*keys, (F.col("_blocks_before") + F.col("_in_block")).alias("_before"), total)
    within = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return within.join(offsets, keys).withColumn(rank, F.col("_before") + F.col("_at") - 1).drop("_before", "_at")


def connected_components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for the nodes of edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds; every round is written to the shared folder, the driver sees
    only counts. An edge list without change is a set of stars, and the answer.
    """
    now = write_table(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name
    )
    # an order-free mark of a table's rows
    mark = F.struct(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0)))
    seen = now.select(mark).first()
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("m", "hi").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.unionByName(least.where("m < hi").select("hi", F.col("m").alias("lo"))).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .distinct()
        )
        later = write_table(small, name)
        before, seen = seen, later.select(mark).first()
        discard(now)
        if seen == before:
            return later.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                later.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        now = later
    raise RuntimeError(f"components of {name} have not settled in {most_rounds} rounds")
