"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is (rank + phase) over the
source's rows, the phase, from 0 to 1, being a seeded hash of the source, so that small sources do not all stand in the middle;
all rows are ordered by it and cut into shards whose counts differ by one at most. So each shard, and each prefix of
one, has the sources in the proportions of the whole corpus, and sources of few rows are spread over all shards.

Both ranks are exact and distributed: slices of the hash and of the fractional rank are sorted by themselves and
offset by counts of the slices, so that neither a hot source nor the whole table nor its small sources meet in one task.

Null sources form a source of their own, null texts are empty; rows alike in all columns read are told apart by no one
and take neighbouring places. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import crc32_of_bytes, exact_rank, group_key, slices_for, text_or_empty, write_table

SHARDS = 24
SEED = 20240229
SORTED_TOGETHER = 500
#: What a record takes besides its text.
FRAMING_BYTES = 8


def phase(seed: int) -> Column:
    """Of a source, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("phase"), "source_key"), 11) / F.lit(float(2**53))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, size, text_crc32, source_key, shard, slot) of documents (doc_id, text, source)."""
    rows = write_table(
        docs.select(
            "doc_id",
            (F.octet_length(text_or_empty()) + F.lit(FRAMING_BYTES)).cast("long").alias("size"),
            crc32_of_bytes(docs).alias("text_crc32"),
            group_key("source").alias("source_key"),
        ).withColumn("shuffled", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"), 2)),
        "shard_rows",
    )
    slices = slices_for(rows.count(), SORTED_TOGETHER)
    width = 2**62 // slices + 1
    tie = ["shuffled", "doc_id", "text_crc32", "size"]
    sliced = rows.withColumn("slice", F.expr(f"shuffled div {width}L"))
    in_source = exact_rank(sliced, ["source_key"], "slice", tie, "rank", "of_source").drop("slice")
    interleaved = write_table(
        in_source.withColumn("fraction", (F.col("rank") + phase(seed)) / F.col("of_source"))
        .withColumn("slice", F.floor(F.col("fraction") * slices).cast("long"))
        .drop("rank", "of_source"),
        "shard_order",
    )
    ranked = exact_rank(interleaved, [], "slice", ["fraction", "source_key", *tie], "at", "of_all")
    k = F.expr(f"(at * {shards}) div of_all")
    return (
        ranked.withColumn("shard", k.cast("int"))
        .withColumn("slot", F.expr(f"at - (shard * of_all + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", "source_key", "shard", "slot")
    )


def query(docs: DataFrame) -> DataFrame:
    return shard(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source_key",
    )
