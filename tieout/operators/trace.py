"""Where a metric comes from: periods, printed lines, confidence, and the columns that depend on a key."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.text import trace_number
from tieout.session import bounded_batches

#: Suggestions for a key, and the least ratio of one.
SUGGESTIONS, CUTOFF = 6, 0.4
#: Known keys of so many letters in all are sent to all tasks; more meet the unknown ones by a merge join.
SENT_LETTERS = 1 << 20


def letters(key: Column) -> Column:
    """The multiset of a key's letters: each with its occurrence, so that a set has them all."""
    all_of = F.filter(F.split(key, ""), lambda x: x != "")
    return F.transform(all_of, lambda x, i: F.concat(x, F.size(F.filter(F.slice(all_of, F.lit(1), i + 1), lambda y: y == x)).cast("string")))


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    like = difflib.SequenceMatcher()
    for batch in batches:
        found, last = [], None
        for key, known in zip(batch.column("key").to_pylist(), batch.column("known").to_pylist()):
            if key != last:
                like.set_seq2(key)
                last = key
            like.set_seq1(known)
            found.append(like.ratio())
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("known"), pa.array(found, pa.float64())], ["key", "known", "ratio"])


def suggestions(unknown: DataFrame, known: DataFrame, n: int = SUGGESTIONS, cutoff: float = CUTOFF) -> DataFrame:
    """Rows (key, nth, suggestion): for each distinct key of unknown (key) the n keys of known (key) that are most like it, by
    the ratio of the standard library's matcher, cutoff at least; of equal ratios the later key first.

    An inverted index of letters finds candidates: keys whose ratio reaches the cutoff share that many letters. The ratio itself
    is worked out for those alone. Null keys have none.
    """

    def own(df: DataFrame, name: str) -> DataFrame:
        keys = df.where("key is not null").select(F.col("key").alias("text")).distinct()
        return keys.select(F.col("text").alias(name), F.length("text").alias(f"{name}_length"), F.explode(letters(F.col("text"))).alias("letter"))

    index = own(known, "known")
    if (known.agg(F.sum(F.length("key"))).first()[0] or 0) <= SENT_LETTERS:
        index = F.broadcast(index)
    shared = own(unknown, "key").join(index, "letter").groupBy("key", "key_length", "known", "known_length").agg(F.count(F.lit(1)).alias("shared"))
    candidates = shared.where(2.0 * F.col("shared") / (F.col("key_length") + F.col("known_length")) >= cutoff).select("key", "known")
    ratios = bounded_batches(candidates).mapInArrow(_ratios, "key string, known string, ratio double").where(F.col("ratio") >= cutoff)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ratio"), F.desc("known"))) - 1
    return ratios.withColumn("nth", nth).where(F.col("nth") < n).select("key", "nth", F.col("known").alias("suggestion"))


def provenance(items: DataFrame, entity: list[str]) -> DataFrame:
    """AG4, AG5: for each key the distinct statements, units, methods and printed lines, and the least confidence."""
    distinct = lambda c: F.array_sort(F.collect_set(c))
    return items.groupBy(*entity, "canonical_key").agg(
        distinct("statement").alias("statements"),
        distinct("unit").alias("units"),
        distinct("method").alias("methods"),
        distinct("source_line").alias("source_lines"),
        F.min("confidence").alias("least_confidence"),
        F.count(F.lit(1)).alias("n_values"),
    )


def values_of(items: DataFrame, key: str, entity: list[str]) -> DataFrame:
    """PF7: a key's values by statement and period, as printed."""
    return items.where(F.col("canonical_key") == key).select(*entity, "statement", "period", "period_sort", trace_number(F.col("value")).alias("shown"), "page", "label").orderBy("statement", "period_sort")


def unpivot(view: DataFrame, entity: list[str], name: str) -> DataFrame:
    """Rows (entity, period, period_sort, view, column, value) of a wide view, nulls included."""
    ids = [*entity, "period", "period_sort"]
    columns = [c for c in view.columns if c not in ids and not c.endswith("_reported")]
    return view.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, "column", "value").withColumn("view", F.lit(name))


def dependents(lineage: DataFrame, views: dict[str, DataFrame], entity: list[str], key: str) -> DataFrame:
    """All values of all columns that depend on a key, by one join with the lineage."""
    hit = lineage.where(F.col("canonical_key") == key).select("view", "column").distinct()
    long = None
    for name, view in views.items():
        own = unpivot(view, entity, name)
        long = own if long is None else long.unionByName(own)
    return long.join(F.broadcast(hit), ["view", "column"])


def quarantine_note(quarantined: DataFrame, key: str) -> DataFrame:
    """Quarantined rows whose label holds the key's words."""
    return quarantined.where(F.lower("raw_label").contains(key.replace("_", " ")))
