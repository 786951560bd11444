"""Labels to canonical keys: closed sets, ordered rules, and a quarantine for all that is not accepted.

Nothing is dropped: every raw row is either accepted or quarantined with a reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions import text as fn
from tieout.operators.matcher import match_rules
from tieout.schemas import allowed_keys, dim_keys
from tieout.session import bounded_batches
from tieout.sources.scratch import settle

ROW = ["doc_id", "page", "row_ord"]
#: A normalizer gives (doc_id, page, row_ord, canonical_key, unit, confidence, method) for the rows it can map.
Normalizer = Callable[[DataFrame], DataFrame]


def with_statement(rows: DataFrame) -> DataFrame:
    """PF4, SC7: the statement of a page, read from its first row."""
    first = rows.groupBy("doc_id", "page").agg(F.min_by("section_title", "row_ord").alias("_title"))
    return rows.join(first, ["doc_id", "page"]).withColumn("statement", fn.statement_for(F.col("_title"))).drop("_title")


def alias_map(rows: DataFrame, aliases: DataFrame, keys: list[str] = ROW, label: str = "raw_label", context: str = "context") -> DataFrame:
    """Rows (keys, canonical_key) by the best matching rule, null where none matches.

    A row in a footnote block is mapped by that block alone. Else priorities come first, in order, then the
    statement's own rules, the longest needle first. No row meets a rule whose needle its label does not hold.
    """
    own = rows.select(*keys, F.col(label).alias("_l"), F.col(context).alias("_c"), F.col("statement").alias("_s"))
    return match_rules(own, aliases, F.col("_l"), F.col("_c"), F.col("_s")).select(*keys, "canonical_key")


def context_of(path: Column) -> Column:
    return F.array_join(path, " > ")


def by_alias(aliases: DataFrame) -> Normalizer:
    """The deterministic normalizer."""

    def run(rows: DataFrame) -> DataFrame:
        unit = fn.guess_unit(F.col("raw_label"), F.col("source_line"), F.col("values")).alias("unit")
        own = rows.select(*ROW, "raw_label", context_of(F.col("section_path")).alias("context"), F.col("statement").alias("stated"), unit)
        mapped = match_rules(own, aliases, F.col("raw_label"), F.col("context"), F.col("stated")).where("canonical_key is not null")
        return mapped.select(*ROW, "canonical_key", "unit", F.lit(1.0).alias("confidence"), F.lit("alias").alias("method"))

    return run


def by_mapping(mapping: DataFrame) -> Normalizer:
    """U1, SRC6: mappings made elsewhere (by a model, or by hand), keyed by row; values are never taken from them."""
    return lambda rows: rows.select(*ROW).join(mapping, ROW)


def requests(rows: DataFrame, model_name: str = "") -> DataFrame:
    """U1, SC14: one request a page for a model: labels with up to three sample values, and its hash, which a change of page,
    labels, values or model changes."""
    line = F.struct("row_ord", "raw_label", context_of(F.col("section_path")).alias("context"), F.slice(F.filter(F.map_values("values"), lambda v: v.isNotNull()), 1, 3).alias("samples"))
    page = with_statement(rows).where("statement is not null").groupBy("doc_id", "page", "statement").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return page.withColumn("request_hash", fn.request_hash(F.lit(model_name).alias("model"), F.col("page"), F.col("statement"), F.col("lines")))


#: A caller's model: the statement of a page, the keys allowed there and the page's lines (row_ord, raw_label, context, samples)
#: to answers (row_ord, canonical_key, unit, confidence). It runs in the tasks.
Model = Callable[[str, list[str], list[dict]], list[dict]]
ANSWERS = "array<struct<row_ord: int, canonical_key: string, unit: string, confidence: double>>"


def _answer_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    keys: dict[str, list[str]] = {}
    for statement, key, _ in allowed_keys():
        keys.setdefault(statement, []).append(key)
    columns = [("row_ord", pa.int32()), ("canonical_key", pa.string()), ("unit", pa.string()), ("confidence", pa.float64())]
    for batch in batches:
        pages = zip(batch.column("statement").to_pylist(), batch.column("lines").to_pylist())
        made = [[{c: a.get(c) for c, _ in columns} for a in model(s, keys.get(s, []), lines)] for s, lines in pages]
        yield pa.RecordBatch.from_pydict({"request_hash": batch.column("request_hash"), "answers": pa.array(made, pa.list_(pa.struct(columns)))})


def ask(wanted: DataFrame, model: Model) -> DataFrame:
    """Rows (request_hash, answers), each distinct request put to the model once. What it answers is checked like any mapping:
    normalize() quarantines keys outside the closed set, and values are never taken from it."""
    once = bounded_batches(wanted).groupBy("request_hash").agg(F.first("statement").alias("statement"), F.first("lines").alias("lines"))
    return once.mapInArrow(partial(_answer_batches, model=model), f"request_hash string, answers {ANSWERS}")


def by_model(rows: DataFrame, model: Model, cache: DataFrame | None = None, model_name: str = "") -> tuple[Normalizer, DataFrame]:
    """U1, SRC6: a normalizer by a caller's model, and the answers that are new, to be appended to the cache (SNK10).

    cache has earlier answers (request_hash, answers); a page found there is not put to the model, in whatever document it stands.
    """
    wanted = settle(requests(rows, model_name), "requests")
    if cache is None:
        cache = rows.sparkSession.createDataFrame([], f"request_hash string, answers {ANSWERS}")
    known = cache.groupBy("request_hash").agg(F.first("answers").alias("answers"))
    fresh = settle(ask(wanted.join(known, "request_hash", "left_anti"), model), "answers")
    answered = wanted.join(known.unionByName(fresh), "request_hash").select("doc_id", "page", F.inline("answers"))
    mapping = answered.where("canonical_key is not null").withColumn("method", F.lit("model"))
    return by_mapping(mapping), fresh


#: Counts over judged rows that can be taken as they are written: accepted rows, line items, whether a model made labels, and rows held.
def judged_counts() -> dict[str, Column]:
    fits = F.col("reason").isNull()
    return {
        "rows": F.count(F.lit(1)),
        "items": F.coalesce(F.sum(F.when(fits, F.size("values"))), F.lit(0)),
        "by_model": F.coalesce(F.bool_or(fits & (F.col("method") != "alias")), F.lit(False)),
        "held": F.count_if(~fits),
    }


def judge(rows: DataFrame, normalizer: Normalizer, keys: DataFrame | None = None) -> DataFrame:
    """Raw rows with statement, canonical_key, unit, confidence and method, and in reason why a row is not accepted.

    A key is accepted once a page, for its first row (AG7); of several mappings of one row the first by key counts.
    """
    dim = dim_keys(rows.sparkSession) if keys is None else keys
    known = with_statement(rows)
    mapped = normalizer(known.where("statement is not null"))
    one = mapped.groupBy(*ROW).agg(F.min(F.struct("canonical_key", "unit", "confidence", "method")).alias("m")).select(*ROW, "m.*")
    joined = known.join(one, ROW, "left").join(F.broadcast(dim.withColumn("_allowed", F.lit(True))), ["statement", "canonical_key"], "left")
    same_key = Window.partitionBy("doc_id", "page", "_allowed", "canonical_key").orderBy("row_ord")
    ranked = joined.withColumn("_nth", F.when(F.col("_allowed"), F.row_number().over(same_key)))
    reason = (
        F.when(F.col("statement").isNull(), "unknown statement")
        .when(F.col("canonical_key").isNull(), "not mapped")
        .when(F.col("_allowed").isNull(), "key not allowed")
        .when(F.col("_nth") > 1, "key repeated")
    )
    judged = ranked.withColumn("reason", reason)
    return judged.withColumn("statement", F.when(F.col("reason").isNull(), F.col("stored_statement")).otherwise(F.col("statement"))).drop("_allowed", "_nth", "stored_statement")


def parted(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of judged rows."""
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").drop("unit", "confidence", "method")


def normalize(rows: DataFrame, normalizer: Normalizer, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) of raw rows; see judge. quarantined has all that is not accepted, and why."""
    return parted(judge(rows, normalizer, keys))


def line_items(accepted: DataFrame, company: Column, ticker: Column, source_file: Column) -> DataFrame:
    """SNK2: the long model, one row for each accepted row and period; nil values stay null."""
    return accepted.select("*", F.explode("values").alias("period", "value")).select(
        company.alias("company"),
        ticker.alias("ticker"),
        source_file.alias("source_file"),
        "statement",
        "canonical_key",
        F.col("raw_label").alias("label"),
        "period",
        fn.period_sort(F.col("period")).alias("period_sort"),
        "value",
        "unit",
        "page",
        "source_line",
        F.col("confidence").cast("double").alias("confidence"),
        "method",
    )


def quarantine_rows(quarantined: DataFrame, company: Column) -> DataFrame:
    """SNK3."""
    return quarantined.select(company.alias("company"), "page", F.col("section_title").alias("section"), "raw_label", "source_line", "reason", "row_ord")


def first_value(items: DataFrame, groups: list[str], order: str, value: str = "value") -> DataFrame:
    """The first value by order, null if that one is null."""
    return items.groupBy(*groups).agg(F.min_by(value, order).alias(value))


def series(items: DataFrame, entity: list[str], order: str) -> DataFrame:
    """PF8: period to value of each key, first values, without nulls."""
    first = first_value(items, [*entity, "canonical_key", "period", "period_sort"], order).where("value is not null")
    entries = F.array_sort(F.collect_list(F.struct("period_sort", "period", "value")))
    return first.groupBy(*entity, "canonical_key").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["period"], e["value"]))).alias("series"))
