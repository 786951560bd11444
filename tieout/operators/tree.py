"""Nested ledger reports to flat tables, walked a few levels at a time, whatever their size and depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.sources.scratch import settle

#: Levels that one pass walks before its rows are written.
LEVELS = 3


def _children(nodes: DataFrame) -> DataFrame:
    own = nodes.select("report_id", "path", F.posexplode(F.expr("try_variant_get(node, '$.Rows.Row', 'array<variant>')")).alias("at", "node"))
    return own.select("report_id", F.concat("path", F.array("at")).alias("path"), "node")


def flatten(reports: DataFrame) -> DataFrame:
    """(report_id, path, cells) of every node with cells, from reports (report_id, body) of JSON text.

    A node comes before its children; path orders them. Only ColData and Rows.Row are followed; a cell without a value is an
    empty string. The driver sees only whether a level is left.
    """
    front = reports.select("report_id", F.array().cast("array<int>").alias("path"), F.parse_json("body").alias("node"))
    walked = []
    while True:
        levels = [_children(front)]
        for _ in range(LEVELS - 1):
            levels.append(_children(levels[-1]))
        # the last level is walked on from, so only it keeps its nodes whole
        cells = F.expr("try_variant_get(node, '$.ColData', 'array<struct<value: string>>')").alias("data")
        rows = [x.select("report_id", "path", cells, (F.col("node") if k == LEVELS else F.lit(None).cast("variant")).alias("node"), F.lit(k).alias("level")) for k, x in enumerate(levels, 1)]
        walked.append(settle(reduce(DataFrame.unionByName, rows), "report_levels"))
        front = walked[-1].where(F.col("level") == LEVELS).select("report_id", "path", "node")
        if front.isEmpty():
            break
    found = reduce(DataFrame.unionByName, [x.select("report_id", "path", "data") for x in walked])
    return found.where("data is not null").select("report_id", "path", F.transform("data", lambda c: F.coalesce(c["value"], F.lit(""))).alias("cells"))


def titles(reports: DataFrame) -> DataFrame:
    """(report_id, titles): a blank title is the account's."""
    found = F.from_json("body", "struct<Columns: struct<Column: array<struct<ColTitle: string>>>>")["Columns"]["Column"]
    named = F.transform(found, lambda c: F.when(F.coalesce(c["ColTitle"], F.lit("")) == "", "Account").otherwise(c["ColTitle"]))
    return reports.select("report_id", named.alias("titles"))


def cells(reports: DataFrame) -> DataFrame:
    """(report_id, path, title, value), one row for each cell."""
    named = flatten(reports).join(titles(reports), "report_id")
    return named.select("report_id", "path", F.explode(F.arrays_zip("titles", "cells")).alias("c")).select("report_id", "path", F.col("c.titles").alias("title"), F.col("c.cells").alias("value"))


def to_table(reports: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each node, one string column for each title; in the report's order."""
    named = flatten(reports).join(titles(reports), "report_id")
    column = lambda c: F.get("cells", F.array_position("titles", c) - 1).alias(c)
    return named.select("report_id", "path", *[column(c) for c in columns]).orderBy("report_id", "path")
