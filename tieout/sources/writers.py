"""Sinks."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """SNK1-SNK3: tables as Parquet under path, each overwritten as a whole. Empty tables are written too."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if keys := (partition_by or {}).get(name):
            writer = writer.partitionBy(*keys)
        writer.parquet(f"{path}/{name}")


def filing_json(header: DataFrame, items: DataFrame, quarantined: DataFrame, entity: list[str], path: str) -> None:
    """SNK5: one JSON document for each entity, with its items and its quarantine, which may be empty."""
    item = [c for c in items.columns if c not in entity]
    held = [c for c in quarantined.columns if c not in entity]
    a = items.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("line_items"))
    b = quarantined.groupBy(*entity).agg(F.array_sort(F.collect_list(F.struct(*held))).alias("quarantined"))
    whole = header.join(a, entity, "left").join(b, entity, "left")
    empty = {c: F.coalesce(c, F.array().cast(whole.schema[c].dataType)) for c in ("line_items", "quarantined")}
    whole.withColumns(empty).write.mode("overwrite").json(path)


def amounts_csv(df: DataFrame, path: str) -> None:
    """SNK9: header, UTF-8, amounts with two decimals."""
    df.write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def append_mappings(mappings: DataFrame, path: str) -> None:
    """SNK10: mappings, or a model's new answers, go to those recorded before."""
    mappings.write.mode("append").parquet(path)


def records(df: DataFrame, most: int = 10_000) -> list[dict]:
    """SRC7: a bounded report as dictionaries; more rows than that are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return [r.asDict(recursive=True) for r in rows]


def html_table(df: DataFrame, most: int = 10_000) -> str:
    """SNK8."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in records(df, most))
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def exit_code(checks: DataFrame | int, strict: bool) -> int:
    """SNK11: 1 if any check failed and strict; of checks, or of the number that failed, counted as they were written."""
    failed = checks if isinstance(checks, int) else strict and not checks.where(~F.col("passed")).isEmpty()
    return int(strict and bool(failed))
