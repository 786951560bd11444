"""SNK6, U7, U8: one HTML file: cards, stacked bars as inline SVG, tables of bounded views, and all quarantined rows."""

from __future__ import annotations

import html
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.functions.text import escaped
from tieout.operators.checks import summarize
from tieout.operators.normalize import judged_counts
from tieout.sources.scratch import join_files, remove, scratch_dir, settle_counting
from tieout.sources.writers import records

SOURCES = [("delta_debt", "Debt"), ("delta_deferred_revenue", "Customers"), ("delta_apic", "Paid-in capital"), ("retained_earnings_change", "Earnings"), ("delta_aoci", "Other income")]
COLOURS = ["#31688e", "#35b779", "#fde725", "#440154", "#90a4ae"]
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}td,th{padding:.2em .7em;border-bottom:1px solid #ccc;text-align:right}.card{display:inline-block;margin-right:2em}.bad{color:#b00}"


def amount(value: float | None, decimals: int = 0) -> str:
    """SC11 for values that are on the driver already."""
    if value is None:
        return "—"
    shown = f"{abs(value):,.{decimals}f}"
    return f"({shown})" if value < 0 else shown


def bars(funding: DataFrame) -> DataFrame:
    """(period, source, value, low, high) of the stacked bars: gains go up from zero, losses down, in the order of SOURCES.
    All sums are columns, so it is one pass over the view."""
    value = [F.coalesce(F.col(c), F.lit(0.0)) for c, _ in SOURCES]
    parts = []
    for k, (column, label) in enumerate(SOURCES):
        up = sum((F.greatest(v, F.lit(0.0)) for v in value[:k]), F.lit(0.0))
        down = sum((F.least(v, F.lit(0.0)) for v in value[:k]), F.lit(0.0))
        start = F.when(value[k] >= 0, up).otherwise(down)
        ends = (start, start + value[k])
        parts.append(F.struct(F.lit(k).alias("k"), F.lit(label).alias("source"), F.col(column).alias("value"), F.least(*ends).alias("low"), F.greatest(*ends).alias("high")))
    known = funding.where("delta_assets is not null")
    return known.select("period", "period_sort", F.explode(F.array(*parts)).alias("b")).select("period", "period_sort", "b.*")


def chart(funding: DataFrame, height: int = 260, width: int = 90) -> list[str]:
    """The bars as lines of SVG."""
    rows = sorted(records(bars(funding)), key=lambda r: (r["period_sort"], r["k"]))
    if not rows:
        return []
    low, high = min(0.0, *(r["low"] for r in rows)), max(0.0, *(r["high"] for r in rows))
    y = lambda v: 20 + (high - v) / ((high - low) or 1) * height
    periods = list(dict.fromkeys(r["period"] for r in rows))
    shapes = [f'<svg width="{width * len(periods)}" height="{height + 45}">', f'<line x1="0" x2="{width * len(periods)}" y1="{y(0):.1f}" y2="{y(0):.1f}" stroke="#333"/>']
    for r in rows:
        x = width * periods.index(r["period"]) + width * 0.2
        shapes.append(f'<rect x="{x:.1f}" y="{y(r["high"]):.1f}" width="{width * 0.6:.1f}" height="{max(0.0, y(r["low"]) - y(r["high"])):.1f}" fill="{COLOURS[r["k"]]}"><title>{html.escape(r["source"])} {amount(r["value"])}</title></rect>')
    shapes += [f'<text x="{width * (i + 0.5):.1f}" y="{height + 38}" text-anchor="middle">{html.escape(p)}</text>' for i, p in enumerate(periods)]
    legend = "".join(f'<span style="color:{c}">■</span> {html.escape(s)} ' for c, (_, s) in zip(COLOURS, SOURCES))
    return [*shapes, "</svg>", f"<p>{legend}</p>"]


def head_of(columns: Iterable[str]) -> str:
    return "<table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in columns) + "</tr>"


def table(rows: list[dict], decimals: int = 0) -> list[str]:
    """A bounded table, a line a row."""
    cell = lambda v: amount(v, decimals) if isinstance(v, float) else html.escape("—" if v is None else str(v))
    body = ["<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows]
    return [head_of(rows[0]), *body, "</table>"] if rows else ["<p>none</p>"]


def row_of(columns: Iterable[str]) -> Column:
    """The same line made in the tasks, of columns of text and whole numbers."""
    cells = [F.concat(F.lit("<td>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit("—"))), F.lit("</td>")) for c in columns]
    return F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


#: (settled judged rows and checks, their counts)
Settled = tuple[DataFrame, DataFrame, dict]


def settled(judged: DataFrame, checks: Callable[[DataFrame], DataFrame]) -> Settled:
    """Judged rows (normalize.judge) and the checks made of them, each written once; what the report counts is counted on the way."""
    rows, seen = settle_counting(judged, "judged", **judged_counts())
    made, passed = settle_counting(checks(rows), "checks", passed=F.count_if("passed"), checks=F.count("passed"))
    return rows, made, seen | passed


def cards(counts: dict) -> list[tuple[str, str]]:
    """AG9, AG10: (card, value) of the report's head, in order: counts, checks passed of all, and who made the labels."""
    return [
        ("line items", str(counts["items"])),
        ("checks", f"{counts['passed']}/{counts['checks']}"),
        ("quarantined", str(counts["held"])),
        ("labels", "model" if counts["by_model"] else "rules"),
    ]


HELD = ["page", "raw_label", "source_line", "reason"]


def lines(title: str, counts: dict, checks: DataFrame, funding: DataFrame, efficiency: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Rows (section, part, page, row_ord, html): the whole report. The quarantined rows, of which there is any number, are made into
    lines where they are; the other sections are bounded reports."""
    summary = records(summarize(checks).orderBy(F.col("name").isNotNull(), "name"))
    sections = [
        [
            f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body>",
            f"<h1>{html.escape(title)}</h1>",
            *[f'<div class="card"><b>{html.escape(v)}</b><br>{html.escape(k)}</div>' for k, v in [("rows", str(counts["rows"])), *cards(counts)]],
        ],
        ["<h2>Funding mix</h2>", *chart(funding), *table(records(funding.where("delta_assets is not null").orderBy("period_sort").drop("period_sort")), 1)],
        ["<h2>Growth and efficiency</h2>", *table(records(efficiency.orderBy("period_sort").drop("period_sort")), 3)],
        ["<h2>Checks</h2>", *table([r for r in summary if r["name"] is not None])],
        ["<h2>Quarantine</h2>", f"<p>{counts['held']} rows</p>", *([head_of(HELD)] if counts["held"] else [])],
        [*(["</table>"] if counts["held"] else []), "</body></html>"],
    ]
    known = [(k, n, None, None, line) for k, own in enumerate(sections) for n, line in enumerate(own)]
    fixed = funding.sparkSession.createDataFrame(known, "section int, part int, page int, row_ord int, html string")
    held = quarantined.select(F.lit(4).alias("section"), F.lit(1 << 20).alias("part"), "page", "row_ord", row_of(HELD).alias("html"))
    return fixed.unionByName(held)


def write(report: DataFrame, path: str) -> None:
    """SNK6: the lines as one file, in order. Tasks sort and write ranges of them, which are then joined."""
    spark = report.sparkSession
    folder = f"{scratch_dir(spark)}/report-{uuid.uuid4().hex}"
    report.orderBy("section", "part", "page", "row_ord", "html").select("html").write.option("compression", "none").text(folder)
    join_files(spark, folder, path)
    remove(spark, folder)
