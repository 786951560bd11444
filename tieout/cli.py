"""U4: words of a document to facts, checks, views and reports.

    python -m tieout.cli DOCUMENT [--db DIR] [--json DIR] [--html FILE] [--trace KEY] [--strict] ...

DOCUMENT is a PDF, or a Parquet table of positioned words (see schemas.WORDS).
"""

from __future__ import annotations

import argparse
import importlib
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout import report, schemas
from tieout.operators import checks, layout, metrics, normalize, rules, trace
from tieout.session import session
from tieout.sources import readers, writers
from tieout.sources.scratch import settle

ENTITY = ["company"]


class Filing:
    """What one run makes; all of it DataFrames."""

    def __init__(self, words: DataFrame, company: str, ticker: str, source: str, mapping: DataFrame | None = None, model: str | None = None, cache: str | None = None):
        spark = words.sparkSession
        self.raw = settle(layout.extract(words, company.upper()), "raw_rows")
        normalizer = normalize.by_mapping(mapping) if mapping is not None else normalize.by_alias(rules.dim_alias(spark))
        if model:
            normalizer, fresh = normalize.by_model(self.raw, named(model), readers.cached_answers(spark, cache) if cache else None, model)
            if cache:
                writers.append_mappings(fresh, cache)
        name = F.lit(company)
        items = lambda judged: normalize.line_items(normalize.parted(judged)[0], name, F.lit(ticker), F.lit(source))
        proof = lambda judged: checks.run_checks(items(judged).withColumn("_ord", F.struct("page", "source_line")), ENTITY, "_ord")
        # judged rows and checks are written once, and counted as they are
        judged, self.checks, self.counts = report.settled(normalize.judge(self.raw, normalizer), proof)
        self.items = items(judged)
        self.quarantined = normalize.quarantine_rows(normalize.parted(judged)[1], name)
        facts = metrics.facts(self.items, ENTITY)
        self.views = {"facts": facts} | {v: metrics.metric_view(facts, ENTITY, v) for v in ("funding_mix", "growth_efficiency")}

    def header(self, ticker: str, source: str) -> DataFrame:
        return self.items.groupBy(*ENTITY).agg(F.max_by("period", "period_sort").alias("fiscal_period"), F.array_sort(F.collect_set("period")).alias("periods")).withColumns({"ticker": F.lit(ticker), "source_file": F.lit(source)})


def named(place: str) -> normalize.Model:
    """A function by module:name; the tasks import it by that name too."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def trace_key(filing: Filing, key: str) -> str:
    """U6, as text."""
    spark, items = filing.items.sparkSession, filing.items
    found = writers.records(trace.provenance(items.where(F.col("canonical_key") == key), []))
    if not found:
        known = spark.createDataFrame([(k,) for k in sorted({k for _, k, _ in schemas.allowed_keys()})], "key string")
        like = writers.records(trace.suggestions(spark.createDataFrame([(key,)], "key string"), known).orderBy("nth"))
        return f"no values for {key}; did you mean: {', '.join(r['suggestion'] for r in like) or 'nothing like it'}"
    own, out = found[0], [f"key: {key}"]
    out += [f"{name}: {', '.join(own[name])}" for name in ("statements", "units", "methods")]
    out.append(f"least confidence: {own['least_confidence']:.2f}")
    out += [f"  {r['statement']} {r['period']}: {r['shown']}  (page {r['page']}: {r['label']})" for r in writers.records(trace.values_of(items, key, []))]
    out += ["printed lines:", *[f"  {x}" for x in own["source_lines"]]]
    lineage = metrics.lineage(spark)
    out += ["feeds:", *[f"  {r['dependent']}" for r in writers.records(metrics.dependents_of(lineage, key))]]
    fed = trace.dependents(lineage, filing.views, ENTITY, key).orderBy("view", "column", "period_sort")
    out += [f"  {r['view']}.{r['column']} {r['period']}: {r['value']}" for r in writers.records(fed)]
    held = trace.quarantine_note(filing.quarantined, key).count()
    return "\n".join(out + ([f"quarantined rows that name it: {held}"] if held else []))


def show_all(view: DataFrame) -> None:
    """show() of every row; it stops at 20 by itself."""
    view.show(max(1, view.count()), truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tieout", description=__doc__.splitlines()[0])
    p.add_argument("document")
    p.add_argument("--db", help="folder for the tables")
    p.add_argument("--json", help="folder for the filing as JSON")
    p.add_argument("--html", help="file for the report")
    p.add_argument("--company", default="Company")
    p.add_argument("--ticker", default="")
    p.add_argument("--mapping", help="Parquet of recorded mappings in place of the label rules")
    p.add_argument("--model", metavar="MODULE:FUNCTION", help="a function that labels pages, see normalize.Model")
    p.add_argument("--cache", help="folder of the model's answers: pages found there are not put to it, others are added")
    p.add_argument("--no-llm", action="store_true", help="label rules alone, even where a mapping or a model is given")
    p.add_argument("--compare", action="store_true", help="compare the mapping with the label rules")
    p.add_argument("--trace", metavar="KEY")
    p.add_argument("--strict", action="store_true", help="exit with 1 if any check fails")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or session()
    pdf = args.document.lower().endswith(".pdf")
    words = readers.pdf_words(spark, args.document) if pdf else readers.words_parquet(spark, args.document)
    mapping = readers.mappings_parquet(spark, args.mapping) if args.mapping else None
    filing = Filing(words, args.company, args.ticker, Path(args.document).name, *((None, None) if args.no_llm else (mapping, args.model)), args.cache)
    if filing.raw.isEmpty():
        print("no tables found in the document")
        return 1
    if args.trace:
        print(trace_key(filing, args.trace))
    n = filing.counts
    print(f"{n['rows']} rows, {n['items']} line items, checks {n['passed']}/{n['checks']}, {n['held']} quarantined")
    failed = filing.checks.where(~F.col("passed")).orderBy("name", "period_sort")
    for r in failed.toLocalIterator():
        print(f"  failed: {r['name']} {r['period']}: {r['actual']} is not {r['expected']} (by {r['diff']})")
    if args.compare and mapping is None:
        print("nothing to compare with: --compare takes the mapping of --mapping")
    elif args.compare:
        sides = [normalize.normalize(filing.raw, n)[0] for n in (normalize.by_mapping(mapping), normalize.by_alias(rules.dim_alias(spark)))]
        compared = settle(checks.compare_normalizers(*sides, normalize.ROW), "compared")
        checks.comparison_report(compared).show()
        for r in compared.where("verdict <> 'agree'").orderBy(*normalize.ROW).toLocalIterator():
            print(f"  page {r['page']}, row {r['row_ord']}: {r['verdict']}: {r['left_key']}, {r['right_key']}")
    show_all(filing.views["funding_mix"].where("delta_assets is not null").orderBy("period_sort"))
    show_all(filing.views["growth_efficiency"].orderBy("period_sort"))
    if args.db:
        writers.rebuild({"line_items": filing.items, "quarantined": filing.quarantined, **filing.views}, args.db)
    if args.json:
        writers.filing_json(filing.header(args.ticker, Path(args.document).name), filing.items, filing.quarantined, ENTITY, args.json)
    if args.html:
        views = filing.views
        report.write(report.lines(f"{args.company} {args.ticker}".strip(), n, filing.checks, views["funding_mix"], views["growth_efficiency"], filing.quarantined), args.html)
    return writers.exit_code(n["checks"] - n["passed"], args.strict)


if __name__ == "__main__":
    sys.exit(main())
