from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from tests.test_layout import Page
from tieout import cli, schemas
from tieout.sources import corpus
from tieout.streaming import feed


def document(spark, path):
    a = Page(page=1).text("Consolidated Balance Sheets", 40)
    for k, (label, values) in enumerate([("Total assets", (30, 60, 90, 120)), ("Total liabilities", (10, 20, 30, 40)), ("Total stockholders' equity", (20, 40, 60, 80)), ("Additional paid-in capital", (5, 6, 7, 8)), ("Something else entirely", (1, 1, 1, 1))]):
        a.text(label, 120 + 15 * k).values(120 + 15 * k, *(f"{v * 1000:,}" for v in values))
    b = Page(page=2).text("Consolidated Statements of Operations", 40).text("Revenue", 120).values(120, "1,000", "2,000", "3,000", "—")
    spark.createDataFrame(a.words + b.words, schemas.WORDS).write.parquet(path)


def test_end_to_end(spark, tmp_path, capsys):
    path = f"{tmp_path}/words"
    document(spark, path)
    code = cli.main([path, "--company", "Acme", "--ticker", "AC", "--db", f"{tmp_path}/db", "--json", f"{tmp_path}/json", "--html", f"{tmp_path}/r.html", "--trace", "total_assets", "--strict"], spark)
    out = capsys.readouterr().out
    assert code == 0 and "6 rows, 20 line items, checks 7/7, 1 quarantined" in out
    assert "feeds:" in out and "funding_mix.delta_assets" in out and "growth_efficiency.asset_turnover Q1 2024: 0.133" in out
    page = Path(f"{tmp_path}/r.html").read_text()
    assert "<svg" in page and "7/7" in page and "Something else entirely" in page
    assert spark.read.parquet(f"{tmp_path}/db/line_items").where("value is null").count() == 1
    assert spark.read.parquet(f"{tmp_path}/db/quarantined").first()["reason"] == "not mapped"
    assert spark.read.json(f"{tmp_path}/json").first()["fiscal_period"] == "Q4 2024"


def test_unknown_key_gets_suggestions(spark, tmp_path, capsys):
    path = f"{tmp_path}/words"
    document(spark, path)
    cli.main([path, "--trace", "total_asset"], spark)
    assert "did you mean: total_assets" in capsys.readouterr().out


def test_bank_feed(spark, tmp_path):
    ledger, bank = corpus.corpus(spark)
    rows = bank.drop("bank_id", "scenario")
    for part in (0, 1):
        rows.where(F.pmod(F.hash("messy_memo"), F.lit(2)) == part).write.mode("append").csv(f"{tmp_path}/in", header=True)
        stream = feed.matched(feed.bank_stream(spark, f"{tmp_path}/in"), ledger)
        feed.write(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 205 and got.where("matched").count() == 50
    daily = feed.daily_totals(feed.bank_stream(spark, f"{tmp_path}/in"))
    query = daily.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily").agg(F.sum("amount")).first()[0] == rows.agg(F.sum("posted_amount")).first()[0] != Decimal(0)


def by_letters(statement, keys, lines):
    """Stands for a model: the first key whose first letter a label has."""
    return [{"row_ord": x["row_ord"], "canonical_key": next((k for k in keys if k[0] == x["raw_label"][0].lower()), None), "unit": "thousands_usd", "confidence": 0.5} for x in lines]


def never(statement, keys, lines):
    raise AssertionError("a page in the cache was put to the model")


def test_model_and_cache(spark, tmp_path, capsys, monkeypatch):
    path = f"{tmp_path}/words"
    document(spark, path)
    flags = [path, "--company", "Acme", "--cache", f"{tmp_path}/cache", "--model", "tests.test_cli:by_letters"]
    cli.main([*flags, "--db", f"{tmp_path}/db"], spark)
    assert spark.read.parquet(f"{tmp_path}/db/line_items").select("method").distinct().first()[0] == "model"
    first = capsys.readouterr().out.splitlines()[0]
    monkeypatch.setattr(cli, "named", lambda place: never)
    cli.main(flags, spark)
    assert capsys.readouterr().out.splitlines()[0] == first
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2
    cli.main([*flags, "--no-llm"], spark)
    assert "20 line items" in capsys.readouterr().out
