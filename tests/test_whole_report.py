"""The report and the printed views leave no row out."""

from pathlib import Path

from tests.test_layout import Page
from tieout import cli, report, schemas
from tieout.sources.scratch import settle_counting


def test_all_quarantined_rows_are_listed(spark, tmp_path):
    words = []
    for page in range(1, 4):
        p = Page(page=page).text("Consolidated Balance Sheets", 40)
        for k in range(80):
            p.text(f"Unheard of thing {page}x{k:02d}", 120 + 15 * k).values(120 + 15 * k, "1,000", "2,000", "3,000", "4,000")
        words += p.words
    spark.createDataFrame(words, schemas.WORDS).withColumn("page_height", cli.F.lit(100_000.0)).write.parquet(f"{tmp_path}/words")
    cli.main([f"{tmp_path}/words", "--html", f"{tmp_path}/r.html"], spark)
    page = Path(f"{tmp_path}/r.html").read_text()
    at = [page.index(f"<td>Unheard of thing {p}x{k:02d}</td>") for p in range(1, 4) for k in range(80)]
    assert "<p>240 rows</p>" in page and at == sorted(at)


def test_views_are_printed_whole(spark, capsys):
    cli.show_all(spark.range(45).selectExpr("concat('row', id) AS period"))
    out = capsys.readouterr().out
    assert all(f"|row{k}" in out for k in range(45)) and "only showing" not in out


def test_a_million_quarantined_rows_go_to_one_file_in_order(spark, tmp_path):
    """Made into lines and sorted by the tasks; the driver keeps no row."""
    n = 1_000_000
    held = spark.range(n).selectExpr("'c' AS company", "CAST(id % 100 AS INT) AS page", "'s' AS section", "concat('<', id, '>') AS raw_label", "'x' AS source_line", "'not mapped' AS reason", "CAST(id AS INT) AS row_ord")
    empty = spark.createDataFrame([], "company string, period string, period_sort int, delta_assets double, " + ", ".join(f"{c} double" for c, _ in report.SOURCES))
    checks = spark.createDataFrame([], "name string, passed boolean")
    counts = {"rows": n, "items": 0, "by_model": False, "held": n, "passed": 0, "checks": 0}
    path = f"{tmp_path}/r.html"
    report.write(report.lines("t", counts, checks, empty, empty, held), path)
    found, last = 0, (-1, -1)
    with open(path) as file:
        for line in file:
            if line.startswith("<tr><td>"):
                page, row = int(line[8 : line.index("</td>")]), int(line[line.index("&lt;") + 4 : line.index("&gt;")])
                assert last < (page, row)
                found, last = found + 1, (page, row)
    assert found == n and line == "</body></html>\n"
    assert not [f for f in tmp_path.iterdir() if f.name != "r.html"]


def test_counts_on_the_way(spark):
    from pyspark.sql import functions as F

    table, counts = settle_counting(spark.range(1000).repartition(7), "t", n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1), most=F.max("id"))
    assert counts == {"n": 1000, "odd": 500, "most": 999} and table.count() == 1000
    table, counts = settle_counting(spark.range(0), "t", n=F.count(F.lit(1)), most=F.max("id"))
    assert counts == {"n": 0, "most": None} and table.count() == 0
