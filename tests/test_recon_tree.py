import json
from collections import Counter

from tieout.operators import recon, tree
from tieout.sources import corpus, readers

SIDE = "id long, day date, cents long, memo string"


def side(spark, *rows):
    from datetime import date

    return spark.createDataFrame([(i, date(2026, 5, d) if d else None, c, m) for i, d, c, m in rows], SIDE)


def test_planted_corpus_is_told_apart(spark):
    ledger, bank = corpus.corpus(spark)
    assert (ledger.count(), bank.count()) == corpus.expected_rows() == (205, 205)
    got = recon.waterfall(recon.ledger_side(ledger), recon.bank_side(bank)).collect()
    assert len(got) == 410 and len({(r["side"], r["id"]) for r in got}) == 410
    counts = Counter((r["side"], r["scenario"]) for r in got)
    want = {"exact": (50, 50), "shift": (50, 50), "wide": (10, 10), "similar": (10, 10), "similar_date": (10, 10), "many_gl": (50, 15), "many_bank": (15, 50), "near": (5, 5), "void": (2, 2), "unmatched": (3, 3)}
    assert counts == Counter({(s, k): v[i] for k, v in want.items() for i, s in enumerate(("gl", "bank"))})
    planted = {("gl", r["gl_id"]): r["scenario"] for r in ledger.collect()} | {("bank", r["bank_id"]): r["scenario"] for r in bank.collect()}
    assert all(planted[r["side"], r["id"]].startswith(r["scenario"].replace("unmatched", "no_match")) for r in got)
    assert {r["status"] for r in got if r["scenario"] in ("wide", "near")} == {"review"}


def test_corpus_is_the_same_each_time_and_grows(spark):
    a, b = (sorted(map(tuple, corpus.corpus(spark, sets=2)[0].collect())) for _ in range(2))
    assert a == b and len(a) == 410
    ledger, bank = corpus.corpus(spark)
    assert recon.corpus_violations(ledger, bank, "2026-05-01", "2026-05-31").where("violations > 0").isEmpty()


def test_csv_round_trip(spark, tmp_path):
    from tieout.sources.writers import amounts_csv

    ledger, bank = corpus.corpus(spark)
    amounts_csv(ledger.drop("gl_id", "scenario"), f"{tmp_path}/gl")
    amounts_csv(bank.drop("bank_id", "scenario"), f"{tmp_path}/bank")
    back = readers.with_ids(readers.ledger_csv(spark, f"{tmp_path}/gl"), "gl_id")
    assert back.count() == 205 and back.select("gl_id").distinct().count() == 205
    assert sorted(map(tuple, back.drop("gl_id").collect())) == sorted(map(tuple, ledger.drop("gl_id", "scenario").collect()))
    assert all(isinstance(r["messy_memo"], str) for r in readers.bank_csv(spark, f"{tmp_path}/bank").collect())


def test_repeated_rows_pair_one_to_one(spark):
    gl = side(spark, (1, 1, 100, "a"), (2, 1, 100, "a"), (3, 1, 100, "a"))
    bank = side(spark, (11, 1, 100, "a"), (12, 1, 100, "a"))
    assert sorted(map(tuple, recon.exact(gl, bank).collect())) == [(1, 11), (2, 12)]


def test_nearest_day_wins_and_each_row_matches_once(spark):
    gl = side(spark, (1, 10, 100, "a"), (2, 12, 100, "a"))
    bank = side(spark, (11, 13, 100, "a"), (12, 15, 100, "a"), (13, 30, 100, "a"))
    assert sorted(map(tuple, recon.shifted(gl, bank).collect())) == [(2, 11)]
    assert recon.shifted(gl, side(spark)).count() == 0


def test_voids_pair_and_leave_the_rest(spark):
    rows = side(spark, (1, 1, 100, "a"), (2, 1, -100, "a"), (3, 1, 100, "a"), (4, 1, 0, "a"), (5, 2, -100, "a"))
    assert sorted(map(tuple, recon.voids(rows).collect())) == [(1, 1), (2, 1)]


def test_nulls_match_nothing(spark):
    gl, bank = side(spark, (1, None, 100, None), (2, 1, None, "a")), side(spark, (11, None, 100, None), (12, 1, None, "a"))
    got = recon.waterfall(gl, bank).collect()
    assert {r["scenario"] for r in got} == {"unmatched"} and len(got) == 4


def test_tree_is_walked_before_its_children(spark):
    report = {
        "Columns": {"Column": [{"ColTitle": ""}, {"ColTitle": "Debit"}]},
        "Rows": {"Row": [{"ColData": [{"value": "Cash"}, {"value": "5"}]}, {"Header": {"ColData": [{"value": "no"}]}, "ColData": [{"value": "Group"}, {}], "Rows": {"Row": [{"ColData": [{"value": "Leaf"}, {"value": "7"}]}]}, "Summary": {"ColData": [{"value": "no"}]}}, {"Rows": {"Row": [{"ColData": [{"value": "Deep"}]}]}}]},
    }
    reports = spark.createDataFrame([("r", json.dumps(report)), ("e", json.dumps({"Columns": {"Column": []}, "Rows": {}}))], "report_id string, body string")
    got = tree.to_table(reports, ["Account", "Debit"]).collect()
    assert [(r["Account"], r["Debit"]) for r in got] == [("Cash", "5"), ("Group", ""), ("Leaf", "7"), ("Deep", None)]
    assert tree.cells(reports).count() == 8


def test_tree_of_more_than_a_million_nodes(spark):
    from pyspark.sql import functions as F

    row = '{"ColData":[{"value":"x"},{"value":"1"}]}'
    body = '{"Columns":{"Column":[]},"Rows":{"Row":[' + ",".join([row] * 110) + "]}}"
    reports = spark.range(10_000).select(F.col("id").cast("string").alias("report_id"), F.lit(body).alias("body"))
    got = tree.flatten(reports).agg(F.count(F.lit(1)), F.countDistinct("report_id"), F.max(F.get("path", F.lit(0)))).first()
    assert tuple(got) == (1_100_000, 10_000, 109)


def test_tree_deeper_than_a_hundred(spark):
    node = None
    for k in range(120, 0, -1):
        node = {"ColData": [{"value": f"level {k}"}], **({"Rows": {"Row": [node]}} if node else {})}
    reports = spark.createDataFrame([("deep", json.dumps({"Rows": {"Row": [node]}}))], "report_id string, body string")
    got = sorted((len(r["path"]), r["cells"]) for r in tree.flatten(reports).collect())
    assert got == [(k, [f"level {k}"]) for k in range(1, 121)]
