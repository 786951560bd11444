"""SRC8: a seeded corpus of two sides with all scenarios planted, of any size.

Every value is an expression of the row's number and the seed, so rows are made where they are used and are the same on any
cluster. Sizes are in sets: one set is one corpus of the published sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from tieout.functions.text import from_cents, reversed_name, zero_pad

# Fixed values: (scenario, cases, ledger rows, bank rows) in a set; dates lie in May 2026.
SCENARIOS = [
    ("exact", 50, 1, 1),
    ("shift", 50, 1, 1),
    ("wide", 10, 1, 1),
    ("similar", 10, 1, 1),
    ("similar_date", 10, 1, 1),
    ("many_gl_2", 5, 2, 1),
    ("many_gl_3", 5, 3, 1),
    ("many_gl_5", 5, 5, 1),
    ("many_bank_2", 5, 1, 2),
    ("many_bank_3", 5, 1, 3),
    ("many_bank_5", 5, 1, 5),
    ("no_match_gl", 3, 1, 0),
    ("no_match_bank", 3, 0, 1),
    ("void_gl", 1, 2, 0),
    ("void_bank", 1, 0, 2),
    ("near", 5, 1, 1),
]
FIRST_DAY, DAYS = "2026-05-01", 31
SEED = 20260503
VOID_CENTS = {"void_gl": 10_000, "void_bank": 30_000}
#: Amounts, in cents; part amounts of groups are shares of one.
LEAST_CENTS, MOST_CENTS = 500, 99_999
# End of fixed values.
SURNAMES = "Abbott Barlow Castell Dunmore Ellery Fairburn Goodall Hartwell Ingram Jessop Kendrick Lovell Marchant Norwood Oakes Pembroke Quill Ramsden Selwyn Thackray Underhill Varley Whitlock Yardley".split()
FIRST_NAMES = "Ada Bruno Clara Dora Emil Flora Gustav Helga Ivo Klara Leo Mina Nora Otto Petra Rosa Samuel Tilda Ulla Viktor".split()
#: One theme for each kind of scenario, so that a reader can tell where a row comes from; the others have names and digits.
THEMES = {
    "exact": "Granite Basalt Marble Slate Flint Quartz Gneiss Chalk".split(),
    "shift": "Heron Kestrel Plover Wren Finch Osprey Linnet Avocet".split(),
    "wide": "Mistral Sirocco Bora Zephyr Foehn Levante Harmattan Chinook".split(),
    "similar": "Crimson Amber Teal Indigo Ochre Sienna Umber Cobalt".split(),
    "similar_date": "Prism Cone Sphere Torus Wedge Cube Helix Lens".split(),
    "many_gl": "Copper Nickel Cobalt Zinc Titanium Bronze Pewter Brass".split(),
    "many_bank": "Linen Velvet Denim Tweed Satin Muslin Felt Canvas".split(),
}


def _draw(seed: int, name: str, low: int | Column, high: int | Column) -> Column:
    """A whole number from low to high for each case."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return low + F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "case_id"), (high - low + 1).cast("long")).cast("int")


def cases(spark: SparkSession, sets: int = 1, seed: int = SEED) -> DataFrame:
    """One row for each planted case."""
    per_set = sum(n for _, n, _, _ in SCENARIOS)
    kinds = [(s, k, gl, bank) for s, n, gl, bank in SCENARIOS for k in range(n)]
    table = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(k).alias("nth"), F.lit(g).alias("gl_rows"), F.lit(b).alias("bank_rows")) for s, k, g, b in kinds])
    numbered = spark.range(sets * per_set).withColumnRenamed("id", "case_id").select("case_id", F.get(table, (F.col("case_id") % per_set).cast("int")).alias("s")).select("case_id", "s.*")
    day = lambda low, high: F.date_add(F.lit(FIRST_DAY).cast("date"), _draw(seed, "day", low, high))
    is_ = lambda *names: F.col("scenario").isin(*names)
    slight, wide = _draw(seed, "slight", 1, 3), _draw(seed, "wide", 14, DAYS - 1)
    behind = F.col("nth") % 2 == 0
    gap = F.when(is_("shift"), slight).when(is_("wide"), wide).when(is_("similar_date"), _draw(seed, "similar", 1, 20)).otherwise(F.lit(0))
    core = F.concat(F.lit("1"), zero_pad(F.col("case_id").cast("string"), _draw(seed, "digits", 2, 8)))
    fuzzy = is_("similar", "similar_date")
    memo = (
        F.when(fuzzy, F.concat(F.lit("Inv 00"), core))
        .when(F.col("scenario").startswith("no_match"), reversed_name(F.get(F.array(*map(F.lit, SURNAMES)), _draw(seed, "name", 0, len(SURNAMES) - 1))))
        .otherwise(F.concat(F.lit("Inv "), core))
    )
    dressed = F.get(F.array(F.concat(F.lit("I"), core), core, F.concat(F.lit("INV"), core), F.concat(F.lit("#"), core)), _draw(seed, "dress", 0, 3))
    early = day(F.lit(0), F.lit(DAYS - 1) - gap)
    picked = lambda words, name: F.get(F.array(*map(F.lit, words)), _draw(seed, name, 0, len(words) - 1))
    kind = F.regexp_replace("scenario", r"_\d$", "")
    number = zero_pad(_draw(seed, "number", 10, 99_999_999).cast("string"), 2)
    main_memo = F.concat(picked(FIRST_NAMES, "first"), number)
    for name, words in THEMES.items():
        main_memo = F.when(kind == name, F.concat_ws(" ", picked(words, "theme"), picked(SURNAMES, "who"))).otherwise(main_memo)
    return numbered.select(
        "*",
        early.alias("early"),
        gap.alias("gap"),
        behind.alias("behind"),
        memo.alias("gl_memo"),
        F.when(fuzzy, dressed).otherwise(memo).alias("bank_memo"),
        _draw(seed, "cents", LEAST_CENTS, MOST_CENTS).cast("long").alias("cents"),
        F.when(is_("near"), _draw(seed, "near", 1, 9)).otherwise(F.lit(0)).alias("off"),
        main_memo.alias("main_memo"),
    )


def _side(planted: DataFrame, rows: str, day: Column, cents: Column, void: str) -> DataFrame:
    """Rows of one side: a case's amount in equal parts, the first taking the rest; voids cancel."""
    exploded = planted.where(F.col(rows) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(rows))).alias("part"))
    share = F.expr(f"{{cents}} div {rows}".format(cents="_cents"))
    part = F.when(F.col("part") == 1, F.col("_cents") - share * (F.col(rows) - 1)).otherwise(share)
    voided = F.when(F.col("part") == 1, F.lit(VOID_CENTS[void])).otherwise(F.lit(-VOID_CENTS[void])).cast("long")
    return exploded.withColumn("_cents", cents).withColumn("_day", day).withColumn("_amount", from_cents(F.when(F.col("scenario") == void, voided).otherwise(part)))


def corpus(spark: SparkSession, sets: int = 1, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(ledger, bank) with columns of schemas.GENERAL_LEDGER and schemas.BANK, and row ids gl_id and bank_id."""
    planted = cases(spark, sets, seed)
    late = F.date_add("early", F.col("gap"))
    gl = _side(planted, "gl_rows", F.when(F.col("behind"), F.col("early")).otherwise(late), F.col("cents"), "void_gl")
    bank = _side(planted, "bank_rows", F.when(F.col("behind"), late).otherwise(F.col("early")), F.col("cents") + F.col("off"), "void_bank")
    key = (F.col("case_id") * 8 + F.col("part")).cast("long")
    ledger = gl.select(key.alias("gl_id"), F.col("_day").alias("gl_date"), F.col("_amount").alias("amount"), "main_memo", F.col("gl_memo").alias("line_memo"), "scenario")
    other = bank.select(key.alias("bank_id"), F.col("_day").alias("posted_date"), F.col("_amount").alias("posted_amount"), F.col("bank_memo").alias("messy_memo"), "scenario")
    return ledger, other


def expected_rows(sets: int = 1) -> tuple[int, int]:
    return tuple(reduce(lambda t, s: (t[0] + s[1] * s[2], t[1] + s[1] * s[3]), SCENARIOS, (0, 0))[k] * sets for k in (0, 1))


