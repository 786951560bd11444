"""Two sides of transactions, matched by a waterfall of scenarios.

A side has (id, day, cents, memo). Each step works on what the steps before left; every row is matched once at most, and ends
with one scenario and status. All steps are equi-joins on amounts, days or memos; amounts are whole cents.

Where days or amounts may differ, no pairs of rows are listed: rows alike in everything compared are counted as one place, a
key's places are paired by counts, nearest first, and the rows of paired places then meet in order of their ids. One pass
does it, however many rows are alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.text import invoice_core, to_cents
from tieout.operators.islands import all_known, dealt
from tieout.operators.subsets import split_groups
from tieout.schemas import MEMO_LENGTHS
from tieout.session import bounded_batches
from tieout.sources.scratch import remove, settle, settle_at

# Days and cents by which scenarios are told apart.
SLIGHT_DAYS = (1, 3)
WIDE_DAYS = 14
SIMILAR_DAYS = (1, 20)
NEAR_CENTS = (1, 9)
# End of fixed values.
#: Scenarios a person looks at.
REVIEW = ("wide", "near")
SIDES = ("gl", "bank")
#: A key with more pairs of places than this is paired gap by gap, else from a sorted list; the result is the same.
LISTED_PAIRS = 10_000


def ledger_side(ledger: DataFrame, id_col: str = "gl_id") -> DataFrame:
    return ledger.select(F.col(id_col).alias("id"), F.col("gl_date").alias("day"), to_cents(F.col("amount")).alias("cents"), F.col("line_memo").alias("memo"))


def bank_side(bank: DataFrame, id_col: str = "bank_id") -> DataFrame:
    return bank.select(F.col(id_col).alias("id"), F.col("posted_date").alias("day"), to_cents(F.col("posted_amount")).alias("cents"), F.col("messy_memo").alias("memo"))


def voids(side: DataFrame) -> DataFrame:
    """Sets 9 and 10: (id, void_id) of rows of one side that cancel: same day and memo, opposite amounts, paired in order of id."""
    nth = Window.partitionBy("day", "memo", "cents").orderBy("id")
    rows = side.where("cents <> 0").withColumn("_nth", F.row_number().over(nth)).withColumn("_size", F.abs("cents"))
    pair = rows.groupBy("day", "memo", "_size", "_nth").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("void_id")).where("_n = 2")
    return rows.join(pair, ["day", "memo", "_size", "_nth"]).select("id", "void_id")


def pair_in_order(gl: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """Sets 1 and 4: rows with equal keys, the first with the first, so that repeated keys make no products."""
    nth = Window.partitionBy(*keys).orderBy("id")
    ranked = lambda side, name: side.where(all_known(keys)).select(F.col("id").alias(name), *keys, F.row_number().over(nth).alias("_nth"))
    return ranked(gl, "gl_id").join(ranked(bank, "bank_id"), [*keys, "_nth"]).select("gl_id", "bank_id")


def in_order_of_gap(gl: dict[int, int], bank: dict[int, int], low: int, high: int | None) -> Iterator[tuple[int, int]]:
    """Pairs of places (ledger, bank) whose gap lies in a range: nearest first, the later bank place before the earlier."""
    if high is None and len(gl) * len(bank) <= LISTED_PAIRS:
        for _, _, p, q in sorted((abs(q - p), q < p, p, q) for p in gl for q in bank if abs(q - p) >= low):
            yield p, q
        return
    span = max(max(gl) - min(bank), max(bank) - min(gl))
    for gap in range(low, min(span, high if high is not None else span) + 1):
        for step in (gap, -gap):
            yield from [(p, p + step) for p in sorted(gl) if p + step in bank]


def allocate(places: list[dict], low: int, high: int | None) -> list[tuple[int, int, int, int, int]]:
    """(ledger place, bank place, first row of either, rows) for a key's places (at, gl, bank), which count rows."""
    gl, bank = ({x["at"]: x[s] for x in places if x[s]} for s in ("gl", "bank"))
    if not gl or not bank:
        return []
    used_gl, used_bank, made = dict.fromkeys(gl, 0), dict.fromkeys(bank, 0), []
    for p, q in in_order_of_gap(gl, bank, low, high):
        if p in gl and q in bank:
            n = min(gl[p], bank[q])
            made.append((p, q, used_gl[p], used_bank[q], n))
            for counts, used, x in ((gl, used_gl, p), (bank, used_bank, q)):
                counts[x] -= n
                used[x] += n
                if not counts[x]:
                    del counts[x]
    return made


ALLOCATED = ("gl_at", "bank_at", "gl_first", "bank_first", "n")


def _allocate_batches(batches: Iterator[pa.RecordBatch], low: int, high: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(k, *x) for k, places in enumerate(batch.column("places").to_pylist()) for x in allocate(places, low, high)]
        keys = [c for c in batch.schema.names if c != "places"]
        index, *columns = map(list, zip(*made)) if made else [[] for _ in range(6)]
        taken = [batch.column(c).take(pa.array(index, pa.int64())) for c in keys]
        yield pa.RecordBatch.from_arrays([*taken, *[pa.array(x, pa.int64()) for x in columns]], [*keys, *ALLOCATED])


def meeting(rows: DataFrame, keys: list[str], wanted: Column, name: str) -> DataFrame:
    """The rows of keys for which wanted, an aggregate, holds, written once: what can match at all. Keys are told by a hash, so that only
    numbers are counted for all rows; one that lets more through costs a little and changes nothing."""
    told = rows.withColumn("_key", F.xxhash64(*keys))
    found = told.groupBy("_key").agg(wanted.alias("_wanted")).where("_wanted").select("_key")
    return settle(told.join(found, "_key", "left_semi").drop("_key"), name)


def nearest(gl: DataFrame, bank: DataFrame, keys: list[str], at: Column, low: int, high: int | None) -> DataFrame:
    """(gl_id, bank_id) of rows with equal keys, at most one for each row, whose places differ by low to high: nearest first.

    A task holds places, not rows: one entry for each day, or each amount, that occurs. Where high bounds the difference, a key of many
    places is dealt by islands of them, between which no pair crosses. Keys of one side, or whose places all lie closer than low, are left
    out beforehand.
    """
    known = all_known(keys)
    placed = lambda side: side.select("id", *keys, at.cast("long").alias("at")).where(known & F.col("at").isNotNull())
    marked = reduce(DataFrame.unionByName, [placed(x).withColumn("side", F.lit(s)) for s, x in zip(SIDES, (gl, bank))])
    apart = F.coalesce(F.try_subtract(F.max("at"), F.min("at")) >= low, F.lit(True))
    rows = meeting(marked, keys, reduce(Column.__and__, [F.count_if(F.col("side") == s) > 0 for s in SIDES], apart), "recon_meeting")
    sides = {s: rows.where(F.col("side") == s).drop("side") for s in SIDES}
    places = settle(rows.groupBy(*keys, "at").agg(*[F.count_if(F.col("side") == s).alias(s) for s in SIDES]), "recon_all_places")
    both = dealt(places, keys, high).groupBy(*keys, "island").agg(F.collect_list(F.struct("at", "gl", "bank")).alias("places"), F.sum("gl").alias("_gl"), F.sum("bank").alias("_bank"))
    apart = both.where(f"_gl > 0 and _bank > 0 and size(places) > {int(low > 0)}").drop("_gl", "_bank", "island")
    types = {f.name: f.dataType.simpleString() for f in placed(gl).schema}
    ddl = ", ".join([*[f"{k} {types[k]}" for k in keys], *[f"{c} long" for c in ALLOCATED]])
    made = bounded_batches(apart).mapInArrow(partial(_allocate_batches, low=low, high=high), ddl)
    pairs = settle(made, "recon_places")

    def matched(side: str) -> DataFrame:
        place = [*keys, f"{side}_at"]
        own = sides[side].select(F.col("id").alias(f"{side}_id"), *keys, F.col("at").alias(f"{side}_at")).join(pairs.select(*place).distinct(), place, "left_semi")
        nth = F.row_number().over(Window.partitionBy(*place).orderBy(f"{side}_id")) - 1
        hit = own.withColumn("_nth", nth).join(pairs, place).withColumn("_k", F.col("_nth") - F.col(f"{side}_first"))
        return hit.where((F.col("_k") >= 0) & (F.col("_k") < F.col("n"))).select(*keys, "gl_at", "bank_at", "_k", f"{side}_id")

    return matched("gl").join(matched("bank"), [*keys, "gl_at", "bank_at", "_k"]).select("gl_id", "bank_id")


def exact(gl: DataFrame, bank: DataFrame) -> DataFrame:
    return pair_in_order(gl, bank, ["cents", "day", "memo"])


def shifted(gl: DataFrame, bank: DataFrame, low: int = SLIGHT_DAYS[0], high: int | None = SLIGHT_DAYS[1]) -> DataFrame:
    """Sets 2 and 3: amount and memo agree, days do not."""
    return nearest(gl, bank, ["cents", "memo"], F.unix_date("day"), low, high)


def _cored(side: DataFrame) -> DataFrame:
    return side.withColumn("core", invoice_core(F.col("memo")))


def similar(gl: DataFrame, bank: DataFrame) -> DataFrame:
    """Set 4: the memos name one invoice."""
    return pair_in_order(_cored(gl), _cored(bank), ["cents", "day", "core"])


def similar_shifted(gl: DataFrame, bank: DataFrame) -> DataFrame:
    """Set 5."""
    return nearest(_cored(gl), _cored(bank), ["cents", "core"], F.unix_date("day"), *SIMILAR_DAYS)


def near(gl: DataFrame, bank: DataFrame) -> DataFrame:
    """Set 11: day and memo agree, amounts nearly."""
    return nearest(gl, bank, ["day", "memo"], F.col("cents"), *NEAR_CENTS)


def _summed(many: DataFrame, one: DataFrame) -> DataFrame:
    """(day, memo, least, one_id) of groups of one day and memo, least being the group's least id, that sum to a row of the other side."""
    sums = many.groupBy("day", "memo").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    first = one.groupBy("day", "memo", "cents").agg(F.min("id").alias("one_id"))
    return sums.join(first, ["day", "memo", "cents"]).select("day", "memo", "least", "one_id")


def groups_to_one(many: DataFrame, one: DataFrame) -> DataFrame:
    """Sets 6 and 7: (many_id, one_id) of groups of one day and memo that sum to a row of the other side, as a whole or else by
    disjoint parts of them. Groups of one row, or without a row of the other side, are left out beforehand."""
    marked = reduce(DataFrame.unionByName, [x.select(F.lit(s).alias("side"), "id", "day", "cents", "memo") for s, x in (("many", many), ("one", one))])
    of = lambda s: F.count_if(F.col("side") == s)
    rows = meeting(marked.where(all_known(["day", "memo"])), ["day", "memo"], (of("many") > 1) & (of("one") > 0), "recon_meeting")
    many, one = (rows.where(F.col("side") == s).drop("side") for s in ("many", "one"))
    whole = settle(_summed(many, one), "recon_groups")
    return many.join(whole, ["day", "memo"]).select(F.col("id").alias("many_id"), "one_id").unionByName(split_groups(many, one, whole))


#: The steps that pair rows before groups are summed, in the order of the waterfall.
PAIRED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "exact": exact,
    "shift": shifted,
    "wide": partial(shifted, low=WIDE_DAYS, high=None),
    "similar": similar,
    "similar_date": similar_shifted,
}


#: Blocks of more rows are not looked at together.
ROWS_TOGETHER = 10_000


def block_of(memo: Column) -> Column:
    """The rows of one invoice, or else of one memo, within which all steps match."""
    return F.coalesce(F.concat(F.lit("#"), invoice_core(memo)), F.concat(F.lit("="), memo))


def pair_rule(days: Column, cents: Column, alike: Column, invoice: Column) -> Column:
    """The first step whose rule two rows keep, one of either side: days and cents are their differences, alike tells of equal memos and
    invoice of memos that name one invoice. Null if they keep none."""
    equal = cents == 0
    rules = {
        "exact": equal & alike & (days == 0),
        "shift": equal & alike & days.between(*SLIGHT_DAYS),
        "wide": equal & alike & (days >= WIDE_DAYS),
        "similar": equal & invoice & (days == 0),
        "similar_date": equal & invoice & days.between(*SIMILAR_DAYS),
        "near": alike & (days == 0) & cents.between(*NEAR_CENTS),
    }
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def lone(rows: DataFrame) -> DataFrame:
    """rows (side, id, day, cents, memo, block) with scenario and match_id of those that no step has to look for: with one row of either
    side at most in their block, or without a memo. The scenario of the others is null.

    A row alone in its block is unmatched, and two are what the first step says whose rule they keep. Rows are written tables' rows: they are
    read more than once.
    """
    told = rows.withColumn("_key", F.xxhash64("block"))
    crowded = told.where("block is not null").groupBy("_key").count().where(F.col("count") > ROWS_TOGETHER).select("_key", F.lit(True).alias("_crowded"))
    marked = told.join(F.broadcast(crowded), "_key", "left")
    apart = F.col("_crowded").isNotNull() | F.col("block").isNull()
    together = Window.partitionBy("block")
    of = lambda s: F.count_if(F.col("side") == s).over(together)
    span = lambda x, c: F.when(F.count(c).over(together) == 2, x)
    low, high = (lambda c: F.min(c).over(together)), (lambda c: F.max(c).over(together))
    seen = marked.where(~apart).withColumns(
        {
            "_gl": of("gl"),
            "_bank": of("bank"),
            "_gl_id": F.max(F.when(F.col("side") == "gl", F.col("id"))).over(together),
            "_days": span(F.date_diff(high("day"), low("day")), "day"),
            "_cents": span(F.try_subtract(high("cents"), low("cents")), "cents"),
            "_alike": low("memo") == high("memo"),
            "_invoice": F.col("block").startswith("#"),
        }
    )
    pair = F.coalesce(pair_rule(F.col("_days"), F.col("_cents"), F.col("_alike"), F.col("_invoice")), F.lit("unmatched"))
    few = (F.col("_gl") < 2) & (F.col("_bank") < 2)
    judged = seen.withColumn("scenario", F.when(few & (F.col("_gl") + F.col("_bank") == 2), pair).when(few, F.lit("unmatched")))
    judged = judged.withColumn("match_id", F.when(F.col("scenario") != "unmatched", F.col("_gl_id")))
    bare = marked.where(apart).withColumn("scenario", F.when(F.col("block").isNull(), F.lit("unmatched"))).withColumn("match_id", F.lit(None).cast("long"))
    columns = [*rows.columns, "scenario", "match_id"]
    return judged.select(*columns).unionByName(bare.select(*columns))


def status_of(scenario: str) -> str:
    return {"void": "void", "unmatched": "open"}.get(scenario, "review" if scenario in REVIEW else "matched")


class _Left:
    """The rows of both sides that no step has taken, but for the lone ones, which are judged first. A step that finds any writes them once,
    what it takes apart from what it leaves."""

    def __init__(self, gl: DataFrame, bank: DataFrame):
        columns = ["id", "day", "cents", "memo"]
        own = [F.col(c) for c in columns] + [block_of(F.col("memo")).alias("block")]
        rows, folder = settle_at(reduce(DataFrame.unionByName, [x.select(F.lit(s).alias("side"), *own) for s, x in zip(SIDES, (gl, bank))]), "recon_all")
        first, self.folder = settle_at(lone(rows).withColumn("took", F.col("scenario").isNotNull()), "recon_left", "took")
        remove(rows.sparkSession, folder)
        self.folder += "/took=false"
        self.lone = first.where("took").drop("took")
        self.rows = first.where("not took").select("side", *columns)
        status = F.coalesce(*[F.when(F.col("scenario") == s, F.lit(status_of(s))) for s in (*PAIRED, "near", "unmatched")])
        self.taken = [self.lone.select("side", "id", "scenario", status.alias("status"), "match_id")]

    def side(self, name: str) -> DataFrame:
        return self.rows.where(F.col("side") == name).drop("side")

    def take(self, scenario: str, matches: DataFrame) -> None:
        """matches has side, id and match_id."""
        matches = settle(matches, "recon_matches")
        if matches.isEmpty():
            return
        judged = self.rows.join(matches.withColumn("took", F.lit(True)), ["side", "id"], "left").withColumn("took", F.coalesce("took", F.lit(False)))
        written, folder = settle_at(judged, "recon_step", "took")
        self.taken.append(written.where("took").select("side", "id", F.lit(scenario).alias("scenario"), F.lit(status_of(scenario)).alias("status"), "match_id"))
        remove(self.rows.sparkSession, self.folder)
        self.rows, self.folder = written.where("not took").select(*self.rows.columns), f"{folder}/took=false"

    def take_voids(self) -> None:
        own = [voids(self.side(s)).select(F.lit(s).alias("side"), "id", F.col("void_id").alias("match_id")) for s in SIDES]
        self.take("void", reduce(DataFrame.unionByName, own))

    def take_pairs(self, scenario: str, pairs: DataFrame) -> None:
        both = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"), F.col("gl_id").alias("match_id")) for s in SIDES])
        self.take(scenario, pairs.select(F.inline(both)))

    def take_groups(self, scenario: str, many: str, one: str) -> None:
        """Each group's rows and the one row that they sum to."""
        pairs = settle(groups_to_one(self.side(many), self.side(one)), "recon_group_rows")
        totals = pairs.groupBy("one_id").agg(F.min("many_id").alias("least")).withColumn("match_id", F.col("least" if many == "gl" else "one_id"))
        rows = pairs.join(totals, "one_id").select(F.lit(many).alias("side"), F.col("many_id").alias("id"), "match_id")
        self.take(scenario, rows.unionByName(totals.select(F.lit(one).alias("side"), F.col("one_id").alias("id"), "match_id")))


def left_for(scenario: str, gl: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as a step of PAIRED finds them: without voids and the rows that steps before it take."""
    left = _Left(gl, bank)
    left.take_voids()
    before = list(PAIRED)[: list(PAIRED).index(scenario)]
    for name in before:
        left.take_pairs(name, PAIRED[name](left.side("gl"), left.side("bank")))
    kept = left.lone.where(~F.col("scenario").isin(before)).select(*left.rows.columns)
    rows = left.rows.unionByName(kept)
    return tuple(rows.where(F.col("side") == s).drop("side") for s in SIDES)


def memo_form(memo: Column, core: Column) -> Column:
    """What an invoice memo has around its core, as a number: memos of one core are equal where these are. Null if the core is not
    last, or if more than six bytes and any zeros, up to 32,767, stand before it."""
    head = F.left(memo, F.length(memo) - F.length(core))
    prefix = F.rtrim(head, F.lit("0"))
    zeros = F.length(head) - F.length(prefix)
    number = F.coalesce(F.conv(F.hex(prefix), 16, 10).cast("long"), F.lit(0)) * 32768 + zeros
    return F.when(memo.endswith(core) & (F.octet_length(prefix) <= 6) & (zeros < 32768), number)


def _sized(side: DataFrame) -> DataFrame:
    """The rows of known day and amount with core and size: the amount without its sign, as a minus, which every amount has."""
    size = F.least("cents", F.try_subtract(F.lit(0).cast("long"), F.col("cents")))
    return _cored(side.where(all_known(["day", "cents"]))).withColumn("size", size)


def found_by(scenario: str, gl: DataFrame, bank: DataFrame) -> DataFrame:
    """(gl_id, bank_id) of a step by invoices, of all rows that the steps before it leave.

    It and all steps before it, voids among them, match within one invoice and size of amount. One aggregate of numbers tells what these
    hold. One row of either side is judged there; more rows go through the steps, but not where all memos are alike (exact takes what
    similar could) or all days (similar_date finds none).
    """
    keys = ["size", "core"]
    form = F.coalesce(memo_form(F.col("memo"), F.col("core")), F.lit(-1))
    rows = reduce(DataFrame.unionByName, [_sized(x).select(F.lit(s).alias("side"), *keys, "id", "day", "cents", form.alias("form")) for s, x in zip(SIDES, (gl, bank))])
    day = lambda x: F.unix_date(x).cast("long")
    told = rows.groupBy(*keys).agg(
        *[F.count(F.when(F.col("side") == s, F.col("core"))).alias(s) for s in SIDES],  # none where the memo is of no invoice
        *[F.max(F.when(F.col("side") == s, F.col("id"))).alias(f"{s}_id") for s in SIDES],
        (day(F.max("day")) - day(F.min("day"))).alias("days"),
        F.count_if(F.col("cents") < 0).alias("minus"),
        (F.min("form") >= 0).alias("known"),
        (F.min("form") == F.max("form")).alias("alike"),
    )
    judged = told.where("gl > 0 and bank > 0").withColumn("many", (F.col("gl") > 1) | (F.col("bank") > 1) | ~F.col("known"))
    can_find = ~(F.col("known") & F.col("alike")) if scenario == "similar" else F.col("days") >= SIMILAR_DAYS[0]
    off = F.when(F.col("minus") != 1, F.lit(0))  # of two rows of one size
    hit = F.when(F.col("many"), can_find).otherwise(pair_rule(F.col("days"), off, F.col("alike"), F.lit(True)) == scenario)
    found = settle(judged.where(hit).select(*keys, "many", *[f"{s}_id" for s in SIDES]), "recon_found")
    pairs, many = found.where("not many").select("gl_id", "bank_id"), found.where("many").select(*keys)
    if many.isEmpty():
        return pairs
    own = [_sized(x).join(many, keys, "left_semi").select("id", "day", "cents", "memo") for x in (gl, bank)]
    return pairs.unionByName(PAIRED[scenario](*left_for(scenario, *own)))


def waterfall(gl: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows (side, id, scenario, status, match_id) of all rows of both sides. match_id is the least ledger id of a match, or the
    least id of a void pair; it is null for what is left."""
    left = _Left(gl, bank)
    left.take_voids()
    for name, step in PAIRED.items():
        left.take_pairs(name, step(left.side("gl"), left.side("bank")))
    left.take_groups("many_gl", "gl", "bank")
    left.take_groups("many_bank", "bank", "gl")
    left.take_pairs("near", near(left.side("gl"), left.side("bank")))
    rest = left.rows.select("side", "id", F.lit("unmatched").alias("scenario"), F.lit("open").alias("status"), F.lit(None).cast("long").alias("match_id"))
    return reduce(DataFrame.unionByName, [*left.taken, rest])


def corpus_violations(ledger: DataFrame, bank: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """PF9: counts of broken rules of the two tables."""
    inside = lambda c: F.col(c).between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    cents = lambda c: (F.col(c).cast("decimal(38,10)") * 100) % 1 == 0
    fits = lambda c: F.length(c) <= MEMO_LENGTHS[c]
    rules = [
        (ledger, "ledger", {"date": inside("gl_date"), "cents": cents("amount"), "main_memo": fits("main_memo"), "line_memo": fits("line_memo")}),
        (bank, "bank", {"date": inside("posted_date"), "cents": cents("posted_amount"), "messy_memo": fits("messy_memo")}),
    ]
    parts = []
    for table, name, own in rules:
        counted = table.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(k) for k, rule in own.items()])
        parts.append(counted.unpivot([], list(own), "rule", "violations").select(F.lit(name).alias("side"), "rule", "violations"))
    return reduce(DataFrame.unionByName, parts)
