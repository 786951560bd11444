"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes for good (1) or bad (-1), or abstains (0). Votes come in at most 3 ** rules patterns whatever the
corpus, so only their counts are gathered; expectation-maximisation over them, written as one SQL expression,
estimates each rule's accuracy on either class and the share of good documents without any label; no accuracy is set or bounded by hand, each
has a weak prior. Its posterior for each pattern goes
back to the documents by a join with that bounded table. A document is kept if its posterior is high enough
and the base rule holds, in place of having to pass every rule.

Null and empty texts have no words, zero counts, fail the base rule, and are not kept. Repeated rows give repeated
results; extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import text_or_empty, write_table

SPACE = r"[\x20\x09-\x0D]+"
#: Posterior probability of a good document from which one is kept.
LEAST_POSTERIOR = 0.5
ROUNDS = 30
#: Where expectation-maximisation starts: the share of good documents, and each rule's accuracy on either class.
START = {"prior": 0.8, "on_good": 0.99, "on_bad": 0.5}
#: What is held of an accuracy before a vote is seen, on good and on bad documents, and the weight of that as a share of all
#: documents. It keeps accuracies off 0 and 1, tells the two classes apart, and counts alike at every size.
HELD, HELD_SHARE = {"on_good": 0.9, "on_bad": 0.5}, 0.01


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _length_of(pattern: str) -> Column:
    """Characters in matches of a pattern."""
    return (F.char_length("_text") - F.char_length(F.regexp_replace("_text", pattern, ""))).cast("long")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes over the columns of features()."""
    c = F.col
    symbols, repeats = _share(c("n_symbols"), c("word_chars")), _share(c("n_repeat_words"), c("n_words"))
    doubles, capitals = _share(c("n_dup_lines"), c("n_lines")), _share(c("n_capitals"), c("word_chars"))
    letters, runs, bare = _share(c("n_letters"), c("word_chars")), _share(c("n_mark_runs"), c("n_words")), _share(c("n_bare_marks"), c("n_words"))
    mean, distinct = _share(c("word_chars"), c("n_words")), _share(c("n_distinct"), c("n_words"))
    return {
        "long_enough": _vote(c("n_words") >= 80, c("n_words") < 50),
        "few_symbols": _vote(symbols < 0.02, symbols > 0.06),
        "mostly_letters": _vote(letters > 0.85, letters < 0.75),
        "few_mark_runs": _vote(runs < 0.05, runs > 0.2),
        "few_bare_marks": _vote(bare < 0.05, bare > 0.2),
        "few_double_lines": _vote(doubles < 0.2, doubles > 0.6),
        "few_repeats": _vote(repeats < 0.1, repeats > 0.3),
        "few_capitals": _vote(capitals < 0.25, capitals > 0.5),
        "word_lengths": _vote((mean >= 3) & (mean <= 11), (mean < 2) | (mean > 15)),
        "varied_words": _vote(distinct > 0.2, (distinct < 0.05) & (c("n_words") > 50)),
    }


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep, and counts over the whole text.

    A repeated window is found by sorting: each window's hash gives the upper bits of a number and its place the
    lower, so equal windows are neighbours once the numbers are sorted; neighbours are compared word by word. Where different
    windows share those upper bits, as in very long texts, windows that share them are sorted once more, by their words.
    """
    words = docs.select(
        *[F.col(k) for k in keep],
        text_or_empty().alias("_text"),
        F.filter(F.split(text_or_empty(), SPACE, -1), lambda w: w != "").alias("_words"),
        F.filter(F.split(text_or_empty(), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("_lines"),
    )
    counted = words.select(
        *[F.col(k) for k in keep],
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _length_of(r"\p{Lu}+").alias("n_capitals"),
        _length_of(r"\p{L}+").alias("n_letters"),
        F.regexp_count("_text", F.lit(r"[^\p{L}\p{N}\s]{2,}")).cast("long").alias("n_mark_runs"),
        F.regexp_count("_text", F.lit(r"(?<=\s)[^\p{L}\p{N}\s]+(?=\s)")).cast("long").alias("n_bare_marks"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        F.when(
            F.size("_words") > 3,
            F.transform(
                F.sequence(F.lit(0), F.size("_words") - 3),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).alias("_windows"),
    )
    names = [c for c in counted.columns if c.startswith("n_") or c == "word_chars"]
    repeating = counted.select(
        *[F.col(k) for k in keep],
        *names,
        "_words",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.col("_windows")).alias("_windows"),
    )
    sorted_keys = repeating.select(
        *[F.col(k) for k in keep],
        *names,
        F.when(F.col("_windows").isNotNull(), F.col("_words")).alias("_words"),
        "_windows",
        F.expr("shiftleft(1L, cast(ceil(log2(size(_windows) + 1)) as int)) - 1").alias("_mask"),
    ).withColumn(
        "_keys",
        F.sort_array(F.transform("_windows", lambda h, i: h.bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))),
    )
    near = lambda x, k, test: test(F.get("_keys", k - 1), x) | test(x, F.get("_keys", k + 1))
    clash = F.size(F.filter("_keys", lambda x, k: _alike(F.get("_keys", k - 1), x) & ~_same(F.get("_keys", k - 1), x))) > 0
    by_words = F.sort_array(F.transform(F.filter("_keys", lambda x, k: near(x, k, _alike)), _window))
    ordered = sorted_keys.withColumn("_ordered", F.when(clash, by_words))
    equal = lambda a, b: F.coalesce(a["words"] == b["words"], F.lit(False))
    found = ordered.select(
        *[F.col(k) for k in keep],
        *names,
        F.array_sort(
            F.when(
                F.col("_ordered").isNotNull(),
                F.transform(
                    F.filter("_ordered", lambda x, k: equal(F.get("_ordered", k - 1), x) | equal(x, F.get("_ordered", k + 1))),
                    lambda x: x["at"],
                ),
            ).otherwise(F.transform(F.filter("_keys", lambda x, k: near(x, k, _same)), _place))
        ).alias("_at"),
    )
    steps = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    return found.select(
        *[F.col(k) for k in keep],
        *names,
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.col("_mask")).cast("int")


def _window(key: Column) -> Column:
    """The words and the place of a key's window."""
    at = _place(key)
    return F.struct(F.struct(*[F.get("_words", at + k).alias(f"w{k}") for k in range(3)]).alias("words"), at.alias("at"))


def _alike(a: Column, b: Column) -> Column:
    """Whether two keys share the bits of the hash; false beyond the ends."""
    return F.coalesce(a.bitwiseXOR(b).between(F.lit(0).cast("long"), F.col("_mask")), F.lit(False))


def _same(a: Column, b: Column) -> Column:
    """Whether two keys are of equal windows; false beyond the ends."""
    i, j = _place(a), _place(b)
    words = [F.get("_words", i + k) == F.get("_words", j + k) for k in range(3)]
    return F.when(_alike(a, b), words[0] & words[1] & words[2]).otherwise(F.lit(False))


def voted(counted: DataFrame) -> DataFrame:
    """Add pattern, the votes as digits -1, 0, 1 raised by one, and base_failed."""
    code = sum(((v + 1) * 3**k for k, v in enumerate(rules().values())), F.lit(0))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("pattern", code.cast("int")).withColumn("base_failed", base)


def _log_odds(votes: Column, model: Column) -> Column:
    """Log odds of good: the prior's, and each vote's at its rule's accuracies."""
    ratio = F.zip_with(
        votes,
        F.arrays_zip(model["on_good"].alias("g"), model["on_bad"].alias("b")),
        lambda v, a: F.when(v == 1, F.log(a["g"] / (1 - a["b"]))).when(v == -1, F.log((1 - a["g"]) / a["b"])).otherwise(F.lit(0.0)),
    )
    return _total(ratio) + F.log(model["prior"] / (1 - model["prior"]))


def _posterior(votes: Column, model: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes, model)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def fit(votes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row: seen, the patterns that occur with their votes and counts, and model, with prior, on_good and on_bad."""
    n = len(rules())
    digits = F.array(*[(F.expr(f"(pattern div {3**k}) % 3") - 1).cast("double") for k in range(n)])
    counts = votes.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = counts.select("pattern", digits.alias("votes"), "n").agg(
        F.array_sort(F.collect_list(F.struct("pattern", "votes", "n"))).alias("seen")
    )

    def refit(weighed: Column) -> Column:
        every = _total(F.transform(weighed, lambda p: p["n"]))

        def accuracy(side: float, share: Callable[[Column], Column], held: float) -> Callable[[Column], Column]:
            """Of a rule's votes on one class, the share on that class's side."""
            weight = HELD_SHARE * F.greatest(every, F.lit(1.0))

            def of(r: Column) -> Column:
                cast = _total(F.transform(weighed, lambda p: p["n"] * share(p) * F.abs(F.get(p["votes"], r))))
                right = _total(F.transform(weighed, lambda p: F.when(F.get(p["votes"], r) == side, p["n"] * share(p)).otherwise(F.lit(0.0))))
                return (right + weight * held) / (cast + weight)

            return of

        index = F.sequence(F.lit(0), F.lit(n - 1))
        prior = (_total(F.transform(weighed, lambda p: p["n"] * p["good"])) + 1) / (every + 2)
        return F.struct(
            prior.alias("prior"),
            F.transform(index, accuracy(1.0, lambda p: p["good"], HELD["on_good"])).alias("on_good"),
            F.transform(index, accuracy(-1.0, lambda p: 1 - p["good"], HELD["on_bad"])).alias("on_bad"),
        )

    def weigh(model: Column) -> Column:
        good = lambda p: _posterior(p["votes"], model).alias("good")
        return F.transform("seen", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), good(p)))

    start = F.struct(*[(F.array_repeat(F.lit(x), n) if k else F.lit(x)).alias(name) for k, (name, x) in enumerate(START.items())])
    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda m, _: _let(weigh(m), refit))
    return one.select("seen", model.alias("model"))


def posteriors(fitted: DataFrame) -> DataFrame:
    """Rows (pattern, posterior) for the patterns that occur: 3 ** rules at most."""
    return fitted.select(F.explode("seen").alias("p"), "model").select(
        F.col("p.pattern").alias("pattern"), _posterior(F.col("p.votes"), F.col("model")).alias("posterior")
    )


def accuracies(fitted: DataFrame) -> DataFrame:
    """Rows (rule, on_good, on_bad): what was estimated."""
    names = F.array(*[F.lit(r).alias("rule") for r in rules()])
    of = F.arrays_zip(names.alias("rule"), F.col("model.on_good").alias("on_good"), F.col("model.on_bad").alias("on_bad"))
    return fitted.select(F.inline(of))


def judge(votes: DataFrame, fitted: DataFrame, least: float = LEAST_POSTERIOR) -> DataFrame:
    """Add posterior and kept. fitted has 3 ** rules rows at most, so it is sent to all."""
    return votes.join(F.broadcast(fitted), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def assess(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, counts, base_failed, posterior, kept) of documents (doc_id, text)."""
    votes = write_table(voted(features(docs, ["doc_id"])), "rule_votes")
    return judge(votes, write_table(posteriors(fit(votes)), "rule_posteriors"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents kept, with their own columns.

    Documents and votes are written once: both the fit and the filter read them, and no filter is pushed below the counts,
    where it would repeat them.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    votes = write_table(voted(features(whole, ["_row"])).select("_row", "pattern", "base_failed"), "rule_votes")
    return judge(votes, write_table(posteriors(fit(votes)), "rule_posteriors")).where("kept").select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    return assess(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )
