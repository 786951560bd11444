"""Spelling variants of words, grouped under their most frequent near form.

Two words are near if they differ by one inserted, deleted or replaced letter. Then their letters, taken as multisets, that is as
binary vectors over (letter, occurrence), have a Hamming distance of two at most. PartEnum signatures find all such pairs by
equality: the dimensions are dealt to PARTS parts, at most two of which hold the differences, so leaving out some two parts the
vectors agree. Each word gives a signature for each two parts left out; words that share one meet by an equi-join and are verified.

A signature also holds the first or the last letters of its word, half as many as the shortest word has: an edit that touches the
one leaves the other. That keeps all pairs and drops most anagrams. Signatures of one word alone go before the join. Where a
signature has more than MOST_IN_BUCKET words, its words meet through the strings that deleting one letter leaves, which only near
words and few others share, so no bucket lists the square of its size.

All joins are merge joins at every size: Spark sizes what signatures make by the words they are made of, and written tables by their
compressed files, far too low for a broadcast.

Words are counted over whole texts. Null texts have no words, a null doc_id stands as an empty string; repeated rows count each time;
a text of one huge run is one word. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, discard, lower, write_table

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has so many times the occurrences of its variant.
TIMES = 5
#: In one of so many (document, run) pairs a letter is dropped, by the contract.
DROPPED_IN = 199
PARTS = 4
MOST_IN_BUCKET = 512
SIGNATURES = pa.schema([("signature", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, run) of all maximal runs of letters."""
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"))


def with_typos(doc_id: Column, run: Column) -> Column:
    """The run, or without one of its letters where the contract's hash says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROPPED_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n) of words long and frequent enough."""
    words = runs(docs).select(with_typos(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def signatures(word: str, half: int) -> list[int]:
    """Equal for near words in one at least: of the letters in all but two parts, with the first or last letters."""
    parts, seen = [[] for _ in range(PARTS)], {}
    for letter in word:
        nth = seen[letter] = seen.get(letter, 0) + 1
        parts[(ord(letter) + nth) % PARTS].append(f"{letter}{nth}")
    whole = ["".join(sorted(p)) for p in parts]
    kept = [f"{i}{j}|" + "|".join(p for k, p in enumerate(whole) if k not in (i, j)) for i, j in combinations(range(PARTS), 2)]
    return [xxhash.xxh64_intdigest(f"{side}|{k}") - (1 << 63) for side in (f"<{word[:half]}", f">{word[-half:]}") for k in kept]


def left_by_deletion(word: str, half: int) -> list[int]:
    """Of the word itself and of all strings that deleting one letter leaves."""
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}]


def _keyed(batches: Iterator[pa.RecordBatch], keys, half: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            some = batch.slice(at, 2000)
            made = [keys(w, half) for w in some.column("word").to_pylist()]
            rows = some.take(pa.array([k for k, x in enumerate(made) for _ in x], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([s for x in made for s in x], pa.int64()), rows.column("word"), rows.column("n")], schema=SIGNATURES)


def _pairs(keyed: DataFrame) -> DataFrame:
    """Verified pairs of words that share a signature."""
    a, b = (keyed.select("signature", F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    return a.join(b.hint("merge"), (a["signature"] == b["signature"]) & (F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """Rows (a, a_n, b, b_n), a < b, of all near pairs of words (word, n) of at least least_length letters (2 or more)."""
    half = least_length // 2
    ddl = "signature long, word string, n long"
    keyed = bounded_batches(words).mapInArrow(partial(_keyed, keys=signatures, half=half), ddl)
    sizes = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = write_table(keyed.join(sizes.hint("merge"), "signature"), "spelling_signatures")
    small = shared.where(F.col("size") <= MOST_IN_BUCKET)
    large = shared.where(F.col("size") > MOST_IN_BUCKET).groupBy("word", "n").agg(F.lit(0)).select("word", "n")
    rest = write_table(large.mapInArrow(partial(_keyed, keys=left_by_deletion, half=half), ddl), "spelling_deletions")
    return _pairs(small.drop("size")).unionByName(_pairs(rest)).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of forms (word, form): each form is followed to the last, twice as far each round.

    Counts grow TIMES-fold along forms, so there is no circle and few rounds do.
    """
    now = write_table(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = now.join(on.hint("merge"), "root", "left")
        later = write_table(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling_roots")
        discard(now)
        now = later
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def group(words: DataFrame, least_length: int = LEAST_LENGTH, times: int = TIMES) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of a written table of words (word, n)."""
    pairs = write_table(near_pairs(words, least_length), "spelling_pairs")
    both = pairs.select("a", "b", "b_n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("order"), F.col("b"))).alias("m"))
    near = words.join(best.hint("merge"), "word", "left").withColumn("fits", -F.col("m.order") >= times * F.col("n"))
    judged = write_table(
        near.select("word", F.when(F.col("fits"), F.col("m.b")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("fits"), -F.col("m.order")).alias("form_n")),
        "spelling_forms",
    )
    ends = roots(judged.where("form is not null"))
    return judged.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(docs: DataFrame) -> DataFrame:
    return group(write_table(vocabulary(docs), "spelling_words"))
