"""Rows that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("slice", T.StringType()),
        T.StructField("n", T.DoubleType()),
    ]
)


def hard_rows(seed=7, n=40):
    rng = random.Random(seed)
    words = ["the", "river", "Stone", "über", "naïve", "x", "1984", "don't", "a,b", "日本語", "🙂", "of", "and"]
    shared = " ".join(rng.choice(words) for _ in range(80))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]
    texts += [shared, f"start {shared} end", f"{shared}\n{shared}", None, "", " \t\n ", "word", "a" * 9000]
    texts += [" ".join(f"w{rng.randint(0, 500)}" for _ in range(30_000)), texts[3], texts[3], "copied text " * 30, "copied text " * 30]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), "k", 1, "s", 0.5) for i, t in enumerate(texts)]
    return rows + [rows[3], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def hard_docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
