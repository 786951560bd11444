"""Counts over everything: forms of all labelled texts."""

import random

from tieout.llm import toxicity


def test_forms_are_counted_beyond_the_sample(spark):
    """zorgle is in 40 toxic texts, of which a sample of 60 of 400 holds too few for the least support."""
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(names, k=8)) + (" zorgle" if i % 10 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(10_000 + i, 1) for i in range(4000)], "doc_id long, y int")
    chain = toxicity.fit(docs, labels, most_labelled=60)
    assert "zorgle" in chain.vocabulary
    assert chain.weights[-1][chain.vocabulary["zorgle"]] > 0


def test_labels_without_documents_and_copies_leave_the_sample_whole(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(i, f"text {i}") for i in range(50)] * 20, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, y int")
    rows = toxicity.sampled(docs, known, 30).collect()
    assert len(rows) == len({r["text"] for r in rows}) == 30
