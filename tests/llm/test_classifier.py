import random
import zlib

import numpy as np

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import classifier


def test_isotonic_against_all_pools():
    rng = np.random.default_rng(3)
    for _ in range(50):
        w, m = rng.uniform(0.5, 3, 8), rng.uniform(0, 1, 8)
        got = classifier.isotonic(w, m)
        # the fit's value at i: max over j <= i of min over k >= i of the mean of j..k
        mean = lambda j, k: float((w[j : k + 1] * m[j : k + 1]).sum() / w[j : k + 1].sum())
        want = [max(min(mean(j, k) for k in range(i, 8)) for j in range(i + 1)) for i in range(8)]
        assert np.allclose(got, want)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    d = len(classifier.STATISTICS)
    model = classifier.Model(np.zeros(d), np.ones(d), None, None, None)
    x = rng.normal(0, 0.7, (60, d))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * classifier.WIDTH**2))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def made_docs(spark, n=900):
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        good = rng.random() < 0.8
        if not good:
            w = rng.choice([[x + "###" for x in w], [x.upper() + "!!" for x in w], w[:5] * 30])
        rows.append((i, " ".join(w)))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_columns(spark):
    docs, labels = made_docs(spark)
    got = classifier.query(docs, labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = {r["doc_id"] for r in classifier.keep_good(docs, labels.withColumnRenamed("quality", "y")).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}


def scores_by_hand(texts, truth):
    """Scores of all texts by one matrix: no partitions, no sums, no bins of bins."""
    x = np.array([classifier.statistics(t) for t in texts.values()])
    fold = np.array([zlib.crc32(str(d).encode()) % 5 for d in texts])
    y = np.array([truth[d] for d in texts], float)
    known = x[fold != 0]
    model = classifier.Model(known.mean(axis=0), np.maximum(known.std(axis=0), 1e-3), None, None, None)
    z = model.features(x)
    fit = fold > 1
    model.weights = np.linalg.solve(z[fit].T @ z[fit] + classifier.RIDGE * fit.sum() * np.eye(z.shape[1]), z[fit].T @ y[fit])
    low, high = classifier.BIN_RANGE
    at = np.clip((z[fold == 1] @ model.weights - low) / (high - low) * classifier.BINS, 0, classifier.BINS - 1).astype(int)
    bins = np.unique(at)
    n, mean = np.array([(at == b).sum() for b in bins], float), np.array([y[fold == 1][at == b].mean() for b in bins])
    knots = low + (bins + 0.5) * (high - low) / classifier.BINS
    levels = [max(min(np.average(mean[j : k + 1], weights=n[j : k + 1]) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    levels = np.clip(0.98 * np.array(levels) + 0.01 * (knots - low) / (high - low) + 0.005, 0, 1)
    return dict(zip(texts, np.interp(z @ model.weights, knots, levels)))


def test_scores_against_one_matrix(spark):
    docs, labels = made_docs(spark, 400)
    got = {r["doc_id"]: r["score"] for r in classifier.query(docs, labels).collect()}
    want = scores_by_hand({r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in labels.collect()})
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in got) < 1e-6


def test_held_out_labels_are_not_learned(spark):
    docs, labels = made_docs(spark, 300)
    flipped = labels.withColumn("quality", (classifier.fold() == 0).cast("int") * (1 - labels.quality) + (classifier.fold() != 0).cast("int") * labels.quality)
    a, b = (sorted(map(tuple, classifier.query(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_hard_rows_and_missing_labels(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(3, 1, None), (5, None, 1), (None, 1, 1), (4, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = classifier.query(docs, own).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in hard_rows())
        assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got} == {0.5}
    assert classifier.query(no_docs(spark), labels).count() == 0
