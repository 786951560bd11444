import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.fixtures import hard_docs, hard_rows, no_docs
from tieout.llm import toxicity


def fitted(x, y, folds):
    return toxicity.newton(lambda models: toxicity.part_sums(x, y, folds, models), np.zeros(x.shape[1] + 1))


def test_models_against_their_gradients():
    rng = np.random.default_rng(5)
    x, folds = rng.normal(size=(400, 3)), np.arange(400) % toxicity.FOLDS
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(x @ [1.5, -1, 0] + 0.3)))).astype(float)
    models = fitted(x, y, folds)
    assert len(models) == toxicity.FOLDS + 1
    for f, w in enumerate(models):
        own, target = x[folds != f], y[folds != f]
        gradient = np.hstack([own, np.ones((len(own), 1))]).T @ (target - toxicity.probability(w, own))
        assert np.abs(gradient - toxicity.penalty(4) * w).max() < 1e-2


def test_a_step_too_far_is_halved():
    x, folds = np.array([[1e4], [-1e4], [9e3], [-9e3]] * 4), np.arange(16) % toxicity.FOLDS
    y = (x[:, 0] > 0).astype(float)
    assert all(np.isfinite(w).all() and w[0] > 0 for w in fitted(x, y, folds))


def test_chain_is_fitted_out_of_fold():
    """Noise that a model could learn by heart must not be trusted by the next one."""
    rng = np.random.default_rng(6)
    x, folds = rng.normal(size=(200, 80)), np.arange(200) % toxicity.FOLDS
    y = rng.integers(0, 2, 200).astype(float)
    first = fitted(x, y, folds)
    unseen = np.empty((200, 81))
    for f in range(toxicity.FOLDS):
        unseen[folds == f] = toxicity.extended(x[folds == f], [first[f]])
    second = fitted(unseen, y, folds)[-1]
    by_heart = fitted(toxicity.extended(x, [first[-1]]), y, folds)[-1]
    assert second[80] < by_heart[80]


def test_weights_are_out_of_fold():
    """A form that only one fold's toxic texts have does not weigh there."""
    presence = np.zeros((toxicity.FOLDS, 2, 3))
    presence[:, 0], presence[:, 1] = [0, 5, 100], [10, 5, 20]
    presence[1, 1, 1] = 15
    telling = toxicity.telling_forms(presence)
    assert (telling[:, 0] > 0).all() and telling[1, 1] < telling[0, 1]
    assert np.allclose(telling[0, 0], np.log(30.5 / 61) - np.log(0.5 / 301))
    assert not toxicity.telling_forms(np.zeros((toxicity.FOLDS, 2, 3))).any()


def test_partitions_sum_to_the_whole():
    rng = np.random.default_rng(8)
    x, y, fold = rng.normal(size=(50, 4)), rng.integers(0, 2, 50).astype(float), rng.integers(0, 4, 50)
    models = [rng.normal(size=5) for _ in range(toxicity.FOLDS + 1)]
    whole = toxicity.part_sums(x, y, fold, models)
    parts = [toxicity.part_sums(x[own], y[own], fold[own], models) for own in (slice(0, 20), slice(20, 50))]
    for f in range(len(models)):
        for part in range(3):
            assert np.allclose(whole[f][part], parts[0][f][part] + parts[1][f][part])


def made_docs(spark, n=800):
    rng = random.Random(15)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    bad = "idiot moron clown loser scum stupid pathetic worthless disgusting trash".split() + ["zorgle" + x for x in vocabulary[:40]]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(30, 150))]
        toxic = i % 8 == 0
        if toxic:
            foreign = rng.random() < 0.5
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(bad[10:] if foreign else bad[:10])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made_docs(spark)
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert np.mean([got[d]["toxic"] == truth[d] for d in held]) > 0.97
    assert all(0 <= got[d][f"p_{c}"] <= 1 for d in got for c in toxicity.CATEGORIES)
    words = {*"idiot moron clown loser scum stupid pathetic worthless disgusting trash".split()}
    texts = {r["doc_id"]: set(r["text"].split()) for r in docs.collect()}
    toxic = [d for d in held if truth[d]]
    assert all(sum(bool(texts[d] & words) == own for d in toxic if got[d]["p_marked"] > 0.5) for own in (True, False))


def test_whole_result_against_one_matrix(spark):
    """Vocabulary, weights out of fold, levels, the chain and all probabilities, by hand over one matrix."""
    docs, labels = made_docs(spark, 300)
    got = {r["doc_id"]: r for r in toxicity.query(docs, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    folds = {r["doc_id"]: r["f"] for r in docs.selectExpr("doc_id", f"pmod(xxhash64('fold', doc_id), {toxicity.FOLDS}) AS f").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = sorted(d for d in texts if zlib.crc32(str(d).encode()) % 5)
    forms = {d: set().union(*map(toxicity.forms, toxicity.words_of(texts[d]))) for d in known}
    n, bad = Counter(f for d in known for f in forms[d]), Counter(f for d in known if truth[d] for f in forms[d])
    toxic = sum(truth[d] for d in known)
    others = len(known) - toxic
    z = {}
    for f in n:
        if n[f] >= toxicity.LEAST_SUPPORT:
            p = n[f] / len(known)
            z[f] = (bad[f] / toxic - (n[f] - bad[f]) / others) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / toxic + 1 / others))
    vocabulary = sorted(z, key=lambda f: (-abs(z[f]), f))[: toxicity.VOCABULARY_SIZE]
    assert len(vocabulary) == toxicity.VOCABULARY_SIZE

    def matrix(ids):
        counts = [Counter(f for w in toxicity.words_of(texts[d]) for f in toxicity.forms(w)) for d in ids]
        return np.log1p(np.array([[c[f] for f in vocabulary] + [len(toxicity.words_of(texts[d]))] for c, d in zip(counts, ids)], float))

    x, y, fold = matrix(known).astype(np.float32).astype(float), np.array([truth[d] for d in known], float), np.array([folds[d] for d in known])
    has = x[:, :-1] > 0
    weight = np.zeros(len(known))
    for f in range(toxicity.FOLDS):
        seen = fold != f
        telling = np.maximum(toxicity.log_ratios(has[seen].sum(0), has[seen & (y == 1)].sum(0), seen.sum(), y[seen].sum()), 0)
        weight[fold == f] = has[fold == f] @ telling
    targets = [(y == 1) & (weight >= np.quantile(weight[y == 1], share)) for share in (2 / 3, 1 / 3)] + [y == 1]
    share = (toxic + 0.5) / (len(known) + 1)
    chains = [[] for _ in range(toxicity.FOLDS + 1)]
    for k, target in enumerate(targets):
        own = np.empty((len(known), x.shape[1] + k))
        for f in range(toxicity.FOLDS):
            own[fold == f] = toxicity.extended(x[fold == f], chains[f])
        start = np.append(np.zeros(x.shape[1] + k), np.log(share / (1 - share)))
        for chain, w in zip(chains, toxicity.newton(lambda models: toxicity.part_sums(own, target.astype(float), fold, models), start)):  # noqa: B023
            chain.append(w)
    every = sorted(texts)
    want = toxicity.extended(matrix(every), chains[-1])[:, x.shape[1] :]
    have = np.array([[got[d][f"p_{c}"] for c in toxicity.CATEGORIES] for d in every])
    assert np.abs(have - want).max() < 1e-6
    assert all(got[d]["toxic"] == (p[-1] >= toxicity.THRESHOLD) for d, p in zip(every, want))


def test_hard_rows_and_missing_labels(spark):
    docs = hard_docs(spark)
    labels = spark.createDataFrame([(3, 1, 1), (5, None, 1), (None, 1, 1), (4, 0, 0), (3, 0, 0), (6, 0, None)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        got = toxicity.query(docs, own).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in hard_rows())
    assert {r["p_toxic"] for r in got} == {0.5}
    assert toxicity.query(no_docs(spark), labels).count() == 0
