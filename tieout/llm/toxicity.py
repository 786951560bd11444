"""Toxicity by a classifier chain.

The labels know one class, toxic; how severe a toxic text is comes from the data: the weight of the telling forms (words and
beginnings of words) that it has, each weighing how many times more of the toxic texts than of others have it. The
upper third of toxic texts by weight is severe, the upper two thirds are marked. A text is weighed out of fold, by
what the other folds tell.

Categories are predicted one after the other, severe, marked and then toxic: each linear model sees the telling forms, and the
probabilities of all categories before it. While fitting, those probabilities are out of fold, so that a later model learns
from what it will see; for scoring they are those of the models fitted on all folds. Models are fitted by Newton's method:
each of a fixed number of partitions sums its part of the gradients and Hessians of all folds in one pass, so what reaches
the driver has one size for any corpus and any sample.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0. The vocabulary is chosen by counts over all labelled
documents. The chain is fitted on a bounded sample of them (most_labelled, by a hash of doc_id; equal texts of one doc_id
count once there); all rows are scored over their whole texts in one pass.

Null and empty texts have no words and are scored like any other; without labels of both classes a category's
probability is the share of toxic labels. Repeated labels count once, by the largest. Extra columns are not read; an empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, key_filter, passes, text_or_empty, write_table

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6, 7)
VOCABULARY_SIZE = 384
#: Labelled documents with a feature, at least.
LEAST_SUPPORT = 5
MOST_LABELLED = 20_000
#: Forms that a task holds before it passes their counts on.
MOST_FORMS = 1 << 18
FOLDS = 4
RIDGE = 1.0
#: Passes of Newton's method for each category, at most, and the relative gain of the last.
STEPS, LEAST_GAIN = 10, 1e-4
#: Partitions that each sum a part of the gradients and Hessians.
SUMMED_IN = 8
THRESHOLD = 0.5
BATCH = 512
#: From which share of toxic texts on, by weight, a category holds.
SEVERITY = {"severe": 2 / 3, "marked": 1 / 3}
CATEGORIES = [*SEVERITY, "toxic"]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def forms(word: str) -> set[str]:
    """The word, and its beginnings with a mark that tells them from words."""
    return {word} | {word[:n] + "-" for n in BEGINNINGS if len(word) >= n}


class _Places(dict):
    """Places in the vocabulary of a word's forms."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1 << 19:
            self.clear()
        own = self[word] = tuple(self.vocabulary[f] for f in forms(word) if f in self.vocabulary)
        return own


@dataclass
class Chain:
    """A model for each category, each over the vocabulary, the number of words and the categories before; the last weight of one
    is its intercept."""

    names: list[str] = field(default_factory=lambda: list(CATEGORIES))
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def matrix(self, texts: list[str]) -> np.ndarray:
        """Logarithms of the counts of each feature, and of the words."""
        x = np.zeros((len(texts), len(self.vocabulary) + 1))
        places = _Places(self.vocabulary) if not hasattr(self, "_places") else self._places
        self._places = places
        for k, text in enumerate(texts):
            words = words_of(text)
            for p in filter(None, map(places.__getitem__, words)):
                for i in p:
                    x[k, i] += 1
            x[k, -1] = len(words)
        return np.log1p(x)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return extended(x, self.weights)[:, len(self.vocabulary) + 1 :]

    def __getstate__(self):
        return {"names": self.names, "vocabulary": self.vocabulary, "weights": self.weights}


def extended(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    """x and the probabilities of a chain of models."""
    for w in chain:
        x = np.hstack([x, probability(w, x)[:, None]])
    return x


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-margin(w, x)))


def margin(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def penalty(width: int) -> np.ndarray:
    """Of each weight; next to none of the intercept."""
    return np.append(np.full(width - 1, RIDGE), 1e-6)


def part_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(Hessian, gradient, loss) of rows for each model: model f does not see fold f, the last sees all."""
    z, sums = np.hstack([x, np.ones((len(x), 1))]), []
    for f, w in enumerate(models):
        seen = fold != f
        own, target, m = z[seen], y[seen], margin(w, x[seen])
        p = 1 / (1 + np.exp(-m))
        v = np.maximum(p * (1 - p), 1e-6)
        sums.append(((own * v[:, None]).T @ own, own.T @ (target - p), float((np.log1p(np.exp(m)) - target * m).sum())))
    return sums


def newton(sums: Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray, float]]], start: np.ndarray) -> list[np.ndarray]:
    """Ridge logistic models of all folds and of all rows, by passes that give part_sums over the rows."""
    models = [start.copy() for _ in range(FOLDS + 1)]
    best: list[tuple[float, np.ndarray] | None] = [None] * len(models)
    own = penalty(len(start))
    for _ in range(STEPS):
        gains = []
        for f, (hessian, gradient, loss) in enumerate(sums(models)):
            w, loss = models[f], loss + float((own * models[f] ** 2).sum()) / 2
            if best[f] and loss > best[f][0]:  # Newton's step went too far
                models[f] = (w + best[f][1]) / 2
                gains.append(1.0)
                continue
            gains.append((best[f][0] - loss) / max(abs(loss), 1e-9) if best[f] else 1.0)
            best[f] = (loss, w)
            models[f] = w + np.linalg.solve(hessian + np.diag(own), gradient - own * w)
        if max(gains) < LEAST_GAIN:
            break
    return [w for _, w in best]


def log_ratios(n: np.ndarray, bad: np.ndarray, rows: float, toxic: float) -> np.ndarray:
    """How many times more of the toxic texts than of others have a form, as a logarithm; n texts have it, bad toxic ones. It is a ratio of
    shares, so forms of a language with few texts weigh about what those of one with many do."""
    return np.log((bad + 0.5) / (toxic + 1)) - np.log((n - bad + 0.5) / (rows - toxic + 1))


def _form_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, documents, toxic documents) summed over a task, in parts; form null has all documents."""
    total, toxic = Counter(), Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"form": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64()), "bad": pa.array([toxic[f] for f in total], pa.int64())})

    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            own = {None}.union(*map(forms, set(words_of(text))))
            total.update(own)
            if y:
                toxic.update(own)
            if len(total) > MOST_FORMS:
                yield part()
                total.clear()
                toxic.clear()
    yield part()


def _matrix_batches(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            x = chain.matrix(batch.column("text").to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"fold": batch.column("fold"), "y": batch.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, fold) of the rows, a block at a time."""
    for batch in batches:
        if batch.num_rows:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, width).astype(np.float64)
            yield x, batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("fold").to_numpy(zero_copy_only=False)


def _presence_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each fold and class, how many texts have each form; the last number counts the texts."""
    sums = np.zeros((FOLDS, 2, width))
    for x, y, fold in _blocks(batches, width):
        has = np.hstack([x[:, :-1] > 0, np.ones((len(x), 1))])
        for f in range(FOLDS):
            for c in range(2):
                sums[f, c] += has[(fold == f) & (y == c)].sum(axis=0)
    yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})


def telling_forms(presence: np.ndarray) -> np.ndarray:
    """(fold, form): the weight of each form by the texts of the other folds; forms that speak against toxic have none."""
    whole, made = presence.sum(axis=0), []
    for own in presence:
        good, bad = whole - own
        made.append(np.maximum(log_ratios((good + bad)[:-1], bad[:-1], good[-1] + bad[-1], bad[-1]), 0))
    return np.stack(made)


def weight_of(x: np.ndarray, fold: np.ndarray, telling: np.ndarray) -> np.ndarray:
    """Of the telling forms of each row."""
    return ((x[:, : telling.shape[1]] > 0) * telling[fold]).sum(axis=1)


def _weight_batches(batches: Iterator[pa.RecordBatch], width: int, telling: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The weights of toxic texts."""
    found = [weight_of(x[y == 1], fold[y == 1], telling) for x, y, fold in _blocks(batches, width)]
    yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate(found or [np.empty(0)]).tobytes()], pa.binary())})


def cuts_of(weights: np.ndarray) -> np.ndarray:
    """The least weight of each category of SEVERITY."""
    return np.quantile(weights, list(SEVERITY.values())) if len(weights) else np.zeros(len(SEVERITY))


def target_of(category: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, telling: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """What a category's model learns: rows of the category are ones."""
    if category >= len(cuts):
        return y
    return ((y == 1) & (weight_of(x, fold, telling) >= cuts[category])).astype(np.float64)


def _sum_batches(batches: Iterator[pa.RecordBatch], width: int, telling: np.ndarray, cuts: np.ndarray, before: list[list[np.ndarray]], models: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """part_sums over a partition; before has, for each fold and for all rows, the chain of categories fitted so far."""
    total: list | None = None
    for x, y, fold in _blocks(batches, width):
        k = len(before[0])
        target = target_of(k, x, y, fold, telling, cuts)
        seen = np.empty((len(x), width + k))
        for f in range(FOLDS):
            seen[fold == f] = extended(x[fold == f], before[f])
        own = part_sums(seen, target, fold, models)
        total = own if total is None else [tuple(a + b for a, b in zip(s, t)) for s, t in zip(total, own)]
    if total:
        upper = np.triu_indices(len(models[0]))
        packed = [np.concatenate([h[upper], g, [loss]]) for h, g, loss in total]
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.stack(packed).tobytes()], pa.binary())})


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Chain:
    """labels has doc_id and y (0 or 1)."""
    chain = Chain()
    crc = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    known = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.max("y").alias("y")).where(crc != 0)
    texts = bounded_batches(docs).where(crc != 0).select("doc_id", text_or_empty().alias("text"))
    # labels grow with the corpus, so they meet the texts by a merge join at every size; texts sure to have none stay where they are
    own_id = F.xxhash64("doc_id").alias("id")
    labelled = passes(texts.select("*", own_id), key_filter(known.select(own_id), "id"), "id", "hit").where("hit").select("doc_id", "text")
    made = labelled.join(known.hint("merge"), "doc_id").select("text", "y").mapInArrow(_form_batches, "form string, n long, bad long")
    counts = write_table(made.groupBy("form").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "toxicity_forms")
    n, bad = counts.where("form is null").select("n", "bad").first() or (0, 0)
    share = (bad + 0.5) / (n + 1)
    constant = np.log(share / (1 - share))
    if not bad or bad == n:
        chain.weights = [np.append(np.zeros(1 + k), constant) for k in range(len(chain.names))]
        return chain
    # how far the share among toxic documents is from that among others, in its own deviations
    p, p1, p0 = F.col("n") / n, F.col("bad") / bad, (F.col("n") - F.col("bad")) / (n - bad)
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / bad + 1 / (n - bad)))
    top = counts.where((F.col("n") >= LEAST_SUPPORT) & F.col("form").isNotNull()).select("form", z.alias("z")).orderBy(F.abs("z").desc(), "form").limit(VOCABULARY_SIZE).collect()
    chain.vocabulary = {r["form"]: k for k, r in enumerate(top)}
    width = len(top) + 1
    rows = sampled(texts, known, most_labelled).mapInArrow(partial(_matrix_batches, chain=chain), "fold int, y int, x binary")
    rows = write_table(rows.repartition(SUMMED_IN), "toxicity_rows")

    def collected(step: Callable) -> list[np.ndarray]:
        return [np.frombuffer(r["sums"], np.float64) for r in rows.mapInArrow(step, "sums binary").collect()]

    telling = telling_forms(sum(collected(partial(_presence_batches, width=width))).reshape(FOLDS, 2, width))
    cuts = cuts_of(np.concatenate(collected(partial(_weight_batches, width=width, telling=telling))))
    before: list[list[np.ndarray]] = [[] for _ in range(FOLDS + 1)]
    for k in range(len(chain.names)):
        size = width + k + 1
        upper = np.triu_indices(size)

        def sums(models: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
            total = sum(collected(partial(_sum_batches, width=width, telling=telling, cuts=cuts, before=before, models=models)))
            unpacked = []
            for own in total.reshape(FOLDS + 1, -1):
                hessian = np.zeros((size, size))
                hessian[upper] = own[: len(upper[0])]
                hessian += np.triu(hessian, 1).T
                unpacked.append((hessian, own[len(upper[0]) : -1], own[-1]))
            return unpacked

        for chained, w in zip(before, newton(sums, np.append(np.zeros(size - 1), constant))):
            chained.append(w)
    chain.weights = before[-1]
    return chain


def sampled(texts: DataFrame, known: DataFrame, most_labelled: int) -> DataFrame:
    """Rows (fold, y, text) of at most most_labelled labelled documents that are in the table."""
    marked = texts.withColumn("_hash", F.xxhash64("text"))
    some = marked.select("doc_id", "_hash").join(known.hint("merge"), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_hash").limit(most_labelled)
    rows = marked.join(F.broadcast(some), ["doc_id", "_hash"]).dropDuplicates(["doc_id", "_hash"])
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    return rows.select(fold.alias("fold"), F.col("y").cast("int").alias("y"), "text")


def _score_batches(batches: Iterator[pa.RecordBatch], chain: Chain) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            p = chain.probabilities(chain.matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {f"p_{c}": pa.array(p[:, k]) for k, c in enumerate(chain.names)})


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Rows (doc_id, p_category...) of all documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = ", ".join([f"doc_id {id_type}", *[f"p_{c} double" for c in chain.names]])
    return bounded_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(_score_batches, chain=chain), made)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = fit(docs, labels.select("doc_id", F.col("toxic").alias("y")))
    return score(docs, chain).withColumn("toxic", (F.col("p_toxic") >= THRESHOLD).cast("int"))
