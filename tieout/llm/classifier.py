"""A quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text are scaled by their means and deviations over the training rows; cosines of random
projections of them approximate a Gaussian kernel. Each of a fixed number of partitions sums its part of the normal
equations, so what reaches the driver has one size for any corpus. The ridge scores are calibrated on rows that the
regression has not seen: counts and labels by bins of the score, made monotone by pooling adjacent violators.

Labels come from rows whose crc32(doc_id as text) mod 5 is not 0: remainder 1 calibrates, the others fit. The model may
be fitted on a bounded sample (most_labelled, by a hash of doc_id); all rows are scored. Labels, language, source
and doc_id are no inputs of a score.

Null and empty texts have statistics of zero and are scored like any other; without labels of any class every score is
1/2. doc_ids that are null count as the empty text for the fold, and have no label. Repeated labels count once, by the
largest. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.common import bounded_batches, free_name, text_or_empty, write_table

FOLDS = 5
FEATURES = 256
#: Width of the kernel, in deviations of the statistics.
WIDTH = 3.0
RIDGE = 1e-4
SEED = 11
#: Partitions that each sum a part of the normal equations.
SUMMED_IN = 8
BINS = 1000
#: Score bins lie between these values of the regression.
BIN_RANGE = (-0.5, 1.5)
MOST_LABELLED = 2_000_000
THRESHOLD = 0.3
BATCH = 512

STATISTICS = (
    "words mean_word distinct top_word lines twin_lines line_words letters capitals digits marks symbols beyond_ascii "
    "bare_marks mark_ends entropy"
).split()
_CODES = np.arange(256)
_LETTER = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122) & (_CODES < 128)
_CAPITAL = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = np.isin(_CODES, [9, 10, 11, 12, 13, 32])
_MARK = (_CODES > 32) & (_CODES < 127) & ~_LETTER & ~_DIGIT
_SYMBOL = np.isin(_CODES, list(b"#*$%&|<>"))
_PLAIN_ENDS = frozenset(b".,;:?'\")")


def statistics(text: str) -> list[float]:
    """STATISTICS of a whole text, all zero if it has no word."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    seen, n = Counter(words), len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = max(1, int(counts[~_SPACE].sum()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = counts[counts > 0] / len(data)
    marked = sum(c for w, c in seen.items() if not (b := w[-1]) >= 128 and not _LETTER[b] and not _DIGIT[b] and b not in _PLAIN_ENDS)
    bare = sum(c for w, c in seen.items() if len(w) == 1 and _MARK[w[0]])
    of = lambda group: int(counts[group].sum()) / solid
    return [
        float(np.log1p(n)),
        solid / n,
        len(seen) / n,
        max(seen.values()) / n,
        float(np.log1p(len(lines))),
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        of(_LETTER),
        of(_CAPITAL),
        of(_DIGIT),
        of(_MARK),
        of(_SYMBOL),
        of(_CODES >= 128),
        bare / n,
        marked / n,
        float(-(share * np.log2(share)).sum()),
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            made = pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "statistics": made})


def statistics_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, statistics) of all documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = bounded_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(_statistics_batches, f"doc_id {id_type}, statistics array<double>")
    return write_table(made, "document_statistics")


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5."""
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


@dataclass
class Model:
    """Scaling, random features, ridge weights and calibration; arrays of fixed size."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / WIDTH, (len(self.centre), FEATURES))
        phase = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.sqrt(2 / FEATURES) * np.cos((np.clip((x - self.centre) / self.scale, -8, 8) @ w) + phase)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.levels)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _equation_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for batch in batches:
        if batch.num_rows:
            z = model.features(matrix(batch.column("statistics")))
            a += z.T @ z
            c += z.T @ batch.column("y").to_numpy(zero_copy_only=False)
    yield pa.RecordBatch.from_pydict({"a": pa.array([a.tobytes()], pa.binary()), "c": pa.array([c.tobytes()], pa.binary())})


def _bin_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    low, high = BIN_RANGE
    for batch in batches:
        if batch.num_rows:
            at = (model.raw(matrix(batch.column("statistics"))) - low) / (high - low) * BINS
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip(at, 0, BINS - 1).astype(np.int32)), "y": batch.column("y")})


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The weighted least-squares non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist()):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.repeat([m for _, m, _ in blocks], [n for *_, n in blocks])


def fit(statistics: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on the labelled rows outside the held-out fold. labels has doc_id and y (0 or 1)."""
    names = range(len(STATISTICS))
    known = labels.where("y is not null").groupBy("doc_id").agg(F.max("y").cast("double").alias("y"))
    rows = statistics.join(known, "doc_id").where(fold() != 0).withColumn("fold", fold())
    n = rows.count()
    if n > most_labelled:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * most_labelled / n))
    rows = write_table(rows, "labelled_statistics")
    at = [F.get("statistics", k) for k in names]
    moments = rows.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(at)], *[F.stddev_pop(x).alias(f"s{k}") for k, x in enumerate(at)]).first()
    centre = np.array([moments[f"m{k}"] or 0.0 for k in names])
    scale = np.array([max(moments[f"s{k}"] or 0.0, 1e-3) for k in names])
    model = Model(centre, scale, np.zeros(FEATURES + 1), np.empty(0), np.empty(0))
    if not n:
        return model
    fitted = rows.where("fold <> 1").select("statistics", "y").repartition(SUMMED_IN)
    parts = fitted.mapInArrow(partial(_equation_batches, model=model), "a binary, c binary").collect()
    a = sum(np.frombuffer(r["a"]).reshape(FEATURES + 1, -1) for r in parts)
    c = sum(np.frombuffer(r["c"]) for r in parts)
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(FEATURES + 1), c)
    binned = rows.where("fold = 1").select("statistics", "y").mapInArrow(partial(_bin_batches, model=model), "bin int, y double")
    bins = sorted(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect())
    low, high = BIN_RANGE
    model.knots = np.array([low + (r["bin"] + 0.5) * (high - low) / BINS for r in bins])
    if bins:
        levels = isotonic(np.array([float(r["n"]) for r in bins]), np.array([r["y"] / r["n"] for r in bins]))
        # what lies beyond is told apart by the regression: levels stay open to both sides
        model.levels = np.clip(0.98 * levels + 0.01 * (model.knots - low) / (high - low) + 0.005, 0, 1)
    return model


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(model.score(matrix(batch.column("statistics"))))})


def score(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Rows (doc_id, score) of all documents."""
    made = statistics_of(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(partial(_score_batches, model=fit(made, labels, most_labelled)), f"doc_id {id_type}, score double")


def _added_batches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            made = pa.array([statistics(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])


def _keep_batches(batches: Iterator[pa.RecordBatch], name: str, model: Model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            kept = pa.array(model.score(matrix(batch.column(name))) >= threshold)
            yield batch.drop_columns([name]).filter(kept)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns. Documents are written with their statistics, which are
    computed once: both the fit and the filter read them."""
    name = free_name(docs, "statistics")
    made = bounded_batches(docs).mapInArrow(partial(_added_batches, name=name), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))
    rows = write_table(made, "document_statistics")
    model = fit(rows.select("doc_id", F.col(name).alias("statistics")), labels, most_labelled)
    return rows.mapInArrow(partial(_keep_batches, name=name, model=model, threshold=threshold), docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels.select("doc_id", F.col("quality").alias("y"))).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
