"""Whitening of embeddings by the singular values of their centred rows.

Centred rows are brought to triangular form block by block: a task folds its rows, some hundred at a time, into one R by QR, and the
Rs are folded FOLDED_TOGETHER at a time until few are left. The last R, of the dimension's size whatever the number of rows,
is bidiagonalised and solved on the driver (qd.py), so the covariance is never formed. Its vectors over their deviations whiten.

Entries c become whole numbers x = floor(64 c) + 1,000,000, so sums and deviations are exact. The fit is over distinct x vectors.

Dropped are rows whose vector is null or empty, holds null or non-finite entries, or an entry beyond MOST_ENTRY, for which x would not be
exact; and rows whose vector has another length than most (of lengths as frequent, than the longer). Components
whose deviation is zero to working precision cannot whiten and are not returned; so equal rows alone, or none, give no
rows. deviation is null where it is beyond 64 bits. Repeated rows stay; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import bounded_batches, discard, write_table
from tieout.llm.qd import EPS, eigen_of_gram

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Beyond it 64 c is no exact whole number.
MOST_ENTRY = float(2**46)
#: A component whose deviation is a smaller part of the largest has none to working precision.
LEAST_DEVIATION = 1e5 * EPS
FOLDED_TOGETHER = 64
ROWS_A_BLOCK = 512


@dataclass(frozen=True)
class Fit:
    """What whitens: n rows with sums s, unit vectors in columns with eigenvalues e of the covariance, and its trace."""

    n: int
    s: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.s) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """Rows (vec_id, x) of the usable vectors of embeddings (vec_id, embedding)."""
    entry = lambda c: c.cast("double")
    usable = F.forall("embedding", lambda c: F.coalesce(F.abs(entry(c)) <= MOST_ENTRY, F.lit(False))) & (F.size("embedding") > 0)
    x = F.transform("embedding", lambda c: F.floor(entry(c) * SCALE).cast("long") + OFFSET)
    return embeddings.where(F.col("embedding").isNotNull()).where(usable).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_A_BLOCK):
            yield _matrix(batch.column("x").slice(at, ROWS_A_BLOCK))


def _entries(parts: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"place": pa.array(range(parts.size), pa.int32()), "part": pa.array(parts.ravel(), kind)})


def _summed(df: DataFrame, each, width: int, kind: str) -> list:
    """Sums of a task's numbers over all tasks: each gives its width numbers, which are summed by place."""
    parts = df.mapInArrow(each, f"place int, part {kind}")
    sums = {r["place"]: r["total"] for r in parts.groupBy("place").agg(F.sum("part").alias("total")).collect()}
    return [sums.get(k, 0) for k in range(width)]


def _sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    total, bound = np.zeros(d + 1, object), 0
    for x in _blocks(batches):
        total[:d] += x.sum(0).astype(object) if np.abs(x).max() < 2**53 else x.astype(object).sum(0)
        total[d] += len(x)
        bound += 1
    if bound:
        yield _entries(np.array([int(v) for v in total], object), pa.decimal128(38, 0))


def _triangles(batches: Iterator[pa.RecordBatch], n: int, s: np.ndarray) -> Iterator[pa.RecordBatch]:
    r = None
    for x in _blocks(batches):
        own = (n * x - s) / n
        r = np.linalg.qr(own if r is None else np.vstack([r, own]), "r")
    if r is not None:
        yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})


def _folded(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    r = None
    for batch in batches:
        for data in batch.column("r").to_pylist():
            own = np.frombuffer(data).reshape(-1, d)
            r = np.linalg.qr(own if r is None else np.vstack([r, own]), "r")
    if r is not None:
        yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})


def _covariance(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    total = None
    for x in _blocks(batches):
        z = fit.whitened(x)
        own = np.concatenate([z.sum(0), (z.T @ z).ravel()])
        total = own if total is None else total + own
    if total is not None:
        yield _entries(total, pa.float64())


def triangle(distinct: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """R of the centred rows, whose R'R is theirs."""
    d = len(s)
    parts = write_table(distinct.mapInArrow(partial(_triangles, n=n, s=s), "r binary"), "whitening_r")
    while (k := parts.count()) > FOLDED_TOGETHER:
        dealt = parts.repartition(-(-k // FOLDED_TOGETHER))
        later = write_table(dealt.mapInArrow(partial(_folded, d=d), "r binary"), "whitening_r")
        discard(parts)
        parts = later
    rows = [np.frombuffer(row["r"]).reshape(-1, d) for row in parts.collect()]
    return np.linalg.qr(np.vstack([np.zeros((d, d)), *rows]), "r")


def fitted(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Fit | None:
    """The fit over a written table of distinct x vectors of d entries; None where nothing varies."""
    *sums, n = _summed(distinct, partial(_sums, d=d), d + 1, "decimal(38,0)")
    n, s = int(n), np.array([int(v) for v in sums], object)
    s = s.astype(np.int64) if max(map(abs, s)) * 2 < 2**63 else s
    r = triangle(distinct, n, s)
    values, vectors = eigen_of_gram(r / np.sqrt(n))
    kept = min(components, int((values > values[0] * LEAST_DEVIATION**2).sum()))
    return Fit(n, s, vectors[:, :kept], values[:kept], float((r * r).sum()) / n) if kept else None


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    k = len(fit.values)
    sums = np.array(_summed(distinct, partial(_covariance, fit=fit), k + k * k, "double"))
    mean = sums[:k] / fit.n
    return float(np.abs(sums[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    whole = fit.n * x.astype(object) - fit.s if fit.n * int(np.abs(x).max()) >= 2**62 else fit.n * x - fit.s
    if len(x) and int(np.abs(whole).max()) ** 2 * x.shape[1] >= 2**63:
        made = (whole.astype(object) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in made]
    return (whole * whole).sum(1).tolist()


def _rows(batches: Iterator[pa.RecordBatch], fit: Fit, error: float) -> Iterator[pa.RecordBatch]:
    k = len(fit.values)
    for batch in batches:
        for at in range(0, len(batch), ROWS_A_BLOCK):
            some = batch.slice(at, ROWS_A_BLOCK)
            x, m = _matrix(some.column("x")), len(some)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": some.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, fit.n), pa.int64()),
                    "deviation": pa.array(_deviations(x, fit), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    "whitened": pa.array(fit.whitened(x).astype(float).ravel()),
                    "explained": pa.array(np.tile(fit.values / fit.trace, m)),
                    "identity_error": pa.array(np.full(m * k, error)),
                }
            )


def query(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    ddl = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = whole_numbers(bounded_batches(embeddings))
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], ddl)
    own = usable.where(F.size("x") == lengths["d"])
    distinct = write_table(own.select("x").distinct(), "whitening_fit")
    fit = fitted(distinct, lengths["d"], components)
    if fit is None:
        return spark.createDataFrame([], ddl)
    return own.mapInArrow(partial(_rows, fit=fit, error=identity_error(distinct, fit)), ddl)
