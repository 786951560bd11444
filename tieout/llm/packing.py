"""Best-fit packing with exact-complement hashing.

Documents are encoded (see bpe) and closed by one end token; documents longer than a sequence are cut so that only
the first piece may be shorter. Lengths never exceed the capacity, so their histogram has at most that many rows
whatever the corpus: only it reaches the driver. There the plan is made. The longest length left opens a
sequence; the gap is looked up in the index of single, pair and triple length sums; a combination that fills it
exactly is consumed as often as the counts allow; else the longest length that fits goes in (best fit) and
the new gap is looked up. The plan maps ranks within a length to sequences and offsets, and is applied to all pieces by
their exact distributed ranks.

Null texts count as empty: one piece, the end token alone. Repeated rows are packed each. Extra columns are not read;
an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.bpe import BATCH, VOCABULARY, codec
from tieout.llm.common import bounded_batches, exact_rank, slices_for, text_or_empty, write_table

CAPACITY = 2048
END_ID = 0
RANKED_TOGETHER = 500


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first that may be shorter."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    end = np.array([end_id], np.uint32)
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH):
            batch = whole.slice(at, BATCH)
            rows: dict[str, list] = {k: [] for k in ("of", "piece", "start", "length", "ids_crc32", "ids")}
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = np.concatenate([own.encode(text), end]).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    data = ids[start : start + length].tobytes()
                    for column, value in zip(rows.values(), (k, piece, start, length, zlib.crc32(data), data if with_ids else None)):
                        column.append(value)
            out = {"doc_id": batch.column("doc_id").take(pa.array(rows["of"], pa.int64()))}
            out |= {"piece": pa.array(rows["piece"], pa.int32())}
            out |= {c: pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32")}
            if with_ids:
                out["ids"] = pa.array(rows["ids"], pa.binary())
            yield pa.RecordBatch.from_pydict(out)


class ComplementIndex:
    """Which single lengths, pairs and triples of available lengths sum to a gap."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.capacity = counts.copy(), len(counts) - 1
        self.there = self.counts > 0
        lengths = self.there.astype(np.int64)
        ordered = np.rint(np.fft.irfft(np.fft.rfft(lengths, 4 * len(counts)) ** 2, 4 * len(counts))).astype(np.int64)
        self.pair_ways = ordered[: len(counts)]  # ordered pairs (a, b) of available lengths by their sum

    def largest(self, limit: int, used: Counter) -> int:
        """The longest available length up to limit beyond what is used; 0 if there is none."""
        x = limit
        while x > 0:
            fits = np.flatnonzero(self.there[1 : x + 1])
            if not len(fits):
                return 0
            x = int(fits[-1]) + 1
            if self.counts[x] > used[x]:
                return x
            x -= 1
        return 0

    def _enough(self, items: tuple[int, ...], used: Counter) -> bool:
        return all(self.counts[x] >= used[x] + n for x, n in Counter(items).items())

    def exact(self, gap: int, used: Counter) -> tuple[int, ...] | None:
        """One, two or three lengths that sum to gap, longest first."""
        if self.there[gap] and self._enough((gap,), used):
            return (gap,)
        if self.pair_ways[gap]:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in a[self.there[a] & self.there[gap - a]].tolist():
                if self._enough((x, gap - x), used):
                    return (x, gap - x)
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for x in a[self.there[a] & (self.pair_ways[gap - a] > 0)].tolist():
            rest = gap - x
            b = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
            for y in b[self.there[b] & self.there[rest - b]].tolist():
                if self._enough((x, y, rest - y), used):
                    return (x, y, rest - y)
        return None

    def consume(self, items: Counter, times: int) -> None:
        for x, n in items.items():
            self.counts[x] -= n * times
            if not self.counts[x]:
                self.there[x] = False
                others = np.flatnonzero(self.there[: self.capacity + 1 - x])
                self.pair_ways[others + x] -= 2
                if 2 * x <= self.capacity:
                    self.pair_ways[2 * x] -= 1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, per sequence, first sequence, offset): ranks of a length from the first on
    lie in consecutive sequences, so many in each, from offset on."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    index, taken, sequence, runs = ComplementIndex(counts), Counter(), 0, []
    while longest := index.largest(capacity, Counter()):
        used, gap = Counter([longest]), capacity - longest
        while gap:
            if tail := index.exact(gap, used):
                used.update(tail)
                break
            if not (best := index.largest(gap, used)):
                break
            used[best] += 1
            gap -= best
        times = min(int(index.counts[x]) // n for x, n in used.items())
        offset = 0
        for x, n in sorted(used.items(), reverse=True):
            runs.append((x, taken[x], n * times, n, sequence, offset))
            taken[x] += n * times
            offset += n * x
        index.consume(used, times)
        sequence += times
    return runs


def _place_batches(batches: Iterator[pa.RecordBatch], runs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for x in np.unique(length).tolist():
            own, at = runs[x], np.flatnonzero(length == x)
            run = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
            seat = rank[at] - run[:, 0]
            sequence[at] = run[:, 2] + seat // run[:, 1]
            offset[at] = run[:, 3] + seat % run[:, 1] * x
        kept = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
        yield pa.RecordBatch.from_pydict(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with the piece's ids if asked for."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    cut_up = partial(_piece_batches, path=path, capacity=capacity, end_id=end_id, with_ids=with_ids)
    pieces = write_table(bounded_batches(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(cut_up, made), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list] = {}
    for length, first, _, per, sequence, offset in plan(histogram, capacity):
        by_length.setdefault(length, []).append((first, per, sequence, offset))
    runs = {x: np.array(r, np.int64) for x, r in by_length.items()}
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    sliced = pieces.withColumn("slice", F.pmod(order, F.lit(slices_for(max(histogram.values(), default=0), RANKED_TOGETHER))))
    ranked = exact_rank(sliced, ["length"], "slice", ["doc_id", "piece", "ids_crc32"], "rank", "of_length").drop("slice", "of_length")
    placed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(partial(_place_batches, runs=runs), f"{placed}, sequence_id long, offset long")


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
