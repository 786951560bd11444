"""Both sides of transactions matched as they come, in any order, with rows held open in state.

Rows of one amount and memo are held until no row that is still to come can match them: until the watermark is further than the
largest shift beyond the last of their island of days (see operators/islands.py). Then the island is paired as the batch
operator pairs it, nearest first, so late and early files give the same pairs; what is left is given out as open, and the
state is dropped. Rows later than the watermark allows are not seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tieout.operators.recon import SIDES, SLIGHT_DAYS, allocate

DAY_MS = 86_400_000
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MATCHES = "gl_id long, bank_id long, gap int"
#: A side whose rows say how far time has come.
END = "end"
OPEN = "cents long, memo string, side string, id long, day long"
#: Amounts and memos are held in so many lists: more rows that are open at a time need more, so that a list stays short.
LISTS = 4096


def pairs_of(rows: list[tuple[str, int, int]], low: int, high: int) -> Iterator[tuple[int | None, int | None, int | None]]:
    """(gl_id, bank_id, gap in days) of an island's rows (side, id, day), and rows that stay open with the other id null."""
    ids: dict[tuple[str, int], list[int]] = {}
    for side, row, day in sorted(rows, key=lambda r: r[1]):
        ids.setdefault((side, day), []).append(row)
    days = sorted({d for _, d in ids})
    places = [{"at": d, **{s: len(ids.get((s, d), ())) for s in SIDES}} for d in days]
    taken = set()
    for p, q, first_gl, first_bank, n in allocate(places, low, high):
        for k in range(n):
            gl, bank = ids["gl", p][first_gl + k], ids["bank", q][first_bank + k]
            taken |= {("gl", gl), ("bank", bank)}
            yield gl, bank, q - p
    for side, row, _ in rows:
        if (side, row) not in taken:
            yield (row, None, None) if side == "gl" else (None, row, None)


class HeldOpen(StatefulProcessor):
    """Of some amounts and memos: the rows that may still be matched. One timer is set at a time, for the island that ends first."""

    def __init__(self, low: int, high: int):
        self.low, self.high = low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", OPEN)

    def closes(self, day: int) -> int:
        """When no row can come any more that is within reach of a day."""
        return (day + self.high + 1) * DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r["cents"], r["memo"], r["side"], r["id"], r["at"]) for r in rows]
        self.held.appendList(new)
        self.handle.registerTimer(self.closes(min(r[-1] for r in new)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, reach = timerValues.getCurrentWatermarkInMs(), self.high
        held = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], r[1], r[-1]))
        islands: list[list[tuple]] = []
        for row in held:
            if islands and islands[-1][-1][:2] == row[:2] and row[-1] - islands[-1][-1][-1] <= reach:
                islands[-1].append(row)
            else:
                islands.append([row])
        done = [i for i in islands if self.closes(i[-1][-1]) <= now]
        waiting = [i for i in islands if self.closes(i[-1][-1]) > now]
        if waiting:
            self.held.put([r for i in waiting for r in i])
            self.handle.registerTimer(min(self.closes(i[-1][-1]) for i in waiting))
        elif held:
            self.held.clear()
        for island in done:
            yield from (Row(gl_id=gl, bank_id=bank, gap=gap) for gl, bank, gap in pairs_of([r[2:] for r in island], self.low, self.high))

    def close(self) -> None:
        pass


def shifted_as_they_come(both: DataFrame, lateness: str = "7 days", low: int = SLIGHT_DAYS[0], high: int = SLIGHT_DAYS[1], lists: int = LISTS) -> DataFrame:
    """Set 2 over a stream of rows (side, id, day, cents, memo): (gl_id, bank_id, gap) of each pair, and of each row that found none with
    the other id null. Rows of the side END only move time on; rows without day, amount or memo are in no pair and not given out.
    The session needs the settings PROVIDER."""
    timed = both.where("day is not null").withColumn("time", F.col("day").cast("timestamp")).withColumn("at", F.unix_date("day").cast("long"))
    # it names the time, so that rows of END are not dropped before they have been seen
    counts = F.col("time").isNotNull() & (F.col("side") != END) & F.col("cents").isNotNull() & F.col("memo").isNotNull()
    keyed = timed.withWatermark("time", lateness).where(F.when(F.col("time").isNotNull(), counts)).withColumn("list", F.pmod(F.xxhash64("cents", "memo"), F.lit(lists))).groupBy("list")
    return keyed.transformWithState(HeldOpen(low, high), MATCHES, "Append", "EventTime")


def run_to_end(both: DataFrame, folder: str, lateness: str = "7 days", **settings: int) -> StreamingQuery:
    """Match all that is there now; pairs go to folder/out, exactly once, the state to folder/state."""
    for name, value in PROVIDER.items():
        both.sparkSession.conf.set(name, value)
    sink = shifted_as_they_come(both, lateness, **settings).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    query = sink.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
