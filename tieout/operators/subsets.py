"""Which rows of a group sum to which of several totals: meeting in the middle.

For groups of one day and memo that as a whole sum to no row of the other side, because two batches share a short memo or a row
is left over. Totals are served in order of id, each by the fewest rows that sum to it, two at least; of as few, by those first in
order of id. Rows serve one total at most. A group may have any number of rows and totals: of few rows the sums of either half are
listed, more rows go to fewest.py, with the same result. A group is one entry of a task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.operators.fewest import fewest
from tieout.session import bounded_batches

#: Up to so many rows the sums of either half, 4,096 at most, are simply listed. The result does not depend on it.
LISTED_ROWS = 24
#: Of more rows a pair is first looked for in order of id. The result does not depend on it.
PASSED_BY = 1000
TASKS_A_CORE = 4
GROUP = ["day", "memo"]

Row = tuple[int, int]


def best_subset(rows: list[Row], total: int) -> tuple[int, ...] | None:
    """Ids of the rows (id, cents), in order of id, that sum to total: the fewest, two at least, and of those the first."""
    if len(rows) > LISTED_ROWS:
        found = fewest([c for _, c in rows], total)
        return found and tuple(rows[i][0] for i in found)
    half = len(rows) // 2

    def listed(part: list[Row]) -> dict[int, list[tuple[int, tuple[int, ...]]]]:
        """By sum, the best of each number of rows below two and the best of all."""
        sums: dict[int, list] = {}
        for n in range(len(part) + 1):
            for chosen in combinations(part, n):
                own = sums.setdefault(sum(c for _, c in chosen), [])
                if len(own) < 3 and all(n > m for m, _ in own):
                    own.append((n, tuple(i for i, _ in chosen)))
        return sums

    first, second = listed(rows[:half]), listed(rows[half:])
    found = [(n + m, a + b) for s, ones in first.items() for n, a in ones for m, b in second.get(total - s, ()) if n + m >= 2]
    return min(found)[1] if found else None


class _Left:
    """The rows of a group that no total has taken, by place in order of id, in order of amount, and the places of each amount."""

    def __init__(self, rows: list[Row]):
        self.rows = rows
        self.cents = {at: c for at, (_, c) in enumerate(rows)}
        self.order = sorted((c, at) for at, c in self.cents.items())
        self.places: dict[int, list[int]] = {}
        for at in reversed(self.cents):
            self.places.setdefault(self.cents[at], []).append(at)

    def _other(self, cents: int, at: int) -> int | None:
        places = self.places.get(cents, [])
        while places and places[-1] not in self.cents:
            places.pop()
        return next((x for x in reversed(places) if x != at and x in self.cents), None)

    def _pair(self, rows: dict[int, int], total: int) -> tuple[int, int] | None:
        """The first two rows that sum to total: the first row that has another, which then comes after it."""
        return next(((at, other) for at, c in rows.items() if (other := self._other(total - c, at)) is not None), None)

    def best(self, total: int) -> tuple[int, ...] | None:
        """The places of best_subset. Where no row is negative, rows larger than the total less the least row are not looked at."""
        least = self.order[0][0] if self.order else 0
        n = bisect_right(self.order, (total - least, len(self.rows))) if least >= 0 else len(self.order)
        if n < 2:
            return None
        # of many rows some of the first have another
        if n > PASSED_BY and (found := self._pair(self.cents, total)):
            return found
        few = dict(sorted((at, c) for c, at in self.order[:n]))
        return self._pair(few, total) or best_subset(list(few.items()), total)

    def take(self, chosen: tuple[int, ...]) -> None:
        """Without these rows, and any of the same ids."""
        for at in chosen:
            for step in (1, -1):
                x = at
                while 0 <= x < len(self.rows) and self.rows[x][0] == self.rows[at][0]:
                    if x in self.cents:
                        del self.order[bisect_left(self.order, (self.cents.pop(x), x))]
                    x += step
        if 2 * len(self.cents) < len(self.rows):  # what has gone is not passed by again
            self.__init__([self.rows[at] for at in self.cents])


def served(rows: list[Row], totals: list[Row]) -> Iterator[tuple[int, int]]:
    """(row id, total id)."""
    left = _Left(sorted(rows))
    for total_id, total in sorted(totals):
        if chosen := left.best(total):
            yield from [(left.rows[at][0], total_id) for at in chosen]
            left.take(chosen)


def _served_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for k in range(len(batch)):  # a group after the other, by columns: groups may be large
            own = [batch.column(c)[k].values for c in ("rows", "totals")]
            made += served(*[list(zip(*[x.field(f).to_pylist() for f in ("id", "cents")])) for x in own])
        many, one = zip(*made) if made else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(many, pa.int64()), pa.array(one, pa.int64())], ["many_id", "one_id"])


def split_groups(many: DataFrame, one: DataFrame, whole: DataFrame) -> DataFrame:
    """(many_id, one_id) of groups that have totals on the other side, but for those in whole (day, memo)."""

    # a part of two rows is the whole
    enough = many.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where("n > 2").select(*GROUP)
    wanted = enough.join(one.select(*GROUP).distinct(), GROUP).join(whole.select(*GROUP), GROUP, "left_anti")
    lists = lambda side, name: side.where("cents is not null").join(wanted, GROUP, "left_semi").groupBy(*GROUP).agg(F.collect_list(F.struct("id", "cents")).alias(name))
    # few bytes may be much work: the groups are dealt to all cores, whatever their size
    tasks = TASKS_A_CORE * many.sparkSession.sparkContext.defaultParallelism
    both = lists(many, "rows").join(lists(one, "totals"), GROUP).repartition(tasks, *GROUP).select("rows", "totals")
    return bounded_batches(both).mapInArrow(_served_batches, "many_id long, one_id long")
