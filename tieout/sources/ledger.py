"""SRC3, SRC4: a ledger service as a source of Spark's.

    ledger.register(spark)
    spark.read.format("ledger_reports").option("client", "module:function").option("reports", '["r1", "r2"]').load()

gives rows (report_id, body), body being what the client, a function from a report's id to text, returns for it; a null body is an empty
report. Each partition fetches some reports (per_partition, 1) and asks again (attempts, 3; wait, seconds before the second
attempt, twice as many before each later one) where the client raises; a lost task is Spark's to run again, so a client must bear being asked
twice. The client is named, not sent: the tasks import it.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tieout.session import bounded_batches

NAME = "ledger_reports"


@dataclass
class Wanted(InputPartition):
    """The reports of a partition."""

    reports: tuple[str, ...]

    def __init__(self, reports: tuple[str, ...]):
        super().__init__(reports)
        self.reports = reports


class LedgerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if ":" not in options.get("client", ""):
            raise ValueError("option client has to name a function, as module:function")
        self.client = options["client"]
        self.reports = [str(r) for r in json.loads(options.get("reports", "[]"))]
        self.per_partition = int(options.get("per_partition", "1"))
        self.attempts, self.wait = int(options.get("attempts", "3")), float(options.get("wait", "1"))

    def partitions(self) -> list[Wanted]:
        n = self.per_partition
        return [Wanted(tuple(self.reports[k : k + n])) for k in range(0, len(self.reports), n)] or [Wanted(())]

    def read(self, partition: Wanted) -> Iterator[tuple[str, str | None]]:
        module, _, name = self.client.partition(":")
        client = getattr(importlib.import_module(module), name)
        for report in partition.reports:
            for attempt in range(1, self.attempts + 1):
                try:
                    body = client(report)
                    break
                except Exception:
                    if attempt == self.attempts:
                        raise
                    time.sleep(self.wait * 2 ** (attempt - 1))
            yield report, body


class LedgerReports(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "report_id string, body string"

    def reader(self, schema) -> LedgerReader:
        return LedgerReader(self.options)


def register(spark: SparkSession) -> None:
    """The format is known to the session, and the tasks find this package."""
    bounded_batches(spark.range(0))
    spark.dataSource.register(LedgerReports)
