"""Scans: files of both sides, ledger reports, positioned words, mappings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout import schemas
from tieout.session import bounded_batches


def ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the general ledger; malformed rows are an error."""
    return spark.read.csv(path, schema=schemas.GENERAL_LEDGER, header=True, mode="FAILFAST")


def bank_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: the bank side; memos of digits alone stay text."""
    return spark.read.csv(path, schema=schemas.BANK, header=True, mode="FAILFAST")


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """A row number over all columns, the same for the same rows: equal rows are numbered within their hash."""
    from pyspark.sql import Window

    columns = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.withColumn("_h", F.xxhash64(*columns))
    nth = F.row_number().over(Window.partitionBy("_h").orderBy(*columns))
    return keyed.withColumn(name, F.xxhash64("_h", nth)).drop("_h")


def reports_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: saved ledger reports, one file each, as (report_id, body)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("report_id"), F.col("value").alias("body"))


#: What brings a report's JSON by its name: a saved file, a web client, a test.
Fetch = Callable[[str], str]


def _fetch_batches(batches: Iterator, fetch: Fetch) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        names = batch.column("report_id").to_pylist()
        yield pa.RecordBatch.from_pydict({"report_id": pa.array(names, pa.string()), "body": pa.array(list(map(fetch, names)), pa.string())})


def fetched_reports(wanted: DataFrame, fetch: Fetch) -> DataFrame:
    """SRC3: ledger reports (report_id, body) of the names in wanted (report_id), by a function of the caller's, which runs in the
    tasks. Write the result before it is used twice: each use fetches anew."""
    return bounded_batches(wanted).select("report_id").mapInArrow(partial(_fetch_batches, fetch=fetch), "report_id string, body string")


def company_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC4."""
    return spark.read.json(path, multiLine=True)


def words_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC2."""
    return spark.read.schema(schemas.WORDS).parquet(path)


def mappings_parquet(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: recorded mappings by row, or a model's answers by request hash."""
    return spark.read.parquet(path)


def cached_answers(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC6: a model's answers of earlier runs; None before the first."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return mappings_parquet(spark, path) if there else None


PageParser = Callable[[str, bytes], Iterator[dict]]


def pdf_words(spark: SparkSession, path: str, parser: PageParser | None = None) -> DataFrame:
    """SRC1: words of PDF files. The parser (name, bytes) -> word rows runs in the tasks; by default that of pdfplumber, where
    it is installed."""
    parse = parser or parse_pdf
    names = schemas.schema(schemas.WORDS).names

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(parse(name, data))
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows])

    files = bounded_batches(spark.read.format("binaryFile").load(path)).select("path", "content")
    typed = ", ".join(f"{f.name} {'long' if f.dataType.simpleString() == 'int' else f.dataType.simpleString()}" for f in schemas.schema(schemas.WORDS))
    return files.mapInArrow(run, typed).select(*[F.col(f.name).cast(f.dataType) for f in schemas.schema(schemas.WORDS)])


def parse_pdf(name: str, data: bytes) -> Iterator[dict]:
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as document:
        for number, page in enumerate(document.pages, 1):
            for k, w in enumerate(page.extract_words()):
                yield {"doc_id": name, "page": number, "word_seq": k, "text": w["text"], "x0": w["x0"], "x1": w["x1"], "top": w["top"], "page_height": float(page.height)}
