"""Tables that cut lineage, in the folder the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Used only where spark.checkpoint.dir is unset and driver and executors are one process, as in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/tieout"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; a cluster has to name one, since its machines do not share their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return LOCAL_SCRATCH


def settle_at(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """df settled, and its folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back, so that loops do not repeat it and lost executors cost a read."""
    return settle_at(df, name)[0]


def settle_counting(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """df settled, and aggregates over its rows by name, taken on the way by the pass that writes it."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    table = settle(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return table, seen.get


def join_files(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, in order of their names, as one file. They are copied in small pieces, so the driver holds none."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.fs.Path(folder), hadoop.fs.Path(path)
    files = source.getFileSystem(conf)
    parts = sorted((s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    sink = hadoop.fs.FileSystem.newInstance(target.toUri(), conf) if target.toUri().getScheme() else hadoop.fs.FileSystem.newInstance(conf)
    try:
        sink.setWriteChecksum(False)
        out = sink.create(target, True)
        for part in parts:
            data = files.open(part)
            hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            data.close()
        out.close()
    finally:
        sink.close()


def remove(spark: SparkSession, folder: str) -> None:
    """A folder that nothing reads any more, with all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads any more."""
    for file in table.inputFiles()[:1]:
        remove(table.sparkSession, file.rpartition("/")[0])
