"""Keyed state under Structured Streaming: every micro-batch is merged into Parquet tables with the store's own functions.

A table is split into buckets by the hash of its key. A batch rewrites only the buckets that its keys fall into; a manifest (a small table of bucket and version) says which folder
holds each bucket. Folders are versioned, so a batch that is tried again reads the version before it and writes its own anew; what two later versions have
replaced is deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Merge = Callable[[DataFrame, DataFrame], DataFrame]
BUCKET = "__bucket"


def _manifest(path: str, n: int) -> str:
    return f"{path}/manifest/v{n:010d}"


def _folder(path: str, version: int, bucket: int) -> str:
    return f"{path}/data/v{version:010d}/{BUCKET}={bucket}"


def _bucket(key: str | None, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)


def merge_batches(
    stream: DataFrame, path: str, merge: Merge, schema: str, checkpoint: str, once: bool = False, key: str | None = None, buckets: int = 64,
) -> StreamingQuery:
    """Keeps ``merge(old table, batch)`` under ``path`` while the stream runs; once: only what is there now. key: the column by which the merge is, in the
    batches and in the table; without it the whole table is one bucket. ``merge`` must treat keys one by one."""

    def write(batch: DataFrame, n: int) -> None:
        spark, held = batch.sparkSession, _versions(batch.sparkSession, path, n)
        batch = batch.withColumn(BUCKET, _bucket(key, buckets))
        touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())  # as many as buckets at most
        old = _read(spark, path, {b: v for b, v in held.items() if b in touched}, schema)
        new = merge(old, batch.drop(BUCKET)).withColumn(BUCKET, _bucket(key, buckets))
        new.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/data/v{n + 1:010d}")
        made = [r[0] for r in spark.read.schema(f"{schema}, {BUCKET} int").parquet(f"{path}/data/v{n + 1:010d}").select(BUCKET).distinct().collect()]
        kept = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(made, n + 1)
        spark.createDataFrame(sorted(kept.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(_manifest(path, n + 1))
        before = _versions(spark, path, n - 1) if n > 0 else {}
        for b, v in before.items():
            if held.get(b) != v:  # neither this version nor the one before it, from which this batch may be tried again, has it
                where = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, v, b))
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _versions(spark: SparkSession, path: str, n: int) -> dict[int, int]:
    """Of version n the version of each bucket's folder; version 0 has none."""
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").parquet(_manifest(path, n)).collect()} if n > 0 else {}


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema: str) -> DataFrame:
    folders = [_folder(path, v, b) for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """Version n; version 0 is empty. The last two versions are there."""
    return _read(spark, path, _versions(spark, path, n), schema)
