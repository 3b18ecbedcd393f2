"""Helpers that the corpus operators share: the shared work folder, materialised steps and word splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.rounds import BATCH_BYTES, materialise, materialise_by, small_batches, work_folder  # noqa: F401

#: ASCII upper case to lower case; every other byte stays.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def partitions_for(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operators' own names, so that extra columns never clash."""
    small_batches(df.sparkSession)
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
