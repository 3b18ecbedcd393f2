"""A store of jobs by day, or by month: a folder for each, so that a batch rewrites the days it touches and retention drops folders instead of rewriting the store.

``DATE`` says the day of a row; rows without it are in the folder of no day. Batches and retention overwrite single days' folders (dynamic partition overwrite), from rows that are written to the shared folder first, so that no folder is
read while it is replaced. Days that nothing touches keep their files.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rounds import materialise

DATE, DAY = "extracted_date", "day"
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


class DatedStore:
    def __init__(self, spark: SparkSession, folder: str, schema: str, unit: str = "day") -> None:
        """schema: that of the rows, with ``extracted_date``; unit: day, or month or year, whose folders are named by their first day, for long histories of few rows."""
        self.spark, self.folder, self.schema, self.unit = spark, folder.rstrip("/"), schema, unit

    def _day(self) -> Column:
        return F.to_date(DATE) if self.unit == "day" else F.trunc(DATE, self.unit)

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def days(self) -> list[date | None]:
        """The days that have a folder, read from the folders' names."""
        where, fs = self._fs()
        names = [s.getPath().getName().split("=")[1] for s in fs.listStatus(where) if s.isDirectory() and "=" in s.getPath().getName()] if fs.exists(where) else []
        return sorted((None if n == NO_DAY else date.fromisoformat(n) for n in names), key=lambda d: d or date.min)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {DAY} date").parquet(self.folder) if self.days() else self.spark.createDataFrame([], f"{self.schema}, {DAY} date")

    def rows(self, since: date | None = None) -> DataFrame:
        """All rows, or those of the days from ``since`` on; other days aren't read."""
        found = self._read()
        return (found if since is None else found.where(F.col(DAY) >= F.lit(since))).drop(DAY)

    def _replace(self, rows: DataFrame, days: list[date | None]) -> None:
        """``rows`` are all that the ``days`` have from now on."""
        rows = materialise(rows, "days")
        held = {r[DAY] for r in rows.select(DAY).distinct().collect()}  # a row a day
        if held:
            rows.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.folder)
        where, fs = self._fs()
        for day in days:
            if day not in held:
                fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{DAY}={NO_DAY if day is None else day}"), True)

    @staticmethod
    def _of(days: list[date | None]) -> Column:
        some = [F.lit(d) for d in days if d is not None]
        inside = F.col(DAY).isin(some) if some else F.lit(False)
        return inside | F.col(DAY).isNull() if None in days else inside

    def put(self, batch: DataFrame, key: str = "id") -> None:
        """Rows of the batch replace those of their day with their key; a key whose day changes must be removed from its old day by the caller."""
        new = materialise(batch.withColumn(DAY, self._day()), "batch")
        days = [r[DAY] for r in new.select(DAY).distinct().collect()]
        old = self._read().where(self._of(days)).join(new.select(key).distinct(), key, "left_anti")
        self._replace(old.unionByName(new.select(*old.columns)), days)

    def retain(self, letters: DataFrame, as_of: datetime, days: int = 30, key: str = "id") -> list[date | None]:
        """Drops rows older than ``days`` that have no letter (job_id); the days that were touched. Rows without a date have no age and stay only with a letter."""
        cut = as_of - timedelta(days=days)
        old = [d for d in self.days() if d is None or d <= cut.date()]
        if not old:
            return []
        rows = self._read().where(self._of(old))
        lettered = letters.select(F.col("job_id").alias(key)).distinct().withColumn("__letter", F.lit(True))
        kept = rows.join(lettered, key, "left").where((F.col(DATE) >= F.lit(cut).cast(rows.schema[DATE].dataType)) | F.col("__letter")).drop("__letter")
        self._replace(kept.select(*rows.columns), old)
        return old

