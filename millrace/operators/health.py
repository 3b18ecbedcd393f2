"""Source health over runs (source, queries, raw_count, duration_s, status, error, run_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def status(raw_count: Column, error: Column) -> Column:
    return F.when(F.coalesce(error, F.lit("")) != "", "error").when(raw_count > 0, "ok").otherwise("empty")


def _last(runs: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("run_at")))
    return runs.withColumn("place", place).where(F.col("place") <= n)


def stale(runs: DataFrame, n: int = 3) -> DataFrame:
    """source, last_error: sources with at least n runs, of which the last n gave nothing."""
    seen = _last(runs, n).groupBy("source").agg(
        F.count("*").alias("k"), F.max("raw_count").alias("most"),
        F.min_by("error", F.when(F.coalesce("error", F.lit("")) != "", F.col("place"))).alias("last_error"),
    )
    return seen.where((F.col("k") == n) & (F.coalesce("most", F.lit(0)) == 0)).select("source", "last_error")


def recovered(before: DataFrame, now: DataFrame, n: int = 3) -> DataFrame:
    """Sources that were stale in the runs before and give something now."""
    productive = now.where("raw_count > 0").select("source").distinct()
    return stale(before, n).select("source").join(productive, "source", "left_semi")


def days_since(runs: DataFrame, as_of: Column) -> DataFrame:
    """source, days since its last productive run; null if it never had one."""
    last = runs.groupBy("source").agg(F.max(F.when(F.col("raw_count") > 0, F.col("run_at"))).alias("last"))
    return last.select("source", F.timestamp_diff("DAY", F.col("last"), as_of).cast("long").alias("days"))


def yield_by_source(runs: DataFrame, as_of: Column, days: int) -> DataFrame:
    """source, total, n_runs over the last days, the most first."""
    recent = runs.where(F.col("run_at") >= as_of - F.make_interval(days=F.lit(days)))
    return recent.groupBy("source").agg(F.sum("raw_count").alias("total"), F.count("*").alias("n_runs")).orderBy(F.desc("total"), "source")


def concentration(run: DataFrame, warn: float = 0.9) -> DataFrame:
    """One row: total, n_sources, n_empty, the largest source, its share, and whether that is a warning."""
    by = run.groupBy("source").agg(F.sum("raw_count").alias("n"))
    one = by.agg(
        F.sum("n").alias("total"), F.count("*").alias("n_sources"), F.count_if(F.col("n") == 0).alias("n_empty"), F.max("n").alias("most"),
        F.max_by("source", F.struct("n", "source")).alias("largest"),
    )
    share = F.coalesce(F.try_divide(F.col("most").cast("double"), F.col("total")), F.lit(0.0))
    return one.select("total", "n_sources", "n_empty", "largest", share.alias("share"), ((share >= warn) & (F.col("n_sources") > 1)).alias("warning"))


def summary(run: DataFrame) -> DataFrame:
    """source, queries, raw_count, duration_s, status: sums by source, the most first."""
    by = run.groupBy("source").agg(
        F.sum("queries").alias("queries"), F.sum("raw_count").alias("raw_count"), F.sum("duration_s").alias("duration_s"),
        F.max("error").alias("error"),
    )
    return by.select(
        "source", "queries", "raw_count", "duration_s", status(F.col("raw_count"), F.col("error")).alias("status"),
    ).orderBy(F.desc("raw_count"), "source")


def summary_lines(run: DataFrame) -> DataFrame:
    line = F.concat(
        F.rpad("source", 24, " "), F.lpad(F.col("queries").cast("string"), 6, " "), F.lpad(F.col("raw_count").cast("string"), 8, " "),
        F.lit("  "), F.col("status"),
    )
    return summary(run).select("source", line.alias("line"))


def record(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The history with the run; recovery must be asked for before."""
    return runs.unionByName(run.withColumn("status", status(F.col("raw_count"), F.col("error"))), allowMissingColumns=True)
