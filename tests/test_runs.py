"""Runs over sources that are counted while they are written, against recounts."""

from datetime import datetime

import pytest
from millrace.functions.rounds import materialise
from millrace.operators import runs
from pyspark.sql import functions as F


def sources(spark):
    rows = lambda n: spark.range(n).select("id", F.lit("x").alias("link"))
    failing = rows(9).withColumn("link", F.when(F.col("id") == 7, F.raise_error(F.lit("bad page"))).otherwise(F.col("link")))
    return {"a": lambda: rows(1000), "b": lambda: rows(7), "none": lambda: rows(0), "missing": lambda: spark.read.parquet("/no/such/folder"), "failing": lambda: failing, "raises": lambda: 1 / 0}


@pytest.mark.parametrize("names,jobs", [(["a", "b", "none"], 1), (["a", "missing", "raises"], 1), (["a", "failing", "b"], 2)])
def test_counts_come_with_the_write(spark, names, jobs):
    written = []

    def write(df, name):
        written.append(name)
        return materialise(df, name)

    out, told = runs.run(spark, {n: sources(spark)[n] for n in names}, {"a": 3}, write=write)
    got = {r.source: r for r in told.collect()}
    want = {"a": 1000, "b": 7}
    assert {n: r.raw_count for n, r in got.items()} == {n: want.get(n, 0) for n in names} and got["a"].queries == 3
    assert out.count() == sum(want.get(n, 0) for n in names) and len(written) == jobs
    assert {n for n, r in got.items() if r.error} == set(names) & {"missing", "failing", "raises"}
    assert all(n != "failing" or "bad page" in r.error for n, r in got.items()) and all(r.duration_s >= 0 for r in got.values())


def test_nothing_works(spark):
    out, told = runs.run(spark, {n: sources(spark)[n] for n in ("missing", "failing")})
    assert out is None and told.where("error is not null").count() == 2
    assert runs.run(spark, {})[1].count() == 0


def test_a_sink_that_fails_is_raised(spark):
    def write(df, name):
        raise OSError("disk full")

    with pytest.raises(OSError):
        runs.run(spark, {"b": sources(spark)["b"]}, write=write)


def test_recovery_is_judged_before_the_run_is_kept(spark):
    at = [datetime(2024, 1, k) for k in (1, 2, 3)]
    history = spark.createDataFrame([(s, 1, n, 0.5, None, d, "x") for d in at for s, n in (("a", 0), ("b", 5))], runs.RUN + ", run_at timestamp, status string")
    _, told = runs.run(spark, {n: sources(spark)[n] for n in ("a", "b", "failing")})
    after, recovered = runs.recorded(history, told, F.lit(datetime(2024, 1, 4)))
    assert [r.source for r in recovered.collect()] == ["a"]
    assert {(r.source, r.status) for r in after.where("run_at > '2024-01-03'").collect()} == {("a", "ok"), ("b", "ok"), ("failing", "error")} and after.count() == 9
