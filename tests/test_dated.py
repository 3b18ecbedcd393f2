"""The store by day against the plain merges, and which files it touches."""

import os
import random
from datetime import datetime, timedelta

import pytest
from millrace.operators import dated, store
from pyspark.sql import functions as F

SCHEMA = "id long, title string, extracted_date timestamp"
NOW = datetime(2024, 3, 1, 12)


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def rows_of(r, ids):
    return [(i, f"t{r.randrange(9)}", NOW - timedelta(days=i % 40, hours=i % 7) if i % 11 else None) for i in ids]


@pytest.mark.parametrize("unit", ["day", "month"])
def test_batches_and_retention_equal_the_plain_merges(spark, tmp_path, unit):
    r = random.Random(1)
    jobs = dated.DatedStore(spark, f"file://{tmp_path}/jobs", SCHEMA, unit)
    assert jobs.days() == [] and jobs.rows().count() == 0 and jobs.retain(spark.createDataFrame([], "job_id long"), NOW) == []
    table = spark.createDataFrame([], SCHEMA)
    for ids in (range(0, 200), range(150, 260), range(0, 30)):
        batch = spark.createDataFrame(rows_of(r, ids), SCHEMA)
        jobs.put(batch)
        table = store.replace_by_key(table, batch, "id")
    assert sorted(map(str, jobs.rows().collect())) == sorted(map(str, table.collect()))
    letters = spark.createDataFrame([(i,) for i in range(0, 260, 13)], "job_id long")
    jobs.retain(letters, NOW, 30)
    assert sorted(map(str, jobs.rows().collect())) == sorted(map(str, store.retained(table, letters, F.lit(NOW), 30).collect()))
    assert jobs.rows(since=datetime(2024, 2, 20).date()).where("extracted_date < '2024-02-20'").count() == 0


def test_untouched_days_keep_their_files(spark, tmp_path):
    jobs = dated.DatedStore(spark, f"file://{tmp_path}/jobs", SCHEMA)
    jobs.put(spark.createDataFrame([(i, "t", NOW - timedelta(days=i)) for i in range(10)], SCHEMA))
    before = files(tmp_path / "jobs")
    jobs.put(spark.createDataFrame([(100, "new", NOW - timedelta(days=3))], SCHEMA))
    after = files(tmp_path / "jobs")
    changed = {f.split("day=")[1][:10] for f in before.keys() ^ after.keys()}
    assert changed == {"2024-02-27"} and all(after[f] == t for f, t in before.items() if f in after)
    touched = jobs.retain(spark.createDataFrame([(8,)], "job_id long"), NOW, 5)
    last = files(tmp_path / "jobs")
    assert {str(d) for d in jobs.days()} == {f"2024-02-{k}" for k in (22, 25, 26, 27, 28, 29)} | {"2024-03-01"}
    assert len(touched) == 5 and all(last[f] == t for f, t in after.items() if f.split("day=")[1][:10] > "2024-02-25")
    plan = jobs.rows(since=NOW.date())._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
