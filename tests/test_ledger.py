"""The ledger of seen links against a plain set, with sketches large and tiny."""

import os
import random
import re
from datetime import datetime, timedelta

import pytest
from millrace.operators import ledger
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)


def link(k):
    return f"https://x.org/jobs/{k}"


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_unseen(spark, tmp_path, bits):
    r = random.Random(bits)
    book, seen = ledger.Ledger(spark, f"file://{tmp_path}/book", 8, bits), {}
    for run in range(3):
        batch = [(i, r.choice([link(r.randrange(300)), link(r.randrange(300)) + "?utm_source=a", "", None])) for i in range(200)]
        df = spark.createDataFrame(batch, "id long, link string").repartition(3)
        own = {i: (x or "").split("?")[0] for i, x in batch}
        assert {x.id for x in book.unseen(df).collect()} == {i for i, x in own.items() if not x or x not in seen}
        at = DAY + timedelta(days=run)
        new = [(x, at) for x in own.values()]
        book.append(spark.createDataFrame([*new, (None, at)], "link string, at timestamp"))
        for x in own.values():
            if x:
                seen[x] = (seen.get(x, (at, at))[0], at)
    assert {x.link: (x.first_seen, x.last_seen) for x in book.links().collect()} == seen
    late = book.compact(f"file://{tmp_path}/new", 1 << 12, since=DAY + timedelta(days=2))
    assert {x.link for x in late.links().collect()} == {x for x, (_, last) in seen.items() if last >= DAY + timedelta(days=2)}
    assert late.unseen(spark.createDataFrame([(1, next(x for x, (_, last) in seen.items() if last >= DAY + timedelta(days=2)))], "id int, link string")).count() == 0
    rows = late.spark.read.parquet(f"{late.folder}/links")
    assert rows.groupBy("link", "at").count().where("count > 1").count() == 0


def test_sketches_tell_new_links(spark, tmp_path):
    """New links pass without a look at the ledger; a tiny sketch only makes more look-ups."""
    for bits, most in ((1 << 20, 2), (32, 500)):
        book = ledger.Ledger(spark, f"file://{tmp_path}/b{bits}", 4, bits)
        book.append(spark.range(500).select(F.concat(F.lit("https://x.org/"), "id").alias("link"), F.lit(DAY).alias("at")))
        new = book._bucketed(spark.range(1000, 1500).select(F.concat(F.lit("https://x.org/"), "id").alias("link")), "link")
        assert book.maybe_seen(new).count() <= most
        assert book.maybe_seen(book._bucketed(book.links().select("link"), "link")).count() == 500


def test_only_touched_buckets_are_read(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/b", 16)
    book.append(spark.range(2000).select(F.concat(F.lit("https://x.org/"), "id").alias("link"), F.lit(DAY).alias("at")))
    assert len([x for x in os.listdir(tmp_path / "b" / "links") if x.startswith("bucket=")]) == 16
    one = spark.createDataFrame([(link(1),)], "link string")
    keyed = book._bucketed(one, "link")
    sketch = ledger._rows(spark, book.folder, "sketch", ledger.SKETCH, book._touched(keyed))
    plan = sketch._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*bucket#\d+ (= {keyed.first().bucket}\)|IN \({keyed.first().bucket}\))", plan), plan
    assert 0 < sketch.count() < book.spark.read.parquet(f"{book.folder}/sketch").count() / 4


def test_no_ledger_yet(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/none")
    assert book.unseen(spark.createDataFrame([(1, link(1)), (2, None)], "id int, link string")).count() == 2 and book.links().count() == 0
