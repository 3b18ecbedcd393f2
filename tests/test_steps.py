"""Steps in the shared folder, and the entry point without the corpus operators."""

import os
import random
import shutil
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from millrace.functions import rounds
from pyspark.sql import functions as F


def folders(spark):
    return set(os.listdir(rounds.work_folder(spark).removeprefix("file://") + "/millrace"))


def test_passing_steps_go(spark):
    before = rounds.materialise(spark.range(3), "before")
    had = folders(spark)
    with rounds.passing_steps(spark) as keep:
        a = rounds.materialise(spark.range(5), "a")
        with rounds.passing_steps(spark) as keep_inner:
            b = keep(keep_inner(rounds.materialise(a.where("id > 2"), "b")))
            rounds.materialise(a, "c")
        assert len(folders(spark) - had) == 2
    assert {x.split("-")[0] for x in folders(spark) - had} == {"b"} and b.count() == 2 and before.count() == 3


def test_bucketed_steps_join_without_moving(spark):
    left = rounds.materialise_by(spark.range(1000).selectExpr("id % 50 home", "id"), "left", "home")
    right = spark.range(50).selectExpr("id home", "id * 2 x").hint("shuffle_hash")
    met = left.join(right, "home")
    assert met.count() == 1000 and met.agg({"x": "sum"}).first()[0] == sum(2 * (i % 50) for i in range(1000))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(home") == 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("millrace_")]


def test_the_rest_works_without_the_corpus_folders(tmp_path):
    root = Path(__file__).parents[1]
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "millrace" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) < set(q) and not any(n.startswith('op1') for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


def test_steps_of_other_threads_stay(spark):
    inside, written = threading.Event(), threading.Event()

    def other():
        inside.wait(60)
        found.append(rounds.materialise(spark.range(7), "other"))
        written.set()

    found, thread = [], threading.Thread(target=other)
    thread.start()
    with rounds.passing_steps(spark):
        rounds.materialise(spark.range(3), "own")
        inside.set()
        assert written.wait(60)
    thread.join()
    assert found[0].count() == 7 and not any(x.startswith("own-") for x in folders(spark))


def settled(links):
    gone = set()
    for b in sorted({b for _, b in links}):
        if any(a not in gone for a, x in links if x == b):
            gone.add(b)
    return sorted(gone)


@pytest.mark.parametrize("few", [0, 3, 200_000])
def test_links_settle_in_order(spark, few):
    r = random.Random(few)
    links = {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)}
    df = spark.createDataFrame([*links, *list(links)[:5]], "a long, b long").repartition(3)
    assert sorted(x.b for x in rounds.settle(df, few).collect()) == settled(links)


def test_a_chain_settles_in_one_task(spark):
    chain = spark.range(200_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    had = folders(spark)
    assert rounds.settle(chain).agg(F.count("*"), F.sum("b")).first() == (100_000, sum(range(1, 200_001, 2)))
    assert len(folders(spark) - had) == 1  # the links only: no rounds


@pytest.mark.parametrize("few", [0, 10])
def test_circles_are_told(spark, few):
    with pytest.raises(Exception, match="circle"):
        rounds.settle(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long"), few).collect()
    assert rounds.settle(spark.createDataFrame([], "a long, b long"), few).count() == 0
