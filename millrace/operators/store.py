"""Keyed state as set-based merges: every function takes the old table and a batch, and gives the new table.

Batches may be split anywhere: merging two parts one after the other equals merging them at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

FIRST = ["job_title", "company", "description", "link", "salary", "source"]


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """store: dedup_key, FIRST, extracted_date, relevance_score, best_cv, seen_count, scam_risk. batch: the same without seen_count, with ord.

    A repeated key counts up and takes the latest date; the score is the largest, and best_cv is that of the first row to reach it; a scam sign sticks;
    the descriptive columns keep their first values.
    """
    best = F.struct(F.coalesce("relevance_score", F.lit(0.0)), -F.col("ord"))
    new = batch.groupBy("dedup_key").agg(
        F.min_by(F.struct(*FIRST), "ord").alias("first"), F.count("*").alias("n"), F.max("extracted_date").alias("date"),
        F.max("relevance_score").alias("score"), F.max_by("best_cv", best).alias("cv"), F.max("scam_risk").alias("scam"),
    )
    old = store.withColumn("__old", F.lit(True))
    met = old.join(new, "dedup_key", "full_outer")
    known = F.col("__old").isNotNull()
    higher = F.coalesce(F.col("score") > F.coalesce("relevance_score", F.lit(0.0)), F.lit(False))
    return met.select(
        "dedup_key", *[F.when(known, F.col(c)).otherwise(F.col(f"first.{c}")).alias(c) for c in FIRST],
        F.greatest("extracted_date", "date").alias("extracted_date"), F.greatest("relevance_score", "score").alias("relevance_score"),
        F.when(~known | higher, F.col("cv")).otherwise(F.col("best_cv")).alias("best_cv"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("seen_count"), F.greatest("scam_risk", "scam").alias("scam_risk"),
    )


def touch_links(seen: DataFrame, links: DataFrame) -> DataFrame:
    """link, first_seen, last_seen, from both (links: link, at); blank links don't count."""
    new = links.where(X.text("link") != "").select("link", F.col("at").alias("first_seen"), F.col("at").alias("last_seen"))
    return seen.unionByName(new).groupBy("link").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def mark_sent(sent: DataFrame, ids: DataFrame) -> DataFrame:
    """job_id, sent_date: ids that are already there keep their date."""
    return sent.unionByName(ids).groupBy("job_id").agg(F.min("sent_date").alias("sent_date"))


def fold_status(status: DataFrame, events: DataFrame) -> DataFrame:
    """job_id, status, updated_date after the events (job_id, ts, status).

    A rejection always wins; the first event starts a job that has no status; an applied job becomes interviewing; all else
    stays. So what decides is the first event, and whether a rejection or an interview is among them: all of it combines in the
    tasks, and no job's events are collected.
    """
    told = events.where(~F.coalesce("status", F.lit("none")).isin("none", ""))
    by_job = told.groupBy("job_id").agg(
        F.min_by(
            "status", F.struct("ts", "status"),
        ).alias("first"), F.max(F.col("status") == "rejected").alias("rejected"), F.max(F.col("status") == "interviewing").alias("talked"), F.max("ts").alias("ts")
    )
    met = status.withColumnRenamed("status", "now").join(by_job, "job_id", "full_outer")
    base = F.when(F.coalesce("now", F.lit("none")).isin("none", ""), F.coalesce("first", "now")).otherwise(F.col("now"))
    folded = F.when(F.col("rejected"), "rejected").when((base == "applied") & F.col("talked"), "interviewing").otherwise(base)
    return met.select("job_id", folded.alias("status"), F.coalesce("ts", "updated_date").alias("updated_date"))


STATUSES = ["none", "applied", "interviewing", "rejected"]


def set_status(status: DataFrame, edits: DataFrame) -> DataFrame:
    """The last valid edit (job_id, ts, status) of each job wins."""
    valid = edits.where(F.col("status").isin(STATUSES)).select("job_id", "status", F.col("ts").alias("updated_date"), F.lit(1).alias("new"))
    rows = status.select("job_id", "status", "updated_date", F.lit(0).alias("new")).unionByName(valid)
    last = F.max_by(F.struct("status", "updated_date"), F.struct("new", "updated_date", "status"))
    return rows.groupBy("job_id").agg(last.alias("x")).select("job_id", "x.status", "x.updated_date")


def delete_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    return jobs.join(ids.select("id").distinct(), "id", "left_anti")


def retained(jobs: DataFrame, letters: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Jobs that are recent or have a letter."""
    lettered = letters.select(F.col("job_id").alias("id")).distinct().withColumn("__letter", F.lit(True))
    return jobs.join(lettered, "id", "left").where((F.col("extracted_date") >= as_of - F.make_interval(days=F.lit(days))) | F.col("__letter")).drop("__letter")


def retained_mails(mails: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return mails.where(F.col("processed_date") >= as_of - F.make_interval(days=F.lit(days)))


def without_orphans(ledger: DataFrame, jobs: DataFrame) -> DataFrame:
    """Ledger rows whose job still exists."""
    return ledger.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")


def add_letters(letters: DataFrame, new: DataFrame) -> DataFrame:
    """New letters, unless the job and the variant have one."""
    fresh = new.dropDuplicates(["job_id", "selected_cv"]).join(letters.select("job_id", "selected_cv"), ["job_id", "selected_cv"], "left_anti")
    return letters.unionByName(fresh)


def migrated(jobs: DataFrame) -> DataFrame:
    """Missing keys are filled in, then each key keeps its newest row."""
    from millrace.operators.dedup import newest

    return newest(jobs.withColumn("dedup_key", F.coalesce("dedup_key", X.dedup_key("job_title", "company"))))


def fill_scores(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Scores, variants and descriptions from ``found`` (id, score, cv, description) where jobs have none."""
    met = jobs.join(found.select("id", F.col("score").alias("__s"), F.col("cv").alias("__cv"), F.col("description").alias("__d")), "id", "left")
    bare = F.coalesce(F.col("relevance_score") == 0, F.lit(True)) & F.col("__s").isNotNull()
    out = met.withColumn("relevance_score", F.when(bare, F.col("__s")).otherwise(F.col("relevance_score")))
    out = out.withColumn("best_cv", F.coalesce(F.nullif(F.col("best_cv"), F.lit("")), F.col("__cv")))
    out = out.withColumn("description", F.coalesce(F.left(F.col("__d"), F.lit(2000)), F.col("description")))
    return out.drop("__s", "__cv", "__d")


def fill_links(jobs: DataFrame, found: DataFrame) -> DataFrame:
    met = jobs.join(found.select("id", F.col("link").alias("__l")), "id", "left")
    return met.withColumn("link", F.coalesce(F.nullif(F.col("link"), F.lit("")), F.col("__l"))).drop("__l")


def replace_by_key(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those with their key."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
