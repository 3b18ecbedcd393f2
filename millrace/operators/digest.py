"""Digests: ranked postings under quotas and company caps.

The rows that can enter a digest are few (the best ``pool`` unsent ones), found by a distributed top-k; the staged passes are
windows over that bounded pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions import vocab as V
from millrace.operators import filters as R


def unsent(jobs: DataFrame, sent: DataFrame) -> DataFrame:
    return jobs.join(sent.select(F.col("job_id").alias("__sent")).distinct(), F.col("id") == F.col("__sent"), "left_anti")


def pool(jobs: DataFrame, most: int) -> DataFrame:
    """The best rows with their place, and the company that counts for the cap."""
    top = jobs.orderBy(F.desc_nulls_last("relevance_score"), F.desc_nulls_last("extracted_date"), "id").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("relevance_score"), F.desc_nulls_last("extracted_date"), "id"))
    company = F.lower(X.strip(F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("Unknown"))))
    return top.withColumn("place", place).withColumn("__company", company).withColumn("slot", F.lit(None).cast("int")).withColumn(
        "pass", F.lit(None).cast("string"),
    )


def _take(rows: DataFrame, name: str, who: Column, slots: int, cap: int, limit: int, order: list[Column]) -> DataFrame:
    """Marks up to ``slots`` of the rows not yet taken, in order, as long as a company has fewer than ``cap`` in all passes and the digest
    fewer than ``limit``."""
    free = F.col("slot").isNull() & who
    held = F.count("slot").over(Window.partitionBy("__company"))
    nth = F.sum(free.cast("int")).over(Window.partitionBy("__company").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__fits", free & (held + nth <= cap))
    used = F.count("slot").over(Window.partitionBy(F.lit(1)))
    turn = F.sum(F.col("__fits").cast("int")).over(Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__used", used).withColumn("__turn", turn)
    now = F.col("__fits") & (F.col("__turn") <= F.least(F.lit(slots), F.lit(limit) - F.col("__used")))
    rows = rows.withColumn("__now", now)
    rows = rows.withColumn("slot", F.when(F.col("__now"), (F.col("__used") + F.col("__turn")).cast("int")).otherwise(F.col("slot")))
    return rows.withColumn("pass", F.when(F.col("__now"), name).otherwise(F.col("pass"))).drop("__fits", "__used", "__turn", "__now")


def main_digest(
    jobs: DataFrame, sent: DataFrame, limit: int = V.DIGEST_SIZE, min_score: float = V.DIGEST_SCORE, live: Column | None = None,
    most: int = 400,
) -> DataFrame:
    """The digest's rows with slot and pass: saved ones, boards, aggregators, the best of the rest (boards before aggregators), and the
    demoted sources last. live: whether a row's link is alive; boards and saved rows aren't asked."""
    rows = pool(unsent(jobs, sent), most)
    source = X.text("source")
    saved, board = source.isin(V.SAVED_SOURCES), source.isin(V.BOARD_SOURCES)
    fit = F.coalesce(F.col("relevance_score") >= min_score, F.lit(min_score <= 0)) & (F.lit(True) if live is None else (board | saved | live))
    demoted = R.demoted_source("source")
    aggregator = ~board & ~demoted
    by_rank = [F.col("place")]
    rows = _take(rows, "saved", saved, limit, limit, limit, by_rank)
    rows = _take(rows, "boards", fit & board, V.BOARD_SLOTS, V.COMPANY_CAP, limit, by_rank)
    rows = _take(rows, "aggregators", fit & aggregator, V.AGGREGATOR_SLOTS, V.COMPANY_CAP, limit, by_rank)
    rows = _take(rows, "wildcard", fit & (board | aggregator), limit, V.COMPANY_CAP, limit, [F.when(board, 0).otherwise(1), F.col("place")])
    rows = _take(rows, "last_resort", fit & demoted, limit, V.COMPANY_CAP, limit, by_rank)
    return rows.where("slot is not null").drop("place", "__company")


def direct_digest(jobs: DataFrame, sent: DataFrame, limit: int = V.DIRECT_SIZE, min_score: float = V.DIGEST_SCORE, most: int = 200) -> DataFrame:
    """The best postings straight from companies' boards."""
    rows = pool(unsent(jobs.where(F.col("source").isin(V.BOARD_SOURCES) & (F.col("relevance_score") >= min_score)), sent), most)
    rows = _take(rows, "direct", F.lit(True), limit, V.COMPANY_CAP, limit, [F.col("place")])
    return rows.where("slot is not null").drop("place", "__company")


def both_digests(jobs: DataFrame, sent: DataFrame, main_limit: int = 10) -> DataFrame:
    """The direct digest, then the main one over what the direct one left."""
    direct = direct_digest(jobs, sent)
    ledger = sent.select("job_id").union(direct.select(F.col("id").alias("job_id")))
    return direct.unionByName(main_digest(jobs, ledger, main_limit))


def shortfall(digest: DataFrame) -> DataFrame:
    """quota, missing: how many slots of the two quotas stayed empty."""
    n = digest.agg(F.count_if(F.col("pass") == "boards").alias("b"), F.count_if(F.col("pass") == "aggregators").alias("a"))
    rows = n.select(F.explode(F.array(F.struct(F.lit("boards").alias("quota"), (F.lit(V.BOARD_SLOTS) - F.col("b")).alias("missing")), F.struct(F.lit("aggregators").alias("quota"), (F.lit(V.AGGREGATOR_SLOTS) - F.col("a")).alias("missing")))).alias("x"))
    return rows.select("x.*").where("missing > 0")


def letter_candidates(jobs: DataFrame, letters: DataFrame, k: int) -> DataFrame:
    """The best postings without a letter."""
    left = jobs.join(letters.select(F.col("job_id").alias("__done")).distinct(), F.col("id") == F.col("__done"), "left_anti")
    return left.orderBy(F.desc_nulls_last("relevance_score"), F.desc_nulls_last("extracted_date"), "id").limit(k)


def rendered(digest: DataFrame) -> DataFrame:
    """slot, line: one line of HTML for each posting, with a warning for suspected scams."""
    esc = lambda c: F.replace(F.replace(F.replace(X.text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    score = F.bround(F.coalesce(F.col("relevance_score"), F.lit(0.0)), 1)
    warn = F.when(F.coalesce(F.col("scam_risk"), F.lit(False)), " ⚠ check before applying").otherwise("")
    label = F.coalesce(F.concat(F.lit(" · "), X.cv_label("best_cv")), F.lit(""))
    line = F.concat(
        F.lit("<b>"), esc("job_title"), F.lit("</b> · "), esc("company"), F.lit(" · "), score.cast("string"), F.lit("%"), label,
        F.lit(" · "), esc("source"), warn, F.lit('\n<a href="'), esc("link"), F.lit('">open</a>'),
    )
    return digest.select("slot", line.alias("line"))
