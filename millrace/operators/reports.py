"""Reports over stored jobs: listing, facets, statistics, weekly digest, exports and similar jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X

#: Words that no search uses.
STOP_WORDS = ["the", "and", "for", "with", "remote", "senior", "junior", "lead", "staff", "principal", "from", "home"]


def _rounded(x: Column) -> Column:
    return F.bround(F.coalesce(x, F.lit(0.0)), 1)


def with_status(jobs: DataFrame, status: DataFrame, letters: DataFrame | None = None) -> DataFrame:
    """Adds apply_status ('none' if there is none) and has_cover_letter."""
    out = jobs.join(status.select(F.col("job_id").alias("__j"), F.col("status").alias("__s")), F.col("id") == F.col("__j"), "left")
    out = out.withColumn("apply_status", F.coalesce("__s", F.lit("none"))).drop("__j", "__s")
    if letters is None:
        return out
    done = letters.select(F.col("job_id").alias("__j")).distinct()
    return out.join(done, F.col("id") == F.col("__j"), "left").withColumn("has_cover_letter", F.col("__j").isNotNull()).drop("__j")


def listing(
    jobs: DataFrame, status: DataFrame, letters: DataFrame, as_of: Column, min_score: float = 0, date: str | None = None, source: str | None = None,
    industry: str | None = None, origin: str | None = None, inbox: str | None = None, sort: str = "score",
) -> DataFrame:
    """The dashboard's rows. Stored columns are filtered in the scan; computed ones after. Missing salaries come last."""
    rows = jobs.where(F.col("relevance_score") >= min_score)
    rows = rows.where(F.to_date("extracted_date") == F.lit(date)) if date else rows
    day = F.to_date("extracted_date")
    out = with_status(rows, status, letters).select(
        "id", F.col("job_title").alias("title"), "company", X.shortened("description", 200, "...").alias("description"), "link", "salary",
        X.site_label("link", F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("JSearch"))).alias("source"), day.alias("date"),
        _rounded(F.col("relevance_score")).alias("score"), X.industry("job_title", "description").alias("industry"),
        F.coalesce("seen_count", F.lit(1)).alias("seen_count"), (F.coalesce("seen_count", F.lit(1)) > 1).alias("relisted"),
        X.origin("source").alias("origin"), X.inbox("source").alias("email_account"), mail_search(
            "source", "source_message_id", "company", "job_title",
        ).alias("gmail_url"),
        "has_cover_letter", "apply_status", F.date_diff(F.to_date(as_of), day).alias("days_old"),
    )
    for name, value in (("source", source), ("industry", industry), ("origin", origin), ("email_account", inbox)):
        out = out.where(F.col(name) == value) if value else out
    orders = {"date": F.desc_nulls_last("date"), "salary": F.desc_nulls_last("salary")}
    return out.orderBy(orders.get(sort, F.desc_nulls_last("score")), "id")


def mail_search(source: str, message_id: str, company: str, title: str) -> Column:
    """A link that finds the mail a job came from; null for jobs that came from searches."""
    account = F.trim(F.regexp_extract(X.text(source), "^Email[^/]*/(.*)$", 1))
    head = F.concat(
        F.lit("https://mail.google.com/mail/"), F.when(account != "", F.concat(F.lit("?authuser="), account)).otherwise(""),
        F.lit("#search/"),
    )
    mid = F.replace(F.regexp_replace(X.text(message_id), "^[<> ]+|[<> ]+$", ""), F.lit(" "), F.lit("%20"))
    by_words = F.concat(F.replace(X.text(company), F.lit(" "), F.lit("+")), F.lit("+"), F.array_join(F.slice(X.words(X.text(title)), 1, 3), "+"))
    return F.when(
        X.origin(source) == "email",
        F.concat(head, F.when(X.text(message_id) != "", F.concat(F.lit("rfc822msgid:"), mid)).otherwise(by_words)),
    )


def facets(jobs: DataFrame) -> DataFrame:
    """facet, value: the distinct sources (by link), dates and inboxes."""
    pairs = F.array(
        F.struct(F.lit("source").alias("facet"), F.when(F.col("link").isNotNull(), X.site_label("link")).alias("value")),
        F.struct(F.lit("date").alias("facet"), F.to_date("extracted_date").cast("string").alias("value")),
        F.struct(F.lit("inbox").alias("facet"), F.nullif(X.inbox("source"), F.lit("")).alias("value")),
    )
    return jobs.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").distinct()


def stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total_jobs"), F.count_distinct("source").alias("sources"),
        _rounded(F.avg("relevance_score")).alias("avg_score"), _rounded(F.max("relevance_score")).alias("max_score"),
    )


def status_counts(status: DataFrame, letters: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: applied, interviewing, rejected, cover_letters, last_sync."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    one = status.agg(n("applied"), n("interviewing"), n("rejected"))
    return one.crossJoin(letters.agg(F.count_distinct("job_id").alias("cover_letters"))).crossJoin(jobs.agg(F.max("extracted_date").alias("last_sync")))


def exported(jobs: DataFrame, status: DataFrame) -> DataFrame:
    """The export's eleven columns, best first; ``write.csv(header=True)`` makes the file."""
    rows = with_status(jobs, status)
    return rows.select(
        "id", "job_title", "company", "link", "salary", "source", "extracted_date", "relevance_score", "best_cv", F.coalesce("seen_count", F.lit(1)).alias("seen_count"), F.col("apply_status").alias("status"),
    ).orderBy(F.desc_nulls_last("relevance_score"), "id")


def similar(jobs: DataFrame, seeds: DataFrame, k: int = 8) -> DataFrame:
    """seed, id, score, place: for each seed (id, job_title) the k best other jobs whose title holds one of its words, also within a longer word.

    A title's words meet the seeds' words by their parts (all substrings of the distinct words), so nothing is compared pair by pair. Of a word only the best
    k + 1 jobs can be among a seed's k best; they are chosen before seeds meet jobs, so a word that many titles and seeds hold makes no pairs of them.
    """
    words = lambda t: F.array_distinct(F.transform(X.words(X.text(t)), F.lower))
    asked = seeds.select(F.col("id").alias("seed"), F.explode(F.filter(words("job_title"), lambda w: (F.length(w) > 3) & ~w.isin(STOP_WORDS))).alias("word"))
    titled = jobs.select("id", "relevance_score", F.explode(words("job_title")).alias("token"))
    best = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("relevance_score"), "id"))
    top = titled.withColumn("n", best("token")).where(F.col("n") <= k + 1).drop("n")
    starts = F.sequence(F.lit(1), F.greatest(F.length("token") - 3, F.lit(1)))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(4), F.greatest(F.length("token") - i + 1, F.lit(4))), lambda n: F.substr("token", i, n))))
    holds = titled.select("token").distinct().where(F.length("token") > 3).select("token", F.explode(F.array_distinct(parts)).alias("word"))
    holds = holds.join(asked.select("word").distinct(), "word")
    top = holds.join(top, "token").select("word", "id", "relevance_score").distinct().withColumn("n", best("word")).where(F.col("n") <= k + 1)
    met = asked.join(top, "word").where("id <> seed").select("seed", "id", "relevance_score").distinct().withColumn("place", best("seed"))
    return met.where(F.col("place") <= k).select("seed", "id", F.col("relevance_score").alias("score"), "place")


# --- the week ---


def _since(column: str, as_of: Column) -> Column:
    return F.to_date(column) >= F.date_sub(F.to_date(as_of), 7)


def weekly_numbers(jobs: DataFrame, letters: DataFrame, as_of: Column) -> DataFrame:
    """One row: jobs_found, avg_score, max_score, cover_letters."""
    week = jobs.where(_since("extracted_date", as_of))
    one = week.agg(
        F.count("*").alias("jobs_found"), _rounded(F.avg("relevance_score")).alias("avg_score"),
        _rounded(F.max("relevance_score")).alias("max_score"),
    )
    return one.crossJoin(letters.join(week.select(F.col("id").alias("job_id")), "job_id").agg(F.count("*").alias("cover_letters")))


def weekly_status(jobs: DataFrame, status: DataFrame, as_of: Column) -> DataFrame:
    met = status.join(jobs.select(F.col("id").alias("job_id"), "extracted_date"), "job_id")
    return met.where(_since("extracted_date", as_of) | _since("updated_date", as_of)).groupBy("status").agg(F.count("*").alias("n"))


def weekly_sources(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where(_since("extracted_date", as_of)).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def weekly_top(jobs: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    top = jobs.where(_since("extracted_date", as_of)).orderBy(F.desc_nulls_last("relevance_score"), "id").limit(k)
    return top.select("id", X.shortened("job_title", 45, "…").alias("title"), "company", "relevance_score")


def weekly_message(numbers: DataFrame, top: DataFrame) -> DataFrame:
    """One row with the week's message."""
    line = F.concat(
        F.lit("• "), F.col("title"), F.lit(" · "), X.text("company"), F.lit(" · "), F.bround("relevance_score", 1).cast("string"),
        F.lit("%"),
    )
    lines = top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("relevance_score").alias("s"), (-F.col("id")).alias("i"), line.alias("l"))), False), lambda x: x["l"]), "\n").alias("lines"))
    head = F.concat(
        F.lit("Week: "), F.col("jobs_found").cast("string"), F.lit(" jobs, average "), F.col("avg_score").cast("string"),
        F.lit("%, best "), F.col("max_score").cast("string"), F.lit("%"),
    )
    return numbers.crossJoin(lines).select(F.concat(head, F.lit("\n"), F.col("lines")).alias("message"))


LETTER = "Dear hiring team at %s,\n\nI am applying for the position of %s. %s\n\nKind regards"


def letters(jobs: DataFrame, pitches: dict[str, str]) -> DataFrame:
    """id, selected_cv, letter: a letter's text from a template and the variant's pitch; writing it out is left to others."""
    pitch = F.lit("")
    for name, line in pitches.items():
        pitch = F.when(F.col("best_cv") == name, line).otherwise(pitch)
    return jobs.select(
        "id", F.col("best_cv").alias("selected_cv"),
        F.format_string(LETTER, X.text("company"), X.text("job_title"), pitch).alias("letter"),
    )
