"""Fallback look-ups that fill descriptions, and the matching of mails to stored jobs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import markup
from millrace.functions import text as X
from millrace.functions import vocab as V


def details(
    jobs: DataFrame, found: DataFrame, wanted: Column, sources: tuple[str, ...] = ("SmartRecruiters", "Workday"), budget: int = 60,
) -> DataFrame:
    """Descriptions from ``found`` (link, description; of several for a link the greatest text) for the first ``budget`` postings that lack one; adds enriched and over_budget."""
    lacks = F.col("source").isin(*sources) & (X.strip(X.text("description")) == "") & (X.text("link") != "") & wanted
    first = jobs.where(lacks).orderBy("ord").limit(budget).select(F.col("ord").alias("__o"))
    out = jobs.join(first, F.col("ord") == F.col("__o"), "left").withColumn("over_budget", lacks & F.col("__o").isNull())
    got = found.groupBy(F.col("link").alias("__l")).agg(F.max("description").alias("__d"))  # of several the last in order of text
    out = out.join(got, (F.col("link") == F.col("__l")) & F.col("__o").isNotNull(), "left")
    enriched = F.coalesce(F.col("__d") != "", F.lit(False))
    return out.withColumn("enriched", enriched).withColumn(
        "description", F.when(enriched, F.col("__d")).otherwise(F.col("description")),
    ).drop("__o", "__l", "__d")


def mail_candidates(jobs: DataFrame, as_of: Column, days: int, prefix: str = "applied via email") -> DataFrame:
    """Jobs from mails, not older than the days, without a real description or a score."""
    bare = F.col("description").isNull() | F.startswith(F.lower(F.trim("description")), F.lit(prefix))
    unscored = F.coalesce(F.col("relevance_score") == 0, F.lit(True))
    return jobs.where(F.ilike("source", F.lit("email%")) & bare & unscored & (F.col("extracted_date") >= as_of - F.make_interval(days=F.lit(days))))


def first_found(jobs: DataFrame, steps: list[tuple[str, DataFrame]], least: int = 150, most: int = 3000) -> DataFrame:
    """Adds text and text_from: the first step's (id, text; of several for an id the greatest text) that is long enough, else the title."""
    out, chosen, told = jobs, F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, found) in enumerate(steps):
        one = found.groupBy(F.col("id").alias(f"__i{k}")).agg(F.max("text").alias(f"__t{k}"))
        out = out.join(one, F.col("id") == F.col(f"__i{k}"), "left")
        long = F.when(F.length(f"__t{k}") > least, F.left(F.col(f"__t{k}"), F.lit(most)))
        told = F.coalesce(told, F.when(long.isNotNull(), name))
        chosen = F.coalesce(chosen, long)
    out = out.withColumn("text_from", F.coalesce(told, F.lit("title"))).withColumn("text", F.coalesce(chosen, F.col("job_title")))
    return out.drop(*[f"__{c}{k}" for k in range(len(steps)) for c in "it"])


def scraped(html: Column | str, url: Column | str, selectors: list[str] | None = None, noise: list[str] | None = None, least: int = 150, most: int = 3000) -> Column:
    """The description in a posting's page; null without a link, on hosts that can't be read, and where no selector has more than ``least`` characters."""
    unreadable = F.regexp_like(F.lower(X.text(url)), F.lit("|".join(re.escape(h) for h in V.UNREADABLE_HOSTS)))
    page = F.when((X.text(url) != "") & ~unreadable, X.col(html))
    return markup.description(page, selectors or V.PAGE_SELECTORS, noise or V.PAGE_NOISE, least, most)


def snippets(results: DataFrame, most: int = 3000) -> DataFrame:
    """id, text: the bodies of the search results (id, place, body), joined in order."""
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"])
    return results.where("body is not null").groupBy("id").agg(F.left(F.array_join(bodies, " "), F.lit(most)).alias("text"))


def matched(mails: DataFrame, jobs: DataFrame) -> DataFrame:
    """mails (message_id, title, company, link) with job_id: by title and company, else by link, else null (a new job)."""
    name = lambda t, c: F.concat(F.lower(X.text(t)), F.lit("\u0001"), F.lower(X.text(c)))
    by_name = jobs.groupBy(name("job_title", "company").alias("__n")).agg(F.min("id").alias("__a"))
    by_link = jobs.where(X.text("link") != "").groupBy(F.col("link").alias("__l")).agg(F.min("id").alias("__b"))
    out = mails.withColumn("__k", name("title", "company")).join(by_name, F.col("__k") == F.col("__n"), "left")
    out = out.join(by_link, F.col("link") == F.col("__l"), "left")
    return out.withColumn("job_id", F.coalesce("__a", "__b")).drop("__k", "__n", "__a", "__l", "__b")


def job_link(
    html: Column | str, wanted: str = r"(?i)/(?:jobs?|careers?|apply|position)",
    skipped: str = r"(?i)unsubscribe|privacy|preferences|\.(?:png|gif|jpe?g|css)|facebook\.|twitter\.|instagram\.",
) -> Column:
    """The posting's link among a mail's links: one on a known board, else the first that looks like a posting."""
    links = F.regexp_extract_all(X.text(html), F.lit("(?i)href=[\"']([^\"']+)[\"']"), F.lit(1))
    fit = F.filter(links, lambda u: ~F.regexp_like(u, F.lit(skipped)) & F.regexp_like(u, F.lit(wanted)))
    known = F.filter(
        fit,
        lambda u: F.regexp_like(u, F.lit(r"(?i)linkedin\.com|greenhouse\.io|lever\.co|ashbyhq\.com|workday|smartrecruiters\.com|indeed\.com")),
    )
    return F.coalesce(F.try_element_at(known, F.lit(1)), F.try_element_at(fit, F.lit(1)))


def followed(links: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """link, final, n_hops: where redirects (link, to) lead to within ``most`` hops; longer chains stop there."""
    step = hops.where("to is not null and to <> link").groupBy(F.col("link").alias("__from")).agg(F.min("to").alias("__to"))
    out = links.select("link").distinct().withColumn("final", F.col("link")).withColumn("n_hops", F.lit(0))
    for _ in range(most):
        met = out.join(step, F.col("final") == F.col("__from"), "left")
        moved = F.col("__to").isNotNull()
        out = met.select("link", F.coalesce("__to", "final").alias("final"), (F.col("n_hops") + moved.cast("int")).alias("n_hops"))
    return out


def flattened_domains(profiles: DataFrame) -> DataFrame:
    """One row: all profiles' key domains (key_domains: array), each once, in order. Only each domain's first place reaches the last task."""
    rows = profiles.select("ord", F.posexplode("key_domains").alias("at", "domain")).where("domain is not null")
    first = rows.groupBy("domain").agg(F.min(F.struct("ord", "at")).alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "domain"))), lambda x: x["domain"])
    return first.agg(listed.alias("key_domains"))


def as_json(rows: DataFrame) -> DataFrame:
    """One column ``json``: each row as a JSON object."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
