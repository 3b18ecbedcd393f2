"""Predicates over postings (title, company, description, link, location, source) and the ordered rejection reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import addresses
from millrace.functions import text as X
from millrace.functions import vocab as V
from millrace.operators import terms


def lowered(*columns: str) -> Column:
    """The columns, joined by blanks and in lower case; null counts as empty."""
    return F.lower(F.concat_ws(" ", *[X.text(c) for c in columns]))


#: Gives the lower-cased text of some columns: an expression, the name of a column that holds it, or its phrases.
Low = Callable[..., "Column | str | X.Searched"]

#: The phrases that rules and scores look for in lower-cased fields.
RULE_PHRASES = [
    *V.DEALBREAKERS, *V.NO_SPONSOR, *V.WORLDWIDE, *V.SPONSOR, *V.PERMIT_NEEDED, *V.SCAM_PHRASES, *V.DEV_TITLES, *V.REMOTE_WORDS, *V.TITLE_BOOST, *V.SECTOR_BOOST,
]


def lowered_once(df: DataFrame, *groups: tuple[str, ...], more: list[str] | None = None) -> tuple[DataFrame, Low]:
    """``df`` with the phrases (``RULE_PHRASES`` and ``more``) that the lower-cased texts of the groups of columns hold, looked up in one pass a row, and how
    predicates get at them."""
    out, of = terms.searched_once(df, list(groups), [*RULE_PHRASES, *(more or [])])
    return out, lambda *columns: of(*columns) or lowered(*columns)


#: The groups of columns that the rules look at.
RULE_FIELDS = [("title", "description"), ("title", "description", "location"), ("title", "description", "company"), ("title",)]


def dealbreaker(low: Low = lowered) -> Column:
    return X.any_of(low("title", "description"), V.DEALBREAKERS)


def geo_restricted(low: Low = lowered) -> Column:
    """A stated permit requirement, or a refusal to sponsor, without an offer to sponsor or worldwide eligibility."""
    x = low("title", "description", "location")
    refused = X.any_of(x, V.NO_SPONSOR)
    open_ = X.any_of(x, V.WORLDWIDE) | (X.any_of(x, V.SPONSOR) & ~refused)
    return (refused | X.any_of(x, V.PERMIT_NEEDED)) & ~open_


def _bad_host(host: Column) -> Column:
    return X.host_in(host, V.FUNNEL_HOSTS) | X.host_in(host, V.FREE_HOSTS)


def blocked_source() -> Column:
    """A known fake board by name, or one of its destinations in the link or, for job pages, in the description."""
    has_url = lambda c: F.contains(F.lower(X.text(c)), F.lit("://"))
    named = X.any_of(X.squash(F.concat_ws(" ", X.text("source"), X.text("company"), X.text("link"))), V.BLOCKED_BOARDS)
    in_link = F.when(has_url("link"), F.exists(X.urls_in("link"), lambda u: _bad_host(u["host"]))).otherwise(False)
    job_page = lambda u: X.host_in(u["host"], V.FREE_HOSTS) & F.regexp_like(u["path"], F.lit("(?i)" + V.JOB_PATH))
    in_text = F.when(has_url("description"), F.exists(X.urls_in("description"), lambda u: X.host_in(u["host"], V.FUNNEL_HOSTS) | job_page(u))).otherwise(False)
    return named | in_link | in_text


def scam_risk(low: Low = lowered) -> Column:
    phrases = X.any_of(low("title", "description", "company"), V.SCAM_PHRASES)
    both = F.concat_ws(" ", X.text("link"), X.text("description"))
    return phrases | F.when(F.contains(both, F.lit("://")), F.exists(X.urls_in(both), lambda u: _bad_host(u["host"]))).otherwise(False)


def us_located(location: Column | str = "location") -> Column:
    low = F.lower(X.text(location))
    head = lambda p: F.substring_index(F.upper(X.strip(p)), " ", 1)
    return X.any_of(low, V.US_NAMES) | F.exists(F.split(X.text(location), "[,/|]"), lambda p: head(p).isin([*V.US_STATES, "US"]))


def us_factor(low: Low = lowered) -> Column:
    x = low("title", "description", "location")
    return F.when(us_located(), F.when(X.any_of(x, V.SPONSOR) | X.any_of(x, V.WORLDWIDE), 1.0).otherwise(V.US_FACTOR)).otherwise(1.0)


def non_english_title() -> Column:
    return F.regexp_like(F.lower(X.text("title")), F.lit(r"(^|[^\p{L}\p{N}_])(?:" + "|".join(V.NON_ENGLISH_TITLES) + ")"))


def dev_titled(low: Low = lowered) -> Column:
    return X.any_of(low("title"), V.DEV_TITLES)


def remote(*columns: str, low: Low = lowered) -> Column:
    """A remote word anywhere in the posting's fields."""
    return X.any_of(low(*columns), V.REMOTE_WORDS)


def remote_description(column: str = "description") -> Column:
    return X.any_of(F.lower(X.text(column)), V.REMOTE_WORDS_SHORT)


def title_prescreen(skills: list[str], title: str = "title") -> Column:
    """Whether a title is worth a look at its description: a wanted role, a wanted sector, or any word of a skill."""
    low = F.lower(X.text(title))
    tokens = sorted({t for s in skills for t in s.lower().split() if len(t) > 2})
    return (low != "") & X.any_of(low, V.TITLE_BOOST + V.SECTOR_BOOST + tokens)


def demoted_source(source: Column | str = "source") -> Column:
    return X.any_of(F.lower(X.text(source)), V.DEMOTED_SOURCES)


def recent(days: int, as_of: Column, posted: str = "date_posted", extracted: str = "extracted_date") -> Column:
    """Posted, or else extracted, within the days; what can't be read counts as recent."""
    stamp = lambda c: F.try_to_timestamp(F.col(c).cast("string"))
    return F.coalesce(F.coalesce(stamp(posted), stamp(extracted)) >= as_of - F.make_interval(days=F.lit(days)), F.lit(True))


def expired_page(body: Column | str, phrases: list[str] = V.EXPIRED_PHRASES) -> Column:
    return X.any_of(F.lower(X.text(body)), phrases)


def link_active() -> Column:
    """From a probe (head_status, get_status, body, null where it failed): not gone, and no phrase of an expired posting."""
    gone = F.col("head_status").isNull() | F.col("head_status").isin(404, 410)
    status = F.when(F.col("head_status") >= 400, F.col("get_status")).otherwise(F.coalesce("get_status", "head_status"))
    return F.coalesce(~gone & (status < 400) & ~expired_page("body"), F.lit(False))


def link_live() -> Column:
    """The digest's milder test of a probe (link, get_status, body): only certain death counts."""
    dead = internal_url("link") | F.col("get_status").isin(404, 410) | ((F.col("get_status") == 200) & expired_page("body", V.EXPIRED_MARKERS))
    return ~F.coalesce(dead, F.lit(False))


def internal_url(url: Column | str) -> Column:
    """Not http(s), no host, or a literal address, in any form, of a network that is not public (``NETWORKS``)."""
    host = F.regexp_extract(F.lower(X.text(url)), r"^https?://(?:[^/@?#]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)
    inside = addresses.verdict(addresses.number(host), V.NETWORKS)
    return (host == "") | (host == "localhost") | F.coalesce(inside, F.lit(False))


def within_budget(df: DataFrame, active: Column, most: int, order: str = "ord") -> DataFrame:
    """Checks postings in order until ``most`` have passed; later ones stay unchecked, those that fail before go.

    The place of the last check is the ``most``-th smallest order value among the active rows, found by a top-k; order values
    must be unique.
    """
    passed = df.where(active).select(F.col(order).alias("__o")).orderBy("__o").limit(most)
    last = passed.agg(F.when(F.count("*") == most, F.max("__o")).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(active | F.coalesce(F.col(order) > F.col("__last"), F.lit(False))).drop("__last")


def reject_reason(score: Column, fields: list[str], min_score: float = 10, remote_only: bool = False, low: Low = lowered) -> Column:
    """The first reason to drop a posting, or null; saved sources are only ever dropped as blocked."""
    saved = X.text("source").isin(V.SAVED_SOURCES)
    free = lambda x: ~saved & x
    steps = [(blocked_source(), "blocked_source")]
    steps += [(free(~remote(*fields, low=low)), "not_remote")] if remote_only else []
    steps += [
        (free(dealbreaker(low)), "dealbreaker"), (free(geo_restricted(low)), "geo_restricted"), (free(non_english_title()), "non_english"),
        (free((score < V.DEV_KEEP_SCORE) & dev_titled(low)), "pure_programming"), (free(score < min_score), "below_min_score"),
    ]
    return reduce(lambda c, s: c.when(*s), steps[1:], F.when(*steps[0]))


def reject_report(judged: DataFrame) -> DataFrame:
    """n by reason, from a frame with ``reject_reason``."""
    return judged.where("reject_reason is not null").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
