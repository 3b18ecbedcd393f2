"""Application mails: title, company and status from subject, body and sender.

An ordered cascade of patterns, as one coalesce over extracted columns; every candidate is guarded by the same tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vocab as V

def clean_body(body: Column | str) -> Column:
    """The body without style rules and links."""
    return X.collapse(reduce(lambda x, p: F.regexp_replace(x, p, " "), V.STYLE_RULES, X.text(body)))


def _tail_cut(x: Column) -> Column:
    return F.regexp_replace(X.strip(x), r"(?U)[^\w)\]]+$", "")


def is_clean(x: Column, max_words: int = 8) -> Column:
    low = F.lower(x)
    ok = F.length(x).between(2, 80) & (F.size(X.words(x)) <= max_words) & ~X.any_of(low, V.BAD_PARTS + V.PROSE)
    return F.coalesce(ok & F.regexp_like(x, F.lit("^[A-Za-z0-9\"'(]")) & F.regexp_like(x, F.lit("[A-Za-z]")), F.lit(False))


def good_title(x: Column) -> Column:
    cut = _tail_cut(x)
    low = F.lower(cut)
    ok = F.length(cut).between(4, 70) & ~low.isin(V.STOP_TITLES) & ~F.substring_index(low, " ", 1).isin(V.BAD_FIRST_WORDS) & F.regexp_like(
        cut, F.lit("[A-Z]"),
    )
    return F.coalesce(ok & is_clean(cut, 11), F.lit(False))


def gate(subject: Column, body: Column, sender: Column) -> Column:
    """Whether a mail may be about an application at all; body is the cleaned one."""
    dropped = X.any_of(F.lower(sender), V.DROPPED_SENDERS) | X.any_of(F.lower(subject), V.DROPPED_SUBJECTS)
    return ~dropped & (X.any_of(F.lower(subject), V.APPLICATION_WORDS) | X.any_of(F.lower(F.left(body, F.lit(2000))), V.APPLICATION_WORDS))


def is_rejection(subject: Column, body: Column) -> Column:
    return X.any_of(F.lower(subject), V.REJECTED_SUBJECTS) | X.any_of(F.lower(F.left(body, F.lit(2000))), V.REJECTED_BODIES)


def _group(x: Column, pattern: str, k: int = 1, fold: bool = True) -> Column:
    """A group of the first match; null without one."""
    full = ("(?i)" if fold else "") + pattern
    return F.when(F.regexp_like(x, F.lit(full)), F.regexp_extract(x, full, k))


def _trimmed(x: Column) -> Column:
    return X.strip(F.regexp_replace(X.strip(x), r"\.+$", ""))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))


def company_of_sender(sender: Column) -> Column:
    """An employer from a sender's display name or domain."""
    name = X.strip(F.regexp_extract(sender, r"^(.+?)\s*<", 1))
    person = F.regexp_like(name, F.lit("^[A-Z][a-z]+ [A-Z][a-z]+$"))
    host = F.lower(F.regexp_extract(sender, r"@([\w.\-]+)", 1))
    label = lambda h, suffix: F.substring_index(F.replace(h, F.lit("." + suffix), F.lit("")), ".", -1)
    named = reduce(lambda x, t: X.strip(F.regexp_replace(x, rf"(?i)\s*{t}.*$", "")), V.TEAM_NAMES, name)
    parts = F.split(F.replace(host, F.lit("www."), F.lit("")), r"\.")
    second = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    general = F.when((F.length(second) > 2) & ~second.isin(V.GENERIC_LABELS), _capital(second))
    by_host = F.when(host == "", None)
    for h in V.TENANT_HOSTS:
        own = label(host, h)
        by_host = by_host.when(
            F.endswith(host, F.lit(h)),
            F.when((own != "") & ~own.isin("mail", "jobs", "hire", "hr", "noreply", "recruiting"), _capital(own)),
        )
    for h, board in V.BOARD_HOSTS:
        by_host = by_host.when(F.contains(host, F.lit(h)), F.lit(board))
    by_host = by_host.otherwise(general)
    from_name = F.when(F.length(named) > 1, named).otherwise(by_host)
    out = None
    for h in V.SUBDOMAIN_HOSTS:
        own = F.substring_index(F.regexp_replace(host, r"\.?" + h.replace(".", r"\.") + "$", ""), ".", -1)
        fits = F.endswith(host, F.lit(h)) & (F.length(own) > 1) & ~own.isin("mail", "jobs", "hr", "noreply", "no-reply", "career", "careers", "apply")
        out = F.when(fits, _capital(own)) if out is None else out.when(fits, _capital(own))
    return out.when((name != "") & ~person, from_name).otherwise(general)


def parsed(mails: DataFrame) -> DataFrame:
    """mails (subject, body, sender, ...) with title, company and status; all null where it isn't an application mail."""
    rows = mails.withColumn("__s", X.strip(X.text("subject"))).withColumn("__b", clean_body("body")).withColumn("__f", X.text("sender"))
    s, b, f = F.col("__s"), F.col("__b"), F.col("__f")
    head = F.left(b, F.lit(1200))
    # "sent to COMPANY TITLE COMPANY": the title stands between two mentions of the company.
    sent = X.strip(_group(s, r"your application was sent to (.+)"))
    low = F.lower(b)
    start = F.instr(low, F.concat(F.lit("sent to "), F.lower(sent))) + F.length(sent) + 8
    rest = F.substr(b, start)
    end = F.instr(F.lower(rest), F.lower(sent))
    between = F.when(F.contains(low, F.concat(F.lit("sent to "), F.lower(sent))) & (end > 1), X.strip(F.left(rest, end - 1)))
    title0 = F.coalesce(F.nullif(between, F.lit("")), X.strip(_group(s, r"indeed application:\s*(.+)")))
    subject_title, subject_company = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, roles in reversed(V.SUBJECT_PATTERNS):
        hit = F.regexp_like(s, F.lit("(?i)" + pattern))
        group = {r: _trimmed(F.regexp_extract(s, "(?i)" + pattern, k + 1)) for k, r in enumerate(roles)}
        subject_title = F.when(hit, group.get("t", F.lit(None).cast("string"))).otherwise(subject_title)
        subject_company = F.when(hit, group.get("c", F.lit(None).cast("string"))).otherwise(subject_company)
    guarded = lambda x: F.when(good_title(x), x)
    rows = rows.withColumn(
        "__t",
        F.coalesce(guarded(F.coalesce(title0, subject_title)), *[guarded(_group(head, p)) for p in V.BODY_TITLES], guarded(_group(s, r"applying for (?:the )?(.+?)(?: position| role|$)"))),
    )
    by_sender = F.when(~X.any_of(F.lower(f), V.AGGREGATORS), company_of_sender(f))
    filled = lambda x: F.nullif(x, F.lit(""))
    rows = rows.withColumn(
        "__c",
        F.coalesce(filled(sent), filled(subject_company), *[filled(_trimmed(_group(head, p, fold=False))) for p in V.BODY_COMPANIES], filled(by_sender)),
    )
    title = F.left(_tail_cut(X.strip(F.regexp_replace(X.collapse(F.col("__t")), r"\s*[-–]\s*[A-Z]?\d{4,}$", ""))), F.lit(80))
    company = X.strip(F.regexp_replace(F.regexp_replace(X.collapse(F.col("__c")), "^[\"']+|[\"']+$", ""), r"(?i)^(?:workday[.\s]*admin|workday|myworkday)\s+", ""))
    rows = rows.withColumn("__t", title).withColumn("__c", F.when(~X.any_of(F.lower(company), V.COMPANY_JUNK) & is_clean(company), company))
    told = gate(s, b, f) & F.col("__c").isNotNull()
    rows = rows.withColumn("title", F.when(told, F.coalesce(guarded(F.col("__t")), F.lit("Position (unknown)"))))
    rows = rows.withColumn("company", F.when(told, F.col("__c"))).withColumn(
        "status", F.when(told, F.when(is_rejection(s, b), "rejected").otherwise("applied")),
    )
    return rows.drop("__s", "__b", "__f", "__t", "__c")


def tracked(
    mails: DataFrame, processed: DataFrame, as_of: Column | None = None, since_days: int = 30,
    subjects: tuple[str, ...] = ("application", "applied", "applying", "indeed application"),
) -> DataFrame:
    """New mails within the days whose subject names an application, parsed; one row for each message id."""
    from millrace.operators.dedup import unprocessed

    rows = mails.where(X.any_of(F.lower(X.text("subject")), list(subjects)))
    rows = rows if as_of is None else rows.where(F.col("date") >= as_of - F.make_interval(days=F.lit(since_days)))
    return parsed(unprocessed(rows, processed)).where("status is not null")


def draft_fields(body: Column | str) -> Column:
    """map<string, string> of the 'Key: value' lines of a saved draft, keys in lower case; the first of a key counts."""
    lines = F.filter(F.split(X.text(body), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^\s*[A-Za-z][A-Za-z _-]{0,30}:\s*\S")))
    pairs = F.transform(
        lines,
        lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")),
    )
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1)
    return F.map_from_entries(first)


def draft_posting(drafts: DataFrame) -> DataFrame:
    """Postings of saved drafts (message_id, subject, body, date)."""
    rows = drafts.withColumn("__m", draft_fields("body"))
    get = lambda *keys: F.coalesce(*[F.nullif(F.col("__m")[k], F.lit("")) for k in keys])
    link = F.coalesce(get("link", "url"), F.nullif(F.regexp_extract(X.text("body"), r"(https?://\S+)", 1), F.lit("")), F.lit(""))
    return rows.select(
        "message_id", F.coalesce(get("title", "position", "job title"), F.nullif(X.strip(X.text("subject")), F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(get("company", "employer"), F.lit("Unknown")).alias("company"), F.coalesce(get("location"), F.lit("Remote")).alias("location"),
        get(
            "salary", "pay",
        ).alias("salary"), X.canonical_url(link).alias("link"), X.collapse(X.text("body")).alias("description"), F.lit("Gmail Draft").alias("source"), F.col("date").alias("date_posted"),
    )
