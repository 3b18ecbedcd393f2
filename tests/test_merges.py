"""Small merges, look-ups and renderings."""

from datetime import datetime

from millrace.functions import vocab as V
from millrace.operators import dedup, digest, enrich, filters, health, mail, reports, score, store
from millrace.operators.score import Variant
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 10)


def test_migration_keeps_the_newest(spark):
    rows = [(1, "Dev (Remote)", "Acme Inc", None), (2, "Dev", "Acme", None), (3, "Ops", "Acme", "ops|acme"), (4, None, None, None)]
    got = store.migrated(spark.createDataFrame(rows, "id long, job_title string, company string, dedup_key string")).collect()
    assert sorted((r.id, r.dedup_key) for r in got) == [(2, "dev|acme"), (3, "ops|acme"), (4, "|")]


def test_ledgers(spark):
    letters = spark.createDataFrame([(1, "A")], "job_id long, selected_cv string")
    new = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "A")], letters.schema)
    assert sorted(map(tuple, store.add_letters(letters, new).collect())) == [(1, "A"), (1, "B"), (2, "A")]
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert sorted(map(tuple, store.replace_by_key(table, spark.createDataFrame([("b", 9)], table.schema), "k").collect())) == [("a", 1), ("b", 9)]
    jobs = spark.createDataFrame([(1, ""), (2, "x"), (3, None)], "id long, link string")
    assert [r.id for r in store.delete_jobs(jobs, jobs.where("id = 2")).orderBy("id").collect()] == [1, 3]
    filled = store.fill_links(jobs, spark.createDataFrame([(1, "n1"), (2, "n2")], jobs.schema))
    assert {r.id: r.link for r in filled.collect()} == {1: "n1", 2: "x", 3: None}
    mails = spark.createDataFrame([("m1",), ("m2",), ("m2",)], "message_id string")
    assert [r.message_id for r in dedup.unprocessed(mails, mails.limit(1)).collect()] == ["m2"]
    links = spark.createDataFrame(
        [(1, "l", "a", "b"), (2, "l", "c", "d"), (3, "", "a", "b"), (4, None, "a", "b")],
        "ord long, link string, title string, company string",
    )
    assert sorted(r.ord for r in dedup.by_link_or_name(links).collect()) == [1, 3]


def test_fallback_texts_and_matches(spark):
    jobs = spark.createDataFrame(
        [(1, "T1", "Co", "l1"), (2, "T2", "Co", ""), (3, "T3", "Co", None)], "id long, job_title string, company string, link string",
    )
    a = spark.createDataFrame([(1, "short"), (2, "x" * 200)], "id long, text string")
    results = spark.createDataFrame([(1, 2, "b" * 90), (1, 1, "a" * 90), (2, 1, "c" * 300)], "id long, place int, body string")
    got = {r.id: (r.text_from, r.text) for r in enrich.first_found(jobs, [("page", a), ("search", enrich.snippets(results))]).collect()}
    assert got == {1: ("search", "a" * 90 + " " + "b" * 90), 2: ("page", "x" * 200), 3: ("title", "T3")}
    mails = spark.createDataFrame(
        [("m1", "t1", "CO", ""), ("m2", "new", "x", "l1"), ("m3", "new", "x", "")],
        "message_id string, title string, company string, link string",
    )
    assert {r.message_id: r.job_id for r in enrich.matched(mails, jobs).collect()} == {"m1": 1, "m2": 1, "m3": None}
    html = '<a href="https://x.org/unsubscribe/job">u</a><a href="https://x.org/jobs/1">a</a><a href="https://jobs.lever.co/co/job/2">b</a>'
    assert spark.createDataFrame([(html,)], "h string").select(enrich.job_link("h").alias("l")).first().l == "https://jobs.lever.co/co/job/2"
    old = spark.createDataFrame(
        [(1, "Email / a@b.c", None, 0.0, DAY), (2, "Email / a@b.c", "real", 0.0, DAY), (3, "RemoteOK", None, None, DAY)],
        "id long, source string, description string, relevance_score double, extracted_date timestamp",
    )
    assert [r.id for r in enrich.mail_candidates(old, F.lit(DAY), 5).collect()] == [1]


def test_health_lines_and_record(spark):
    run = spark.createDataFrame(
        [("a", 2, 5, 1.0, None), ("b", 1, 0, 1.0, "timeout"), ("c", 1, 0, 1.0, "")],
        "source string, queries long, raw_count long, duration_s double, error string",
    )
    assert [(r.source, r.status) for r in health.record(run.limit(0).withColumn("status", F.lit("")), run).orderBy("source").collect()] == [("a", "ok"), ("b", "error"), ("c", "empty")]
    assert health.summary_lines(run).count() == 3


def test_rendering_and_listing_filters(spark):
    rows = [
        (1, "A <b>", "Co & Co", None, "https://www.linkedin.com/jobs/1", None, "Email / me@x.org", DAY, 55.25, 2, "<id 1>", "cv_sales_2.docx", True),
        (2, "Pump Engineer", None, "y" * 250, None, "9", "RemoteOK", DAY, None, None, None, None, None),
    ]
    jobs = spark.createDataFrame(
        rows,
        "id long, job_title string, company string, description string, link string, salary string, source string, extracted_date timestamp, relevance_score double, seen_count long, source_message_id string, best_cv string, scam_risk boolean",
    )
    none = spark.createDataFrame([], "job_id long, status string")
    one = reports.listing(jobs, none, none.select("job_id"), F.lit(DAY), origin="email").collect()
    assert [(r.id, r.source, r.email_account, r.relisted, r.apply_status, r.gmail_url) for r in one] == [(1, "LinkedIn", "me", True, "none", "https://mail.google.com/mail/?authuser=me@x.org#search/rfc822msgid:id%201")]
    line = digest.rendered(jobs.where("id = 1").withColumn("slot", F.lit(1))).first().line
    assert "A &lt;b&gt;" in line and "Co &amp; Co" in line and "⚠" in line and "cv sales" in line
    text = reports.letters(jobs.where("id = 1"), {"cv_sales_2.docx": "I sell."}).first().letter
    assert "Co & Co" in text and "I sell." in text


def test_rules_on_odd_rows(spark):
    null = spark.createDataFrame(
        [(1, None, None, None, None, None, None)],
        "ord long, title string, description string, company string, link string, location string, source string",
    )
    got = score.judged(null, [Variant("v", {"x": 1.0})]).first()
    assert (got.base_score, got.best_cv, got.reject_reason) == (0.0, None, "below_min_score")
    saved = null.withColumn("source", F.lit(V.SAVED_SOURCES[0]))
    assert score.judged(saved, [Variant("v", {"x": 1.0})]).first().reject_reason is None
    df = spark.range(1, 11).select(F.col("id").alias("ord"))
    ok = F.col("ord") % 2 == 0
    assert [r.ord for r in filters.within_budget(df, ok, 2).orderBy("ord").collect()] == [2, 4, 5, 6, 7, 8, 9, 10]
    assert [r.ord for r in filters.within_budget(df, ok, 99).orderBy("ord").collect()] == [2, 4, 6, 8, 10]
    assert score.expanded(" Go ", {"go": ["Golang"]}) == ["go", "golang"]
    pick = spark.createDataFrame([("python and sales",), ("nothing",)], "d string").select(score.letter_variant("d", [Variant("a", {"sales": 1.0, "x": 1.0}), Variant("b", {"python": 1.0, "sales": 2.0})]).alias("v")).collect()
    assert [r.v for r in pick] == ["b", "Primary"]


def test_tracked_mails(spark):
    mails = spark.createDataFrame(
        [("m1", "You applied to Valve Engineer at Acme", "application submitted", "x@linkedin.com", DAY), ("m1", "You applied to Valve Engineer at Acme", "application submitted", "x@linkedin.com", DAY), ("m2", "hello", "b", "c", DAY), ("m3", "You applied to Ops Engineer at Foo Co", "application submitted", "x@linkedin.com", datetime(2020, 1, 1))],
        "message_id string, subject string, body string, sender string, date timestamp",
    )
    got = mail.tracked(mails, spark.createDataFrame([], "message_id string"), F.lit(DAY)).collect()
    assert [(r.message_id, r.title, r.company, r.status) for r in got] == [("m1", "Valve Engineer", "Acme", "applied")]
