"""Readers on small payloads of each shape, and the incremental mode."""

import json

from millrace.operators import enrich, store
from millrace.sources import boards, mailbox, profiles
from millrace.streaming import incremental
from pyspark.sql import functions as F


def rows(spark, reader, payload, *args):
    return [r.asDict() for r in reader(spark.createDataFrame([(json.dumps(payload),), ("{}",)] if isinstance(payload, dict) else [(json.dumps(payload),)], "payload string"), *args).collect()]


def test_board_shapes(spark):
    assert rows(spark, boards.lever, [{"text": "A", "descriptionPlain": "", "description": "<b>B</b>", "hostedUrl": "https://x.org/1?lever-source=a", "categories": {"location": "Oslo", "commitment": "Full-time"}}], "Co")[0] | {} == {
        "title": "A", "company": "Co", "description": "B", "link": "https://x.org/1?lever-source=a", "location": "Oslo", "salary": "Full-time", "source": "Lever", "date_posted": None}
    a = rows(
        spark, boards.ashby,
        {"jobs": [{"title": "A", "descriptionPlain": "d", "jobUrl": "https://x.org/2", "location": "", "publishedAt": "2024-01-01", "compensation": None}]},
        "Co",
    )[0]
    assert (a["location"], a["date_posted"]) == ("Not stated", "2024-01-01")
    s = rows(
        spark, boards.smart_recruiters,
        {"content": [{"id": "7", "name": "A", "location": {"city": "Rome", "country": ""}}, {"id": "8", "name": "B"}]}, "Co", "co",
    )
    assert [(x["link"], x["location"]) for x in s] == [
        ("https://jobs.smartrecruiters.com/co/7", "Rome"), ("https://jobs.smartrecruiters.com/co/8", "Not stated"),
    ]
    w = rows(
        spark, boards.workday, {"jobPostings": [{"title": "A", "externalPath": "/job/1", "bulletFields": ["x", "y"]}]}, "Co",
        "https://co.example.org",
    )[0]
    assert (w["description"], w["link"]) == ("x y", "https://co.example.org/job/1")


def test_feed_shapes(spark):
    ok = rows(
        spark, boards.remote_ok,
        [{"legal": "terms"}, {"position": "Dev &amp; Ops", "company": "X", "description": "<p>cloud</p>", "url": "https://r.org/1", "tags": ["aws"], "salary_min": 1000, "salary_max": 2000}],
        ["AWS"],
    )
    assert [(x["title"], x["salary"]) for x in ok] == [("Dev & Ops", "USD 1,000 – 2,000")]
    assert rows(spark, boards.remote_ok, [{"position": "P", "description": "none"}], ["aws"]) == []
    assert [x["title"] for x in rows(spark, boards.arbeitnow, {"data": [{"title": "A", "remote": True}, {"title": "B", "location": "Bonn"}, {"title": "C", "location": ""}]})] == ["A", "C"]
    assert [x["title"] for x in rows(spark, boards.muse, {"results": [{"name": "A", "locations": [{"name": "Flexible / Remote"}]}, {"name": "B", "locations": [{"name": "Bonn"}]}, {"name": "C", "locations": []}]})] == ["A", "C"]
    h = rows(
        spark, boards.himalayas,
        {"jobs": [{"title": "A", "company": '{"name": "Inner"}', "applicationLink": "https://h.org/a"}, {"title": "B", "company": "Plain", "url": "https://h.org/b"}]},
    )
    assert [(x["company"], x["link"]) for x in h] == [("Inner", "https://h.org/a"), ("Plain", "https://h.org/b")]
    assert rows(
        spark, boards.adzuna, {"results": [{"title": "A", "salary_min": 10, "salary_max": None, "company": {"display_name": "C"}}]}, "gb",
    )[0]["salary"] == "£ 10+"
    b = rows(spark, boards.federal_agency, {"stellenangebote": [{"beruf": "Schlosser", "refnr": "9", "arbeitsort": {"ort": "Ulm"}}]})[0]
    assert (b["title"], b["link"], b["location"]) == ("Schlosser", "https://www.arbeitsagentur.de/jobsuche/jobdetail/9", "Ulm")
    g = rows(
        spark, boards.serp,
        {"jobs_results": [{"title": "A", "share_link": "https://s.org/1", "apply_options": [], "job_highlights": [{"items": ["x", "y"]}], "description": "d"}]},
    )[0]
    assert (g["link"], g["description"]) == ("https://s.org/1", "d x y")
    for name in ("remotive", "jobicy", "jooble", "reed", "jsearch"):
        assert rows(spark, boards.READERS[name], {"jobs": []}) == []


def test_rss_and_cards(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<?xml version="1.0"?><rss xmlns:g="http://g"><channel><item><title>Acme: Pump Engineer</title><description>&lt;p&gt;Build&lt;/p&gt;</description><link>https://w.org/1?utm_source=x</link><g:location>Oslo</g:location></item></channel></rss>')
    got = boards.rss(spark, str(tmp_path / "f.xml"), "WeWorkRemotely").collect()[0]
    assert (got.title, got.company, got.description, got.link, got.location) == ("Pump Engineer", "Acme", "Build", "https://w.org/1", "Oslo")
    html = '<ul><li><a class="l" href="https://l.org/1?trk=a"></a><h3 class="base-title"> Dev </h3><h4 class="base-subtitle">Co</h4><time datetime="2024-01-02">x</time></li><li><p>no</p></li></ul>'
    card = boards.guest_cards(spark.createDataFrame([(html,)], "html string"), "remote dev").collect()
    assert [(c.title, c.company, c.link, c.location, c.date_posted, c.search_query) for c in card] == [("Dev", "Co", "https://l.org/1", "Remote", "2024-01-02", "remote dev")]
    web = spark.createDataFrame(
        [("Acme hiring Dev in Oslo | LinkedIn", "https://www.linkedin.com/jobs/view/1", "b"), ("Jobs", "https://x.org/search?q=a", "b")],
        "title string, href string, body string",
    )
    assert [(r.title, r.company, r.source) for r in boards.search_results(web).collect()] == [("Dev", "Acme", "LinkedIn")]


def test_profiles():
    assert profiles.variants({"cvs": {"a": {"skills": ["x", "y"]}, "b": {"skills": {"z": 3}}, "c": {}}})[1].skills == {"z": 3.0}
    assert profiles.variants({"cvs": {"c": {"skills": []}}}) is None and profiles.variants(None) is None


def test_incremental_merges(spark, tmp_path):
    schema = "link string, first_seen timestamp, last_seen timestamp"
    source = str(tmp_path / "in")
    merge = lambda old, batch: store.touch_links(old, batch)
    for n in range(3):
        spark.range(5).select(
            F.concat(F.lit("l"), (F.col("id") % (n + 2)).cast("string")).alias("link"),
            F.make_timestamp(F.lit(2024), F.lit(1), F.lit(n + 1), F.lit(0), F.lit(0), F.lit(0)).alias("at"),
        ).write.mode("append").parquet(source)
        stream = spark.readStream.schema("link string, at timestamp").parquet(source)
        incremental.merge_batches(stream, str(tmp_path / "table"), merge, schema, str(tmp_path / "check"), once=True).awaitTermination()
    got = {r.link: (r.first_seen.day, r.last_seen.day) for r in incremental.read_table(spark, str(tmp_path / "table"), 3, schema).collect()}
    assert got == {"l0": (1, 3), "l1": (1, 3), "l2": (2, 3), "l3": (3, 3)}


def test_mails(spark):
    raw = [
        b"Message-ID: <1@x>\r\nSubject: =?utf-8?q?Bewerbung_f=C3=BCr_Dev?=\r\nFrom: Jos <jos@x.org>\r\nDate: Wed, 10 Jan 2024 10:00:00 +0100\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nHello  there\r\n",
        b"Message-ID: <2@x>\r\nSubject: s\r\nFrom: b@x.org\r\nContent-Type: text/html\r\n\r\n<p>Only <b>html</b> &amp; more</p>",
        b"", None,
    ]
    got = mailbox.mails(spark.createDataFrame([(r,) for r in raw], "content binary")).collect()
    assert (
        got[0].message_id, got[0].subject, got[0].sender, got[0].date.hour, got[0].body,
    ) == ("<1@x>", "Bewerbung für Dev", "Jos <jos@x.org>", 9, "Hello there")
    assert got[1].body == "Only html & more" and len(got) == 4 and got[3].subject is None


def test_redirects_and_cache(spark):
    hops = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x"), *[(f"n{i}", f"n{i + 1}") for i in range(9)]], "link string, to string")
    links = spark.createDataFrame([("a",), ("x",), ("n0",), ("q",)], "link string")
    assert {r.link: (r.final, r.n_hops) for r in enrich.followed(links, hops).collect()} == {"a": ("c", 2), "x": ("x", 0), "n0": ("n5", 5), "q": ("q", 0)}
    dims = spark.createDataFrame([(1, ["b", "a"]), (0, ["a", "z"])], "ord int, key_domains array<string>")
    assert enrich.flattened_domains(dims).first().key_domains == ["a", "z", "b"]
    assert json.loads(enrich.as_json(links.limit(1)).first().json) == {"link": "a"}
    assert profiles.from_cache(None, {"cvs": {"k": {"skills": ["x"]}}})[0].name == "k"


def test_keywords_match_whole_descriptions_and_tags_before_the_cut(spark):
    late = "<p>" + "word " * 600 + "turbine</p>"
    ok = [{"position": "A", "description": late}, {"position": "B", "description": "x", "tags": ["Turbine"]}, {"position": "C", "description": "x"}]
    got = rows(spark, boards.remote_ok, ok, ["turbine"])
    assert [(x["title"], len(x["description"])) for x in got] == [("A", 2000), ("B", 1)]
    got = rows(spark, boards.remotive, {"jobs": [{"title": "A", "description": late}, {"title": "B", "tags": ["turbine"]}, {"title": "C"}]}, ["Turbine"])
    assert [x["title"] for x in got] == ["A", "B"] and len(got[0]["description"]) == 2000
    got = rows(spark, boards.muse, {"results": [{"name": "A", "contents": late, "locations": [{"name": "Anywhere"}]}, {"name": "B", "contents": "x"}]}, ["turbine"])
    assert [(x["title"], len(x["description"])) for x in got] == [("A", 2000)]


def test_one_board_that_fails_takes_nothing_from_the_others(spark):
    data = [
        ("A", "greenhouse", "a", None, '{"jobs": [{"title": "P"}, {"title": "Q"}]}', None), ("B", "Lever", "b", None, '[{"text": "R"}]', ""), ("C", "lever", "c", None, "<html>", None),
        ("D", "workday", "d", "https://d.org", None, "TimeoutError"), ("E", "other", "e", None, "{}", None), ("F", "ashby", "f", None, "{}", None),
    ]
    postings, report = boards.scan(spark.createDataFrame(data, "name string, ats string, slug string, site string, payload string, error string"))
    assert sorted((r.title, r.company) for r in postings.collect()) == [("P", "A"), ("Q", "A"), ("R", "B")]
    assert {r.source: (r.queries, r.raw_count, r.error) for r in report.collect()} == {
        "greenhouse / A": (1, 2, None), "lever / B": (1, 1, None), "lever / C": (1, 0, "unreadable"), "workday / D": (1, 0, "TimeoutError"), "other / E": (1, 0, "no reader"), "ashby / F": (1, 0, None),
    }


def test_union_has_one_order(spark):
    frames = [spark.range(1000).select((F.col("id") % 7).cast("string").alias("title"), F.lit("x").alias("company")).repartition(n) for n in (150, 5)]
    got = boards.union_of(frames)
    both = sorted((r.ord, r.title) for r in got.collect())
    assert [o for o, _ in both] == list(range(2000)) and [t for _, t in both[:1000]] == sorted(t for _, t in both[:1000])
    again = boards.union_of([f.repartition(3) for f in frames])
    assert sorted((r.ord, r.title) for r in again.collect()) == both


def test_sources_get_their_quotas(spark):
    from millrace.operators import score

    queries = spark.createDataFrame([(f"remote skill number {i:02d}", "specific") for i in range(8)] + [(f"remote s{i:02d}", "broad") for i in range(14)], "query string, tier string")
    got = score.planned(queries).groupBy("source").agg(F.count("*").alias("n"), F.max("place").alias("last")).collect()
    assert {r.source: r.n for r in got} == {"JSearch": 8, "Free aggregators": 22, "LinkedIn": 5, "SerpAPI": 5, "Apify": 3, "DuckDuckGo": 10}
    assert all(r.n == r["last"] for r in got)


def test_incremental_merges_rewrite_touched_buckets_only(spark, tmp_path):
    import os

    schema, source, table = "link string, first_seen timestamp, last_seen timestamp", str(tmp_path / "in"), str(tmp_path / "table")
    for n, keys in enumerate([range(40), [3], [3, 100]]):
        spark.createDataFrame([(f"l{k}",) for k in keys], "link string").withColumn("at", F.make_timestamp(F.lit(2024), F.lit(1), F.lit(n + 1), F.lit(0), F.lit(0), F.lit(0))).write.mode("append").parquet(source)
        stream = spark.readStream.schema("link string, at timestamp").parquet(source)
        incremental.merge_batches(stream, table, store.touch_links, schema, str(tmp_path / "check"), once=True, key="link", buckets=8).awaitTermination()
    got = {r.link: (r.first_seen.day, r.last_seen.day) for r in incremental.read_table(spark, table, 3, schema).collect()}
    assert got == {f"l{k}": (1, 3 if k == 3 else 1) for k in range(40)} | {"l100": (3, 3)}
    folders = {v: [x for x in os.listdir(f"{table}/data/{v}") if x.startswith("__bucket")] for v in sorted(os.listdir(f"{table}/data"))}
    assert len(folders["v0000000002"]) <= 1 and len(folders["v0000000003"]) <= 2
    assert len(folders["v0000000001"]) == 7 and incremental.read_table(spark, table, 2, schema).count() == 40


def test_items_of_a_feed_are_read_once(spark, monkeypatch):
    from millrace.plans import feeds

    read, once = [], boards.rss_items
    monkeypatch.setattr(boards, "rss_items", lambda *a: read.append(a) or once(*a))
    out = feeds.read_rss(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(read) == 1 and "xml" not in plan.lower() and out.count() == 3000
