"""Order-dependent operators against plain restatements of their rules, on random inputs."""

import random
from datetime import datetime, timedelta

import pytest
from millrace.functions import vocab as V
from millrace.operators import dedup, digest, filters, health, store
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)


def jobs_of(r, n):
    sources = ["Greenhouse", "Workday", "RemoteOK", "Jobicy", "Apify / Indeed", "JSearch", "Gmail Draft"]
    return [(i, f"t{i}", r.choice(["Acme", "acme ", "Foo", "Bar", None, "", f"co{i % 9}"]), float(r.choice([0, 5, 10, 20, 20, 50, 80])), DAY + timedelta(days=r.randint(0, 5)), r.choices(sources, [3, 3, 3, 3, 3, 3, 1])[0]) for i in range(n)]


def greedy(jobs, sent, limit, min_score):
    rows = sorted([j for j in jobs if j[0] not in sent], key=lambda j: (-j[3], -j[4].timestamp(), j[0]))[:400]
    chosen, per = [], {}

    def take(candidates, slots, cap, name):
        n = 0
        for j in candidates:
            if n >= slots or len(chosen) >= limit:
                return
            company = (j[2] or "Unknown").strip().lower()
            if any(c[0] == j[0] for c in chosen) or per.get(company, 0) >= cap:
                continue
            chosen.append((j[0], name))
            per[company] = per.get(company, 0) + 1
            n += 1

    low = lambda j: any(m in j[5].lower() for m in V.DEMOTED_SOURCES)
    take([j for j in rows if j[5] in V.SAVED_SOURCES], limit, limit, "saved")
    fit = [j for j in rows if j[3] >= min_score]
    board = [j for j in fit if j[5] in V.BOARD_SOURCES]
    rest = [j for j in fit if j[5] not in V.BOARD_SOURCES and not low(j)]
    take(board, V.BOARD_SLOTS, V.COMPANY_CAP, "boards")
    take(rest, V.AGGREGATOR_SLOTS, V.COMPANY_CAP, "aggregators")
    take(board + rest, limit - len(chosen), V.COMPANY_CAP, "wildcard")
    take([j for j in fit if low(j)], limit - len(chosen), V.COMPANY_CAP, "last_resort")
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_digest_equals_the_greedy_loop(spark, seed):
    r = random.Random(seed)
    jobs = jobs_of(r, r.choice([5, 30, 90]))
    sent = {j[0] for j in jobs if r.random() < 0.2}
    df = spark.createDataFrame(jobs, "id long, job_title string, company string, relevance_score double, extracted_date timestamp, source string")
    ledger = spark.createDataFrame([(i,) for i in sent], "job_id long")
    got = [(x.id, x["pass"]) for x in sorted(digest.main_digest(df, ledger).collect(), key=lambda x: x.slot)]
    assert got == greedy(jobs, sent, V.DIGEST_SIZE, V.DIGEST_SCORE)


def test_digest_skips_dead_links_but_not_of_boards(spark):
    rows = [(1, "a", "A", 50.0, DAY, "Jobicy"), (2, "b", "B", 40.0, DAY, "Jobicy"), (3, "c", "C", 60.0, DAY, "Greenhouse")]
    df = spark.createDataFrame(rows, "id long, job_title string, company string, relevance_score double, extracted_date timestamp, source string")
    none = spark.createDataFrame([], "job_id long")
    assert {x.id for x in digest.main_digest(df, none, live=F.col("id") == 2).collect()} == {2, 3}
    assert {(x.quota, x.missing) for x in digest.shortfall(digest.main_digest(df, none)).collect()} == {("boards", 4), ("aggregators", 3)}


def test_near_titles_equal_the_greedy_leader(spark):
    r = random.Random(1)
    words = "sales field process valve engineer lead senior technical pump flow".split()
    rows = [(i, " ".join(r.sample(words, r.randint(0, 7))), r.choice(["Acme Inc", "ACME", "Foo"])) for i in range(200)]
    kept = []
    for i, title, company in rows:
        mine = set(title.split())
        co = "acme" if company.lower().startswith("acme") else "foo"
        if mine and any(c == co and t and len(mine & t) / len(mine | t) >= 0.85 for c, t, _ in kept):
            continue
        kept.append((co, mine, i))
    df = spark.createDataFrame(rows, "ord long, title string, company string").repartition(3)
    assert sorted(x.ord for x in dedup.near_titles(df).collect()) == [i for *_, i in kept]


def upsert_model(batches):
    table = {}
    for batch in batches:
        for k, company, date, score, cv, scam in batch:
            if k not in table:
                table[k] = [company, date, score, cv, 1, scam]
            else:
                t = table[k]
                if score > t[2]:
                    t[3] = cv
                t[1], t[2], t[4], t[5] = max(t[1], date), max(t[2], score), t[4] + 1, max(t[5], scam)
    return {k: tuple(v) for k, v in table.items()}


def test_upsert_in_any_split(spark):
    r = random.Random(2)
    rows = [(f"k{r.randint(0, 9)}", f"c{i}", DAY + timedelta(hours=i), float(r.choice([1, 2, 3])), f"cv{i}", r.random() < 0.1) for i in range(60)]
    schema = "dedup_key string, job_title string, company string, description string, link string, salary string, source string, extracted_date timestamp, relevance_score double, best_cv string, seen_count long, scam_risk boolean"
    want = upsert_model([rows])
    for cuts in ([60], [7, 30, 60], [1, 2, 59, 60]):
        table, a = spark.createDataFrame([], schema), 0
        for b in cuts:
            batch = [(k, None, c, None, None, None, None, d, s, cv, x, i) for i, (k, c, d, s, cv, x) in enumerate(rows[a:b], a)]
            new = spark.createDataFrame(batch, schema.replace("seen_count long, ", "") + ", ord long")
            table = spark.createDataFrame(store.upsert(table, new).collect(), schema)
            a = b
        assert {x.dedup_key: (x.company, x.extracted_date, x.relevance_score, x.best_cv, x.seen_count, x.scam_risk) for x in table.collect()} == want


def test_status_events_in_order(spark):
    r = random.Random(3)
    events = [(r.randint(1, 8), DAY + timedelta(minutes=i), r.choices(["applied", "interviewing", "rejected"], [5, 4, 1])[0]) for i in range(60)]
    want = {}
    for job, _, e in events:
        now = want.get(job, "none")
        want[job] = "rejected" if e == "rejected" else e if now in ("none", "") else "interviewing" if (now, e) == (
            "applied", "interviewing",
        ) else now
    none = spark.createDataFrame([], "job_id long, status string, updated_date timestamp")
    half = spark.createDataFrame(events[:30], "job_id long, ts timestamp, status string")
    rest = spark.createDataFrame(events[30:], half.schema)
    got = store.fold_status(store.fold_status(none, half), rest).collect()
    assert {x.job_id: x.status for x in got} == want


def test_stale_needs_three_empty_runs(spark):
    runs = [("a", d, n, None) for d, n in enumerate([5, 0, 0, 0])] + [("b", d, n, None) for d, n in enumerate([0, 0])] + [("c", d, n, e) for d, (n, e) in enumerate([(0, "x"), (0, "y"), (0, None)])] + [("d", d, n, None) for d, n in enumerate([0, 0, 1])]
    df = spark.createDataFrame(
        [(s, 1, n, 1.0, e, DAY + timedelta(days=d)) for s, d, n, e in runs],
        "source string, queries long, raw_count long, duration_s double, error string, run_at timestamp",
    )
    assert sorted((x.source, x.last_error) for x in health.stale(df).collect()) == [("a", None), ("c", "y")]
    now = df.where("source = 'a'").limit(1).withColumn("raw_count", F.lit(3).cast("long"))
    assert [x.source for x in health.recovered(df, now).collect()] == ["a"]
    one = health.concentration(spark.createDataFrame([("x", 134), ("y", 1), ("z", 0)], "source string, raw_count long")).collect()[0]
    assert (one.largest, one.n_empty, one.warning) == ("x", 1, True)


def test_internal_addresses(spark):
    urls = {
        "http://10.0.0.1/x": True, "http://127.0.0.1": True, "http://169.254.1.1/": True, "http://192.168.3.4": True,
        "http://172.20.0.1": True, "http://8.8.8.8/x": False, "https://example.org": False, "ftp://example.org": True, "": True,
        "http://[::1]/": True, "http://localhost:80/": True,
    }
    df = spark.createDataFrame(list(urls.items()), "url string, want boolean")
    assert all(x.got == x.want for x in df.select("want", filters.internal_url("url").alias("got")).collect())


def test_titles_of_one_hot_block_meet_in_cells_and_no_task_folds_them(spark, monkeypatch):
    import random

    from millrace.operators import dedup

    monkeypatch.setattr(dedup, "CELL_ROWS", 7)
    r = random.Random(5)
    titles = [" ".join(r.sample([f"tok{k}" for k in range(9)], r.randint(5, 8))) for _ in range(250)]
    df = spark.createDataFrame([(i, t, None if i % 3 else "c") for i, t in enumerate(titles)], "ord long, title string, company string").repartition(3)
    kept = []
    for i, t in enumerate(titles):
        own = frozenset(t.split())
        if not any(len(own & k) / len(own | k) >= 0.85 and (i % 3 == 0) == (j % 3 == 0) for j, k in kept):
            kept.append((i, own))
    out = dedup.near_titles(df, block=dedup.F.col("company"))
    assert sorted(x.ord for x in out.collect()) == [i for i, _ in kept]
    assert "InPandas" not in out._jdf.queryExecution().toString()
    pairs = dedup.similar_pairs(df.withColumn("company", dedup.F.lit("c")), 0.3).collect()
    first = {}
    for i, t in enumerate(titles):
        first.setdefault(frozenset(t.split()), i)
    want = sorted((i, j) for x, i in first.items() for y, j in first.items() if i < j and len(x & y) / len(x | y) >= 0.3)
    assert sorted((x.a, x.b) for x in pairs) == want


def test_queries_over_whole_tables(spark):
    from millrace.plans.queries import QUERIES
    from millrace.plans.views import view

    sf = "/root/testdata/sf0.001"
    rows = lambda name: QUERIES[name](spark, sf).collect()
    keys = [r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    hops = lambda k: min(5, -k % 7, max(keys) + 1 - k)  # noqa: E731 the last key leads out of the table
    assert sorted(map(tuple, rows("redirect_chain_all"))) == sorted((k, hops(k), k + hops(k)) for k in keys)
    jobs = view(spark, sf, "v_jobs")
    assert {r.id for r in rows("letter_texts")} == {r.id for r in jobs.select("id").collect()}
    assert {r.seed for r in rows("similar_jobs_all")} == {r.id for r in jobs.where("id % 100 = 0").select("id").collect()}
    assert {r.job_id for r in rows("posting_flags_all")} == {r.job_id for r in view(spark, sf, "v_docs").select("job_id").collect()}
    assert len(rows("mail_parse_all")) == view(spark, sf, "v_mail").count()


def test_similar_jobs_against_all_pairs(spark):
    import random

    from millrace.operators import reports

    r = random.Random(3)
    words = ["pump", "pumps", "valve", "engineer", "Engineering", "of", "senior", "bioengineer", "x" * 30, "Valves/pumps"]
    jobs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 4))), float(r.randint(0, 9)) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(jobs, "id long, job_title string, relevance_score double").repartition(3)
    got = {(x.seed, x.place): x.id for x in reports.similar(df, df.where("id % 10 = 0"), k=5).collect()}
    want = {}
    for seed, title, _ in jobs[::10]:
        own = {w.lower() for w in title.split() if len(w) > 3} - set(reports.STOP_WORDS)
        met = [(-s if s is not None else 99, i) for i, t, s in jobs if i != seed and any(w in t.lower() for w in own)]
        want |= {(seed, k + 1): i for k, (_, i) in enumerate(sorted(met)[:5])}
    assert got == want


def test_cells_of_hot_tokens_are_bounded_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CELL_ROWS", 10)
    rows = spark.createDataFrame([(k, "c", ["hot", f"w{k % 7}", f"x{k}"]) for k in range(120)], "ord long, block string, tokens array<string>")
    pairs = dedup._similar(rows, 0.5)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(a, b) for a in range(120) for b in range(a + 1, 120) if a % 7 == b % 7]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(sequence(0") == 2  # either side is dealt
