"""Further registered queries: look-ups, edits, mails, filters and orders that the other catalogue doesn't reach. Whole tables, each with its SQL."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import addresses
from millrace.functions import text as X
from millrace.functions import vocab as V
from millrace.functions.rounds import materialise, work_folder
from millrace.operators import dated, dedup, digest, enrich, filters, health, index, ledger, mail, reports, runs, score, store
from millrace.plans import queries as P
from millrace.plans import readers
from millrace.plans import sql as Q
from millrace.plans.queries import NOW, VARIANTS, register
from millrace.plans.views import AS_OF, view, with_
from millrace.sources import boards, paged

# --- text ---

HOSTED = "case id % 3 when 0 then 'https://acme.wd5.example.org/en-US/site/job/' || id when 1 then 'https://acme.wd5.example.org/site/job/' || id else 'ftp://acme/' || id end"


@register(with_("v_jobs") + "select id, case when id % 3 < 2 then 'https://acme.wd5.example.org/wday/cxs/acme/site/job/' || id end as detail from v_jobs")
def detail_urls(spark, d):
    return view(spark, d, "v_jobs").select("id", X.detail_api_url(F.expr(HOSTED)).alias("detail"))


@register(with_("v_jobs") + "select id, case when id % 3 = 0 then id || 'k' end as salary from v_jobs")
def tidy_salaries(spark, d):
    return view(spark, d, "v_jobs").select("id", X.tidy_salary(F.expr("case id % 3 when 0 then '  ' || id || 'k ' when 1 then ' ' end")).alias("salary"))


LINKS = "'<a href=\"https://x.org/jobs/unsubscribe\">a</a><a href=\"https://acme.org/jobs/' || id || '\">b</a>' || case when id % 2 = 0 then '<A HREF=\"https://boards.greenhouse.io/a/jobs/' || id || '\">c</a>' else '<a href=\"https://y.org/x\">' end"


@register(with_("v_jobs") + "select id, case when id % 5 = 0 then null when id % 2 = 0 then 'https://boards.greenhouse.io/a/jobs/' || id else 'https://acme.org/jobs/' || id end as link from v_jobs")
def mail_links(spark, d):
    html = F.when(F.col("id") % 5 != 0, F.expr(LINKS)).otherwise("no link")
    return view(spark, d, "v_jobs").select("id", enrich.job_link(html).alias("link"))


SYNONYMS = {"thand": ["onst", "tion"], "lich": ["keit"]}


@register(with_("v_docs") + "select job_id, cast(contains(l, 'thand') or contains(l, 'onst') or contains(l, 'tion') as int) + cast(contains(l, 'lich') or contains(l, 'keit') as int) + cast(contains(l, 'que') as int) as n from (select job_id, lower(coalesce(description, '')) l from v_docs)")
def synonym_matches(spark, d):
    rows = view(spark, d, "v_docs")
    return rows.select("job_id", score.matches(F.lower(X.text("description")), [" Thand", "lich", "que", ""], SYNONYMS).alias("n"))


@register(
    with_("v_docs") + ", n as (select job_id, " + ", ".join(f"{Q.matches('l', list(v.skills))} n{k}" for k, v in enumerate(VARIANTS)) + " from (select job_id, lower(coalesce(description, '')) l from v_docs)) "
    "select job_id, case when greatest(n0, n1, n2) = 0 then 'Primary' when n0 = greatest(n0, n1, n2) then 'CV_A' when n1 = greatest(n0, n1, n2) then 'CV_B' else 'CV_C' end as variant from n"
)
def letter_variants(spark, d):
    return view(spark, d, "v_docs").select("job_id", score.letter_variant("description", VARIANTS).alias("variant"))


@register(with_("v_docs") + f"select job_id, {Q.any_of('lower(coalesce(description, chr(32)))', V.REMOTE_WORDS_SHORT)} as remote from v_docs")
def remote_descriptions(spark, d):
    return view(spark, d, "v_docs").select("job_id", filters.remote_description().alias("remote"))


@register(with_("v_docs") + ", x as (select ord, unnest([lang, company]) d, unnest([1, 2]) k from v_docs), f as (select d, min(ord * 10 + k) o from x where d is not null group by d) select string_agg(d, ',' order by o) as domains from f")
def domains_flattened(spark, d):
    rows = view(spark, d, "v_docs").select("ord", F.array_compact(F.array("lang", "company")).alias("key_domains"))
    return enrich.flattened_domains(rows).select(F.array_join("key_domains", ",").alias("domains"))


@register(with_("v_jobs") + "select '{\"id\":' || id || ',\"company\":\"' || company || '\"}' as json from v_jobs")
def json_rows(spark, d):
    return enrich.as_json(view(spark, d, "v_jobs").select("id", "company"))


@register("select conv_id as id, left(string_agg(text, ' ' order by turn, text), 3000) as text from conversations where text is not null group by conv_id")
def search_snippets(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return enrich.snippets(rows.select(F.col("conv_id").alias("id"), F.col("turn").alias("place"), F.col("text").alias("body")))


# Every page asks for two of its own phrases, for words of its own in another order, or for a word that no page has.
_W = "regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}]+')"
ASKED = (
    "select job_id qid, case job_id % 3 when 0 then [array_to_string(w[6:8], ' '), array_to_string(w[10:11], ' ')] when 1 then [concat_ws(' ', w[9], w[6], w[12])] else [concat_ws(' ', w[6], 'zzqx')] end phrases from d"
)
PHRASES_SQL = (
    with_("v_postings") + f", t as (select job_id, {P._page_sql('description', None)} x from v_postings), d as (select job_id, {_W.format(x='x')} w from t), q0 as ({ASKED}), "
    f"q1 as (select qid, list_filter(list_transform(phrases, lambda p: {_W.format(x='p')}), lambda p: len(p) > 0) ps from q0), q as (select qid, list_filter(ps, lambda p, i: list_position(ps, p) = i) ps from q1), p as (select qid, unnest(range(1, len(ps) + 1)) k, unnest(ps) p from q), "
    "o as (select p.qid, p.k, d.job_id id, p.p, i from p join d on list_has_all(d.w, p.p), unnest(range(1, len(d.w) - len(p.p) + 2)) u(i) where d.w[i : i + len(p.p) - 1] = p.p), "
    "e as (select qid, id, count(distinct k) has, count(*) n, min(i - 1) filter (where k = 1) pos from o group by all), "
    "x as (select e.* from e join q using (qid) where has = len(ps)), "
    "b as (select qid, d.job_id id, list_distinct(flatten(ps)) ws, w from q join d on list_has_all(w, flatten(ps)) where len(ps) > 0 and qid not in (select qid from x)), "
    "c as (select qid, id, len(list_filter(w, lambda y: list_contains(ws, y))) n, list_min(list_transform(ws, lambda y: list_position(w, y))) - 1 pos from b), "
    "r as (select qid, id, n, pos, false broad from x union all select qid, id, n, pos, true from c), f as (select *, row_number() over (partition by qid order by n desc, id) rank from r qualify rank <= 5) "
)


def _looked_up(spark, d):
    pages = materialise(view(spark, d, "v_postings").select("job_id", X.page_text("description", None).alias("x")), "pages")
    w = index.words("x")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    one = lambda k: F.get(w, F.lit(k - 1))
    asked = F.when(F.col("job_id") % 3 == 0, F.array(part(6, 3), part(10, 2))).when(F.col("job_id") % 3 == 1, F.array(F.concat_ws(" ", one(9), one(6), one(12)))).otherwise(F.array(F.concat_ws(" ", one(6), F.lit("zzqx"))))
    return pages, index.search(index.build(pages, "job_id", "x"), pages.select(F.col("job_id").alias("qid"), asked.alias("phrases")))


@register(PHRASES_SQL + "select qid, cast(rank as int) as rank, id, cast(pos as int) as \"at\", cast(n as bigint) as n, broad from f")
def phrase_lookup(spark, d):
    return _looked_up(spark, d)[1]


@register(PHRASES_SQL + ", s as (select qid, rank, array_to_string(w[greatest(pos - 5, 0) + 1 : greatest(pos - 5, 0) + 30], ' ') body from f join d on d.job_id = f.id) select qid, left(string_agg(body, ' ' order by rank), 3000) as text from s group by qid")
def phrase_snippets(spark, d):
    pages, found = _looked_up(spark, d)
    return index.snippets(found, pages, "job_id", "x")


# Addresses near the borders of networks, in five text forms.
OCTETS = (
    "select id, k, case id % 9 when 0 then 10 when 1 then 127 when 2 then 169 when 3 then 172 when 4 then 192 when 5 then 198 when 6 then 203 when 7 then 100 else id % 256 end a, "
    "case id % 9 when 2 then 253 + id % 3 when 3 then 14 + id % 20 when 4 then id % 2 * 168 when 5 then 17 + id % 4 * 17 when 6 then id % 2 else id * 7 % 256 end b, case when id % 9 in (4, 5, 6) then id % 3 * 50 + 2 + id % 2 * 11 else id * 13 % 256 end c, id * 29 % 256 d "
    "from (select o_orderkey id, o_orderkey % 7 k from orders)"
)
ADDRESS_SQL = f"with o as ({OCTETS}), n as (select *, a * 16777216 + b * 65536 + c * 256 + d n from o) "
IN_SQL = (
    "(n // 16777216 in (0, 10, 127) or n // 65536 in (43518, 49320) or n // 1048576 = 2753 or n // 256 in (12582912, 12582914, 12989284, 13303921) and n not in (3221225481, 3221225482) or n // 131072 = 25353 or n // 268435456 >= 14)"
)


def _addresses(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    n = F.expr("cast(a * 16777216 + b * 65536 + c * 256 + d as bigint)")
    dotted = F.concat_ws(".", "a", "b", "c", "d")
    form = (
        F.when(F.col("k") == 0, dotted).when(F.col("k") == 1, F.concat(F.lit("[::FFFF:"), dotted, F.lit("]"))).when(F.col("k") == 2, n.cast("string")).when(F.col("k") == 3, F.concat(F.lit("0x"), F.hex(n)))
        .when(F.col("k") == 4, F.concat(F.lit("[64:ff9b::"), dotted, F.lit("]"))).when(F.col("k") == 5, F.concat(F.lit("[2a00:"), F.lower(F.hex("c")), F.lit("::"), F.hex("d"), F.lit("]"))).otherwise(F.concat(F.conv("a", 10, 8).alias("x"), F.lit(".host.org")))
    )
    return spark.sql(OCTETS).select("id", form.alias("host"))


@register(ADDRESS_SQL + f"select id, case when k < 4 then {IN_SQL} else k = 4 end as internal from n")
def address_ranges(spark, d):
    return _addresses(spark, d).select("id", filters.internal_url(F.concat(F.lit("http://u@"), "host", F.lit(":8080/x"))).alias("internal"))


NETS = "select distinct p_partkey * 40503 % 256 na, p_partkey * 193 % 256 nb, 4 + p_partkey % 17 len from part"


@register(
    ADDRESS_SQL + f", t as (select distinct len, (na * 16777216 + nb * 65536) net, na || '.' || nb || '.0.0/' || len network from ({NETS})), m as (select id, network, row_number() over (partition by id order by len desc, network) r from n join t on n.n >> (32 - len) = t.net >> (32 - len) where k < 4) "
    "select id, network from m where r = 1"
)
def address_networks(spark, d):
    spark.read.parquet(f"{d}/part.parquet").createOrReplaceTempView("part")
    nets = spark.sql(f"select concat(na, '.', nb, '.0.0/', len) network from ({NETS})")
    return addresses.matched(_addresses(spark, d), "host", nets, "id")


# --- runs and searches ---


@register(with_("v_runs") + f"select source, run_at, case when run_at < {P.RUN_END} - interval 10 day then 'old' when coalesce(error, '') <> '' then 'error' when raw_count > 0 then 'ok' else 'empty' end as status from v_runs")
def run_records(spark, d):
    runs = view(spark, d, "v_runs")
    cut = P._run_end() - F.make_interval(days=F.lit(10))
    before = runs.where(F.col("run_at") < cut).withColumn("status", F.lit("old"))
    return health.record(before, runs.where(F.col("run_at") >= cut)).select("source", "run_at", "status")


@register(
    with_("v_runs") + ", s as (select source, cast(sum(queries) as varchar) q, cast(cast(sum(raw_count) as bigint) as varchar) n, case when max(coalesce(error,'')) <> '' then 'error' when sum(raw_count) > 0 then 'ok' else 'empty' end st from v_runs group by source) "
    "select source, concat(rpad(source, 24, ' '), lpad(q, 6, ' '), lpad(n, 8, ' '), '  ', st) as line from s"
)
def run_lines(spark, d):
    return health.summary_lines(view(spark, d, "v_runs"))


def _planned_sql(source: str, tier: str | None, most: int | None) -> str:
    where = f"where tier = '{tier}'" if tier else ""
    limit = f"where place <= {most}" if most else ""
    return f"select '{source}' as source, query, place from (select query, cast(row_number() over (order by length(query) desc, query) as int) place from q {where}) {limit}"


@register(with_("v_parts") + ", q as (select concat('remote ', title, ' ', job_id) as query, case when job_id % 3 = 0 then 'broad' else 'specific' end tier from v_parts) " + " union all ".join(_planned_sql(*x) for x in V.SOURCE_QUERIES))
def planned_queries(spark, d):
    rows = view(spark, d, "v_parts").selectExpr("concat('remote ', title, ' ', job_id) as query", "case when job_id % 3 = 0 then 'broad' else 'specific' end as tier")
    return score.planned(rows)


@register(
    f"with b as ({readers.BASE}) select 'greenhouse / A' as source, count(distinct id // 400) as queries, count(*) as raw_count, cast(null as varchar) as error from b union all select 'lever / B', count(distinct id // 400), count(*), null from b "
    "union all select 'workday / C', 1, 0, 'TimeoutError' union all select 'ashby / D', 1, 0, 'unreadable' union all select 'other / E', 1, 0, 'no reader'"
)
def board_scan(spark, d):
    named = lambda name, ats: readers.payloads(spark, d, ats).selectExpr(f"'{name}' name", f"'{ats}' ats", "'x' slug", "cast(null as string) site", "payload", "cast(null as string) error")
    broken = spark.sql("select * from values ('C', 'Workday', 'x', 's', null, 'TimeoutError'), ('D', 'ashby', 'x', null, '<html>', null), ('E', 'other', 'x', null, '{}', '') as t(name, ats, slug, site, payload, error)")
    return boards.scan(named("A", "greenhouse").union(named("B", "lever")).union(broken))[1]


# Sixty boards of three kinds: short pages and totals with more behind them, refusals, failures.
PAGED = (
    "select *, case k when 0 then 'smartrecruiters' when 1 then 'workday' else 'jsearch' end kind, case k when 2 then n div 40 else 0 end query, case k when 0 then n div 100 * 100 when 1 then n div 20 * 20 else n % 40 div 10 + 1 end start from "
    "(select o_orderkey id, o_custkey % 60 no, o_custkey % 60 % 3 k, concat('b', o_custkey % 60) board, row_number() over (partition by o_custkey % 60 order by o_orderkey) - 1 n, count(*) over (partition by o_custkey % 60) total from orders)"
)
PAGED_SQL = "with p as (" + PAGED.replace(" div ", " // ") + "), failed as (select distinct board, case k when 0 then 'HTTP 500' else 'HTTP 401' end error from p where k = 0 and no % 15 = 0 and start = 100 or k = 1 and no % 5 = 0) "


def _paged_scan(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    rows = spark.sql(PAGED).where("not (k = 0 and no % 4 = 0 and start = 100 and n % 100 >= 60)")
    item = {
        "content": "named_struct('id', cast(id as string), 'name', concat('Job ', id))", "jobPostings": "named_struct('title', concat('Job ', id), 'externalPath', concat('/job/', id))",
        "data": "named_struct('job_title', concat('Job ', id), 'employer_name', board, 'job_apply_link', concat('https://j.org/', id))",
    }
    lists = {name: F.transform(F.array_sort(F.collect_list(F.expr(f"struct(n, {x} as x)"))), lambda e: e["x"]) for name, x in item.items()}
    grouped = rows.groupBy("no", "k", "board", "kind", "query", "start").agg(*[x.alias(name) for name, x in lists.items()], F.max("total").alias("own"))
    total = F.when(F.col("start") > 0, 0).otherwise(F.expr("if(no % 4 = 0, 45, own)"))
    json = F.when(F.col("k") == 0, F.to_json(F.struct("content"))).when(F.col("k") == 1, F.to_json(F.struct("jobPostings", total.alias("total")))).otherwise(F.to_json(F.struct("data")))
    status = F.expr(
        "case when k = 0 and no % 15 = 0 and start = 100 then 500 when k = 1 and no % 5 = 0 and start = 0 then 401 when k = 2 and no % 4 = 0 and query = 2 and start = 2 then 429 when k = 2 and no % 5 = 0 and query = 1 and start = 1 then 500 else 200 end"
    )
    pages = grouped.select("board", "kind", F.col("query").cast("int").alias("query"), F.col("start").cast("long").alias("start"), status.cast("int").alias("status"), json.alias("payload"))
    return paged.read(spark, paged.record(pages, "pages"), most=240, pages=3)


@register(
    PAGED_SQL + "select board as company, 'Job ' || id as title, case k when 0 then 'https://jobs.smartrecruiters.com/' || board || '/' || id when 1 then 'https://' || board || '.wd5.myworkdayjobs.com/External/job/' || id else 'https://j.org/' || id end as link, "
    "case k when 0 then 'SmartRecruiters' when 1 then 'Workday' else 'JSearch' end as source from p where board not in (select board from failed) and case k when 0 then n < 240 and (no % 4 <> 0 or n < 160) when 1 then n < case when no % 4 = 0 then 60 else 240 end "
    "else n % 40 < 30 and not (no % 4 = 0 and (query > 2 or query = 2 and start >= 2)) and not (no % 5 = 0 and query = 1 and start = 1) end"
)
def paged_boards(spark, d):
    return boards.paged(_paged_scan(spark, d)).select("company", "title", "link", "source")


@register(PAGED_SQL + "select board, error from failed")
def paged_failures(spark, d):
    return _paged_scan(spark, d).where("error is not null").select("board", "error")


# A run over all sources of the jobs, one that can't be made, one that fails on the way and an empty one.
def _watched(spark, d):
    jobs = view(spark, d, "v_jobs").select("id", "source", "link")
    names = [r["source"] for r in jobs.select("source").distinct().collect()]
    made = {n: (lambda n=n: jobs.where(F.col("source") == n)) for n in names}
    broken = {
        "Missing": lambda: jobs.where("no_such_column > 0"), "Failing": lambda: jobs.withColumn("link", F.when(F.col("id") % 100 == 50, F.raise_error(F.lit("page 3 is no page"))).otherwise(F.col("link"))),
        "Nothing": lambda: jobs.where("id < 0"),
    }
    return runs.run(spark, made | broken, {n: k for k, n in enumerate(sorted(names))})


@register(
    with_("v_jobs") + "select source, cast(row_number() over (order by source) - 1 as int) as queries, count(*) as raw_count, cast(null as varchar) as error from v_jobs group by source union all "
    "select 'Missing', 0, 0, 'AnalysisException' union all select 'Failing', 0, 0, 'page 3 is no page' union all select 'Nothing', 0, 0, null"
)
def watched_run(spark, d):
    told = F.when(F.contains("error", F.lit("page 3 is no page")), "page 3 is no page").otherwise(F.substring_index("error", ":", 1))
    return _watched(spark, d)[1].select("source", "queries", "raw_count", told.alias("error"))


@register(with_("v_jobs") + "select id, source, link from v_jobs")
def watched_rows(spark, d):
    return _watched(spark, d)[0]


# Two runs have seen the links of two thirds of the jobs; the batch has all of them, tracked, repeated or without a link.
@register(with_("v_jobs") + "select id from v_jobs where id % 3 = 0 or id % 10 = 9")
def ledger_unseen(spark, d):
    jobs = view(spark, d, "v_jobs")
    book = ledger.Ledger(spark, f"{work_folder(spark)}/millrace/ledger-{uuid.uuid4().hex}", buckets=16)
    seen = jobs.select(X.canonical_url("link").alias("link"), F.col("extracted_date").cast("timestamp").alias("at"), "id")
    for k in (1, 2):
        book.append(seen.where(F.col("id") % 3 == k).drop("id"))
    batch = jobs.withColumn("link", F.when(F.col("id") % 10 == 9, F.when(F.col("id") % 20 == 9, "")).otherwise(F.concat("link", F.lit("&gclid=x"))))
    return book.unseen(batch).select("id")


# Jobs by month, put in two batches; the second has new values of some; retention drops days but for what has a letter.
@register(
    with_("v_jobs") + f"select id, case when id % 4 = 1 then 'again' else source end as source from v_jobs where extracted_date >= {NOW} - interval 400 day or id % 97 = 0"
)
def dated_retention(spark, d):
    rows = view(spark, d, "v_jobs").select("id", "source", F.col("extracted_date").cast("timestamp").alias("extracted_date"))
    jobs = dated.DatedStore(spark, f"{work_folder(spark)}/millrace/jobs-{uuid.uuid4().hex}", "id long, source string, extracted_date timestamp", "month")
    jobs.put(rows.where("id % 4 < 3"))
    jobs.put(rows.where("id % 2 = 1").withColumn("source", F.when(F.col("id") % 4 == 1, "again").otherwise(F.col("source"))))
    jobs.retain(rows.where("id % 97 = 0").select(F.col("id").alias("job_id")), datetime.fromisoformat(AS_OF), 400)
    return jobs.rows().select("id", "source")


# --- edits of stored rows ---


@register(with_("v_jobs") + "select id from v_jobs where id % 3 <> 0")
def jobs_deleted(spark, d):
    jobs = view(spark, d, "v_jobs")
    return store.delete_jobs(jobs, jobs.where("id % 3 = 0").union(jobs.where("id % 6 = 0"))).select("id")


@register(with_("v_jobs") + "select id, case when id % 2 = 0 then link when id % 3 = 0 then 'found ' || id end as link from v_jobs")
def links_filled(spark, d):
    jobs = view(spark, d, "v_jobs")
    found = jobs.where("id % 3 = 0").select("id", F.concat(F.lit("found "), F.col("id").cast("string")).alias("link"))
    return store.fill_links(jobs.withColumn("link", F.when(F.col("id") % 2 == 0, F.col("link")).otherwise("")), found).select("id", "link")


@register(with_("v_jobs") + "select id, case when id % 4 = 0 then 'new' else company end as company from v_jobs")
def keys_replaced(spark, d):
    jobs = view(spark, d, "v_jobs").select("id", "company")
    return store.replace_by_key(jobs, jobs.where("id % 4 = 0").withColumn("company", F.lit("new")), "id")


@register(with_("v_jobs") + f"select id from v_jobs where extracted_date >= {NOW} - interval 1100 day")
def mails_retained(spark, d):
    rows = view(spark, d, "v_jobs").withColumnRenamed("extracted_date", "processed_date")
    return store.retained_mails(rows, P._at(), 1100).select("id")


# --- deduplication ---


@register(with_("v_jobs") + "select min(id) as id from v_jobs group by case when id % 3 = 0 then 'l' || (id % 50) else job_title || '|' || company end")
def dedup_by_link_or_name(spark, d):
    rows = view(spark, d, "v_jobs").withColumn("link", F.when(F.col("id") % 3 == 0, F.expr("'l' || (id % 50)"))).withColumnsRenamed({"job_title": "title"})
    return dedup.by_link_or_name(rows.withColumn("ord", F.col("id"))).select("id")


@register(with_("v_jobs") + ", r as (select id, case when id % 2 = 0 then upper(job_title) else job_title end t, company from v_jobs) select min(id) as id from r group by t, company")
def dedup_exact_names(spark, d):
    rows = view(spark, d, "v_jobs").withColumn("title", F.when(F.col("id") % 2 == 0, F.upper("job_title")).otherwise(F.col("job_title")))
    return dedup.by_name(rows.withColumn("ord", F.col("id"))).select("id")


@register(
    with_("v_jobs") + ", r as (select id, job_title, company, 'https://jobs.example.org/view/' || (id - id % 8) h from v_jobs), f as (select *, row_number() over (partition by h order by id) rn from r) "
    "select job_title as title, company, h as link, 'Example' as source from f where rn = 1"
)
def web_results_once(spark, d):
    results = view(spark, d, "v_jobs").selectExpr("id ord", "concat(company, ' hiring ', job_title) title", "concat('https://jobs.example.org/view/', id - id % 8, case when id % 2 = 0 then '?utm_source=x' else '' end) href", "'b' body")
    return boards.search_results(results).select("title", "company", "link", "source")


@register(with_("v_mail") + "select distinct message_id from v_mail where length(body) % 3 > 0")
def mails_unprocessed(spark, d):
    mails = view(spark, d, "v_mail")
    return dedup.unprocessed(mails.union(mails), mails.where("length(body) % 3 = 0 or body is null")).select("message_id")


# --- mails ---


@register(
    with_("v_jobs") + "select cast(id as varchar) as message_id, case when id % 3 = 0 then 'Subject ' || id else job_title end as title, case when id % 4 = 0 then 'Unknown' else company end as company, "
    "case when id % 5 = 0 then 'Oslo' else 'Remote' end as location, case when id % 5 = 0 then '10k' end as salary, 'https://board.example.org/jobs/' || id as link, 'Gmail Draft' as source from v_jobs"
)
def draft_postings(spark, d):
    body = (
        "concat_ws('\n', 'Saved today', case when id % 3 > 0 then concat('Title:  ', job_title, ' ') end, case when id % 4 > 0 then concat('Company: ', company) end, "
        "case when id % 5 = 0 then 'Location: Oslo\r\nPay: 10k' end, case when id % 2 = 0 then concat('Link: ', link) else concat('see ', link, ' for more') end, 'title: other')"
    )
    rows = view(spark, d, "v_jobs").selectExpr("cast(id as string) message_id", "concat(' Subject ', id) subject", f"case when id % 3 = 0 then replace({body}, '\ntitle: other', '') else {body} end body", "extracted_date date")
    return mail.draft_posting(rows).select("message_id", "title", "company", "location", "salary", "link", "source")


@register(
    with_("v_jobs") + f"select id from v_jobs where id % 4 = 0 and (id % 8 = 0 or id % 12 = 0) and id % 5 > 0 and extracted_date >= {NOW} - interval 1200 day"
)
def mail_candidates(spark, d):
    jobs = view(spark, d, "v_jobs").selectExpr(
        "id", "extracted_date", "case when id % 4 = 0 then 'Email / a@b.c' else source end source", "case when id % 8 = 0 then ' Applied via Email on Monday' when id % 12 = 0 then null else 'text' end description",
        "case when id % 5 = 0 then 50.0 when id % 3 = 0 then 0.0 end relevance_score",
    )
    return enrich.mail_candidates(jobs, P._at(), 1200).select("id")


# --- orders, digests and listings ---


@register(
    P.SCORED + f", j as (select *, {P._reason_sql(10)} as reject_reason from scored), r as (select job_id, ord, {P.FACTORED} s from j where reject_reason is null) select job_id, s as relevance_score, row_number() over (order by s desc, ord) - 1 as place from r"
)
def kept_order(spark, d):
    kept = score.judged(view(spark, d, "v_docs"), VARIANTS, P.MERGED, min_score=10).where("reject_reason is null")
    return boards.numbered(kept.select("job_id", "ord", "relevance_score"), [F.desc("relevance_score"), F.col("ord")], "place").select("job_id", "relevance_score", "place")


FEW_BOARDS = f"(not ({P.BOARD}) or id % 1500 = 0)"


@register(
    with_("v_jobs") + P._pool_sql(FEW_BOARDS, 400) + P._main_sql(V.DIGEST_SIZE)
    + f", n as (select count_if(pass = 'boards') b, count_if(pass = 'aggregators') a from d5 where slot is not null) select 'boards' as quota, {V.BOARD_SLOTS} - b as missing from n where b < {V.BOARD_SLOTS} union all select 'aggregators', {V.AGGREGATOR_SLOTS} - a from n where a < {V.AGGREGATOR_SLOTS}"
)
def digest_shortfall(spark, d):
    jobs = view(spark, d, "v_jobs").where(FEW_BOARDS)
    return digest.shortfall(digest.main_digest(jobs, P._sent(jobs)))


MAILED = "case when id % 10 = 0 then 'Email / ann@x.org' when id % 10 = 1 then 'Email' else source end"


@register(
    with_("v_jobs") + "select id, 'email' as origin, 'ann' as email_account, 'https://mail.google.com/mail/?authuser=ann@x.org#search/' || case when id % 20 = 0 then 'rfc822msgid:m' || id || '%20x@y' else replace(company, ' ', '+') || '+' || array_to_string(list_slice(string_split(job_title, ' '), 1, 3), '+') end as gmail_url "
    "from v_jobs where id % 10 = 0"
)
def dashboard_mails(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("source", F.expr(MAILED)).withColumn("source_message_id", F.expr("case when id % 20 = 0 then '<m' || id || ' x@y>' end"))
    return reports.listing(jobs, P._status(jobs), P._letters(jobs), P._at(), origin="email", inbox="ann").select("id", "origin", "email_account", "gmail_url")


@register(with_("v_jobs") + f"select id from v_jobs where id % 3 = 0 and {Q.industry('job_title', 'description')} = 'Other' and cast(extracted_date as date) = date '1996-01-02'")
def dashboard_filters(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("link", F.expr("case when id % 3 = 0 then 'https://www.linkedin.com/jobs/' || id else link end"))
    return reports.listing(jobs, P._status(jobs), P._letters(jobs), P._at(), date="1996-01-02", source="LinkedIn", industry="Other", sort="date").select("id")
