"""The catalogue of registered queries over the posting relations, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import markup
from millrace.functions import text as X
from millrace.functions import vocab as V
from millrace.operators import dedup, digest, enrich, filters, health, mail, reports, score, store, terms
from millrace.operators.score import Variant
from millrace.plans import readers
from millrace.plans import sql as Q
from millrace.plans.views import AS_OF, view, with_
from millrace.sources import boards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(readers.QUERIES)
ORACLE_SQL: dict[str, str] = dict(readers.ORACLE_SQL)
NOW = f"timestamp '{AS_OF}'"


def _at() -> Column:
    """The moment at which the reports are made."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def _over(spark: SparkSession, sf_dir: str, rows: str, *tables: str) -> DataFrame:
    """A subquery over given tables that Spark and DuckDB both read."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"select * from {rows}")


def register(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add


# A profile whose skills occur in the tables' invented prose.
VARIANTS = [
    Variant("CV_A", dict.fromkeys(["thand", "ingth", "onst", "eaed", "tionre", "blear", "wereth"], 1.0)),
    Variant("CV_B", dict.fromkeys(["eux", "tion", "ment", "elle", "lich"], 1.0)),
    Variant("CV_C", dict.fromkeys(["cion", "mente", "ando", "heit", "keit", "schaft", "ung", "que", "los", "der"], 1.0)),
]
MERGED = score.merged_skills(VARIANTS)


# --- links and text ---


@register(with_("v_postings") + f"select job_id, {Q.canonical_url('link')} as canonical from v_postings")
def canonical_url(spark, d):
    return view(spark, d, "v_postings").select("job_id", X.canonical_url("link").alias("canonical"))


@register(with_("v_postings") + f"select job_id, {Q.domain('link')} as domain, {Q.site_label('link', Q.q('JSearch'))} as label from v_postings")
def url_domain_label(spark, d):
    return view(spark, d, "v_postings").select("job_id", X.domain("link").alias("domain"), X.site_label("link").alias("label"))


@register(with_("v_postings") + f"select job_id, {Q.strip_html('description')} as plain from v_postings")
def strip_html(spark, d):
    return view(spark, d, "v_postings").select("job_id", X.strip_html("description").alias("plain"))


TITLE_SQL = "case job_id % 4 when 0 then title || ' (m/w/d) - Berlin' when 1 then 'Remote ' || title || ' [Full-time]' when 2 then upper(title) || ' Contract' else title end"
COMPANY_SQL = "case job_id % 3 when 0 then company || ' GmbH & Co. KG' when 1 then company || ', Inc. Group' else company end"


def _decorated(spark, d):
    return view(spark, d, "v_parts").select("job_id", "ord", F.expr(TITLE_SQL).alias("title"), F.expr(COMPANY_SQL).alias("company"))


DECORATED = with_("v_parts") + f", dec as (select job_id, ord, {TITLE_SQL} title, {COMPANY_SQL} company from v_parts) "
KEY_SQL = f"{Q.normal_title('title')} || '|' || {Q.normal_company('company')}"


@register(DECORATED + f"select job_id, {Q.normal_title('title')} as title_core, {Q.normal_company('company')} as company_core, {KEY_SQL} as dedup_key from dec")
def normalize_title_company(spark, d):
    return _decorated(spark, d).select(
        "job_id", X.normal_title("title").alias("title_core"), X.normal_company("company").alias("company_core"),
        X.dedup_key("title", "company").alias("dedup_key"),
    )


# File names of all parts, with and without prefixes, numbers and endings.
LABELS = (
    "(select p_partkey id, case p_partkey % 5 when 0 then concat('master_cv_', replace(p_name, ' ', '_'), '-', p_partkey, '.docx') when 1 then concat(p_partkey, '.pdf') when 2 then concat(p_name, ' ', p_partkey % 30) "
    "when 3 then concat('a<b:\"', p_name, '?|', p_partkey, '.t.x') else '' end name from part) t"
)
LABEL_SQL = "nullif(" + Q.collapse("regexp_replace(translate(regexp_replace(regexp_replace(name, '\\.[A-Za-z0-9]+$', ''), '^master_cv_', ''), '_-', '  '), '\\s*\\d+\\s*$', '')") + ", '')"


@register(f"select id, {LABEL_SQL} as label, translate(name, '<>:\"/\\|?*', '_________') as safe, case when length(name) > 8 then left(name, 8) || '…' else name end as short from {LABELS}")
def cv_labels(spark, d):
    return _over(spark, d, LABELS, "part").select(
        "id", X.cv_label("name", "master_cv_").alias("label"), X.safe_filename("name").alias("safe"),
        X.shortened("name", 8, "…").alias("short"),
    )


@register(
    "select o_orderkey as id, case when o_totalprice > 0 and o_totalprice * 2 > 0 and o_orderkey % 3 > 0 then 'USD ' || format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) || ' – ' || format('{:,}', cast(round_even(o_totalprice * 2, 0) as bigint)) "
    "else 'USD ' || format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) || '+' end as salary from orders"
)
def salary_text(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    high = F.when(F.col("o_orderkey") % 3 > 0, F.rint(F.col("o_totalprice") * 2))
    return o.select(F.col("o_orderkey").alias("id"), X.salary_range(F.rint("o_totalprice"), high, F.lit("USD")).alias("salary"))


@register("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props_scan(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# --- deduplication ---


@register(DECORATED + f"select job_id from (select job_id, row_number() over (partition by {KEY_SQL} order by ord) rn from dec) where rn = 1")
def dedup_exact_first_wins(spark, d):
    return dedup.exact(_decorated(spark, d)).select("job_id")


@register(with_("v_docs") + "select job_id from (select job_id, row_number() over (partition by lower(description), lower(lang) order by ord) rn from v_docs where description <> '' and lang <> '') where rn = 1")
def dedup_free_board(spark, d):
    return dedup.boards(view(spark, d, "v_docs"), "description", "lang").select("job_id")


@register(with_("v_postings") + "select job_id from (select job_id, link, row_number() over (partition by case when job_id % 5 = 0 then '' else company end order by ord) rn, job_id % 5 = 0 blank from v_postings) where rn = 1 or blank")
def dedup_by_link(spark, d):
    rows = view(spark, d, "v_postings").withColumn("link", F.when(F.col("job_id") % 5 == 0, "").otherwise(F.col("company")))
    return dedup.by_link(rows).select("job_id")


@register(with_("v_postings") + f", seen as (select distinct {Q.canonical_url('link')} l from v_postings where job_id % 2 = 0) select job_id from v_postings where {Q.canonical_url('link')} not in (select l from seen where l <> '')")
def seen_link_anti(spark, d):
    rows = view(spark, d, "v_postings")
    return dedup.unseen(rows, rows.where("job_id % 2 = 0").select(X.canonical_url("link").alias("link"))).select("job_id")


BLOCK = "lang || '/' || company"
FOLD_SQL = (
    "g as (select block, list({'o': ord, 't': toks} order by ord) l from t where len(toks) > 0 group by block), "
    f"f as (select list_reduce(l, lambda acc, x: case when len(list_filter(acc, lambda k: {Q.jaccard('k.t', 'x[1].t')} >= 0.85)) > 0 then acc else list_concat(acc, x) end) r from (select list_transform(l, lambda e: [e]) l from g)) "
)


@register(
    with_("v_docs") + f", t as (select ord, {BLOCK} block, {Q.tokens('title')} toks from v_docs), "
    + FOLD_SQL + "select unnest(r).o as job_id from f union all select ord from t where len(toks) = 0"
)
def near_duplicates(spark, d):
    rows = view(spark, d, "v_docs")
    return dedup.near_titles(rows, block=F.expr(BLOCK)).select("job_id")


@register(
    with_("v_docs") + f", u as (select ord, {BLOCK} block, list_sort({Q.tokens('title')}) toks from v_docs), t as (select min(ord) ord, block, toks from u where len(toks) > 0 group by block, toks) "
    f"select a.ord as a, b.ord as b, {Q.jaccard('a.toks', 'b.toks')} as similarity from t a join t b on a.block = b.block and a.ord < b.ord where {Q.jaccard('a.toks', 'b.toks')} >= 0.3"
)
def pairwise_title_jaccard(spark, d):
    rows = view(spark, d, "v_docs").withColumn("block", F.expr(BLOCK))
    return dedup.similar_pairs(rows, 0.3, block="block")


@register(with_("v_docs") + f", u as (select ord, {BLOCK} block, list_sort({Q.tokens('title')}) toks from v_docs) select ord as job_id, min(ord) over (partition by block, toks) as representative from u where len(toks) > 0")
def title_classes(spark, d):
    rows = view(spark, d, "v_docs").withColumn("block", F.expr(BLOCK))
    return dedup.title_classes(rows, block="block").select(F.col("ord").alias("job_id"), "representative")


@register(DECORATED + f"select max(job_id) as job_id from dec group by {KEY_SQL}")
def dedup_newest(spark, d):
    rows = _decorated(spark, d).withColumn("dedup_key", X.dedup_key("title", "company")).withColumnRenamed("job_id", "id")
    return dedup.newest(rows).select(F.col("id").alias("job_id"))


# --- rules ---

POSTED = (
    "(values (1,'Sales Engineer','We sponsor visas for remote work','Acme','https://acme.com/jobs/1','Berlin, DE','Web'),"
    "(2,'Backend Engineer','us only, green card','Foo','https://x.vercel.app/apply','Austin, TX','Web'),"
    "(3,'Vertriebsleiter','worldwide and cloud','Bar','','','Web'),(4,'Data Entry','registration fee via telegram','Zest Jobs','https://zest.io','Remote','Web'),"
    "(5,'Writer','see https://demo.netlify.app/jobs/2 now','Baz','https://baz.org','Lausanne','Web'),(6,'Welder','top secret clearance required','Qux','https://q.org','Oslo','Gmail Draft'),"
    "(7,'Nurse','no visa sponsorship','Clinic','https://c.org','usa','Web'),(8,'Leiter (m/w/d)','must be a citizen, work from anywhere','K','https://k.org','Paris','Web'),"
    "(9,'SDR','demo at https://demo.fly.dev/about only','L','https://l.victorytuitions.in/x','United States','Web')) as t(job_id, title, description, company, link, location, source)"
)
FIELDS = ["title", "description", "company", "link", "location", "source"]


FLAGS_SQL = (
    f"select job_id, {Q.dealbreaker()} as dealbreaker, {Q.geo()} as geo, {Q.blocked()} as blocked, {Q.scam()} as scam, {Q.us_located()} as us, {Q.us_factor()} as us_factor, "
    f"{Q.non_english()} as non_english, {Q.any_of(Q.lowered('title'), V.DEV_TITLES)} as dev, {Q.remote(*FIELDS)} as remote from "
)


@register(FLAGS_SQL + POSTED)
def posting_flags(spark, d):
    return _flags(spark.sql(f"select * from {POSTED}"))


def _flags(rows: DataFrame) -> DataFrame:
    return rows.select(
        "job_id", filters.dealbreaker().alias("dealbreaker"), filters.geo_restricted().alias("geo"), filters.blocked_source().alias("blocked"), filters.scam_risk().alias("scam"),
        filters.us_located().alias("us"), filters.us_factor().alias("us_factor"), filters.non_english_title().alias("non_english"), filters.dev_titled().alias("dev"), filters.remote(*FIELDS).alias("remote"),
    )


@register(with_("v_docs") + FLAGS_SQL + "v_docs")
def posting_flags_all(spark, d):
    return _flags(view(spark, d, "v_docs"))


@register(with_("v_postings") + f"select job_id, {Q.blocked()} as blocked, {Q.scam()} as scam from v_postings")
def blocked_and_scam(spark, d):
    return view(spark, d, "v_postings").select("job_id", filters.blocked_source().alias("blocked"), filters.scam_risk().alias("scam"))


def _score_sql() -> str:
    low, title, sector = Q.lowered("description", "title", "company"), "lower(coalesce(title,''))", Q.lowered("description", "company")
    shares = [Q.share(low, list(v.skills)) for v in VARIANTS]
    best = f"greatest({', '.join(shares)})"
    name = "case " + " ".join(f"when {s} = top then {Q.q(v.name)}" for s, v in zip([f"s{k}" for k in range(3)], VARIANTS, strict=True)) + " end"
    return (
        ", sh as (select *, " + ", ".join(f"{s} s{k}" for k, s in enumerate(shares)) + f", {best} top from src), "
        f"b1 as (select *, case when top > 0 and {Q.any_of(title, V.TITLE_BOOST)} then round_even(least(100.0::double, top * {V.TITLE_FACTOR}::double), 1) else top end t1 from sh), "
        f"b2 as (select *, case when t1 > 0 and {Q.any_of(sector, V.SECTOR_BOOST)} then round_even(least(100.0::double, t1 * {V.SECTOR_FACTOR}::double), 1) else t1 end t2, case when top > 0 then {name} end best_cv from b1), "
        f"scored as (select *, case when t2 > 0 then t2 else {Q.share(low, MERGED)} end base_score from b2) "
    )


def _reason_sql(min_score: float) -> str:
    free = f"(coalesce(source,'') not in {Q.in_list(V.SAVED_SOURCES)})"
    return (
        f"case when {Q.blocked()} then 'blocked_source' when {free} and {Q.dealbreaker()} then 'dealbreaker' when {free} and {Q.geo()} then 'geo_restricted' when {free} and {Q.non_english()} then 'non_english' "
        f"when {free} and base_score < {V.DEV_KEEP_SCORE} and {Q.any_of(Q.lowered('title'), V.DEV_TITLES)} then 'pure_programming' when {free} and base_score < {min_score} then 'below_min_score' end"
    )


TEXTS = ["title", "company", "description", "lang", "link", "location", "source"]
FACTOR_SQL = f"(case when source in {Q.in_list(V.SAVED_SOURCES)} then 1.0::double else {Q.us_factor()} * case when {Q.remote(*TEXTS)} then 1.0::double else {V.ON_SITE_FACTOR}::double end * case when {Q.scam()} then {V.SCAM_FACTOR}::double else 1.0::double end end)"
SCORED = with_("v_docs") + ", src as (select * from v_docs)" + _score_sql()


@register(SCORED + "select job_id, base_score as score, best_cv from scored")
def score_best_variant(spark, d):
    out = score.scored(view(spark, d, "v_docs"), VARIANTS, MERGED)
    return out.select("job_id", F.col("base_score").alias("score"), "best_cv")


@register(SCORED + f", j as (select *, {_reason_sql(40)} as reject_reason from scored) select job_id, base_score, best_cv, reject_reason, case when reject_reason is null then cast(round_even(base_score * {FACTOR_SQL}, 0) as int) end as relevance_score from j")
def score_and_reject(spark, d):
    out = score.judged(view(spark, d, "v_docs"), VARIANTS, MERGED, min_score=40)
    return out.select("job_id", "base_score", "best_cv", "reject_reason", "relevance_score")


@register(SCORED + f", j as (select {_reason_sql(40)} as reason from scored) select reason, count(*) as n from j where reason is not null group by reason")
def reject_summary(spark, d):
    return filters.reject_report(score.rejected(view(spark, d, "v_docs"), VARIANTS, MERGED, min_score=40))


TITLE_WORDS = "regexp_extract_all(lower(title), '[a-z]{5,}')"
TERMS_SQL = with_("v_docs") + f", low as (select job_id, lower(coalesce(description, '')) low from v_docs), terms as (select distinct term from (select unnest({TITLE_WORDS}) term from v_docs)) "


def _title_words(spark, d):
    return view(spark, d, "v_docs").select("company", F.explode(F.regexp_extract_all(F.lower(X.text("title")), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))


@register(TERMS_SQL + "select job_id, count(*) as n_terms, md5(string_agg(term, ' ' order by term)) as terms_md5 from low join terms on contains(low, term) group by job_id")
def skill_terms(spark, d):
    met = terms.found(view(spark, d, "v_docs"), _title_words(spark, d), "job_id", "description")
    return met.groupBy("job_id").agg(F.count("*").alias("n_terms"), F.md5(F.array_join(F.array_sort(F.collect_list("term")), " ").cast("binary")).alias("terms_md5"))


@register(
    TERMS_SQL + ", own as (select distinct coalesce(company, '') variant, term skill from (select company, unnest(" + TITLE_WORDS + ") term from v_docs) where length(term) >= 9), "
    "sizes as (select variant, count(*) size from own group by variant), syn as (select distinct skill base, skill term from own union select skill, left(skill, 7) from own), "
    "met as (select distinct job_id, base from low join syn on contains(low, term)), n as (select job_id, variant, count(*) n from met join own on base = skill group by all), "
    f"s as (select job_id, variant, round_even(least(100.0::double, n / least({float(V.SKILLS_COUNTED)}::double, size::double) * 100), 1) score from n join sizes using (variant)) "
    "select job_id, score, variant from s qualify row_number() over (partition by job_id order by score desc, variant) = 1"
)
def profile_scores(spark, d):
    """Profiles are a table: the longer title words of each source; a word's beginning is its synonym."""
    own = _title_words(spark, d).where("length(term) >= 9").select(X.text("company").alias("variant"), F.col("term").alias("skill")).distinct()
    places = own.select("variant").distinct().withColumn("place", F.dense_rank().over(Window.orderBy("variant")))
    synonyms = own.select("skill", F.left("skill", F.lit(7)).alias("term")).distinct()
    return terms.profile_scores(view(spark, d, "v_docs"), own.join(places, "variant"), synonyms, "job_id", "description", V.SKILLS_COUNTED)


SKILLS = ["Copper Wire", "antique brass", "tin"]


@register(with_("v_parts") + f"select job_id, (title <> '' and {Q.any_of('lower(title)', V.TITLE_BOOST + V.SECTOR_BOOST + sorted({t for s in SKILLS for t in s.lower().split() if len(t) > 2}))}) as worth from v_parts")
def title_prescreen(spark, d):
    return view(spark, d, "v_parts").select("job_id", filters.title_prescreen(SKILLS).alias("worth"))


# Five profiles: the first word of each part's name is a skill of one of them.
SKILL_ROWS = (
    "(select p_partkey % 5 variant_ord, p_partkey ord, case when p_partkey % 3 = 0 then upper(split_part(p_name, ' ', 1)) else split_part(p_name, ' ', 1) end skill, case when p_partkey % 7 = 0 then null else p_retailprice end weight from part) t"
)


@register(f"select skill, coalesce(weight, 0) as weight from (select *, row_number() over (partition by skill order by variant_ord, ord) rn from {SKILL_ROWS}) where rn = 1 order by coalesce(weight, 0) desc, variant_ord, ord limit 200")
def top_skills(spark, d):
    return score.top_skills(_over(spark, d, SKILL_ROWS, "part"), 200)


@register(
    f"with s as (select ord, skill from {SKILL_ROWS} where variant_ord = 1 and lower(skill) not in ('azure', 'red') and length(skill) > 3 order by ord limit 20), qs as (select 'remote ' || lower(skill) as query from s union select 'remote technical sales engineer') "
    "select query, cast(len(string_split(query, ' ')) as int) as n_words, case when len(string_split(query, ' ')) >= 3 then 'specific' else 'broad' end as tier from qs"
)
def search_queries(spark, d):
    rows = _over(spark, d, SKILL_ROWS, "part").where("variant_ord = 1").select("ord", "skill")
    return score.search_queries(rows, ["azure", "red"], packs=["remote technical sales engineer"])


@register(with_("v_jobs") + f"select id from v_jobs where extracted_date is null or extracted_date >= {NOW} - interval 400 day")
def recency_filter(spark, d):
    rows = view(spark, d, "v_jobs").withColumn("date_posted", F.lit("soon")).withColumn("extracted_date", F.col("extracted_date").cast("string"))
    return rows.where(filters.recent(400, F.lit(AS_OF).cast("timestamp"))).select("id")


@register(with_("v_parts") + ", p as (select job_id, job_id % 3 > 0 ok, coalesce(sum(cast(job_id % 3 > 0 as int)) over (order by ord rows between unbounded preceding and 1 preceding), 0) passed from v_parts) select job_id from p where passed >= 100 or ok")
def link_budget(spark, d):
    return filters.within_budget(view(spark, d, "v_parts"), F.col("job_id") % 3 > 0, 100).select("job_id")


# A probe of every page: statuses, redirects refused, bodies of expired postings.
PROBES = (
    "(select page_id id, case page_id % 7 when 0 then null when 1 then 404 when 2 then 405 when 3 then 403 when 4 then 301 else 200 end head_status, case page_id % 5 when 0 then null when 1 then 403 when 2 then 410 else 200 end get_status, "
    "concat(html, case page_id % 4 when 0 then '<b>This job has EXPIRED</b>' when 1 then 'Position has been filled' else '' end) body, case page_id % 13 when 0 then 'http://127.0.0.1/x' when 1 then '' else url end link from pages) t"
)


@register(
    f"select id, coalesce(not (head_status is null or head_status in (404, 410)) and (case when head_status >= 400 then get_status else coalesce(get_status, head_status) end) < 400 and not {Q.any_of('lower(body)', V.EXPIRED_PHRASES)}, false) as active, "
    f"not coalesce(link = '' or link = 'http://127.0.0.1/x' or get_status in (404, 410) or (get_status = 200 and {Q.any_of('lower(body)', V.EXPIRED_MARKERS)}), false) as live from {PROBES}"
)
def link_probes(spark, d):
    return _over(spark, d, PROBES, "pages").select("id", filters.link_active().alias("active"), filters.link_live().alias("live"))


# --- digests ---


def _sent(jobs: DataFrame) -> DataFrame:
    return jobs.where("already_sent").select(F.col("id").alias("job_id"))


BOARD, SAVED = f"source in {Q.in_list(V.BOARD_SOURCES)}", f"source in {Q.in_list(V.SAVED_SOURCES)}"
DEMOTED = Q.any_of("lower(source)", V.DEMOTED_SOURCES)


def _take_sql(n: int, name: str, who: str, slots: int, cap: int, limit: int, order: str) -> str:
    return (
        f", f{n} as (select *, slot is null and ({who}) free from d{n - 1}), g{n} as (select *, free and count(slot) over (partition by co) + sum(cast(free as int)) over (partition by co order by {order} rows unbounded preceding) <= {cap} fits, count(slot) over () used from f{n}), "
        f"h{n} as (select *, sum(cast(fits as int)) over (order by {order} rows unbounded preceding) turn from g{n}), "
        f"d{n} as (select id, company, source, relevance_score, place, co, case when fits and turn <= least({slots}, {limit} - used) then cast(used + turn as int) else slot end slot, case when fits and turn <= least({slots}, {limit} - used) then '{name}' else pass end pass from h{n})"
    )


def _pool_sql(where: str, most: int, sent: str = "already_sent") -> str:
    return (
        f", d0 as (select id, company, source, relevance_score, row_number() over (order by relevance_score desc, extracted_date desc, id) place, lower(trim(company)) co, cast(null as int) slot, cast(null as varchar) pass "
        f"from (select * from v_jobs where not ({sent}) and {where} order by relevance_score desc, extracted_date desc, id limit {most}))"
    )


def _main_sql(limit: int) -> str:
    fit, agg = f"relevance_score >= {V.DIGEST_SCORE}", f"not ({BOARD}) and not {DEMOTED}"
    return (
        _take_sql(1, "saved", SAVED, limit, limit, limit, "place") + _take_sql(
            2, "boards", f"{fit} and {BOARD}", V.BOARD_SLOTS, V.COMPANY_CAP, limit, "place",
        )
        + _take_sql(3, "aggregators", f"{fit} and {agg}", V.AGGREGATOR_SLOTS, V.COMPANY_CAP, limit, "place")
        + _take_sql(4, "wildcard", f"{fit} and ({BOARD} or ({agg}))", limit, V.COMPANY_CAP, limit, f"case when {BOARD} then 0 else 1 end, place")
        + _take_sql(5, "last_resort", f"{fit} and {DEMOTED}", limit, V.COMPANY_CAP, limit, "place")
    )


@register(with_("v_jobs") + _pool_sql("true", 400) + _main_sql(V.DIGEST_SIZE) + " select id, slot, pass from d5 where slot is not null")
def digest_main(spark, d):
    jobs = view(spark, d, "v_jobs")
    return digest.main_digest(jobs, _sent(jobs)).select("id", "slot", "pass")


@register(with_("v_jobs") + _pool_sql(f"{BOARD} and relevance_score >= {V.DIGEST_SCORE}", 200) + _take_sql(1, "direct", "true", V.DIRECT_SIZE, V.COMPANY_CAP, V.DIRECT_SIZE, "place") + " select id, slot, pass from d1 where slot is not null")
def digest_direct(spark, d):
    jobs = view(spark, d, "v_jobs")
    return digest.direct_digest(jobs, _sent(jobs)).select("id", "slot", "pass")


def _again(sql: str) -> str:
    """The same steps under other names."""
    return re.sub(r"\b([dfgh][0-9])\b", r"z\1", sql)


DIRECT_SQL = _pool_sql(f"{BOARD} and relevance_score >= {V.DIGEST_SCORE}", 200) + _take_sql(1, "direct", "true", V.DIRECT_SIZE, V.COMPANY_CAP, V.DIRECT_SIZE, "place")


@register(
    with_("v_jobs") + DIRECT_SQL + ", picked as (select id, slot, pass from d1 where slot is not null)" + _again(_pool_sql("id not in (select id from picked)", 400) + _main_sql(10))
    + " select id, slot, pass from picked union all select id, slot, pass from zd5 where slot is not null"
)
def digest_two_stage(spark, d):
    jobs = view(spark, d, "v_jobs")
    return digest.both_digests(jobs, _sent(jobs)).select("id", "slot", "pass")


@register(with_("v_jobs") + "select id from v_jobs where id % 5 <> 0 order by relevance_score desc, extracted_date desc, id limit 3")
def letters_topk(spark, d):
    jobs = view(spark, d, "v_jobs")
    return digest.letter_candidates(jobs, jobs.where("id % 5 = 0").select(F.col("id").alias("job_id")), 3).select("id")


ESC = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LINE_SQL = (
    f"concat('<b>', {ESC('j.job_title')}, '</b> · ', {ESC('j.company')}, ' · ', cast(round_even(coalesce(j.relevance_score, 0), 1) as varchar), '% · ', "
    f"{LABEL_SQL.replace('name', 'j.best_cv').replace('master_cv_', '')}, ' · ', {ESC('j.source')}, case when j.scam_risk then ' ⚠ check before applying' else '' end, chr(10), '<a href=\"', {ESC('j.link')}, '\">open</a>')"
)


@register(with_("v_jobs") + _pool_sql("true", 400) + _main_sql(V.DIGEST_SIZE) + f" select slot, {LINE_SQL} as line from d5 join v_jobs j using (id) where slot is not null")
def digest_lines(spark, d):
    jobs = view(spark, d, "v_jobs")
    return digest.rendered(digest.main_digest(jobs, _sent(jobs)))


# --- keyed state ---

STORE_COLS = "job_title, company, description, link, salary, source, extracted_date, relevance_score, best_cv, scam_risk"


def _keyed(spark, d):
    return view(spark, d, "v_jobs").withColumn("dedup_key", F.expr("concat(job_title, '|', cast(id % 500 as string))")).withColumn("ord", F.col("id"))


EMPTY_STORE = "dedup_key string, job_title string, company string, description string, link string, salary string, source string, extracted_date timestamp_ntz, relevance_score double, best_cv string, seen_count long, scam_risk boolean"


@register(
    with_("v_jobs") + ", k as (select *, concat(job_title, '|', cast(id % 500 as varchar)) dedup_key, case when extracted_date < timestamp '1998-01-01' then 0 else 1 end part from v_jobs), "
    "a as (select dedup_key, part, arg_min(company, id) company, count(*) n, max(extracted_date) dt, max(relevance_score) s, arg_max(best_cv, {'s': relevance_score, 'o': -id}) cv, max(scam_risk) scam from k group by 1, 2) "
    "select coalesce(o.dedup_key, n.dedup_key) as dedup_key, case when o.dedup_key is not null then o.company else n.company end as company, greatest(o.dt, n.dt) as extracted_date, greatest(o.s, n.s) as relevance_score, "
    "case when o.dedup_key is null or n.s > o.s then n.cv else o.cv end as best_cv, cast(coalesce(o.n, 0) + coalesce(n.n, 0) as bigint) as seen_count, greatest(o.scam, n.scam) as scam_risk "
    "from (select * from a where part = 0) o full join (select * from a where part = 1) n on o.dedup_key = n.dedup_key"
)
def job_upsert(spark, d):
    rows = _keyed(spark, d)
    early = F.col("extracted_date") < F.lit("1998-01-01").cast("timestamp_ntz")
    first = store.upsert(spark.createDataFrame([], EMPTY_STORE), rows.where(early))
    return store.upsert(first, rows.where(~early)).select(
        "dedup_key", "company", "extracted_date", "relevance_score", "best_cv", "seen_count", "scam_risk",
    )


@register(with_("v_jobs") + "select company as link, min(extracted_date) as first_seen, max(extracted_date) as last_seen from v_jobs group by 1")
def link_seen_merge(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("company").alias("link"), F.col("extracted_date").alias("at"), "id")
    old = store.touch_links(spark.createDataFrame([], "link string, first_seen timestamp_ntz, last_seen timestamp_ntz"), rows.where("id % 2 = 0"))
    return store.touch_links(old, rows.where("id % 2 = 1"))


@register(
    with_("v_jobs") + ", e as (select company, status, extracted_date ts, id, row_number() over (partition by company order by extracted_date, status) rn from v_jobs), "
    "w as (select *, count(*) filter (status = 'rejected') over (partition by company) rej, min(rn) filter (status = 'interviewing') over (partition by company) iv, min(rn) filter (status = 'applied') over (partition by company) ap from e) "
    "select company as job_id, case when max(rej) > 0 then 'rejected' when max(iv) is not null then 'interviewing' else 'applied' end as status, max(ts) as updated_date from w group by 1"
)
def status_fold(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("company").alias("job_id"), F.col("extracted_date").alias("ts"), "status")
    return store.fold_status(
        spark.createDataFrame([], "job_id string, status string, updated_date timestamp_ntz"), rows,
    ).select("job_id", "status", "updated_date")


@register(with_("v_jobs") + "select company as job_id, arg_max(status, {'t': extracted_date, 's': status}) as status from v_jobs group by 1")
def status_overwrite(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("company").alias("job_id"), F.col("extracted_date").alias("ts"), "status")
    return store.set_status(spark.createDataFrame([], "job_id string, status string, updated_date timestamp_ntz"), rows).select("job_id", "status")


@register(with_("v_jobs") + f"select id from v_jobs where extracted_date >= {NOW} - interval 300 day or id % 9 = 0")
def retention(spark, d):
    jobs = view(spark, d, "v_jobs")
    return store.retained(jobs, jobs.where("id % 9 = 0").select(F.col("id").alias("job_id")), _at(), 300).select("id")


@register(with_("v_jobs") + "select id as job_id from v_jobs where already_sent and id % 2 = 0")
def ledger_purge(spark, d):
    jobs = view(spark, d, "v_jobs")
    return store.without_orphans(_sent(jobs), jobs.where("id % 2 = 0"))


@register(with_("v_jobs") + "select company as job_id, min(extracted_date) as sent_date from v_jobs group by 1")
def sent_ledger(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("company").alias("job_id"), F.col("extracted_date").alias("sent_date"))
    return store.mark_sent(rows.limit(0), rows)


@register(with_("v_jobs") + "select id, case when id % 4 = 0 and relevance_score < 20 then 55.5 else case when relevance_score < 20 then 0 else relevance_score end end as relevance_score, case when id % 4 = 0 then 'found text' else description end as description from v_jobs")
def email_backfill(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("relevance_score", F.when(F.col("relevance_score") < 20, 0.0).otherwise(F.col("relevance_score")))
    found = jobs.where("id % 4 = 0").select("id", F.lit(55.5).alias("score"), F.lit("X").alias("cv"), F.lit("found text").alias("description"))
    return store.fill_scores(jobs, found).select("id", "relevance_score", "description")


@register(
    with_("v_jobs") + ", c as (select *, row_number() over (order by id) rn from v_jobs where source = 'Workday' and id % 2 = 0) "
    "select j.id, case when c.rn <= 60 and c.id % 3 = 0 then 'detail of ' || j.id else '' end as description, coalesce(c.rn > 60, false) as over_budget from v_jobs j left join c on j.id = c.id"
)
def enrich_join(spark, d):
    jobs = view(spark, d, "v_jobs").withColumn("description", F.lit("")).withColumn("ord", F.col("id"))
    found = jobs.where("id % 3 = 0").select("link", F.concat(F.lit("detail of "), F.col("id").cast("string")).alias("description"))
    return enrich.details(jobs, found, F.col("id") % 2 == 0).select("id", "description", "over_budget")


# --- reports ---

STATUS_SQL = "st as (select id job_id, status, extracted_date updated_date from v_jobs where id % 2 = 0)"


def _status(jobs):
    return jobs.where("id % 2 = 0").select(F.col("id").alias("job_id"), "status", F.col("extracted_date").alias("updated_date"))


def _letters(jobs):
    return jobs.where("id % 5 = 0").select(F.col("id").alias("job_id"))


WEEK = f"cast(extracted_date as date) >= cast({NOW} as date) - 7"


@register(with_("v_jobs") + f"select status, count(*) as n from v_jobs where id % 2 = 0 and {WEEK} group by status")
def weekly_status(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.weekly_status(jobs, _status(jobs), _at())


@register(with_("v_jobs") + f"select source, count(*) as n from v_jobs where {WEEK} group by source")
def weekly_sources(spark, d):
    return reports.weekly_sources(view(spark, d, "v_jobs"), _at())


@register(with_("v_jobs") + f"select id, job_title as title, company, relevance_score from v_jobs where {WEEK} order by relevance_score desc, id limit 5")
def weekly_top(spark, d):
    return reports.weekly_top(view(spark, d, "v_jobs"), _at())


@register(with_("v_jobs") + f"select count(*) as jobs_found, round_even(coalesce(avg(relevance_score), 0), 1) as avg_score, round_even(coalesce(max(relevance_score), 0), 1) as max_score, count_if(id % 5 = 0)::bigint as cover_letters from v_jobs where {WEEK}")
def weekly_scores(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.weekly_numbers(jobs, _letters(jobs), _at())


@register(
    with_("v_jobs") + f", n as (select count(*) jobs, round_even(coalesce(avg(relevance_score), 0), 1) a, round_even(coalesce(max(relevance_score), 0), 1) m from v_jobs where {WEEK}), "
    f"t as (select * from v_jobs where {WEEK} order by relevance_score desc, id limit 5), "
    "l as (select string_agg(concat('• ', case when length(job_title) > 45 then left(job_title, 45) || '…' else job_title end, ' · ', company, ' · ', cast(round_even(relevance_score, 1) as varchar), '%'), chr(10) order by relevance_score desc, id) lines from t) "
    "select concat('Week: ', jobs, ' jobs, average ', a, '%, best ', m, '%', chr(10), lines) as message from n, l"
)
def weekly_message(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.weekly_message(reports.weekly_numbers(jobs, _letters(jobs), _at()), reports.weekly_top(jobs, _at()))


@register(with_("v_jobs") + "select count(*) as total_jobs, count(distinct source) as sources, round_even(coalesce(avg(relevance_score), 0), 1) as avg_score, round_even(coalesce(max(relevance_score), 0), 1) as max_score from v_jobs")
def stats(spark, d):
    return reports.stats(view(spark, d, "v_jobs"))


@register(with_("v_jobs") + f", {STATUS_SQL} select count_if(status = 'applied')::bigint as applied, count_if(status = 'interviewing')::bigint as interviewing, count_if(status = 'rejected')::bigint as rejected, (select count(*) from v_jobs where id % 5 = 0) as cover_letters, (select max(extracted_date) from v_jobs) as last_sync from st")
def status_counts(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.status_counts(_status(jobs), _letters(jobs), jobs)


@register(with_("v_jobs") + f"select distinct 'source' as facet, {Q.site_label('link', Q.q('JSearch'))} as value from v_jobs union select distinct 'date', cast(cast(extracted_date as date) as varchar) from v_jobs")
def facets(spark, d):
    return reports.facets(view(spark, d, "v_jobs"))


@register(with_("v_jobs") + f", {STATUS_SQL} select id, job_title, company, link, salary, source, extracted_date, relevance_score, best_cv, seen_count, coalesce(st.status, 'none') as status from v_jobs left join st on st.job_id = id")
def csv_export(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.exported(jobs, _status(jobs))


@register(
    with_("v_jobs") + f", {STATUS_SQL} select id, job_title as title, company, {Q.site_label('link', 'source')} as source, cast(extracted_date as date) as date, round_even(relevance_score, 1) as score, {Q.industry('job_title', 'description')} as industry, seen_count, seen_count > 1 as relisted, "
    f"id % 5 = 0 as has_cover_letter, coalesce(st.status, 'none') as apply_status, cast(date_diff('day', cast(extracted_date as date), cast({NOW} as date)) as int) as days_old from v_jobs left join st on st.job_id = id where relevance_score >= 50"
)
def dashboard_listing(spark, d):
    jobs = view(spark, d, "v_jobs")
    out = reports.listing(jobs, _status(jobs), _letters(jobs), _at(), min_score=50)
    return out.select(
        "id", "title", "company", "source", "date", "score", "industry", "seen_count", "relisted", "has_cover_letter", "apply_status",
        "days_old",
    )


@register(with_("v_docs") + f"select job_id, {Q.industry('title', 'description')} as industry from v_docs")
def industry(spark, d):
    return view(spark, d, "v_docs").select("job_id", X.industry("title", "description").alias("industry"))


SIMILAR_SQL = (
    with_("v_jobs") + ", w as (select id seed, unnest(list_distinct(list_filter(list_transform(string_split(job_title, ' '), lambda x: lower(x)), lambda x: length(x) > 3 and x not in "
    + Q.in_list(reports.STOP_WORDS) + "))) word from v_jobs where {seeds}), m as (select distinct seed, j.id, relevance_score from w join v_jobs j on contains(lower(job_title), word) and j.id <> seed) "
    "select seed, id, relevance_score as score, place from (select *, cast(row_number() over (partition by seed order by relevance_score desc, id) as int) place from m) where place <= 8"
)


@register(SIMILAR_SQL.format(seeds="id in (1, 2, 3)"))
def similar_jobs(spark, d):
    jobs = view(spark, d, "v_jobs")
    return reports.similar(jobs, jobs.where("id in (1, 2, 3)"))


@register(SIMILAR_SQL.format(seeds="id % 100 = 0"))
def similar_jobs_all(spark, d):
    """The whole search: each row whose id is divisible by 100 asks."""
    jobs = view(spark, d, "v_jobs")
    return reports.similar(jobs, jobs.where("id % 100 = 0"))


# --- source health ---

RUN_END = "timestamp '2024-01-31 00:00:00'"


def _run_end() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


@register(with_("v_runs") + ", r as (select *, row_number() over (partition by source order by run_at desc) rn from v_runs) select source, arg_min(error, rn) filter (error is not null and error <> '') as last_error from r where rn <= 3 group by source having count(*) = 3 and max(raw_count) = 0")
def stale_sources(spark, d):
    return health.stale(view(spark, d, "v_runs"))


@register(
    with_("v_runs") + f", r as (select *, row_number() over (partition by source order by run_at desc) rn from v_runs where run_at < {RUN_END} - interval 10 day), s as (select source from r where rn <= 3 group by source having count(*) = 3 and max(raw_count) = 0) "
    f"select source from s where source in (select source from v_runs where run_at >= {RUN_END} - interval 10 day and raw_count > 0)"
)
def recovered_sources(spark, d):
    runs = view(spark, d, "v_runs")
    cut = _run_end() - F.make_interval(days=F.lit(10))
    return health.recovered(runs.where(F.col("run_at") < cut), runs.where(F.col("run_at") >= cut))


@register(with_("v_runs") + f"select source, date_diff('day', max(case when raw_count > 0 then cast(run_at as timestamp) end), {RUN_END}) as days from v_runs group by source")
def days_since(spark, d):
    return health.days_since(view(spark, d, "v_runs"), _run_end())


@register(with_("v_runs") + f"select source, cast(sum(raw_count) as bigint) as total, count(*) as n_runs from v_runs where run_at >= {RUN_END} - interval 7 day group by source")
def yield_by_source(spark, d):
    return health.yield_by_source(view(spark, d, "v_runs"), _run_end(), 7)


@register(
    with_("v_runs") + ", b as (select source, sum(raw_count) n from v_runs group by source), t as (select sum(n) total, count(*) k, count_if(n = 0) e, max(n) m from b) "
    "select cast(total as bigint) as total, k as n_sources, e::bigint as n_empty, (select max(source) from b where n = m) as largest, m / total as share, m / total >= 0.9 and k > 1 as warning from t"
)
def concentration(spark, d):
    return health.concentration(view(spark, d, "v_runs"))


@register(with_("v_runs") + "select source, cast(sum(queries) as bigint) as queries, cast(sum(raw_count) as bigint) as raw_count, case when max(coalesce(error,'')) <> '' then 'error' when sum(raw_count) > 0 then 'ok' else 'empty' end as status from v_runs group by source")
def source_summary(spark, d):
    return health.summary(view(spark, d, "v_runs")).drop("duration_s")


# --- mail ---


@register(
    with_("v_mail") + f"select message_id, (not ({Q.any_of('lower(sender)', V.DROPPED_SENDERS)} or {Q.any_of('lower(subject)', V.DROPPED_SUBJECTS)}) and ({Q.any_of('lower(subject)', V.APPLICATION_WORDS)} or {Q.any_of('lower(left(body, 2000))', V.APPLICATION_WORDS)})) as gate, "
    f"({Q.any_of('lower(subject)', V.REJECTED_SUBJECTS)} or {Q.any_of('lower(left(body, 2000))', V.REJECTED_BODIES)}) as rejection from v_mail"
)
def mail_gate(spark, d):
    s, b, f = F.col("subject"), F.col("body"), F.col("sender")
    return view(spark, d, "v_mail").select("message_id", mail.gate(s, b, f).alias("gate"), mail.is_rejection(s, b).alias("rejection"))


MAILS = (
    "(values ('m1','You applied to Sales Engineer at Acme Fluid','Your application was submitted.','LinkedIn <jobs@linkedin.com>'),"
    "('m2','Thank you for applying to Initech - Process Engineer','We received your application','Initech Careers <no-reply@initech.com>'),"
    "('m3','Your application was sent to Globex','application sent to Globex Field Engineer Globex Berlin','LinkedIn <jobs-noreply@linkedin.com>'),"
    "('m4','Update on your application','We regret to inform you that your application for the Valve Specialist position at Umbra Systems. was unsuccessful','Umbra Hiring Team <hr@umbra.io>'),"
    "('m5','10 new jobs for you','apply now','x <a@b.com>'),('m6','Lunch?','see you','Bob Doe <bob@doe.net>'),"
    "('m7','Application Received! Technical Writer','thanks','Jobot <no@jobot.com>')) as t(message_id, subject, body, sender)"
)


@register(
    "select * from (values ('m1','Sales Engineer','Acme Fluid','applied'),('m2','Process Engineer','Initech','applied'),('m3','Field Engineer','Globex','applied'),"
    "('m4','Valve Specialist','Umbra Systems','rejected'),('m5',null,null,null),('m6',null,null,null),('m7','Technical Writer','Jobot','applied')) as t(message_id, title, company, status)"
)
def mail_parse(spark, d):
    return mail.parsed(spark.sql(f"select * from {MAILS}")).select("message_id", "title", "company", "status")


@register()
def mail_parse_all(spark, d):
    return mail.parsed(view(spark, d, "v_mail")).select("message_id", "title", "company", "status")


# --- sources ---


@register("select 'Pump & Valve Engineer' as title, 'Acme' as company, 'We build pumps.' as description, 'https://boards.example.org/jobs/1' as link, 'Berlin' as location union all select 'Writer', 'Acme', '', 'https://boards.example.org/jobs/2?id=7', 'Not stated'")
def greenhouse_scan(spark, d):
    doc = """{"jobs": [{"title": "Pump &amp; Valve  Engineer", "absolute_url": "https://Boards.example.org/jobs/1/?utm_source=x", "content": "&lt;p&gt;We build&lt;/p&gt; pumps.", "location": {"name": "Berlin"}}, {"title": "Writer", "absolute_url": "https://boards.example.org/jobs/2?id=7&gh_src=a#f", "content": null, "location": null}]}"""
    rows = spark.createDataFrame([(doc,), ("{}",), ('{"jobs": []}',)], "payload string")
    out = boards.greenhouse(rows, "Acme")
    return out.select(X.unescaped(F.col("title")).alias("title"), "company", "description", "link", "location")


FEEDS = {
    "lever": '[{"text": "Valve Lead", "descriptionPlain": "", "description": "<b>Own</b> valves", "hostedUrl": "https://x.org/1?utm_medium=a", "categories": {"location": "Oslo", "commitment": "Full-time"}}]',
    "ashby": '{"jobs": [{"title": "Ops", "descriptionPlain": "run", "jobUrl": "https://x.org/2", "location": "", "publishedAt": "2024-01-01", "compensation": {"summary": "10k"}}]}',
}


@register(
    "select 'Valve Lead' as title, 'Lever' as source, 'Own valves' as description, 'https://x.org/1' as link, 'Oslo' as location, 'Full-time' as salary, cast(null as varchar) as date_posted "
    "union all select 'Ops', 'Ashby', 'run', 'https://x.org/2', 'Not stated', '10k', '2024-01-01'"
)
def board_union(spark, d):
    frame = lambda name: spark.createDataFrame([(FEEDS[name],)], "payload string")
    out = boards.union_of([boards.lever(frame("lever"), "Co"), boards.ashby(frame("ashby"), "Co")])
    return out.select("title", "source", "description", "link", "location", "salary", "date_posted")


COMPANIES = (
    "(select c_name name, case c_custkey % 9 when 0 then 'greenhouse' when 1 then 'Workday' when 2 then 'unknown' when 3 then 'LEVER' when 4 then 'successfactors' when 5 then null when 6 then '' when 7 then 'ashby' else 'smart recruiters' end ats, "
    "case when c_custkey % 5 = 0 then '' when c_custkey % 11 = 0 then null else concat('s', c_custkey) end slug from customer) t"
)


@register(f"select name, ats, slug from {COMPANIES} where lower(ats) in {Q.in_list([*boards.READERS, 'successfactors'])} and coalesce(slug, '') <> ''")
def company_config(spark, d):
    return boards.companies(_over(spark, d, COMPANIES, "customer"))


RESULTS = (
    "(values ('Acme hiring Pump Engineer in Oslo | LinkedIn','https://www.linkedin.com/jobs/view/1','b1'),('Process Engineer at Foo','https://boards.greenhouse.io/foo/jobs/2','b2'),"
    "('Jobs near you','https://x.org/search?q=a','b3'),('Writer - Bar','https://careers.bar.com/writer','b4')) as t(title, href, body)"
)


@register("select * from (values ('Pump Engineer','Acme','LinkedIn'),('Process Engineer','Foo','Greenhouse'),('Writer','Bar','Careers')) as t(title, company, source)")
def web_results(spark, d):
    return boards.search_results(spark.sql(f"select * from {RESULTS}")).select("title", "company", "source")


# --- look-ups and ledgers ---


@register(
    with_("v_jobs") + ", m as (select id mid, case when id % 2 = 0 then job_title else 'New' end title, case when id % 2 = 0 then upper(company) else company end company, case when id % 3 = 0 then link else '' end link from v_jobs), "
    "byn as (select lower(job_title) t, lower(company) c, min(id) a from v_jobs group by 1, 2), byl as (select link, min(id) b from v_jobs group by 1) "
    "select mid, coalesce(a, b) as job_id from m left join byn on lower(m.title) = t and lower(m.company) = c left join byl on m.link = byl.link"
)
def mail_match(spark, d):
    jobs = view(spark, d, "v_jobs")
    even = F.col("id") % 2 == 0
    mails = jobs.select(
        F.col("id").alias("mid"), F.when(
            even, F.col("job_title"),
        ).otherwise("New").alias("title"), F.when(even, F.upper("company")).otherwise(F.col("company")).alias("company"),
        F.when(F.col("id") % 3 == 0, F.col("link")).otherwise("").alias("link"),
    )
    return enrich.matched(mails, jobs).select("mid", "job_id")


@register(
    with_("v_docs") + "select job_id as id, case when length(description) > 800 and job_id % 2 = 0 then 'page' when length(description) > 300 then 'search' else 'title' end as text_from, "
    "case when length(description) > 800 and job_id % 2 = 0 then left(description, 3000) when length(description) > 300 then left(description, 3000) else title end as text from v_docs"
)
def text_fallback(spark, d):
    rows = view(spark, d, "v_docs").select(F.col("job_id").alias("id"), F.col("title").alias("job_title"), "description")
    text = F.col("description").alias("text")
    page = rows.where("length(description) > 800 and id % 2 = 0").select("id", text)
    search = rows.where("length(description) > 300").select("id", text)
    return enrich.first_found(rows.drop("description"), [("page", page), ("search", search)]).select("id", "text_from", "text")


@register(DECORATED + f", k as (select job_id id, case when job_id % 2 = 0 then {KEY_SQL} else 'odd|' || (job_id % 97) end dedup_key from dec) select max(id) as id, dedup_key from k group by dedup_key")
def migration(spark, d):
    rows = _decorated(spark, d).withColumnsRenamed({"job_id": "id", "title": "job_title"})
    rows = rows.withColumn("dedup_key", F.when(F.col("id") % 2 == 1, F.concat(F.lit("odd|"), (F.col("id") % 97).cast("string"))))
    return store.migrated(rows).select("id", "dedup_key")


@register(with_("v_jobs") + "select distinct company, best_cv as selected_cv from v_jobs")
def letters_ledger(spark, d):
    rows = view(spark, d, "v_jobs").select(F.col("company").alias("job_id"), F.col("best_cv").alias("selected_cv"), "id")
    old = store.add_letters(rows.limit(0), rows.where("id % 2 = 0"))
    return store.add_letters(old, rows.where("id % 2 = 1")).select(F.col("job_id").alias("company"), "selected_cv")


@register(with_("v_postings") + "select job_id, (length(link) > 0 and not regexp_matches(lower(link), '^https?://[^/?#]')) or link = '' as internal from v_postings")
def internal_links(spark, d):
    return view(spark, d, "v_postings").select("job_id", filters.internal_url("link").alias("internal"))


@register("select p_partkey as id, cast(least(5, (7 - p_partkey % 7) % 7) as int) as n_hops, cast(p_partkey + least(5, (7 - p_partkey % 7) % 7) as bigint) as final from part where p_partkey <= 500")
def redirect_chain(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").where("p_partkey <= 500").select(F.col("p_partkey").cast("string").alias("link"))
    hops = spark.range(1, 600).where("id % 7 <> 0").select(F.col("id").cast("string").alias("link"), (F.col("id") + 1).cast("string").alias("to"))
    out = enrich.followed(rows, hops)
    return out.select(F.col("link").cast("long").alias("id"), "n_hops", F.col("final").cast("long").alias("final"))


@register(
    "with p as (select p_partkey k, max(p_partkey) over () top from part), n as (select k, least(5, (7 - k % 7) % 7, top + 1 - k) h from p) "
    "select k as id, cast(h as int) as n_hops, cast(k + h as bigint) as final from n"
)
def redirect_chain_all(spark, d):
    """Over the whole part table: each key that 7 doesn't divide leads to the next one."""
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("link"))
    hops = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 7 <> 0")
    hops = hops.select(F.col("p_partkey").cast("string").alias("link"), (F.col("p_partkey") + 1).cast("string").alias("to"))
    out = enrich.followed(rows, hops)
    return out.select(F.col("link").cast("long").alias("id"), "n_hops", F.col("final").cast("long").alias("final"))


def _page_sql(x: str, limit: int | None = 3000) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg", "form"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    return Q.strip_html(x) if limit is None else f"left({Q.strip_html(x)}, {limit})"


@register(with_("v_postings") + f"select job_id, {_page_sql('description')} as text from v_postings")
def page_text(spark, d):
    return view(spark, d, "v_postings").select("job_id", X.page_text("description").alias("text"))


# Pages in other hands' templates: containers of one tag name within each other, a first match that is too short, hosts that can't be read.
TEMPLATES = (
    "select page_id, case page_id % 7 when 0 then 'https://acme.MyWorkday.com/x' when 6 then '' else url end url, case page_id % 5 "
    "when 1 then concat('<div id=\"a\"><div class=\"wide job-description x\"><div><div>', inner_, '</div></div><div>tail of ', page_id, '</div></div><div>after</div></div>') "
    "when 2 then concat('<div class=\"posting-body\"><b>short</b></div><main><p>head</p><article><div>', inner_, '</div></article></main>') "
    "when 3 then concat('<section class=\"acme-jobDescriptionBox\"><section>', inner_, '</section><nav>no</nav><section>end</section></section><section>after</section>') "
    "when 4 then concat('<div id=\"content\"><div><div class=\"section\">', inner_, '</div></div></div>') else html end html, inner_ from (select page_id, url, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) inner_ from pages)"
)


@register(
    f"with t as ({TEMPLATES}), a as (select page_id, url, page_id % 5 k, {Q.strip_html('inner_')} a from t), "
    "b as (select page_id, url, case k when 1 then trim(a || ' tail of ' || page_id) when 3 then trim(a || ' end') when 2 then case when length(a) > 150 then a else trim('head ' || a) end else a end x from a) "
    "select page_id, case when url <> '' and not contains(lower(url), 'workday.com') and length(x) > 150 then left(x, 3000) end as text from b"
)
def scraped_pages(spark, d):
    spark.read.parquet(f"{d}/pages.parquet").createOrReplaceTempView("pages")
    return spark.sql(TEMPLATES).select("page_id", enrich.scraped("html", "url").alias("text"))


@register(
    "with i as (select page_id, unnest(regexp_extract_all(html, '<li>(<a href=\"[^\"]*\">[^<]*</a>)</li>', 1)) c from pages) "
    "select page_id, regexp_extract(c, 'href=\"([^\"]*)\"', 1) as link, trim(regexp_extract(c, '>([^<]*)<', 1)) as name, count(*) as n from i group by all"
)
def page_links(spark, d):
    """The records of all list items, within lists within list items."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    nested = F.concat(F.lit("<ul><li class=outer><b>menu</b>"), F.col("html"), F.lit("</li></ul>"))
    rows = pages.select("page_id", F.inline(markup.records(nested, "li li", {"name": ("a", None), "link": ("a[href]", "href")})))
    return rows.groupBy("page_id", "link", "name").agg(F.count("*").alias("n"))


@register(
    with_("v_jobs") + "select id, best_cv as selected_cv, concat('Dear hiring team at ', company, ',', chr(10), chr(10), 'I am applying for the position of ', job_title, '. ', "
    "case best_cv when 'CV_A' then 'Pumps are my trade.' when 'CV_B' then 'I write about pumps.' else '' end, chr(10), chr(10), 'Kind regards') as letter from v_jobs"
)
def letter_texts(spark, d):
    return reports.letters(view(spark, d, "v_jobs"), {"CV_A": "Pumps are my trade.", "CV_B": "I write about pumps."})


# --- the flagship: postings, scored and capped ---


FACTORED = f"cast(round_even(base_score * {FACTOR_SQL}, 0) as int)"


@register(
    with_("v_docs") + f", ex as (select * from (select *, row_number() over (partition by {KEY_SQL} order by ord) rn from v_docs) where rn = 1), t as (select ord, {BLOCK} block, {Q.tokens('title')} toks from ex), "
    + FOLD_SQL + ", kept as (select unnest(r).o o from f union all select ord from t where len(toks) = 0), src as (select * from ex where ord in (select o from kept))" + _score_sql()
    + f", j as (select *, {_reason_sql(10)} as reject_reason from scored), r as (select *, {FACTORED} relevance from j where reject_reason is null), "
    "p as (select *, cast(row_number() over (partition by company order by relevance desc, ord) as int) place from r) select job_id, company, title, relevance as relevance_score, best_cv, place from p where place <= 2"
)
def daily_search(spark, d):
    """Canonical links, first-wins and near-duplicate removal, scores and reasons, then two postings a company at most."""
    from pyspark.sql.window import Window

    rows = view(spark, d, "v_docs").withColumn("link", X.canonical_url("link"))
    rows = dedup.near_titles(dedup.exact(rows), block=F.expr(BLOCK))
    kept = score.judged(rows, VARIANTS, MERGED, min_score=10).where("reject_reason is null")
    place = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("relevance_score"), "ord"))
    return kept.withColumn("place", place).where("place <= 2").select("job_id", "company", "title", "relevance_score", "best_cv", "place")


from millrace.plans import feeds, more  # noqa: E402, F401  the further queries register themselves here
