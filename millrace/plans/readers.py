"""The board readers over payloads that are made from all orders, each with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import boards

#: What every reader's items are made from: title, company, description, link, location, salary range, day.
BASE = (
    "select o_orderkey id, concat(o_orderpriority, '  ', cast(o_orderkey as varchar(20))) t, c_name c, concat('<p>Pump &amp; valve ', cast(o_orderkey as varchar(20)), '</p>') d, "
    "concat('https://Jobs.example.org/', cast(o_orderkey as varchar(20)), '/?utm_source=x') u, case o_orderkey % 4 when 0 then '' when 1 then 'Oslo' when 2 then 'Remote' else 'Bonn' end loc, "
    "case when o_orderkey % 3 = 0 then cast(1000 + o_orderkey % 1000 as double) end lo, case when o_orderkey % 6 = 0 then cast(2000 + o_orderkey % 1000 as double) end hi, "
    "concat('2024-01-', lpad(cast(1 + o_orderkey % 28 as varchar(2)), 2, '0')) dt from orders join customer on c_custkey = o_custkey"
)
TITLE, COMPANY, PLAIN, LINK = "concat(split_part(t, '  ', 1), ' ', cast(id as varchar))", "c", "concat('Pump & valve ', cast(id as varchar))", "concat('https://jobs.example.org/', cast(id as varchar))"
ID = "cast(id as string)"


def _place(default: str) -> str:
    return f"case when loc = '' then '{default}' else loc end"


def _salary(sign: str) -> str:
    n = lambda x: f"format('{{:,}}', cast({x} as bigint))"
    return f"case when lo > 0 and hi > 0 then concat('{sign} ', {n('lo')}, ' – ', {n('hi')}) when lo > 0 then concat('{sign} ', {n('lo')}, '+') end"


#: reader -> (path of the array, item, further arguments, what comes out, which items do).
CASES: dict[str, tuple[str, str, tuple, dict[str, str], str]] = {
    "greenhouse": ("jobs", "t title, u absolute_url, d content, dt updated_at, struct(loc name) location", ("Co",), {"company": "'Co'", "location": _place("Not stated"), "date_posted": "dt"}, "true"),
    "lever": ("", "t text, d descriptionPlain, u hostedUrl, struct('Full-time' commitment, loc location) categories", ("Co",), {"company": "'Co'", "location": _place("Not stated"), "salary": "'Full-time'"}, "true"),
    "ashby": ("jobs", "t title, d descriptionPlain, u jobUrl, loc location, dt publishedAt, struct('10k' summary) compensation", ("Co",), {"company": "'Co'", "location": _place("Not stated"), "salary": "'10k'", "date_posted": "dt"}, "true"),
    "smartrecruiters": ("content", f"{ID} id, t name, dt releasedDate, struct(loc city, 'NO' country) location", ("Co", "co"), {"company": "'Co'", "description": "''", "link": "concat('https://jobs.smartrecruiters.com/co/', cast(id as varchar))", "location": "case when loc = '' then 'NO' else concat(loc, ', NO') end", "date_posted": "dt"}, "true"),
    "workday": ("jobPostings", f"t title, concat('/job/', {ID}) externalPath, loc locationsText, dt postedOn, array('a', {ID}) bulletFields", ("Co", "https://co.example.org"), {"company": "'Co'", "description": "concat('a ', cast(id as varchar))", "link": "concat('https://co.example.org/job/', cast(id as varchar))", "location": _place("Not stated"), "date_posted": "dt"}, "true"),
    "remoteok": ("", "t position, c company, d description, u url, array(concat('Tag', cast(id % 10 as string))) tags, lo salary_min, hi salary_max, dt date", (["tag3"],), {"location": "'Remote'", "salary": _salary("USD"), "date_posted": "dt"}, "id % 10 = 3"),
    "remotive": ("jobs", "t title, c company_name, d description, u url, ' 10k ' salary, array(concat('Tag', cast(id % 10 as string))) tags, dt publication_date", (["tag3", "tag4"],), {"location": "'Remote'", "salary": "'10k'", "date_posted": "dt"}, "id % 10 in (3, 4)"),
    "arbeitnow": ("data", "t title, c company_name, d description, u url, id % 5 = 0 remote, loc location", (), {"location": _place("Remote")}, "id % 5 = 0 or loc in ('', 'Remote')"),
    "muse": ("results", "t name, d contents, struct(c name) company, array(struct(loc name)) locations, struct(u landing_page) refs, dt publication_date", (["pump"],), {"location": "loc", "date_posted": "dt"}, "loc = 'Remote'"),
    "jobicy": ("jobs", "t jobTitle, c companyName, d jobDescription, u url, loc jobGeo, lo annualSalaryMin, hi annualSalaryMax, 'EUR' salaryCurrency, dt pubDate", (), {"location": _place("Remote"), "salary": _salary("EUR"), "date_posted": "dt"}, "true"),
    "himalayas": ("jobs", "t title, to_json(struct(c name)) company, d description, u applicationLink, lo minSalary, hi maxSalary", (), {"location": "'Remote'", "salary": _salary("USD")}, "true"),
    "adzuna": ("results", "t title, d description, u redirect_url, struct(c display_name) company, struct(loc display_name) location, lo salary_min, hi salary_max, dt created", ("gb",), {"location": _place("Remote"), "salary": _salary("£"), "date_posted": "dt"}, "true"),
    "jooble": ("jobs", "t title, c company, d snippet, u link, loc location, '' salary, dt updated", (), {"location": _place("Remote"), "date_posted": "dt"}, "true"),
    "bundesagentur": ("stellenangebote", f"case when id % 2 = 0 then t end titel, 'Schlosser' beruf, c arbeitgeber, {ID} refnr, struct(loc ort, 'NRW' region) arbeitsort, dt aktuelleVeroeffentlichungsdatum", (), {"title": f"case when id % 2 = 0 then {TITLE} else 'Schlosser' end", "description": "'Schlosser'", "link": "concat('https://www.arbeitsagentur.de/jobsuche/jobdetail/', cast(id as varchar))", "location": "case when loc = '' then 'NRW' else concat(loc, ', NRW') end", "date_posted": "dt"}, "true"),
    "reed": ("results", "t jobTitle, c employerName, d jobDescription, u jobUrl, loc locationName, lo minimumSalary, hi maximumSalary, dt date", (), {"location": _place("Remote"), "salary": _salary("£"), "date_posted": "dt"}, "true"),
    "jsearch": ("data", "t job_title, c employer_name, d job_description, u job_apply_link, 'Oslo' job_city, 'NO' job_country, lo job_min_salary, hi job_max_salary, case when id % 2 = 0 then 'Dice' end job_publisher, dt job_posted_at_datetime_utc", (), {"description": "d", "location": "'Oslo, NO'", "salary": _salary("USD"), "source": "case when id % 2 = 0 then 'Dice' else 'JSearch' end", "date_posted": "dt"}, "true"),
    "serp": ("jobs_results", f"t title, c company_name, 'd' description, loc location, u share_link, array(struct(array('x', {ID}) items)) job_highlights", (), {"description": "concat('d x ', cast(id as varchar))", "location": _place("Remote")}, "true"),
    "actor": ("", "t positionName, c company, d descriptionText, u url, loc location, array('1', '2') salaryInfo, dt postedAt", ("Apify / Indeed",), {"location": _place("Remote"), "salary": "'1 – 2'", "date_posted": "dt"}, "true"),
}
SOURCES = {
    "greenhouse": "Greenhouse", "lever": "Lever", "ashby": "Ashby", "smartrecruiters": "SmartRecruiters", "workday": "Workday", "remoteok": "RemoteOK", "remotive": "Remotive",
    "arbeitnow": "Arbeitnow", "muse": "The Muse", "jobicy": "Jobicy", "himalayas": "Himalayas", "adzuna": "Adzuna", "jooble": "Jooble", "bundesagentur": "Bundesagentur", "reed": "Reed",
    "serp": "Google Jobs", "actor": "Apify / Indeed",
}


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(BASE)


def payloads(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A payload for every 100 or so orders."""
    path, item, *_ = CASES[name]
    items = F.collect_list(F.expr(f"struct({item})"))
    rows = base(spark, sf_dir).groupBy(F.floor(F.col("id") / 400).alias("page"))
    return rows.agg(F.to_json(F.struct(items.alias(path)) if path else items).alias("payload")).select("payload")


def read(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boards.READERS[name](payloads(spark, sf_dir, name), *CASES[name][2])

    query.__name__ = f"read_{name}"
    return query


def expected(name: str) -> str:
    want = {"title": TITLE, "company": COMPANY, "description": PLAIN, "link": LINK, "location": "'Remote'", "salary": "cast(null as varchar)", "source": f"'{SOURCES.get(name, '')}'", "date_posted": "cast(null as varchar)"}
    cols = ", ".join(f"{sql} as {c}" for c, sql in (want | CASES[name][3]).items())
    return f"with b as ({BASE}) select {cols} from b where {CASES[name][4]}"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards of search pages."""
    li = "concat('<li><a class=\"l\" href=\"', u, '\"></a><h3 class=\"base-title\"> ', t, ' </h3><h4 class=\"base-subtitle\">', c, '</h4><span class=\"card__location\">', loc, '</span><time datetime=\"', dt, '\">x</time></li>')"
    pages = base(spark, sf_dir).groupBy(F.floor(F.col("id") / 400)).agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list(F.expr(li)), "\n"), F.lit("<li><p>none</p></li></ul>")).alias("html"))
    return boards.guest_cards(pages.select("html"), "remote pump")


CARDS_SQL = f"with b as ({BASE}) select {TITLE} as title, c as company, '' as description, {LINK} as link, {_place('Remote')} as location, cast(null as varchar) as salary, 'LinkedIn' as source, dt as date_posted, 'remote pump' as search_query from b"
QUERIES = {f"read_{name}": read(name) for name in CASES} | {"read_cards": cards}
ORACLE_SQL = {f"read_{name}": expected(name) for name in CASES} | {"read_cards": CARDS_SQL}
