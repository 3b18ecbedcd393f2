"""Payloads of job boards and feeds as postings.

Every reader takes a frame with one payload (a JSON document) a row in ``payload`` and gives postings: title, company, description, link,
location, salary, source, date_posted. Fetching is left to whatever fills the payload table; paged payloads are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import markup
from millrace.functions import text as X
from millrace.functions.rounds import materialise
from millrace.operators.dedup import first_wins

POSTING = "title string, company string, description string, link string, location string, salary string, source string, date_posted string"


def _rows(payloads: DataFrame, path: str, item: str) -> DataFrame:
    """The items of the array at ``path`` ('' for a payload that is an array itself) as the struct column x; none for a payload
    without them."""
    schema = f"array<struct<{item}>>" if not path else f"struct<{path}: array<struct<{item}>>>"
    parsed = F.from_json("payload", schema)
    return payloads.select("*", F.posexplode(parsed if not path else parsed[path]).alias("__place", "x"))


def _posting(rows: DataFrame, source: str | Column, **fields: Column) -> DataFrame:
    named = {f: fields.get(f, F.lit(None)) for f in ("title", "company", "description", "link", "location", "salary", "date_posted")}
    empty = {f: F.coalesce(named[f].cast("string"), F.lit("")) for f in ("title", "company", "description")}
    return rows.select(
        X.collapse(empty["title"]).alias("title"), X.collapse(empty["company"]).alias("company"), empty["description"].alias("description"),
        (fields["made_link"] if "made_link" in fields else X.canonical_url(F.coalesce(named["link"].cast("string"), F.lit("")))).alias("link"),
        F.coalesce(F.nullif(X.strip(X.text(named["location"].cast("string"))), F.lit("")), F.lit("Remote")).alias("location"),
        named["salary"].cast("string").alias("salary"), (source if isinstance(source, Column) else F.lit(source)).alias("source"), named["date_posted"].cast("string").alias("date_posted"),
    )


def _x(name: str) -> Column:
    return F.col(f"x.{name}")


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


#: Characters of a description that are kept.
DESCRIPTION = 2000


def keyword_match(rows: DataFrame, keywords: list[str], *columns: str | Column) -> DataFrame:
    """Rows that hold any keyword; all without keywords."""
    low = F.lower(F.concat_ws(" ", *[X.text(c) for c in columns]))
    return rows.where(X.any_of(low, [k.lower() for k in keywords])) if keywords else rows


def cut(rows: DataFrame, most: int = DESCRIPTION) -> DataFrame:
    """``rows`` with the descriptions shortened; after whatever looks at whole ones."""
    return rows.withColumn("description", F.left("description", F.lit(most)))


def greenhouse(payloads: DataFrame, company: str | Column) -> DataFrame:
    x = _rows(payloads, "jobs", "title string, absolute_url string, content string, updated_at string, location struct<name: string>")
    return _posting(
        x, "Greenhouse", title=_x("title"), company=F.lit(company), description=X.strip_html(_x("content")), link=_x("absolute_url"),
        location=_filled(_x("location.name"), F.lit("Not stated")), date_posted=_x("updated_at"),
    )


def lever(payloads: DataFrame, company: str | Column) -> DataFrame:
    x = _rows(
        payloads, "",
        "text string, descriptionPlain string, description string, hostedUrl string, categories struct<commitment: string, location: string>",
    )
    body = X.strip_html(F.coalesce(F.nullif(_x("descriptionPlain"), F.lit("")), _x("description")))
    return _posting(
        x, "Lever", title=_x("text"), company=F.lit(company), description=body, link=_x("hostedUrl"),
        location=_filled(_x("categories.location"), F.lit("Not stated")), salary=_x("categories.commitment"),
    )


def ashby(payloads: DataFrame, company: str | Column) -> DataFrame:
    x = _rows(
        payloads, "jobs",
        "title string, descriptionPlain string, jobUrl string, location string, publishedAt string, compensation struct<summary: string>",
    )
    return _posting(
        x, "Ashby", title=_x("title"), company=F.lit(company), description=X.strip_html(_x("descriptionPlain")), link=_x("jobUrl"),
        location=_filled(_x("location"), F.lit("Not stated")), salary=_x("compensation.summary"), date_posted=_x("publishedAt"),
    )


def smart_recruiters(payloads: DataFrame, company: str | Column, slug: str | Column) -> DataFrame:
    x = _rows(payloads, "content", "id string, name string, releasedDate string, location struct<city: string, country: string>")
    place = F.nullif(F.concat_ws(", ", F.nullif(_x("location.city"), F.lit("")), F.nullif(_x("location.country"), F.lit(""))), F.lit(""))
    return _posting(
        x, "SmartRecruiters", title=_x("name"), company=F.lit(company),
        link=F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.lit(slug), F.lit("/"), _x("id")), location=F.coalesce(place, F.lit("Not stated")),
        date_posted=_x("releasedDate"),
    )


def workday(payloads: DataFrame, company: str | Column, site: str | Column) -> DataFrame:
    x = _rows(payloads, "jobPostings", "title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>")
    return _posting(
        x, "Workday", title=_x("title"), company=F.lit(company), description=F.array_join(_x("bulletFields"), " "),
        link=F.concat(F.lit(site), _x("externalPath")), location=_filled(_x("locationsText"), F.lit("Not stated")),
        date_posted=_x("postedOn"),
    )


def remote_ok(payloads: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Keywords are looked for in titles, whole descriptions and tags."""
    x = _rows(
        payloads, "",
        "position string, company string, description string, url string, tags array<string>, salary_min double, salary_max double, date string",
    ).where("x.position is not null")
    x = keyword_match(x, keywords or [], X.unescaped(X.text("x.position")), X.strip_html("x.description"), F.array_join(_x("tags"), " "))
    return cut(_posting(
        x, "RemoteOK", title=X.unescaped(_x("position")), company=X.unescaped(_x("company")), description=X.strip_html(_x("description")),
        link=_x("url"), salary=X.salary_range(_x("salary_min"), _x("salary_max"), F.lit("USD")), date_posted=_x("date"),
    ))


def remotive(payloads: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Keywords are looked for in titles, whole descriptions and tags."""
    x = _rows(
        payloads, "jobs",
        "title string, company_name string, description string, url string, salary string, tags array<string>, publication_date string",
    )
    x = keyword_match(x, keywords or [], "x.title", X.strip_html("x.description"), F.array_join(_x("tags"), " "))
    return cut(_posting(
        x, "Remotive", title=_x("title"), company=_x("company_name"), description=X.strip_html(_x("description")),
        link=_x("url"), salary=X.tidy_salary(_x("salary")), date_posted=_x("publication_date"),
    ))


def arbeitnow(payloads: DataFrame) -> DataFrame:
    x = _rows(payloads, "data", "title string, company_name string, description string, url string, remote boolean, location string")
    x = x.where(F.coalesce(_x("remote"), F.lit(False)) | F.lower(X.text(_x("location"))).isin("", "remote", "worldwide"))
    return _posting(
        x, "Arbeitnow", title=_x("title"), company=_x("company_name"), description=F.left(X.strip_html(_x("description")), F.lit(2000)),
        link=_x("url"), location=_x("location"),
    )


def muse(payloads: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    x = _rows(
        payloads, "results",
        "name string, contents string, company struct<name: string>, locations array<struct<name: string>>, refs struct<landing_page: string>, publication_date string",
    )
    x = x.where((F.coalesce(F.size(_x("locations")), F.lit(0)) <= 0) | F.exists(_x("locations"), lambda p: X.any_of(F.lower(X.text(p["name"])), ["remote", "flexible", "anywhere"])))
    rows = _posting(
        x, "The Muse", title=_x("name"), company=_x("company.name"), description=X.strip_html(_x("contents")),
        link=_x("refs.landing_page"), location=F.array_join(F.transform(_x("locations"), lambda p: p["name"]), ", "),
        date_posted=_x("publication_date"),
    )
    return cut(keyword_match(rows, keywords or [], "title", "description"))


def jobicy(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "jobs",
        "jobTitle string, companyName string, jobDescription string, url string, jobGeo string, annualSalaryMin double, annualSalaryMax double, salaryCurrency string, pubDate string",
    )
    return _posting(
        x, "Jobicy", title=X.unescaped(_x("jobTitle")), company=_x("companyName"),
        description=F.left(X.strip_html(_x("jobDescription")), F.lit(2000)), link=_x("url"), location=_x("jobGeo"),
        salary=X.salary_range(_x("annualSalaryMin"), _x("annualSalaryMax"), F.coalesce(_x("salaryCurrency"), F.lit("USD"))),
        date_posted=_x("pubDate"),
    )


def himalayas(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "jobs",
        "title string, company string, companyName string, description string, url string, applicationLink string, minSalary double, maxSalary double",
    )
    company = F.coalesce(F.get_json_object(_x("company"), "$.name"), _x("company"), _x("companyName"))
    return _posting(
        x, "Himalayas", title=_x("title"), company=company, description=F.left(X.strip_html(_x("description")), F.lit(2000)),
        link=_filled(_x("url"), _x("applicationLink")), salary=X.salary_range(_x("minSalary"), _x("maxSalary"), F.lit("USD")),
    )


def adzuna(payloads: DataFrame, country: str) -> DataFrame:
    x = _rows(
        payloads, "results",
        "title string, description string, redirect_url string, company struct<display_name: string>, location struct<display_name: string>, salary_min double, salary_max double, created string",
    )
    sign = {"gb": "£", "us": "$", "ca": "$", "au": "$", "in": "₹"}.get(country, "€")
    return _posting(
        x, "Adzuna", title=X.strip_html(_x("title")), company=_x("company.display_name"), description=X.strip_html(_x("description")),
        link=_x("redirect_url"), location=_x("location.display_name"),
        salary=X.salary_range(_x("salary_min"), _x("salary_max"), F.lit(sign)), date_posted=_x("created"),
    )


def jooble(payloads: DataFrame) -> DataFrame:
    x = _rows(payloads, "jobs", "title string, company string, snippet string, link string, location string, salary string, updated string")
    return _posting(
        x, "Jooble", title=_x("title"), company=_x("company"), description=X.strip_html(_x("snippet")), link=_x("link"),
        location=_x("location"), salary=X.tidy_salary(_x("salary")), date_posted=_x("updated"),
    )


def federal_agency(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "stellenangebote",
        "titel string, beruf string, arbeitgeber string, refnr string, externeUrl string, arbeitsort struct<ort: string, region: string>, aktuelleVeroeffentlichungsdatum string",
    )
    place = F.nullif(F.concat_ws(", ", F.nullif(_x("arbeitsort.ort"), F.lit("")), F.nullif(_x("arbeitsort.region"), F.lit(""))), F.lit(""))
    link = _filled(_x("externeUrl"), F.concat(F.lit("https://www.arbeitsagentur.de/jobsuche/jobdetail/"), _x("refnr")))
    return _posting(
        x, "Bundesagentur", title=_filled(_x("titel"), _x("beruf")), company=_x("arbeitgeber"),
        description=_filled(_x("beruf"), F.lit("")), link=link, location=F.coalesce(place, F.lit("Deutschland")),
        date_posted=_x("aktuelleVeroeffentlichungsdatum"),
    )


def reed(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "results",
        "jobTitle string, employerName string, jobDescription string, jobUrl string, locationName string, minimumSalary double, maximumSalary double, date string",
    )
    return _posting(
        x, "Reed", title=_x("jobTitle"), company=_x("employerName"), description=X.strip_html(_x("jobDescription")), link=_x("jobUrl"),
        location=_x("locationName"), salary=X.salary_range(_x("minimumSalary"), _x("maximumSalary"), F.lit("£")), date_posted=_x("date"),
    )


def jsearch(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "data",
        "job_title string, employer_name string, job_description string, job_apply_link string, job_city string, job_country string, job_min_salary double, job_max_salary double, job_salary_currency string, job_publisher string, job_posted_at_datetime_utc string",
    )
    return _posting(
        x, F.coalesce(_x("job_publisher"), F.lit("JSearch")), title=_x("job_title"), company=_x("employer_name"),
        description=_x("job_description"), link=_x("job_apply_link"), location=F.concat_ws(", ", _x("job_city"), _x("job_country")),
        salary=X.salary_range(_x("job_min_salary"), _x("job_max_salary"), F.coalesce(_x("job_salary_currency"), F.lit("USD"))),
        date_posted=_x("job_posted_at_datetime_utc"),
    )


def serp(payloads: DataFrame) -> DataFrame:
    x = _rows(
        payloads, "jobs_results",
        "title string, company_name string, description string, location string, share_link string, apply_options array<struct<link: string>>, job_highlights array<struct<items: array<string>>>",
    )
    more = F.array_join(
        F.flatten(F.transform(F.coalesce(_x("job_highlights"), F.array().cast("array<struct<items: array<string>>>")), lambda h: F.coalesce(h["items"], F.array().cast("array<string>")))),
        " ",
    )
    link = F.coalesce(F.try_element_at(_x("apply_options"), F.lit(1))["link"], _x("share_link"))
    return _posting(
        x, "Google Jobs", title=_x("title"), company=_x("company_name"),
        description=F.left(F.concat_ws(" ", _x("description"), more), F.lit(2000)), link=link, location=_x("location"),
    )


def actor_dataset(payloads: DataFrame, source: str) -> DataFrame:
    """Items of a scraping service's data set; both of its naming styles."""
    x = _rows(
        payloads, "",
        "title string, positionName string, companyName string, company string, description string, descriptionText string, link string, url string, location string, salary string, salaryInfo array<string>, postedAt string",
    )
    salary = _filled(_x("salary"), F.array_join(_x("salaryInfo"), " – "))
    return _posting(
        x, source, title=_filled(_x("title"), _x("positionName")), company=_filled(_x("companyName"), _x("company")),
        description=F.left(X.strip_html(_filled(_x("descriptionText"), _x("description"))), F.lit(3000)),
        link=_filled(_x("link"), _x("url")), location=_x("location"), salary=salary, date_posted=_x("postedAt"),
    )


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of RSS files, for ``of_items``, with what doesn't depend on the source made once: plain descriptions and canonical links."""
    schema = "title string, description string, link string, location string, `g:location` string, pubDate string"
    rows = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    made = rows.withColumns({"description": X.strip_html("description"), "link": X.canonical_url("link")})
    return made.select(F.struct("*").alias("x"))


def rss(spark: SparkSession, path: str, source: str, company: str | None = None, keywords: list[str] | None = None) -> DataFrame:
    """Postings of RSS files, see ``of_items``."""
    return of_items(rss_items(spark, path), source, company, keywords)


def of_items(x: DataFrame, source: str, company: str | None = None, keywords: list[str] | None = None) -> DataFrame:
    """Postings of the items of feeds. With a company they are its own; without, titles are 'Company: title'."""
    split = F.contains(_x("title"), F.lit(":")) & F.lit(company is None)
    title = F.when(split, X.strip(F.substr(_x("title"), F.instr(_x("title"), ":") + 1))).otherwise(_x("title"))
    name = F.when(split, X.strip(F.substring_index(_x("title"), ":", 1))).otherwise(F.lit(company or ""))
    rows = _posting(
        x, source, title=title, company=name, description=_x("description"), made_link=_x("link"),
        location=F.coalesce(F.col("x.`g:location`"), _x("location")), date_posted=_x("pubDate"),
    )
    return keyword_match(rows, keywords or [], "title", "description")


#: The fields of a search page's card, where they stand: text of an element, or an attribute.
CARD_FIELDS = {
    "title": ('h3[class*="title" i], span[class*="title" i]', None), "company": ('h4[class*="subtitle" i], a[class*="subtitle" i]', None), "link": ("a[href]", "href"),
    "location": ('[class*="location" i]', None), "date_posted": ("time", "datetime"),
}


def guest_cards(pages: DataFrame, search_query: str = "") -> DataFrame:
    """Postings of a search page's cards (html): each list item, nested ones too; cards without a title go."""
    rows = pages.select(F.inline(markup.records("html", "li", CARD_FIELDS))).where("title <> ''")
    found = _posting(
        rows, "LinkedIn", title=F.col("title"), company=F.coalesce("company", F.lit("Unknown")), link=F.col("link"), location=F.coalesce("location", F.lit("Remote")), date_posted=F.col("date_posted"),
    )
    return found.withColumn("search_query", F.lit(search_query))


def search_results(results: DataFrame) -> DataFrame:
    """Postings of web search results (title, href, body; with ``ord``: only the first of each link); pages that list many jobs go."""
    listing = F.regexp_like(F.lower(X.text("href")), F.lit(r"/(?:search|jobs/?$|q-|browse|categories)|[?&](?:q|keywords)="))
    name = F.regexp_replace(X.text("title"), r"\s*[|–-]\s*(?:LinkedIn|Indeed(?:\.com)?|Glassdoor|Greenhouse|Lever|Workable)\s*$", "")
    pair = lambda p, a, b: (F.regexp_extract(name, p, a), F.regexp_extract(name, p, b))
    cases = [pair(r"^(.+?) hiring (.+?)(?: in .+)?$", 2, 1), pair(r"^(.+?) at (.+)$", 1, 2), pair(r"^(.+?)\s+[|–-]\s+(.+)$", 1, 2)]
    title = F.coalesce(*[F.nullif(t, F.lit("")) for t, _ in cases], name)
    company = F.coalesce(*[F.nullif(c, F.lit("")) for _, c in cases], F.lit("Unknown"))
    x = results.where(~listing & (X.text("href") != ""))
    x = first_wins(x, [X.canonical_url("href")]) if "ord" in results.columns else x
    return _posting(x, X.site_label("href", F.lit("DuckDuckGo")), title=title, company=company, description=F.col("body"), link=F.col("href"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smart_recruiters, "workday": workday, "remoteok": remote_ok,
    "remotive": remotive, "arbeitnow": arbeitnow, "muse": muse, "jobicy": jobicy, "himalayas": himalayas, "adzuna": adzuna, "jooble": jooble,
    "bundesagentur": federal_agency, "reed": reed, "jsearch": jsearch, "serp": serp, "actor": actor_dataset,
}


def companies(rows: DataFrame) -> DataFrame:
    """Configured companies (name, ats, slug) that can be read."""
    return rows.where(F.lower("ats").isin(*READERS, "successfactors") & (X.text("slug") != ""))


def scan(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of all companies' boards, and a row for each board (source, queries, raw_count, error) for the run history.

    payloads: name, ats, slug, site, payload (null where fetching failed) and error (what went wrong then). A board that failed or that can't be read
    is told in the second frame and takes nothing from the others; payloads of boards without a reader are told too.
    """
    name, slug, site = F.col("name"), F.col("slug"), X.text("site")
    arguments = {"greenhouse": (name,), "lever": (name,), "ashby": (name,), "smartrecruiters": (name, slug), "workday": (name, site)}
    payloads = payloads.withColumn("ats", F.lower("ats"))
    unread = F.when(X.text("error") != "", F.col("error")).when(~F.col("ats").isin(*arguments), "no reader").when(F.get_json_object("payload", "$").isNull(), "unreadable")
    marked = payloads.withColumn("__error", unread)
    fine = marked.where("__error is null").drop("error", "__error")
    found = [READERS[ats](fine.where(F.col("ats") == ats), *given).withColumn("ats", F.lit(ats)) for ats, given in arguments.items()]
    postings = reduce(DataFrame.unionByName, found)
    boards = marked.groupBy("ats", F.col("name").alias("company")).agg(F.count("*").alias("queries"), F.max("__error").alias("error"))
    counts = postings.groupBy("ats", "company").agg(F.count("*").alias("raw_count"))
    boards = boards.withColumn("company", X.collapse(X.text("company"))).join(counts, ["ats", "company"], "left")
    return postings, boards.select(F.concat_ws(" / ", "ats", "company").alias("source"), "queries", F.coalesce("raw_count", F.lit(0)).alias("raw_count"), "error")


def paged(pages: DataFrame) -> DataFrame:
    """The postings of the pages that a scan of paged boards has found (see ``sources.paged``); failures have none."""
    of = lambda kind: pages.where((F.col("kind") == kind) & F.col("payload").isNotNull())
    board = F.col("board")
    site = F.concat(F.lit("https://"), board, F.lit(".wd5.myworkdayjobs.com/External"))
    found = [smart_recruiters(of("smartrecruiters"), board, board), workday(of("workday"), board, site), jsearch(of("jsearch"))]
    return reduce(DataFrame.unionByName, found)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """All postings with their order ``ord``: the frames' order, then by what a posting holds, so that reruns agree whatever the partitions. Equal
    postings of a frame get different numbers."""
    marked = [f.withColumn("__frame", F.lit(k)) for k, f in enumerate(frames)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return numbered(both, [F.col("__frame"), *[F.col(c) for c in both.columns if c != "__frame"]]).drop("__frame")


def numbered(df: DataFrame, order: list[Column], name: str = "ord") -> DataFrame:
    """``df`` with the rows' places in the order, from 0: rows are sorted by ranges, and only the ranges' sizes go through the driver."""
    part, spark = "__part", df.sparkSession
    held = materialise(df.sort(*order).withColumn(part, F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id()), "numbered")
    sizes = {r[part]: (r["n"], r["first"]) for r in held.groupBy(part).agg(F.count("*").alias("n"), F.min(name).alias("first")).collect()}
    ahead, moves = 0, []
    for k in sorted(sizes):
        n, first = sizes[k]
        moves.append((k, ahead - first))
        ahead += n
    moves_ = spark.createDataFrame(moves, f"{part} int, __move long")
    return held.join(F.broadcast(moves_), part).withColumn(name, F.col(name) + F.col("__move")).drop(part, "__move")
