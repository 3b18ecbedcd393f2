"""Posting relations over the driver's generic tables, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-01 00:00:00"

SQL = {
    "v_postings": (
        "pages",
        "select page_id job_id, page_id ord, regexp_extract(html,'<title>([^<]*)</title>',1) title, regexp_extract(url,'^[a-z]+://([^/?#]+)',1) company, "
        "html description, url link, '' location, 'Web' source from pages",
    ),
    "v_jobs": (
        "orders customer",
        "select o_orderkey id, concat(c_mktsegment,' ',o_orderpriority) job_title, c_name company, concat('desc ', o_orderpriority) description, "
        "concat('https://board.example.org/jobs/', cast(o_orderkey as varchar(20)), '?utm_source=x') link, cast(null as varchar(20)) salary, "
        "least(cast(100 as double), o_totalprice/5000) relevance_score, o_orderdate extracted_date, "
        "case when o_orderkey%5000=0 then 'Gmail Draft' when o_orderpriority like '1%' then 'Greenhouse' when o_orderpriority like '2%' then 'Workday' "
        "when o_orderpriority like '3%' then 'RemoteOK' when o_orderpriority like '4%' then 'Jobicy' else 'Apify / Indeed' end source, "
        "case when o_orderstatus='O' then 'applied' when o_orderstatus='F' then 'rejected' else 'interviewing' end status, "
        "o_orderkey%7=0 already_sent, case when o_orderkey%3=0 then 'CV_A' else 'CV_B' end best_cv, cast(1 + o_orderkey%4 as bigint) seen_count, "
        "o_orderkey%11=0 scam_risk, cast(null as varchar(20)) source_message_id from orders join customer on c_custkey=o_custkey",
    ),
    "v_runs": (
        "events",
        "select concat('user-',cast(user_id as varchar(20))) source, date_trunc('day',ts) run_at, "
        "cast(sum(case when event_type='purchase' then 1 else 0 end) as bigint) raw_count, cast(count(*) as bigint) queries, sum(value) duration_s, "
        "max(case when event_type='error' then props end) error from events group by 1,2",
    ),
    "v_docs": ("documents", "select doc_id job_id, doc_id ord, substr(text,1,60) title, source company, text description, lang, '' link, '' location, 'Docs' source from documents"),
    "v_parts": ("part", "select p_partkey job_id, p_partkey ord, p_name title, p_brand company from part"),
    "v_mail": ("conversations", "select concat(cast(conv_id as varchar(20)),'-',cast(turn as varchar(20))) message_id, substr(text,1,80) subject, text body, role sender from conversations"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = SQL[name]
    for t in tables.split():
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    out = spark.sql(sql)
    return out.withColumn("run_at", out["run_at"].cast("timestamp_ntz")) if name == "v_runs" else out


def with_(*names: str) -> str:
    """The WITH clause of a DuckDB query over views."""
    return "with " + ", ".join(f"{n} as ({SQL[n][1]})" for n in names) + " "
