"""Registered queries over feeds and raw mails that are written from the given tables first: RSS files and mail messages. Each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.rounds import materialise, work_folder
from millrace.plans import sql as Q
from millrace.plans.queries import register
from millrace.plans.views import view, with_
from millrace.sources import boards, mailbox


def _xml(spark, rows, item: str) -> str:
    """RSS files of the rows' items in the shared folder, some thousand in each."""
    folder = f"{work_folder(spark)}/millrace/feed-{uuid.uuid4().hex}"
    items = F.array_join(F.collect_list(F.expr(item)), "")
    feeds = rows.groupBy(F.floor(F.col("id") / 4000).alias("feed")).agg(F.concat(F.lit("<rss><channel><title>t</title>"), items, F.lit("</channel></rss>")).alias("value"))
    feeds.write.partitionBy("feed").text(folder)
    return folder


ITEM = (
    "concat('<item><title>', case when id % 4 = 0 then '' else concat(company, ': ') end, job_title, ' ', id, '</title><description>&lt;p&gt;Pay &amp;amp; more: &lt;b&gt;', id, '&lt;/b&gt;&lt;/p&gt;</description>"
    "<link>https://w.example.org/j/', id, '?utm_source=rss</link>', case when id % 3 = 0 then '<g:location xmlns:g=\"http://g\">Oslo</g:location>' when id % 3 = 1 then '<location>Bonn</location>' else '' end, '<pubDate>d', id, '</pubDate></item>')"
)
RSS_SQL = (
    "select '{source}' as source, {title} as title, {company} as company, 'Pay & more: ' || id as description, 'https://w.example.org/j/' || id as link, "
    "case id % 3 when 0 then 'Oslo' when 1 then 'Bonn' else 'Remote' end as location, 'd' || id as date_posted from v_jobs"
)


@register(
    with_("v_jobs") + RSS_SQL.format(source="WeWorkRemotely", title="job_title || ' ' || id", company="case when id % 4 = 0 then '' else company end") + " union all "
    + RSS_SQL.format(source="SuccessFactors", title="case when id % 4 = 0 then '' else company || ': ' end || job_title || ' ' || id", company="'Acme AG'")
)
def read_rss(spark, d):
    """A board of many companies, and one company's own feed."""
    items = materialise(boards.rss_items(spark, _xml(spark, view(spark, d, "v_jobs"), ITEM)), "items")  # XML is read once
    both = boards.of_items(items, "WeWorkRemotely").unionByName(boards.of_items(items, "SuccessFactors", company="Acme AG"))
    return both.select("source", "title", "company", "description", "link", "location", "date_posted")


# Mails with encoded headers and bodies, plain or as HTML only.


@register(
    with_("v_mail") + f", m as (select message_id, trim(regexp_replace(left(coalesce(subject, ''), 40), '[^A-Za-z]+', ' ', 'g')) as s, body, sender from v_mail) select message_id, 'Ré: ' || s as subject, sender || ' <' || sender || '@example.org>' as sender, "
    f"timestamp '2024-03-01 10:00:00' as date, {Q.collapse('coalesce(body, chr(32))')} as body from m"
)
def raw_mails(spark, d):
    rows = view(spark, d, "v_mail")
    subject = F.trim(F.regexp_replace(F.left(F.coalesce("subject", F.lit("")), F.lit(40)), "[^A-Za-z]+", " "))
    coded = F.concat(F.lit("=?utf-8?B?"), F.base64(F.concat(F.lit("Ré: "), subject).cast("binary")), F.lit("?="))
    html = F.crc32(F.col("message_id").cast("binary")) % 2 == 1
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    text = F.coalesce("body", F.lit(" "))
    body = F.when(html, F.concat(F.lit("<html><p>"), safe(text), F.lit("</p></html>"))).otherwise(text)
    lines = F.concat_ws(
        "\r\n", F.concat(F.lit("Message-ID: "), "message_id"), F.concat(F.lit("Subject: "), coded), F.concat(F.lit("From: "), "sender", F.lit(" <"), "sender", F.lit("@example.org>")),
        F.lit("Date: Fri, 01 Mar 2024 12:00:00 +0200"), F.concat(F.lit("Content-Type: text/"), F.when(html, "html").otherwise("plain"), F.lit("; charset=utf-8")),
        F.lit("Content-Transfer-Encoding: base64\r\nMIME-Version: 1.0\r\n"), F.base64(body.cast("binary")),
    )
    return mailbox.mails(rows.select(lines.cast("binary").alias("content"))).select("message_id", "subject", "sender", F.col("date").cast("timestamp_ntz").alias("date"), "body")
