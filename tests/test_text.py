"""Single rules on chosen cases."""

import pytest
from millrace.functions import text as X
from millrace.operators import mail
from pyspark.sql import functions as F


def value(spark, make, *args):
    names = [f"a{i}" for i in range(len(args))]
    df = spark.createDataFrame([args], ", ".join(f"{n} string" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://Acme.com/Jobs/1/?utm_source=a&gh_src=b", "https://acme.com/Jobs/1"), ("HTTPS://acme.com", "https://acme.com/"), ("https://a.com/x?b=2&a=1#frag", "https://a.com/x?a=1&b=2"),
        ("https://a.com/x?a=&b=1", "https://a.com/x?b=1"), ("  https://a.com/x  ", "https://a.com/x"), ("", ""), (None, ""), ("https://a.com/x?q=a%20b&r=c~d*", "https://a.com/x?q=a+b&r=c~d%2A"),
        ("not a url", "not a url"), ("http://[bad/x", "http://[bad/x"), ("https://a.com/?UTM_Medium=x&Z=1", "https://a.com/?Z=1"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, X.canonical_url, url) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Sales Engineer (Remote, m/w/d)", "sales engineer"), ("Sales Engineer - Berlin", "sales engineer"), ("Remote Sales Engineer", "sales engineer"), ("Senior Sales Engineer", "senior sales engineer"),
        ("Full-time C++ Dev [new]", "c dev"), (None, ""), ("Müller/Ärztin h/f", "müller ärztin"), ("Intern | Paris", ""),
    ],
)
def test_normal_title(spark, title, want):
    assert value(spark, X.normal_title, title) == want


@pytest.mark.parametrize(("name", "want"), [("Acme Fluid Systems B.V.", "acme fluid systems"), ("Acme Group Ltd", "acme"), ("Ltd", "ltd"), ("Foo GmbH & Co. KG", "foo"), ("SAP SE", "sap se"), ("", "")])
def test_normal_company(spark, name, want):
    assert value(spark, X.normal_company, name) == want


def test_html_and_pages(spark):
    assert value(spark, X.strip_html, "&lt;p&gt;We&amp;nbsp;build&lt;/p&gt; <b>pumps</b>") == "We build pumps"
    assert value(spark, X.page_text, "<html><script>x<y</script><nav>menu</nav><p>Hi &amp; bye</p><!-- no --></html>") == "Hi & bye"


def test_labels(spark):
    assert value(
        spark, X.detail_api_url, "https://acme.wd3.myworkdayjobs.com/en-US/Careers/job/Berlin/X_1",
    ) == "https://acme.wd3.myworkdayjobs.com/wday/cxs/acme/Careers/job/Berlin/X_1"
    assert value(spark, X.inbox, "Email / me@gmail.com") == "me" and value(spark, X.inbox, "RemoteOK") == ""
    assert value(spark, X.site_label, "https://www.acme.io/jobs") == "Acme" and value(spark, X.site_label, "") == "JSearch"


def test_drafts(spark):
    df = spark.createDataFrame(
        [("m", "Saved job", "Title: Pump Engineer\nCompany: Acme\nTitle: again\nLink: https://a.com/j?utm_source=x", "d"), ("n", None, "see https://b.org/1", "d")],
        "message_id string, subject string, body string, date string",
    )
    got = {r.message_id: r for r in mail.draft_posting(df).collect()}
    assert (got["m"].title, got["m"].company, got["m"].link) == ("Pump Engineer", "Acme", "https://a.com/j")
    assert (got["n"].title, got["n"].company, got["n"].link) == ("Untitled", "Unknown", "https://b.org/1")


def test_entities(spark):
    import html

    from millrace.functions import text as X
    from pyspark.sql import functions as F

    rows = ["a &lt;b&gt; &amp;lt; &quot;c&quot; &#39;d&apos;", "&eacute;t&eacute; &euro;5 &#8364; &#x20AC; &#X1F600; &hellip;", "&unknown; & &; &#0; &#xD800; x&y", "plain", "", "&amp;amp;amp;", "&nbsp;|&copy;&middot;"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(X.unescaped(F.col("x"))).collect()]
    want = [html.unescape(r) for r in rows]
    assert got[:2] == want[:2] and got[3:] == want[3:] and got[2] == rows[2]
