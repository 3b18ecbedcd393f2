"""Element trees, selectors, cascades and records against hand-written and random pages."""

import random
import re
import xml.etree.ElementTree as ET

import pytest
from millrace.functions import markup
from millrace.functions.markup import Page, described
from millrace.operators import enrich
from millrace.sources import boards


def texts(html, selector, noise=()):
    page = Page(html, frozenset(noise))
    return [page.text(k, " ") for k in page.select(selector)]


HTML = """<!DOCTYPE html><body id=top><div class="a  job-detail-x"><p>one<p>two<br>three</p></div><ul><li>x<ul><li>y</li></ul>z</li></ul>
<section data-ui='job-description' data-n="12 34"><b>B &amp; C</b><img src=x></b></section><script>var t="<p>no</p>";</script><!-- <p>no</p> --><main><div><article>deep</article></div></main><i>open"""


@pytest.mark.parametrize("selector,want", [
    ("p", ["one two three", "two three"]), ("div p", ["one two three", "two three"]), ("div > p", ["one two three"]), ("li li", ["y"]), ("ul > li", ["x y z", "y"]), ("LI", ["x y z", "y"]),
    (".job-detail-x", ["one two three"]), (".a.job-detail-x p > p", ["two three"]), (".job", []), ('[class*="job-detail"]', ["one two three"]), ('[data-ui="job-description"]', ["B & C"]), ("[data-ui='JOB-description' i]", ["B & C"]),
    ("section[data-n~='34'] b", ["B & C"]), ("[data-n^='12'][data-n$='34']", ["B & C"]), ("[data-n*='']", []), ("main article", ["deep"]), ("main > article", []), ("#top > main", ["deep"]), ("i, article", ["deep", "open"]),
    ("img", [""]), ("* > article", ["deep"]), ("[data-n=x]", []),
])
def test_selectors(selector, want):
    assert texts(HTML, selector, ["script"]) == want


@pytest.mark.parametrize("bad", ["", "  ", "a >", "> a", "a,,b", "a[", "a:hover", ","])
def test_bad_selectors(bad):
    with pytest.raises(ValueError):
        markup.description("html", [bad], [])


def test_noise_is_left_out_with_all_it_holds():
    html = "<div>a<nav>b<div>c</div><br><p>d</nav>e<footer>f</footer></div></nav>g<header>h"
    assert texts(html, "div", ["nav", "footer", "header"]) == ["a e"] and texts(html, "p", ["nav"]) == []


def tree(rng, depth=0):
    tag = rng.choice(["div", "div", "p", "span", "li", "main"])
    attrs = rng.choice(["", ' class="x"', ' class="x y"', ' id="k"', ' data-q="u v"'])
    inner = "".join(rng.choice(["t%d " % rng.randrange(9), tree(rng, depth + 1) if depth < 5 else "", "<br/>"]) for _ in range(rng.randrange(5)))
    return f"<{tag}{attrs}>{inner}</{tag}>"


def test_random_trees_against_an_xml_parser():
    rng = random.Random(2)
    paths = {"div": ".//div", "div p": ".//div//p", "div > span": ".//div/span", "#k": ".//*[@id='k']", "div > div > div": ".//div/div/div", "[data-q='u v'] li": ".//*[@data-q='u v']//li"}
    for _ in range(150):
        html = f"<body>{tree(rng)}{tree(rng)}</body>"
        root = ET.fromstring(html)
        order = {e: k for k, e in enumerate(root.iter())}
        for selector, path in paths.items():
            found = sorted(set(root.findall(path)), key=order.get)
            assert texts(html, selector) == [" ".join(x for t in e.itertext() if (x := t.strip())) for e in found], (selector, html)


LONG = "word " * 40


def test_cascade():
    first = lambda html, **o: described(html, [".a", ".b", "main"], frozenset(["nav"]), o.get("least", 150), o.get("most", 3000))
    assert first(f"<div class=b>{LONG}</div><div class=a>short</div>") == LONG.strip()
    assert first(f"<div class=a>short</div><div class=a>{LONG}</div>") is None  # only the first element of a selector counts
    assert first(f"<main><nav>{LONG}</nav><p>{'x' * 151}</p></main>") == "x" * 151 and first(f"<main>{'x' * 150}</main>") is None
    assert first(f"<main>{LONG}</main>", most=9) == "word word" and first("") is None and first(None) is None
    assert first("<div><div class=b>" + "<div>" * 300 + LONG) == LONG.strip()


def test_scraped(spark):
    page = f"<html><main><main>{LONG}</main>\n more</main></html>"
    rows = [(1, "https://a.org/1", page), (2, "https://www.LinkedIn.com/jobs", page), (3, "", page), (4, None, page), (5, "https://a.org/5", None), (6, "https://a.org/?x=taleo.net", page), (7, "https://a.org/7", "<p>none</p>"), (8, "https://a.org", page * 300)]
    df = spark.createDataFrame(rows, "id int, url string, html string").repartition(3)
    got = {r.id: r.t for r in df.select("id", enrich.scraped("html", "url").alias("t")).collect()}
    want = re.sub(r"\s+", " ", LONG + "more")
    assert got == {1: want, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: want}
    assert df.limit(0).select(enrich.scraped("html", "url")).count() == 0


def test_cards_within_cards(spark):
    html = """<ul><li><h3 class="Base-Title">Outer</h3><ul><li>no title</li><li><span class="sr-title">Inner</span><a class="x-subtitle" href="https://i.org/2">I Co</a></li></ul><a href="https://o.org/1">o</a>
    <h4 class="subtitle">O <b>Co</b></h4><p class="job__LOCATION">Bonn</p><time datetime="2024-01-02">x</time></li></ul>"""
    got = boards.guest_cards(spark.createDataFrame([(html,), (None,), ("<li>",)], "html string"), "q").orderBy("title").collect()
    assert [(r.title, r.company, r.link, r.location, r.date_posted) for r in got] == [("Inner", "I Co", "https://i.org/2", "Remote", None), ("Outer", "I Co", "https://i.org/2", "Bonn", "2024-01-02")]


def test_cut_references_are_plain_text():
    html = "<h1>a &amp;&amp;&amp</h1><p>b &&& &lt &#39; &eacute;</p><script>x && y &lt</script><a href='?a=1&copy=2&amp;b=3'>c&d</a>"
    assert texts(html, "h1") == ["a &&&amp"] and texts(html, "p") == ["b &&& &lt ' é"] and texts(html, "script") == ["x && y &lt"]
    page = Page(html)
    assert page.elements[next(page.select("a"))].attrs["href"] == "?a=1&copy=2&b=3" and texts(html, "a") == ["c&d"]
