"""Column builders for posting text: links, titles, companies, labels, previews and salaries.

All are built-in expressions. Patterns use the ``(?U)`` flag so that words and blanks are Unicode's.
"""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vocab as V

BLANK = r"(?U)\s+"
MARKS = r"(?U)[^\w\s]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """The value, or an empty string for null."""
    return F.coalesce(col(x), F.lit(""))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of blanks become one, and none is left at the ends."""
    return strip(F.regexp_replace(x, BLANK, " "))


def words(x: Column) -> Column:
    """The words between blanks; none for an empty text."""
    return F.filter(F.split(F.regexp_replace(x, BLANK, " "), " "), lambda w: w != "")


class Searched:
    """A lower-cased text in which phrases have been looked up: the places of those that it holds, and all phrases' places."""

    def __init__(self, places: Column, ids: dict[str, int]) -> None:
        self.places, self.ids = places, ids

    def any_of(self, phrases: list[str]) -> Column:
        return F.arrays_overlap(self.places, F.array(*[F.lit(self.ids[p]) for p in phrases])) if phrases else F.lit(False)


def any_of(x: Column | str | Searched, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds any phrase, with no regard to word boundaries. A column given by name is searched in generated code; an
    expression is made once a row, not once a phrase."""
    if isinstance(x, Searched):
        return x.any_of(phrases)
    holds = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in phrases])
    return holds(F.col(x)) if isinstance(x, str) else F.exists(F.array(x), holds)


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once a row however often it is used: filters on them aren't pushed below."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def squash(x: Column | str) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text(x)), "[^a-z0-9]", "")


# --- links ---


def _url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    return tuple(F.regexp_extract(url, pattern, k) for k in (1, 2, 3, 4))


def _form_encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column | str) -> Column:
    """One form for all links to a posting: lower-case scheme and host, no fragment, no tracking or blank parameters, the
    others sorted, no slash at the end of the path."""
    raw = strip(text(url))
    scheme, host, path, query = _url_parts(raw)
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("="))),
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.substr(p, F.instr(p, "=") + 1)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(V.TRACKING_PARAMS)))
    line = F.array_join(F.transform(kept, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&")
    path = F.regexp_replace(path, "/+$", "")
    made = F.concat(
        F.when(scheme != "", F.concat(F.lower(scheme), F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), F.lower(host))).otherwise(""),
        F.when(path == "", "/").otherwise(path),
        F.when(line != "", F.concat(F.lit("?"), line)).otherwise(""),
    )
    return F.when(raw == "", "").when(F.regexp_like(host, F.lit(r"[\[\]]")), raw).otherwise(made)


def domain(url: Column | str) -> Column:
    return _url_parts(strip(text(url)))[1]


def urls_in(x: Column | str) -> Column:
    """array<struct<host, path>> of all http links in a text."""
    pattern = r"(?i)https?://([a-z0-9.\-]+)([^\s\"'<>)]*)"
    hosts = F.regexp_extract_all(text(x), F.lit(pattern), F.lit(1))
    return F.arrays_zip(F.transform(hosts, F.lower).alias("host"), F.regexp_extract_all(text(x), F.lit(pattern), F.lit(2)).alias("path"))


def host_in(host: Column, hosts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(host == h) | F.endswith(host, F.lit("." + h)) for h in hosts])


def site_label(url: Column | str, fallback: Column | str = "JSearch") -> Column:
    """The job site's name by parts of the link, else the host's first label, else the fallback."""
    low, other = F.lower(text(url)), fallback if isinstance(fallback, Column) else F.lit(fallback)
    label = F.substring_index(F.replace(F.replace(F.lower(domain(url)), F.lit("www."), F.lit("")), F.lit("jobs."), F.lit("")), ".", 1)
    named = F.when(low == "", other)
    for parts, name in V.SITE_NAMES:
        named = named.when(any_of(low, parts), name)
    return named.when(label != "", F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))).otherwise(other)


def detail_api_url(url: Column | str) -> Column:
    """The JSON address behind a hosted careers page: tenant is the host's first label, then its site and the rest of the path."""
    pattern = r"^https?://(([^./]+)\.[^/]+)/(?:[a-z]{2}-[A-Z]{2}/)?([^/]+)(/.*)$"
    part = lambda k: F.regexp_extract(text(url), pattern, k)
    made = F.concat(F.lit("https://"), part(1), F.lit("/wday/cxs/"), part(2), F.lit("/"), part(3), part(4))
    return F.when(part(1) != "", made)


# --- titles and companies ---


def normal_title(title: Column | str) -> Column:
    """The title's comparable core."""
    x = F.lower(text(title))
    for pattern in V.TITLE_NOISE:
        x = F.regexp_replace(x, "(?U)" + pattern, " ")
    x = F.split(x, r"(?U)\s+[-–—|]\s+", 2)[0]
    return collapse(F.regexp_replace(x, MARKS, " "))


def suffix_pattern() -> str:
    tokens = {" ".join(re.sub(r"[^\w\s]", " ", s).split()) for s in V.COMPANY_SUFFIXES}
    return "(?: (?:" + "|".join(sorted(tokens, key=lambda t: (-len(t), t))) + "))+$"


def normal_company(company: Column | str) -> Column:
    """The company's comparable core: legal suffixes go from the end, one after the other."""
    x = collapse(F.regexp_replace(F.lower(text(company)), MARKS, " "))
    return F.regexp_replace(x, suffix_pattern(), "")


def dedup_key(title: Column | str, company: Column | str) -> Column:
    return F.concat(normal_title(title), F.lit("|"), normal_company(company))


def token_set(title: Column | str) -> Column:
    return F.array_distinct(words(normal_title(title)))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), both))


# --- html, labels, previews ---


#: Characters of named entities, from the standard library's table of HTML 4 names.
_ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def unescaped(x: Column) -> Column:
    """Entities, named and numbered in either base, as their characters; one level is undone at a time. Unknown names stay."""
    table = F.create_map(*[F.lit(v) for pair in _ENTITIES.items() for v in pair])

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{0,30});", 1)
        code = F.when(F.regexp_like(name, F.lit("^#[xX]")), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("int")
        fits = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(F.startswith(name, F.lit("#")), F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))).otherwise(F.try_element_at(table, name))
        return F.when(char.isNotNull(), F.concat(char, F.substr(part, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), part))

    parts = F.split(x, "&")
    return F.when(F.contains(x, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), decoded), ""))).otherwise(x)


def strip_html(x: Column | str) -> Column:
    """Text of an HTML fragment, which may itself be escaped: unescape and drop tags, twice."""
    out = text(x)
    for _ in range(2):
        out = F.regexp_replace(unescaped(out), "<[^>]+>", " ")
    return collapse(out)


def page_text(html: Column | str, limit: int | None = 3000) -> Column:
    """A page's visible text without scripts, styles, navigation and comments; its first ``limit`` characters, or all of it."""
    x = F.regexp_replace(text(html), r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg", "form"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return strip_html(x) if limit is None else F.left(strip_html(x), F.lit(limit))


def cv_label(name: Column | str, prefix: str = "") -> Column:
    """A file name of a profile variant as a label; null if nothing is left."""
    x = F.regexp_replace(text(name), r"\.[A-Za-z0-9]+$", "")
    if prefix:
        x = F.regexp_replace(x, "^" + re.escape(prefix), "")
    x = F.regexp_replace(F.translate(x, "_-", "  "), r"\s*\d+\s*$", "")
    return F.nullif(collapse(x), F.lit(""))


def safe_filename(name: Column | str) -> Column:
    return F.trim(F.translate(text(name), '<>:"/\\|?*', "_________"))


def shortened(x: Column | str, n: int, mark: str) -> Column:
    return F.when(F.length(text(x)) > n, F.concat(F.left(text(x), F.lit(n)), F.lit(mark))).otherwise(text(x))


def salary_range(low: Column, high: Column, currency: Column) -> Column:
    """A displayed range, an open range, or null."""
    n = lambda x: F.format_number(x, 0)
    both = F.concat(currency, F.lit(" "), n(low), F.lit(" – "), n(high))
    return F.when((low > 0) & (high > 0), both).when(low > 0, F.concat(currency, F.lit(" "), n(low), F.lit("+")))


def tidy_salary(x: Column | str) -> Column:
    return F.nullif(strip(text(x)), F.lit(""))


def industry(title: Column | str, description: Column | str) -> Column:
    low, found = F.lower(F.concat(text(title), F.lit(" "), text(description))), None
    for name, keywords in V.INDUSTRIES:
        found = F.when(any_of(low, keywords), name) if found is None else found.when(any_of(low, keywords), name)
    return found.otherwise("Other")


def origin(source: Column | str) -> Column:
    return F.when(F.startswith(text(source), F.lit("Email")), "email").otherwise("search")


def inbox(source: Column | str) -> Column:
    """The local part of the address in 'Email / address'; empty for other sources."""
    address = F.trim(F.regexp_extract(text(source), "^Email[^/]*/(.*)$", 1))
    return F.substring_index(address, "@", 1)
