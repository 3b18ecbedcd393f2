"""Fragments of DuckDB SQL from the same fixed values that the column builders use."""

from __future__ import annotations

from millrace.functions import text as X
from millrace.functions import vocab as V


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def any_of(x: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def lowered(*cols: str) -> str:
    return "lower(concat_ws(' ', " + ", ".join(f"coalesce({c},'')" for c in cols) + "))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"



def domain(url: str) -> str:
    return f"regexp_extract({strip(url)}, {q(URL)}, 2)"


def canonical_url(url: str) -> str:
    raw = strip(url)
    part = lambda k: f"regexp_extract({raw}, {q(URL)}, {k})"
    decode = lambda x: f"url_decode(replace({x}, '+', ' '))"
    encode = lambda x: f"replace(url_encode({x}), '%20', '+')"
    pairs = f"list_transform(list_filter(string_split({part(4)}, '&'), lambda p: contains(p, '=')), lambda p: {{'k': {decode("split_part(p, '=', 1)")}, 'v': {decode("substr(p, instr(p, '=') + 1)")}}})"
    kept = f"list_sort(list_filter({pairs}, lambda p: p.v <> '' and lower(p.k) not in {in_list(V.TRACKING_PARAMS)}))"
    line = f"array_to_string(list_transform({kept}, lambda p: {encode('p.k')} || '=' || {encode('p.v')}), '&')"
    path = f"regexp_replace({part(3)}, '/+$', '')"
    return (
        f"case when {raw} = '' then '' else concat(case when {part(1)} <> '' then lower({part(1)}) || ':' else '' end, case when {part(2)} <> '' then '//' || lower({part(2)}) else '' end, "
        f"case when {path} = '' then '/' else {path} end, case when {line} <> '' then '?' || {line} else '' end) end"
    )


def normal_title(x: str) -> str:
    x = f"lower({x})"
    for pattern in V.TITLE_NOISE:
        x = f"regexp_replace({x}, {q(pattern)}, ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+[-–—|]\\s+.*$', '', 's')"
    return collapse(f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")


def normal_company(x: str) -> str:
    return f"regexp_replace({collapse(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')")}, {q(X.suffix_pattern())}, '')"


def tokens(title: str) -> str:
    return f"list_distinct(list_filter(string_split({normal_title(title)}, ' '), lambda t: t <> ''))"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def site_label(url: str, fallback: str) -> str:
    low = f"lower(coalesce({url}, ''))"
    cases = " ".join(f"when {any_of(low, parts)} then {q(name)}" for parts, name in V.SITE_NAMES)
    label = f"split_part(replace(replace(lower({domain(f"coalesce({url}, '')")}), 'www.', ''), 'jobs.', ''), '.', 1)"
    return f"case when {low} = '' then {fallback} {cases} when {label} <> '' then upper(left({label}, 1)) || lower(substr({label}, 2)) else {fallback} end"


def industry(title: str, description: str) -> str:
    low = f"lower({title} || ' ' || coalesce({description}, ''))"
    return "case " + " ".join(f"when {any_of(low, words)} then {q(name)}" for name, words in V.INDUSTRIES) + " else 'Other' end"


def strip_html(x: str) -> str:
    out = x
    for _ in range(2):
        for entity, plain in [
            ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&"),
        ]:
            out = f"replace({out}, {q(entity)}, {q(plain)})"
        out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    return collapse(out)


def matches(low: str, skills: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({low}, {q(s.lower())}) as int)" for s in skills) + ")"


def share(low: str, skills: list[str]) -> str:
    return f"round_even(least(100.0::double, {matches(low, skills)} / {float(min(len(skills), V.SKILLS_COUNTED))}::double * 100), 1)"


def hosts_like(host: str, hosts: list[str]) -> str:
    return "(" + " or ".join(f"{host} = {q(h)} or ends_with({host}, {q('.' + h)})" for h in hosts) + ")"


def blocked() -> str:
    url = r"https?://([a-z0-9.\-]+)([^\s\"''<>)]*)"
    named = any_of(squash("concat_ws(' ', coalesce(source,''), coalesce(company,''), coalesce(link,''))"), V.BLOCKED_BOARDS)
    hosts = lambda c: f"list_transform(regexp_extract_all(coalesce({c},''), '(?i){url}', 1), lambda h: lower(h))"
    in_link = f"len(list_filter({hosts('link')}, lambda h: {hosts_like('h', V.FUNNEL_HOSTS + V.FREE_HOSTS)})) > 0"
    whole = f"list_transform(regexp_extract_all(coalesce(description,''), '(?i){url}'), lambda u: {{'h': lower(regexp_extract(u, '(?i){url}', 1)), 'p': regexp_extract(u, '(?i){url}', 2)}})"
    in_text = f"len(list_filter({whole}, lambda u: {hosts_like('u.h', V.FUNNEL_HOSTS)} or ({hosts_like('u.h', V.FREE_HOSTS)} and regexp_matches(u.p, '(?i){V.JOB_PATH}')))) > 0"
    return f"({named} or {in_link} or {in_text})"


def scam() -> str:
    url = r"https?://([a-z0-9.\-]+)([^\s\"''<>)]*)"
    hosts = f"list_transform(regexp_extract_all(concat_ws(' ', coalesce(link,''), coalesce(description,'')), '(?i){url}', 1), lambda h: lower(h))"
    return f"({any_of(lowered('title', 'description', 'company'), V.SCAM_PHRASES)} or len(list_filter({hosts}, lambda h: {hosts_like('h', V.FUNNEL_HOSTS + V.FREE_HOSTS)})) > 0)"


def geo() -> str:
    x = lowered("title", "description", "location")
    refused = any_of(x, V.NO_SPONSOR)
    return f"(not ({any_of(x, V.WORLDWIDE)} or ({any_of(x, V.SPONSOR)} and not {refused})) and ({refused} or {any_of(x, V.PERMIT_NEEDED)}))"


def us_located() -> str:
    head = "split_part(upper(trim(p)), ' ', 1)"
    return f"({any_of("lower(coalesce(location,''))", V.US_NAMES)} or len(list_filter(regexp_split_to_array(coalesce(location,''), '[,/|]'), lambda p: {head} in {in_list([*V.US_STATES, 'US'])})) > 0)"


def us_factor() -> str:
    x = lowered("title", "description", "location")
    return f"case when {any_of(x, V.SPONSOR)} or {any_of(x, V.WORLDWIDE)} then 1.0::double when {us_located()} then {V.US_FACTOR}::double else 1.0::double end"


def dealbreaker() -> str:
    return any_of(lowered("title", "description"), V.DEALBREAKERS)


def non_english() -> str:
    return "regexp_matches(lower(coalesce(title,'')), '(^|[^\\p{L}\\p{N}_])(?:" + "|".join(V.NON_ENGLISH_TITLES) + ")')"


def remote(*cols: str) -> str:
    return any_of(lowered(*cols), V.REMOTE_WORDS)
