import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from millrace.llm import pii as P

RE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in RE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def texts():
    r = random.Random(11)
    bits = ["a.b@c.de", "x@y", "a@b.co_m@d.ef.g", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "007.08.9.255", "4232245145735943", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (619) 555-0053", "+49 30 1234",
            "+1", "😀", "é", ",", " ", " ", "word", "12", "+12345678901234567", "(212) 555-1234", "123-45-6789", "jo.doe (at) mail (dot) com", "Call Dr. Anna Smith", "@", "..", "a@b-.c", "1-2-3"]
    out = ["".join(r.choice(bits) for _ in range(r.choice([1, 3, 10, 60]))) for _ in range(150)]
    return [*out, None, "", "a" * 30_000, "9" * 3_000, "1 " * 20_000, "a@b.cd " * 3000]


def test_base_against_brute_force(spark):
    rows = [(i // 2, t, "x", 1) for i, t in enumerate(texts())]  # doc_ids come twice
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, rid int").repartition(3)
    got = P.summarise(P.find(df)).collect()
    assert len(got) == len(rows)
    key = lambda i, base, n: (i, base, tuple(n))
    want = []
    for i, t, *_ in rows:
        b = brute(t)
        want.append(key(i, ",".join(f"{k}:{s}:{e}" for k, s, e in b), [sum(x[0] == k for x in b) for k in RE]))
    assert sorted(key(r.doc_id, r.base, [r[f"n_{k}"] for k in RE]) for r in got) == sorted(want)
    for r in got:
        assert set(r.base.split(",")) <= {"", *r.spans.split(",")}


def test_reliabilities_are_found():
    r = random.Random(3)
    hits = [0.9, 0.8, 0.75, 0.6, 0.5]
    counts, truth = {}, {}
    for _ in range(4000):
        y = r.random() < 0.6
        v = tuple((1 if (r.random() < h) == y else -1) for h in hits)
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    patterns = np.array(sorted(counts))
    share, rates = P.estimate(patterns, np.array([counts[tuple(v)] for v in patterns.tolist()], float))
    assert share == pytest.approx(0.6, abs=0.06)
    for h, rate in zip(hits, rates, strict=True):
        assert rate[1][2] == pytest.approx(h, abs=0.08)
    likely = P.posterior(patterns, share, rates)
    right = sum((p > 0.5) == y for v, p in zip(patterns.tolist(), likely, strict=True) for y in truth[tuple(v)])
    assert right >= 0.88 * 4000


def test_classifier_learns_what_the_votes_say():
    rng = np.random.default_rng(4)
    given, form = rng.integers(-1, 2, (400, 5)), np.stack([rng.integers(0, n, 400) for n in P.FEATURE_SIZES], axis=1)
    true = 1 / (1 + np.exp(-(2.0 * given[:, 0] + given[:, 2])))
    weights = P.train_classifier(given, form, rng.integers(1, 50, 400).astype(float), true, rounds=2000)
    guess = 1 / (1 + np.exp(-weights[P._inputs(given, form)].sum(axis=1)))
    assert np.abs(guess - true).mean() < 0.05


def test_method_adds_and_masks(spark):
    rows = [(i, f"Contact us by e-mail: user{i}.x@mail{i}.com, or phone: +1 (619) 555-00{i:02d} now") for i in range(40)]
    rows += [(100 + i, f"Please call (212) 555-12{i:02d} today") for i in range(20)]
    rows += [(200, "plain words only"), (201, None), (202, "the code 4111 1111 1111 1112 fails")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("__text", "__m", "kind", "rid")})
    found = {r.doc_id: r for r in P.summarise(P.find(df)).collect()}
    assert found[100].spans == "local_phone:12:26" and found[200].spans == "" and found[202].spans == ""
    masked = {r.doc_id: r for r in P.mask(df).collect()}
    assert masked[1].text == "Contact us by e-mail: <EMAIL>, or phone: <PHONE> now" and masked[1].source == "s"
    assert masked[100].text == "Please call <LOCAL_PHONE> today"
    assert masked[200].text == "plain words only" and masked[201].text is None and masked[202].text == rows[-1][1]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.summarise(P.find(df)).count() == 0 and P.mask(df).count() == 0
    one = spark.createDataFrame([(1, "no data")], "doc_id long, text string")
    assert [tuple(r) for r in P.summarise(P.find(one)).collect()] == [(1, 0, 0, 0, 0, "", "")]


def test_added_spans_never_overlap_and_masks_are_the_spans(spark):
    r = random.Random(2)
    bits = ["Call Dr. Anna Smith", "jo.doe (at) mail (dot) com", "(212) 555-1234", "212-555-1234-99", "123-45-6789", "a.b@c.de", "4111 1111 1111 1111", "+1 (619) 555-0053", "Mr Paul.Jones [at] x.org", "é", "words"]
    rows = [(i, "".join(r.choice(bits) + r.choice([" ", "", ", "]) for _ in range(12)), "own") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    spans, texts = {}, {i: t for i, t, _ in rows}
    for x in P.find(df).where("kind is not null").collect():
        spans.setdefault(x.doc_id, []).append((x.start, x.end, x.kind, x.base))
        assert texts[x.doc_id][x.start : x.end] == x.match
    masked = {x.doc_id: x.text for x in P.mask(df).collect()}
    for i, t, _ in rows:
        own = sorted(spans.get(i, []), key=lambda s: (s[0], -s[1], P.KINDS.index(s[2])))
        added = [s for s in own if not s[3]]
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in added for b in own if a is not b)
        out, at = [], 0
        for a, b, kind, _ in own:
            if a >= at:
                out += [t[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert masked[i] == "".join(out) + t[at:]
