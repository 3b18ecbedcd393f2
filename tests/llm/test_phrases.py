"""Phrases against a plain count of all word runs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from millrace.llm import phrases
from millrace.llm.phrases import Bitmap


def model(rows, least, longest=5, cover=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


WORDS = "the cat Sat on a mat New York city of light é 日本 x\x00y x\x85 mat".split(" ")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for k in range(300):
        text = "".join(rng.choice(["New York City", *WORDS]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?"]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "en", "fr", None]), text))
    return [*out, ("en", None), ("en", ""), (None, None), ("de", "eins zwei"), *[("en", "of the same copied line over and over")] * 40]


@pytest.mark.parametrize("shard_words,least,cover,top", [(4_000_000, 10, 100, 2000), (50, 10, 100, 2000), (200, 3, 60, 7), (1, 25, 100, 2000)])
def test_collocations(spark, rows, shard_words, least, cover, top):
    docs = spark.createDataFrame([(k, *r, "own", "own") for k, r in enumerate(rows)], "doc_id long, lang string, text string, n string, phrase string").repartition(3)
    assert mined(docs, least=least, cover=cover, top=top, shard_words=shard_words) == model(rows, least, cover=cover, top=top)


def test_no_rows_and_no_phrases(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert mined(docs.limit(0)) == [] and mined(docs, least=10**6) == []


def test_very_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rows = [("en", "one two three. four five, " * 30_000), ("en", "never ending " * 20_000)]
    assert mined(spark.createDataFrame(rows, "lang string, text string"), shard_words=1000) == model(rows, 100)
    monkeypatch.setattr(phrases, "SLICE", 10)
    parts = list(phrases._slices(b"a b c d e f g. h i j k l m n o, p q"))
    assert b"".join(parts) == b"a b c d e f g. h i j k l m n o, p q" and [p[-1:] for p in parts[:-1]] == [b".", b","]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**14
    got = phrases._cuts(
        spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 7)], "lang string, phrase string, k int, a long"),
        spark.createDataFrame([("en", 9 * 10**17)], "lang string, n long"),
    ).collect()
    assert [r.score for r in got] == [1000 * (big - 7) * 9 * 10**17 // (big * big)]


def test_bitmaps():
    rng = np.random.default_rng(1)
    for size in (1, 5, 64, 300, 5000):
        a, b = (np.flatnonzero(rng.random(size * 3) < p) for p in (0.3, 0.02))
        assert Bitmap.of(a).popcount() == len(a) and Bitmap.of(a).positions().tolist() == a.tolist()
        both = Bitmap.of(a).shifted() & Bitmap.of(b)
        assert both.positions().tolist() == sorted(set((a + 1).tolist()) & set(b.tolist()))
    edge = Bitmap.of(np.array([63, 127, 640])).shifted()
    assert edge.positions().tolist() == [64, 128, 641]


def test_packed_gaps():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 + 5, 7], np.int64)
    raw, n = phrases.packed(x)
    assert phrases.unpacked(raw).tolist() == x.tolist() and n.sum() == len(raw)
    assert phrases.unpacked(np.zeros(0, np.uint8)).tolist() == []
