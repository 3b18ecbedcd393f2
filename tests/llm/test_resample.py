"""Resampling against a plain model that writes every feature out."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from millrace.llm import resample
from millrace.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def features(text, longest=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def model(docs, bench, least=20, percent=25, buckets=10_000, longest=2):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(of(f) for x in bench for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for doc, text in docs:
        words, own = features(text, longest)
        weight = sum(gain(of(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
        rows.append([len(words), doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((*r[1:], ranks.get(id(r))) for r in rows), key=str)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == model(docs, bench)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_ring(longest):
    words = b"the cat sat on the cat \xe6\x97\xa5 sat".split()
    want = Counter(zlib.crc32(b" ".join(words[i : i + k])) % 1000 for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    assert Counter(resample.crc_ring(words, longest, 1000)) == want
    assert resample.crc_ring([], longest, 1000) == []


def test_longer_runs_and_more_buckets(spark):
    texts = ["One two, three FOUR five " * (k % 7) + f"word{k % 5} end" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([("two three four",), (None,)], "text string")
    got = resample.resample(docs, bench, longest=3, buckets=100_000, least_words=5, percent=40).drop("n_words")
    assert sorted(map(tuple, got.collect()), key=str) == model(list(enumerate(texts)), ["two three four", None], 5, 40, 100_000, 3)


def test_ranks_of_equal_scores_and_parts(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("s")).repartition(7)
    got = resample.ranked(rows, F.desc("s"), F.asc("id")).orderBy("rank").collect()
    want = sorted(((r.id, r.s) for r in got), key=lambda r: (-r[1], r[0]))
    assert [(r.id, r.s, r["rank"]) for r in got] == [(*w, k + 1) for k, w in enumerate(want)]


def test_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(None, words), (None, words), (1, None), (2, ""), (3, "x " * 300_000), (4, words), (4, words)]
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, rank string, weight int")
    bench = spark.createDataFrame([(words,), ("",)], "text string")
    got = resample.resample(docs, bench, percent=100).collect()
    assert sorted((r.n_words, r.n_features) for r in got) == [(0, 0), (0, 0), *[(30, 59)] * 4, (300_000, 599_999)]
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4, 5] and all(r["rank"] is None and r.weight == 0 for r in got if not r.n_words)
    assert resample.resample(docs.limit(0), bench).count() == 0
    assert resample.resample(docs, bench.limit(0)).count() == len(rows)
