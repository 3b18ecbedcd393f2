"""All pairs of similar sets against a plain loop."""

import random

import pytest
from millrace.operators import dedup, pairs
from pyspark.sql import functions as F


def plain(rows, least):
    out = {}
    for b, x, i in rows:
        for c, y, j in rows:
            if b is not None and b == c and i < j and (n := len(set(x) & set(y))) and n / (len(x) + len(y) - n) >= least:
                out[i, j] = n / (len(x) + len(y) - n)
    return out


def some(r, n, words, blocks):
    tokens = [f"w{min(int(r.expovariate(0.02)), words)}" for _ in range(5000)]
    return [(r.choice(blocks), sorted({r.choice(tokens) for _ in range(r.randint(1, 12))}), k) for k in range(n)]


@pytest.mark.parametrize(("chunk", "tile", "words", "kind"), [(16_000, 64, 16, "long"), (40, 7, 1, "long"), (1, 64, 16, "string"), (25, 1, 2, "string")])
@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_all_pairs(spark, monkeypatch, chunk, tile, words, kind, least):
    """Tokens as bits and by rows, in one cell and in many."""
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(pairs, "WORDS", words)
    r = random.Random(chunk)
    n = 60 if chunk == 1 else 300
    rows = some(r, n, 200, ["a", "b", "b", None]) + [("c", ["alone"], 900), ("d", [f"w{k}" for k in range(300)], 901), ("d", [f"w{k}" for k in range(2, 290)], 902), ("d", ["w1"], 903)]
    rows = [(b, x, k if kind == "long" else f"k{k:03}") for b, x, k in rows]
    df = spark.createDataFrame(rows, f"block string, tokens array<string>, ord {kind}").repartition(3)
    got = pairs.compared(df, least, chunk).collect()
    assert {(x.a, x.b): x.similarity for x in got} == plain(rows, least) and len(got) == len(plain(rows, least))


def test_empty(spark):
    assert pairs.compared(spark.createDataFrame([], "block string, tokens array<string>, ord long"), 0.3).count() == 0


def test_titles_that_nearly_all_share_a_token_are_not_joined(spark):
    """The pairs of low similarity of a block of common words are compared in place; rare words and high similarities still meet by token."""
    r = random.Random(3)
    common = [(k, "c", " ".join(sorted({f"tok{min(r.randrange(9), r.randrange(9))}" for _ in range(5)}) + [f"own{k}"])) for k in range(150)]
    rare = [(k, "c", f"word{k} word{k + 1}") for k in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "ord long, company string, title string")
    found = dedup.similar_pairs(frame(common), 0.3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    rows = [(b, sorted(set(t.split())), k) for k, b, t in common]
    assert {(x.a, x.b): x.similarity for x in found.collect()} == plain(rows, 0.3)
    for rows, least in ((common, 0.6), (rare, 0.3)):
        found = dedup.similar_pairs(frame(rows), least)
        assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {(x.a, x.b) for x in found.select("a", "b").collect()} == set(plain([(b, sorted(set(t.split())), k) for k, b, t in rows], least))
    assert found.agg(F.count("*")).first()[0] == 299
