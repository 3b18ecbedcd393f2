import random

import pytest
from millrace.llm import mixing as M


def brute_targets(size_of, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(x for x in size_of if x is not None) + [None] * (None in size_of)
    w = {x: weights[i % len(weights)] for i, x in enumerate(names)}
    left, full, target = share * sum(size_of.values()), set(), {}
    while True:
        rest = [x for x in names if x not in full]
        level = left / sum(w[x] for x in rest) if rest else 0
        over = [x for x in rest if level * w[x] > most * size_of[x]]
        if not over:
            return target | {x: level * w[x] for x in rest}
        for x in over:
            full.add(x)
            target[x] = most * size_of[x]
            left -= target[x]


def cases():
    r = random.Random(6)
    rows = [(i, r.choice(["a", "b", "c", "d", "Z", "é", None]) if i % 3 else "a", " ".join("w" * r.randint(0, 60))) for i in range(900)]
    return [*rows, (1, "a", "one two"), (1, "a", "one two"), (2000, "tiny", "x"), (2001, "empty", None), (2002, None, "")]


@pytest.mark.parametrize(("chunk_rows", "fan"), [(20_000, 1000), (20, 3)])
def test_targets_and_words(spark, chunk_rows, fan):
    rows = cases()
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, source string, text string, target double").repartition(5)
    got = M.mix(df, chunk_rows=chunk_rows, fan=fan).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, len((t or "").split())) for i, _, t in rows)
    size_of, taken = {}, {}
    for r in got:
        size_of[r.source] = size_of.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(size_of)
    for r in got:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(want[r.source])
    for x in want:
        assert abs(taken[x] - want[x]) <= max(r["size"] for r in got if r.source == x)
    again = M.mix(df.repartition(2), chunk_rows=chunk_rows, fan=fan).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in again) == sorted((r.doc_id, r["size"], r.taken) for r in got)


def test_expectation_is_kept(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i % 7)) for i in range(60)], "doc_id long, source string, text string")
    runs = [M.mix(df, chunk_rows=10, fan=2, seed=100 + k).collect() for k in range(12)]
    for s in "ab":
        rows = [r for x in runs for r in x if r.source == s]
        assert sum(r.copies for r in rows) / len(rows) == pytest.approx(rows[0].target / rows[0].source_size, abs=0.15)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert M.mix(df).count() == 0
    assert [tuple(r) for r in M.mix(spark.createDataFrame([(1, None, None)], df.schema)).collect()] == [(1, None, 0, 0, 0.0, 0, 0)]
