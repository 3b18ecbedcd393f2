import numpy as np
from millrace.llm import ann as A


def brute(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, m = np.array([i for i, _ in ok]), np.stack([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            s = m @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_and_scores(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in t.collect()]
    got, want = result(A.search(t)), brute(rows)
    assert recall(got, want) >= 0.9
    by = dict(rows)
    for q, found in got.items():
        for i, s in found:
            assert abs(s - np.dot(by[q], by[i])) < 1e-9


def test_exact_with_all_lists_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).round(2).tolist()) for i in range(300)]
    same = rng.standard_normal(8).tolist()
    rows += [(i, same) for i in range(300, 420)]
    rows += [(500, None), (520, [0.0] * 8), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] * 8), (580, [1.0]), (None, same), (300, same)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, did int").repartition(3)
    want = brute([r for r in rows[:-1] if r[0] != 580])
    for options in ({"probes": 10**6}, {"probes": 10**6, "list_rows": 30, "query_rows": 4}):
        got = result(A.search(df, **options))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert {q: [i for i, _ in x] for q, x in result(A.search(df)).items()} == {0: [20, 3], 20: [3, 0]}
    assert A.search(df.limit(0)).count() == 0
    assert A.search(df.where("vec_id = 0")).count() == 0


def test_limits_from_elsewhere_abandon_what_is_farther():
    rng = np.random.default_rng(7)
    rows, queries = rng.standard_normal((3000, 65)), rng.standard_normal((20, 65))
    d = ((queries[:, None] - rows[None]) ** 2).sum(axis=2)
    near = np.sort(d, axis=1)[:, 20]
    of, at = A.scan(queries, rows, 21)
    tight_of, tight_at = A.scan(queries, rows, 21, near * 0.5)
    assert len(tight_of) < 0.2 * len(of) and (d[tight_of, tight_at] <= near[tight_of] * 0.5).all()
    want = {(q, r) for q in range(20) for r in np.flatnonzero(d[q] <= near[q])}
    assert len(want & set(zip(of.tolist(), at.tolist(), strict=True))) >= 0.97 * len(want)
    few_of, few_at = A.scan(queries, rows[:30], 21, near * 0.9)
    assert (d[few_of, few_at] <= near[few_of] * 0.9).all()
