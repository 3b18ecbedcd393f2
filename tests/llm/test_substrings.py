import random

import numpy as np
import pytest
from millrace.llm import substrings as S


def brute(docs, window=13):
    words = [[w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def cases():
    r = random.Random(8)
    passages = [" ".join(f"p{k}w{r.randint(0, 5)}" for _ in range(n)) for k, n in enumerate([12, 13, 14, 40, 90])]
    docs = []
    for i in range(60):
        parts = [r.choice(passages) if r.random() < 0.3 else " ".join(r.choice(["the", "of", "é", "A"]) + str(r.randint(0, 99)) for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 6))]
        docs.append((r.randint(0, 10**9), "\n".join(parts)))
    docs += [(docs[3][0] + 1, docs[3][1]), docs[4], (7, None), (8, ""), (None, docs[9][1]), (10**12, "x " * 60), (5, "x " * 40)]
    return docs


@pytest.mark.parametrize("group_rows", [2_000_000, 300, 20, 4])
def test_against_brute_force(spark, group_rows):
    docs = cases()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, places int").repartition(3)
    got = S.remove_repeats(df, group_rows=group_rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(docs)
    assert all(sum(s.words for s in r.repeats) == r.n_removed for r in got)


def test_groups_stay_small():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 13, dtype=np.uint64)[np.arange(3000) % 13]
    words = np.concatenate([words, rng.integers(0, 2**63, 9000, dtype=np.uint64)])
    codes = S.path_codes(words, 13, np.arange(len(words) - 12))
    counts = np.array([np.bincount(S._bins(c, 16), minlength=1 << 16) for c in codes])
    group = S.Plan(counts, 500).of(codes)
    assert group.min() >= 0 and np.bincount(group).max() <= 500


def test_subtree_has_the_deep_nodes():
    rng = np.random.default_rng(2)
    for _ in range(30):
        table = rng.integers(0, 3, (rng.integers(1, 60), 5)).astype(np.int32)
        order, shared = S.subtree(table)
        rows = [tuple(table[i]) for i in order]
        assert rows == sorted(map(tuple, table.tolist()))
        want = [0] + [next((k for k in range(5) if a[k] != b[k]), 5) for a, b in zip(rows, rows[1:], strict=False)]
        assert shared.tolist() == want
        for depth in (1, 3, 5):
            assert len(S.deep_nodes(shared, depth)) == len({r[:depth] for r in rows})


def maximal(docs, window=13):
    """By brute force the maximal runs of words in repeated windows: (doc_id, first word, words)."""
    words = [(t or "").split() for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [any(first.get(tuple(w[k : k + window]), i) < i for k in range(max(0, j - window + 1), j + 1) if k + window <= len(w)) for j in range(len(w))]
        out += [(i, j, next((e for e in range(j, len(w)) if not gone[e]), len(w)) - j) for j in range(len(w)) if gone[j] and (not j or not gone[j - 1])]
    return sorted(out)


def test_maximal_repeats_and_equal_codes(spark, monkeypatch):
    """Also where unlike windows have equal codes: words decide."""
    docs = [(i, t) for i, (_, t) in enumerate(cases())]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    spans = lambda: sorted((r.doc_id, s.start, s.words) for r in S.remove_repeats(df, group_rows=300).collect() for s in r.repeats)
    assert spans() == maximal(docs)


def test_equal_codes_of_unlike_windows():
    import zlib

    import zstandard

    texts = [b" ".join(b"%d" % (k % 7 + j) for k in range(40)) for j in range(3)]
    table = np.stack([np.ones(3, np.int64), np.zeros(3, np.int64), np.array([len(t) for t in texts])])
    pack = S.Pack(zlib.compress(table.tobytes()), zstandard.compress(b"".join(texts)), 13)
    pack.codes = [c * np.uint64(0) for c in pack.codes]
    first, of = S.distinct(pack, np.arange(len(pack.docs)))
    got, own = pack.windows(first[of]), pack.windows(np.arange(len(pack.docs)))
    assert (got == own).all()


def test_stretches_cover_the_windows():
    starts = np.array([3, 4, 9, 30, 31, 70])
    places, at = S.stretches(starts, 13)
    assert places.tolist() == [*range(3, 22), *range(30, 44), *range(70, 83)]
    assert places[at].tolist() == starts.tolist()


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 5)
    text = b" ab  cdefghij k\tl\n\nmnopq r"
    assert [w for part in S._pieces(text) for w in part] == text.split()


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = S.remove_repeats(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r)[:4] for r in one] == [(1, 2, 0, "a b")]


def test_every_window_is_hot(spark):
    df = spark.createDataFrame([(i, "x " * 50) for i in range(40)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(df, group_rows=8).collect()}
    assert got == {i: 50 * (i > 0) for i in range(40)}
