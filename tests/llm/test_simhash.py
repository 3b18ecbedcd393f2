import random

import numpy as np
import pytest
import xxhash
from millrace.llm import simhash as S


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=4):
    label = dict(fps)
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i < j and (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in label}


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_against_brute_force(spark, bucket_rows):
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n)) for n in [3, 4, 5, 40, 200, 300, 300, 300]]
    texts = [None, "", " \n", "One", "one\ttwo", *base]
    for t in base:
        for _ in range(12):
            words = t.split()
            words[r.randrange(len(words))] = "q"
            texts.append(" ".join(words))
    texts += [base[5]] * 20
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int").repartition(3)
    got = {r.doc_id: r for r in S.near_duplicates(df, bucket_rows=bucket_rows).collect()}
    fps = [(i, brute_print(t)) for i, t in docs]
    assert {i: g.fp & (2**64 - 1) for i, g in got.items()} == dict(fps)
    assert {i: g.component_id for i, g in got.items()} == brute_components(fps)


def test_tree_finds_every_link():
    r = np.random.default_rng(1)
    center = r.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in center for a, b in r.integers(0, 64, (30, 2))], np.uint64))
    label = S.bucket_labels(fps, 4)
    want = brute_components(list(enumerate(map(int, fps))))
    assert {i: int(x) for i, x in enumerate(label)} == want


@pytest.mark.parametrize("m", [1000, 4000, 16_000])
def test_edges_stay_few_in_a_split_bucket(spark, m):
    r = np.random.default_rng(3)
    flips = [int(np.bitwise_or.reduce(np.uint64(1) << r.choice(64, 4, replace=False).astype(np.uint64))) for _ in range(2 * m)]
    fps = list(dict.fromkeys(f - 2**64 if f >= 2**63 else f for f in flips))[:m]
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long").repartition(3)
    edges = S.near_links(nodes, bucket_rows=256)
    assert edges.count() <= 15 * m  # a tree for each of the 15 keys at most, however many cells
    if m == 1000:
        got = {x.node: x.component for x in S.components(edges).collect()}
        assert {i: got.get(i, i) for i in range(m)} == brute_components([(i, f & (2**64 - 1)) for i, f in enumerate(fps)])


def test_long_paths_settle_in_few_rounds(spark):
    r = random.Random(6)
    place = list(range(20_000))
    r.shuffle(place)
    edges = spark.createDataFrame(list(zip(place, place[1:], strict=False)), "u long, v long").repartition(4)
    got = S.components(edges, max_rounds=20)
    assert got.where("component <> 0").count() == 0 and got.count() == 19_999


def test_null_ids_take_part_alone(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text), (5, text + " x"), (3, text + " y z"), (None, "other words here altogether now")]
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), max_bits=12).collect()}
    assert {(5, 3), (3, 3)} <= got and (None, None) in got


def test_chain_and_star_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(200 + i, 100) for i in range(30)] + [(300, 100), (500, 500)]
    got = {r.node: r.component for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in [*range(200, 230), 300])


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
