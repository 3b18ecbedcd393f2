import numpy as np
from millrace.llm import ordinal as Q


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(1)
    model = Q.Ordinal(4)
    model.weights = rng.standard_normal(1 << Q.BITS) * 0.3
    model.steps = np.array([-0.5, 0.2, -0.1])
    bags = [np.unique(rng.integers(0, 50, 12)).astype(np.uint32) for _ in range(40)]
    grade = rng.integers(0, 4, 40)
    got = model.gradient(grade, bags)
    for k in [0, 7, 49, (1 << Q.BITS), (1 << Q.BITS) + 1, (1 << Q.BITS) + 2]:
        values = []
        for d in (1e-5, -1e-5):
            other = Q.Ordinal(4)
            other.weights, other.steps = model.weights.copy(), model.steps.copy()
            if k < 1 << Q.BITS:
                other.weights[k] += d
            else:
                other.steps[k - (1 << Q.BITS)] += d
            values.append(other.gradient(grade, bags)[-1])
        assert np.isclose(got[k], (values[0] - values[1]) / 2e-5, rtol=1e-4, atol=1e-6)
    assert (np.diff(model.thresholds()) > 0).all()


def test_held_out_order(spark):
    rng = np.random.default_rng(2)
    rows, grades = [], []
    for i in range(900):
        g = int(rng.integers(0, 3))
        words = [f"w{rng.integers(0, 300)}" for _ in range(30)] + [["scum", "idiot"][i % 2]] * (g == 0) + ["noise%%%"] * (3 * (g == 1))
        rows.append((i, " ".join(words), "x"))
        grades.append((i, g))
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, grade string").repartition(4)
    labels = spark.createDataFrame([*grades[:600], (9999, 1), (4, None)], "doc_id long, grade int")
    got = {r.doc_id: r for r in Q.grade(docs, labels, least=1).collect()}
    assert len(got) == 902 and abs(got[5000].expected_grade - got[5001].expected_grade) < 1e-9
    held = grades[600:]
    assert np.mean([got[i].selected == (g >= 1) for i, g in held]) > 0.95
    assert np.mean([round(got[i].expected_grade) == g for i, g in held]) > 0.8
    for r in got.values():
        assert r.tails == sorted(r.tails, reverse=True) and abs(sum(r.tails) - r.expected_grade) < 1e-9


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert [tuple(r) for r in Q.grade(docs, none).collect()] == [(1, None, None, False, None)]
    assert Q.grade(docs.limit(0), none).count() == 0


def dense_fit(x, grade, grades, penalty, rounds=4000, rate=0.5):
    """The same model by plain gradient descent over dense features."""
    w, cut = np.zeros(x.shape[1]), np.linspace(1.0, -1.0, grades - 1)  # tails fall with g: P(>= g) = s(w.x + cut_g)
    for _ in range(rounds):
        tail = np.hstack([np.ones((len(x), 1)), 1 / (1 + np.exp(-(x @ w)[:, None] - cut[None])), np.zeros((len(x), 1))])
        at = np.arange(len(x))
        up, low = tail[at, grade], tail[at, grade + 1]
        du, dl = up * (1 - up) / (up - low), low * (1 - low) / (up - low)
        w += rate * ((du - dl) @ x / len(x) - penalty * w)
        for g in range(1, grades):
            cut[g - 1] += rate * (du[grade == g].sum() - dl[grade == g - 1].sum()) / len(x)
    return 1 / (1 + np.exp(-(x @ w)[:, None] - cut[None]))


def test_equals_a_dense_fit(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(12)]
    docs, grades = [], []
    for i in range(400):
        own = [w for w in words if rng.random() < 0.4]
        docs.append((i, " ".join(own)))
        grades.append((i, int(np.clip(round(len(set(own) & set(words[:4])) - len(set(own) & set(words[4:7])) + rng.normal()), 0, 3))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.tails for r in Q.grade(frame, spark.createDataFrame(grades, "doc_id long, grade int"), penalty=0.01, rounds=300).collect()}
    bags = [Q.features(t.encode()) for _, t in docs]
    names = np.unique(np.concatenate(bags))
    x = np.array([np.isin(names, b) for b in bags], float)
    want = dense_fit(x, np.array([g for _, g in grades]), 4, 0.01)
    np.testing.assert_allclose(np.array([got[i] for i, _ in docs]), want, atol=0.02)
    assert all(t == sorted(t, reverse=True) for t in got.values())


def test_an_unsettled_fit_says_so(spark):
    import pytest

    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)], "doc_id long, grade int")
    with pytest.warns(UserWarning, match="settled"):
        Q.grade(docs, labels, rounds=2).collect()
