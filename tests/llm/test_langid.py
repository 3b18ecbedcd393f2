import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from millrace.llm import langid as L


def kneser_ney(texts, order=L.ORDER):
    """p(symbol | context) by the textbook's recursion over dictionaries."""
    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [0] * (order - 1) + L.symbols(t).tolist()
        for i in range(order - 1, len(s)):
            grams[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1
    totals, kinds = defaultdict(int), defaultdict(int)
    d = [0.0]
    for k in range(1, order + 1):
        once, twice = sum(n == 1 for n in grams[k].values()), sum(n == 2 for n in grams[k].values())
        d.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)
        for g, n in grams[k].items():
            totals[g[:-1]] += n
            kinds[g[:-1]] += 1

    def p(g, alphabet):
        if not g:
            return 1 / (alphabet + 1)
        below, total = p(g[1:], alphabet), totals[g[:-1]]
        if not total:
            return below
        return max(grams[len(g)][g] - d[len(g)], 0) / total + d[len(g)] * kinds[g[:-1]] / total * below

    return p, len(grams[1])


def fitted(spark, by_lang):
    rows = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate((x, t) for x, ts in by_lang.items() for t in ts)], "doc_id long, lang string, text string")
    return L.learn(rows.repartition(3), calibrate_docs=0)


def test_equals_the_textbook(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcd e.É") for _ in range(60)) for _ in range(12)]
    models, limits = fitted(spark, {"xx": texts})
    p, alphabet = kneser_ney(texts)
    for text in ["abc dÉa bzz q", "e", "日本 abcd", texts[0], "a" * 30]:
        s = [0] * (L.ORDER - 1) + L.symbols(text).tolist()
        want = [p(tuple(s[i - L.ORDER + 1 : i + 1]), alphabet) for i in range(L.ORDER - 1, len(s))]
        known = [i for i, c in enumerate(s[L.ORDER - 1 :]) if c in {x for t in texts for x in L.symbols(t).tolist()}]
        got = models.log_p(L.symbols(text))[:, 0]
        np.testing.assert_allclose(got[known], np.log(np.array(want)[known]), rtol=1e-4)
    assert limits == {}


def test_blocks_give_the_same_sums(spark, monkeypatch):
    models, _ = fitted(spark, {"xx": ["ab cd ab ce", "de ab"], "yy": ["xyz zyx", "zy"]})
    texts = ["ab cd zyx " * 50, None, "  ", "xy", "12 34", "ab"]
    whole, n = models.totals(texts)
    monkeypatch.setattr(L, "BLOCK", 7)
    parts, m = models.totals(texts)
    np.testing.assert_allclose(whole, parts, rtol=1e-6)
    assert n.tolist() == m.tolist() and n[1] == n[2] == n[4] == 0


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", None), (9002, "12 !", "fr", "s"), (None, "the of and", None, "s"), (9003, "", None, None)], "doc_id long, text string, lang string, source string")
    got = L.predict(docs.drop("n_chars").unionByName(odd).withColumn("score", odd_col())).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and by[9001].score == 0
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()


def odd_col():
    from pyspark.sql import functions as F

    return F.lit("a column of the operator's own name")


def test_nothing_to_learn(spark):
    rows = spark.createDataFrame([(1, "ab", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:4] for r in L.predict(rows).collect()] == [("und", 0.0)]
    assert L.predict(rows.limit(0)).count() == 0
    assert L.keep_identified(rows).count() == 1 and L.keep_identified(rows.limit(0)).count() == 0


def test_rejection_is_calibrated_on_unseen_documents(spark):
    """Texts of unknown languages are rejected, about one in a thousand known ones is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(3)
    strange = ["".join(r.choice("qxzjkvwy") for _ in range(6)) for _ in range(300)]
    odd = [(90_000 + i, " ".join(r.choice(strange) for _ in range(n)), "en", "s") for i, n in enumerate([20, 50, 100, 300] * 10)]
    rows = docs.drop("n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string").where("doc_id % 1 = 0"))
    learnt = L.learn(L._labelled(docs, "doc_id", "text", "lang", 4, 2).where("not held_out"))
    got = L.predict_with(L.pick(rows, doc_id="doc_id", text="text"), *learnt, ["doc_id"]).collect()
    assert not any(x.accepted for x in got if x.doc_id >= 90_000)
    known = [x.accepted for x in got if x.doc_id < 90_000 and x.symbols > 0]
    assert sum(known) >= 0.99 * len(known)
    z = np.abs(np.random.default_rng(1).standard_normal(4000))
    limits = L.calibrated([("xx", 1.4 + 0.1 * float(x), 10**6) for x in z], 0.01)
    assert abs(np.mean([not L.accepted_at(limits, "xx", 1.4 + 0.1 * float(x), 10**6) for x in z]) - 0.01) < 0.002


def test_many_languages_share_the_cells(spark):
    r = random.Random(5)
    rows = []
    for k in range(100):
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(40)]
        rows += [(1000 * k + i, f"l{k:03d}", " ".join(r.choice(words) for _ in range(40))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    train = docs.where("doc_id % 1000 < 9")
    models, limits = L.learn(train, cells=8_000_000)
    assert sum(x.size for x in models.logs) + sum(x.size for x in models.backs) <= 1.5 * 8_000_000
    got = L.predict_with(docs.where("doc_id % 1000 >= 9"), models, limits, ["lang"]).collect()
    assert len(got) == 300 and np.mean([x.lang == x.lang_pred for x in got]) >= 0.97
