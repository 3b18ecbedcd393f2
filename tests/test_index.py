"""Look-ups of phrases against a scan of all texts."""

import random
import re

import duckdb
import pytest
from millrace.operators import index
from millrace.plans import more
from millrace.plans.queries import ORACLE_SQL

R = random.Random(11)
WORDS = ["the"] * 12 + ["of"] * 6 + [f"w{k}" for k in range(12)] + ["É", "日本", "a1"]


def words(text):
    return [x for x in re.findall(r"[^\W_]+", (text or "").lower())]


def plain(docs, queries, most):
    out = []
    for qid, phrases in queries:
        ps = []
        for p in map(words, phrases or []):
            if p and p not in ps:
                ps.append(p)
        exact, broad = [], []
        for i, text in docs:
            w = words(text)
            starts = [[k for k in range(len(w)) if w[k : k + len(p)] == p] for p in ps]
            if ps and all(starts):
                exact.append((-sum(map(len, starts)), i, starts[0][0], False))
            if ps and all(x in w for p in ps for x in p):
                own = {x for p in ps for x in p}
                broad.append((-sum(x in own for x in w), i, min(k for k, x in enumerate(w) if x in own), True))
        out += [(qid, k + 1, i, at, -n, b) for k, (n, i, at, b) in enumerate(sorted(exact or broad)[:most])]
    return sorted(out)


@pytest.fixture(scope="module")
def docs():
    rows = [(k, "".join(R.choice(WORDS) + R.choice([" ", ", ", " - ", "\n"]) for _ in range(R.randrange(60)))) for k in range(120)]
    return [*rows, (900, None), (901, ""), (902, "the " * 5000), (903, "The the, THE")]


@pytest.mark.parametrize("hot,most", [(100_000, 5), (10, 3)])
def test_search(spark, docs, hot, most):
    queries = []
    for k in range(150):
        w = words(R.choice(docs)[1]) or ["the"]
        cut = lambda: " ".join(w[(a := R.randrange(len(w))) : a + R.randrange(1, 4)])  # noqa: B023, E731
        queries.append((k, [R.choice([cut(), cut().upper(), R.choice(WORDS), "the the", "of"]) for _ in range(R.randrange(1, 4))]))
    queries += [(500, ["unknownword the"]), (501, []), (502, None), (503, ["", "--"]), (504, ["the", "The!"]), (505, ["the the the the"]), (506, ["w0 w1 w2"]), (507, ["w5 a1 w5"])]
    df = spark.createDataFrame(docs, "id long, x string").repartition(4)
    got = index.search(index.build(df, "id", "x", hot), spark.createDataFrame(queries, "qid long, phrases array<string>").repartition(3), most)
    assert sorted(map(tuple, got.collect())) == plain(docs, queries, most)
    assert {r.broad for r in got.collect()} == {True, False}


def test_hot_words_are_dealt(spark, docs):
    made = index.build(spark.createDataFrame(docs, "id long, x string"), "id", "x", 10)
    the = made.postings.where("term = 'the'")
    assert the.select("bucket").distinct().count() > 5 and the.count() == made.terms.where("term = 'the'").first().df
    assert made.postings.where("term = 'a1'").count() and made.terms.count() == len({w for _, t in docs for w in words(t)})


def test_snippets(spark, docs):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x a b"), (3, "b")], "id long, x string")
    found = index.search(index.build(df, "id", "x"), spark.createDataFrame([(7, ["a b"]), (8, ["F G"]), (9, ["q"])], "qid long, phrases array<string>"))
    got = {r.qid: r.text for r in index.snippets(found, df, "id", "x", before=2, length=4).collect()}
    assert got == {7: "a b c d x a b", 8: "d e f g"}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, x string")
    assert index.search(index.build(none, "id", "x"), spark.createDataFrame([(1, ["a"])], "qid long, phrases array<string>")).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_blocks_and_repeated_queries(spark, docs, kind):
    own = [(k if kind == "long" else f"t{k}", t) for k, t in docs]
    queries = [(k, [["the of"], ["w1 the", "of"], ["w3 w1 of"], ["w7"], ["w2", "nowhere"]][k % 5]) for k in range(100)]
    made = index.build(spark.createDataFrame(own, f"id {kind}, x string").repartition(4), "id", "x", 20)
    got = index.search(made, spark.createDataFrame(queries, "qid long, phrases array<string>"), 4, block=300)
    assert sorted(map(tuple, got.collect())) == plain(own, queries, 4)


def test_only_the_bests_of_a_block_leave_it(spark, docs, monkeypatch):
    """What is written for queries of hot words doesn't grow with the texts that hold them."""
    written = {}
    once = index.materialise
    monkeypatch.setattr(index, "materialise", lambda df, name: written.setdefault(name, once(df, name)))
    made = index.build(spark.createDataFrame(docs, "id long, x string"), "id", "x")
    written.clear()
    index.search(made, spark.createDataFrame([(k, ["the of the"]) for k in range(50)] + [(99, ["of w1 the"])], "qid long, phrases array<string>"), 3).collect()
    assert max(df.count() for name, df in written.items() if name != "asked") <= 6


def test_queries_read_whole_pages(spark, tmp_path):
    """Finds far behind a page's first 3000 characters, in the queries as in their SQL."""
    filler = " ".join(f"fill{k}" for k in range(700))
    pages = [(3, "u", "<p>a b c d e one two three f four five g</p>"), (1, "u", f"<p>{filler} one two three x four five</p>"), (2, "u", f"<p>{filler} four five</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = [tuple(r) for r in more.phrase_lookup(spark, str(tmp_path)).where("qid = 3").orderBy("rank").select("rank", "id", "at", "n", "broad").collect()]
    assert found == [(1, 1, 700, 2, False), (2, 3, 5, 2, False)]
    text = more.phrase_snippets(spark, str(tmp_path)).where("qid = 3").first().text
    assert text == "fill695 fill696 fill697 fill698 fill699 one two three x four five a b c d e one two three f four five g"
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name, query in (("phrase_lookup", more.phrase_lookup), ("phrase_snippets", more.phrase_snippets)):
        got = query(spark, str(tmp_path))
        want = con.execute(f"select {', '.join(f'\"{c}\"' for c in got.columns)} from ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
