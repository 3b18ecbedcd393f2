"""All operators on the same odd table: nulls in every column, empty and very long texts, repeated rows and clashing names."""

import pytest
from millrace.llm import decontaminate, langid, lattice, mixing, ordinal, pii, secrets, simhash, substrings
from pyspark.sql import functions as F

LONG = "the of and word9 x@y.org " * 20_000
ROWS = [
    (None, "the of and to in is that was", "en", "s1"), (None, None, None, None), (1, "", "en", None), (2, "\n \t", None, "s1"), (3, LONG, "fr", "s1"), (4, LONG, "fr", "s2"),
    (5, "z" * 200_000, "en", "s2"), (6, "日本語 のテキスト 😀", "ja", "s2"), (7, "the of and to", "en", "s1"), (7, "the of and to", "en", "s1"), (8, "\x00 odd \x85 bytes", "en", "s1"),
]
CLASH = ["n_words", "fp", "component_id", "size", "target", "copies", "score", "kind", "start", "match", "uid", "word", "pack", "grp", "__text", "train", "held_out", "grade", "rid", "node", "items"]

OPERATORS = {
    "op2": lambda d, b: langid.predict(d, train_docs=50, calibrate_docs=10),
    "op3": lambda d, b: mixing.mix(d),
    "op4": lambda d, b: pii.summarise(pii.find(d)),
    "op5": lambda d, b: substrings.remove_repeats(d),
    "op6": lambda d, b: simhash.near_duplicates(d),
    "op7": lambda d, b: ordinal.grade(d, d.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade")).where("doc_id is not null").distinct(), rounds=3),
    "op8": lambda d, b: secrets.summarise(secrets.find(d)),
    "op9": lambda d, b: decontaminate.scan_documents(d, b),
    "op10": lambda d, b: lattice.score_texts(d),
}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("own") for c in CLASH}).repartition(3)
    bench = spark.createDataFrame([(None, "word9 x y org"), (1, None), (1, "the of and to in is that was"), (2, "")], "item_id long, text string")
    return docs, bench


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(tables, name):
    docs, bench = tables
    got = OPERATORS[name](docs, bench).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_all_null_and_empty(tables, name):
    docs, bench = tables
    nulls = docs.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes])
    assert OPERATORS[name](nulls, bench.limit(0)).count() == 1
    assert OPERATORS[name](docs.limit(0), bench).count() == 0


def test_passing_operators_keep_all_columns(tables):
    docs, bench = tables
    for out in (langid.keep_identified(docs, train_docs=50, calibrate_docs=10), decontaminate.decontaminate(docs, bench), pii.mask(docs)):
        assert out.columns == docs.columns and out.count() >= 1
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert "x@y.org" not in masked[3] and masked[3].count("<EMAIL>") == 20_000 and masked[6] == ROWS[7][1]
