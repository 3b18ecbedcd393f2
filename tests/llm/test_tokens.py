"""Token counts against the tokenizer over whole texts."""

import random

import pytest
from millrace.llm import tokens
from millrace.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
PARTS = ["the", "The", "don't", "we'll", " ", "  ", "\n", " \n ", "\t", "日本語", "привет мир", "é", "é", "1234", "12 34", "...", "--", "<|endoftext|>", "<|endof", "text|>", "😀👍🏽", " ", "　", "​", " ", "\x85", "\x1c", "a" * 40, "z" * 300, "x,y", "(q)", "'s", " 's", "\x00", "﻿", "᠎", "⁠"]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def texts(n, longest, glue=("", " ", " ", " ")):
    rng = random.Random(5)
    return ["".join(rng.choice(glue) + rng.choice(PARTS) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_stretches_are_tokenized_on_their_own(exact):
    counter = tokens.Counter(tokens.default_tokenizer())
    for text in texts(1500, 40):
        assert counter.count(text) == exact(text), repr(text)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (64, 32), (200, 20), (5000, 100)])
def test_chunks_are_spliced(spark, exact, chunk, overlap):
    rows = list(enumerate([*texts(150, 120), *texts(20, 120, ("",)), "z" * 3000, " " * 3000, "a b" * 900, "日本語" * 500, "word " * 700, "<|endoftext|>" * 100]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in tokens.count_tokens(docs, chunk_chars=chunk, overlap=overlap).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        assert (got[k].n_bytes, got[k].n_tokens) == (len(text.encode()), exact(text)), repr(text)


def test_runs_of_chunks_without_boundaries_between_good_ones(spark, exact):
    good = "some words go here and there, and more of them "
    rows = [(k, good * (k % 3 + 1) + "q" * (40 * k) + good * 3 + "日本" * (20 * k) + " " + good) for k in range(30)]
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=100, overlap=20).collect()}
    assert got == {k: exact(t) for k, t in rows}


def test_query(spark, exact):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_token_counts"](spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted((k, len(t.encode()), (n := exact(t)), n > 1024) for k, t in docs.items())


def test_odd_rows(spark, exact):
    long = "x@y.org, the end\n" * 40_000
    rows = [(None, "a b"), (None, None), (1, ""), (2, None), (3, long), (3, long), (4, "k" * 100_000)]
    docs = spark.createDataFrame([(*r, "own", 3) for r in rows], "doc_id long, text string, k string, n_tokens int")
    got = sorted(map(str, tokens.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens").collect()))
    assert got == sorted(f"Row(doc_id={k}, n_bytes={len((t or '').encode())}, n_tokens={exact(t or '')})" for k, t in rows)
    assert tokens.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, overlap=4)
