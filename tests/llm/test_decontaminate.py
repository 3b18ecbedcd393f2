import os
import random
import re

import pytest
from millrace.llm import decontaminate as D
from millrace.llm.common import work_folder
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text, items, window=10):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, t in items:
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(window, len(ws))
        for s in range(len(ws) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == ws[s : s + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def cases():
    r = random.Random(3)
    word = lambda: r.choice(["a", "B", "c9", "é", "x y"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 2, 4, 5, 12, 15, 25])))) for i in range(8)] + [(90, None), (91, ""), (92, "--")]
    docs = [(i, r.choice([", ", " ", "\n"]).join(word() for _ in range(r.choice([0, 1, 3, 30, 120])))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, items[5][1]), (103, f"q q {items[6][1].upper()}. q"), (103, f"q q {items[6][1].upper()}. q")]
    return docs, items


@pytest.mark.parametrize(("window", "max_words", "automaton_words"), [(4, 10**6, 10**6), (10, 10**6, 10**6), (4, 20, 20), (4, 10**6, 0), (10, 10**6, 20), (4, 60, 7)])
def test_against_brute_force(spark, window, max_words, automaton_words):
    docs, items = cases()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, items string, __x int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.scan_documents(df, bench, window=window, max_words=max_words, automaton_words=automaton_words).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted((i, *brute(t, items, window)) for i, t in docs)


def test_cut_text_and_coverage(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    passage = "One two three, four five six seven eight nine ten ELEVEN"
    rows = [(1, f"Before it. {passage}! And " + "then more " * 12, "a"), (2, passage, "b"), (3, "clean Text stays", "c"), (4, None, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("__text", "__match", "n_words")})
    got = {r.doc_id: r for r in D.decontaminate(df, bench).collect()}
    assert got[1].text == "Before it. ! And " + "then more " * 12
    assert set(got) == {1, 3, 4} and got[3].text == "clean Text stays" and got[4].text is None and got[1].source == "a"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:3] for r in D.scan_documents(docs, bench).collect()] == [(1, 2, 0)]
    assert D.scan_documents(docs.limit(0), bench).count() == 0


def test_two_million_words_of_benchmark_in_one_pass(spark):
    """Documents are read once and nothing is written; repeated passages share an automaton."""
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(r.choices(vocabulary, k=100))) for k in range(20_000)]
    docs = [(k, " ".join(r.choices(vocabulary, k=60)) + " " + (" ".join(items[k][1].split()[20:35]) if k % 3 == 0 else "") + " end") for k in range(300)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    had = set(os.listdir(work_folder(spark).removeprefix("file://"))) if os.path.isdir(work_folder(spark).removeprefix("file://")) else set()
    steps = lambda: set(os.listdir(os.path.join(work_folder(spark).removeprefix("file://"), "millrace"))) if "millrace" in had else set()
    before = steps()
    got = D.scan_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench)
    plan = got._jdf.queryExecution().executedPlan().toString()
    rows = {x.doc_id: x for x in got.collect()}
    assert steps() == before and plan.count("MapInArrow") == 1
    assert all((x.n_hit, x["items"]) == ((15, [str(k)]) if k % 3 == 0 else (0, [])) for k, x in rows.items()) and len(rows) == 300
