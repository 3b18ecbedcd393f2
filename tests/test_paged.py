"""Paged boards against recorded answers that hold more than what may count."""

import json

import pytest
from millrace.sources import boards, paged
from millrace.sources.paged import Answers, Failed, by_number, by_offset


def smart(n, first=0):
    return 200, json.dumps({"content": [{"id": str(first + k), "name": f"Job {first + k}"} for k in range(n)]})


def day(n, total):
    return 200, json.dumps({"jobPostings": [{"title": f"t{k}", "externalPath": f"/{k}"} for k in range(n)], "total": total})


def found(n):
    return 200, json.dumps({"data": [{"job_title": "x"}] * n})


def sizes(pages, key):
    return [(q, s, len(json.loads(p)[key])) for q, s, p in pages]


def test_offsets_stop_at_short_and_empty_pages():
    a = Answers({(0, 0): smart(100), (0, 100): smart(30), (0, 130): smart(100), (0, 200): smart(100)})
    assert sizes(by_offset(a, "smartrecruiters", 300), "content") == [(0, 0, 100), (0, 100, 30)] and a.asked == 2
    a = Answers({(0, 0): smart(100)})
    assert len(by_offset(a, "smartrecruiters", 300)) == 1 and a.asked == 2
    a = Answers({(0, 100 * k): smart(100) for k in range(5)})
    assert sizes(by_offset(a, "smartrecruiters", 240), "content") == [(0, 0, 100), (0, 100, 100), (0, 200, 40)] and a.asked == 3
    assert by_offset(Answers(), "smartrecruiters", 300) == []


def test_only_the_first_page_tells_the_total():
    a = Answers({(0, 0): day(20, 45), **{(0, 20 * k): day(20, 0) for k in range(1, 9)}})
    assert [s for _, s, _ in by_offset(a, "workday", 300)] == [0, 20, 40] and a.asked == 3
    a = Answers({(0, 0): day(20, 0), (0, 20): day(20, 1)})  # no total: until a page is empty
    assert len(by_offset(a, "workday", 300)) == 2 and a.asked == 3
    a = Answers({(0, 0): day(20, 99), (0, 20): day(7, 0), (0, 27): day(20, 0)})  # a short page doesn't end it
    assert len(by_offset(a, "workday", 300)) == 3
    a = Answers({(0, 20 * k): day(20, 999) for k in range(30)})
    assert len(by_offset(a, "workday", 50)) == 3


def test_refusals_hold_for_all_later_queries():
    a = Answers({(0, 1): found(2), (0, 2): (500, None), (1, 1): found(1), (1, 2): (429, "quota"), (2, 1): found(9), (3, 1): found(9)})
    assert [(q, n) for q, n, _ in by_number(a, [0, 1, 2, 3], 2)] == [(0, 1), (1, 1)] and a.asked == 4
    a = Answers({(0, 1): (200, "<html>"), (0, 2): found(1), (1, 1): (200, "{}"), (1, 2): found(1), (1, 3): found(1)})
    assert [(q, n) for q, n, _ in by_number(a, [0, 1], 2)] == [(1, 2)]


@pytest.mark.parametrize("answer", [(401, None), (422, "x"), (500, ""), (200, "<html>"), (200, None), (200, "[1]"), (200, '{"content": 3, "jobPostings": 3}')])
@pytest.mark.parametrize("kind", ["smartrecruiters", "workday"])
def test_failures(kind, answer):
    first = smart(100) if kind == "smartrecruiters" else day(20, 99)
    for pages in ({(0, 0): answer}, {(0, 0): first, (0, paged.SIZES[kind]): answer}):
        with pytest.raises(Failed):
            by_offset(Answers(pages), kind, 300)


def test_a_scan_of_many_boards(spark):
    rows = []
    for k in range(30):
        if k % 3 == 0:
            rows += [(f"s{k}", "smartrecruiters", 0, 100 * i, *smart(100 if i < 2 else 50, 100 * i)) for i in range(5)]
        elif k % 3 == 1:
            rows += [(f"w{k}", "workday", 0, 20 * i, *((401, None) if k == 7 and i == 1 else day(20, 40 if i == 0 else 0))) for i in range(6)]
        else:
            rows += [(f"j{k}", "jsearch", q, n, *found(3)) for q in range(2) for n in range(1, 5)]
    rows += [("odd", "other", 0, 0, 200, "{}"), ("none", "workday", 0, 0, 200, None), (None, "workday", 0, 0, 200, "{}")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], paged.PAGE + ", note string").repartition(5)
    got = paged.read(spark, paged.record(df, "test"), pages=2)
    assert {(r.board, r.error) for r in got.where("error is not null").collect()} == {("w7", "HTTP 401"), ("odd", "no reader for other"), ("none", "the answer can't be read")}
    counted = {r.board: r["count"] for r in got.where("error is null").groupBy("board").count().collect()}
    assert counted == {**{f"s{k}": 3 for k in range(0, 30, 3)}, **{f"w{k}": 2 for k in range(1, 30, 3) if k != 7}, **{f"j{k}": 4 for k in range(2, 30, 3)}}
    assert got.rdd.getNumPartitions() > 1
    postings = boards.paged(got)
    assert {r.source: r["count"] for r in postings.groupBy("source").count().collect()} == {"SmartRecruiters": 10 * 250, "Workday": 9 * 40, "JSearch": 10 * 12}
    assert postings.where("source = 'SmartRecruiters' and company = 's3'").select("link").distinct().count() == 250
    assert paged.read(spark, paged.record(df.limit(0), "empty")).count() == 0
