"""Boards that answer in pages, as a Spark data source: which pages a board is asked for, when to stop, and failures that are told.

A board is asked for one page after the other, since each answer says whether there is another one; different boards are different partitions' work, so a scan of
many boards is spread over the cluster. What answers is a recording: a row for each page that was fetched (``PAGE``), written by ``record`` so that all pages of a board
are in one file. A live scan only puts another ``Answers`` in its place.

The rules, by kind of board:

* ``smartrecruiters``: pages of 100 from an offset; the last one is empty or short; no more than ``most`` postings, for which the last page may be asked for less.
* ``workday``: pages of 20 from an offset; only the first page tells the total, later ones say 0; an empty page or the total ends it, as does ``most`` postings before a page.
* ``jsearch``: numbered pages of each query, ``pages`` at most; a refusal (429) ends this and all later queries of the board, an answer that can't be read ends its query, other
  failures and answers without postings only cost their page.

Any other status than 200 on the first two kinds, or an answer that can't be read, fails the board: it gives a row with the error and no pages, and the others go on.

Defined cases: pages that were never recorded count as empty ones; null payloads can't be read; an unknown kind is a failure; empty recordings give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.rounds import work_folder

PAGE = "board string, kind string, query int, start long, status int, payload string"
SCHEMA = "board string, kind string, query int, start long, payload string, error string"
#: Postings of a page, and where they stand in it.
SIZES = {"smartrecruiters": 100, "workday": 20}
ITEMS = {"smartrecruiters": "content", "workday": "jobPostings", "jsearch": "data"}


class Failed(Exception):
    """What a board is told to have failed with."""


@dataclass
class Answers:
    """The recorded pages of one board, by query and start."""

    pages: dict[tuple[int, int], tuple[int, str | None]] = field(default_factory=dict)
    asked: int = 0

    def get(self, query: int, start: int) -> tuple[int, str | None]:
        self.asked += 1
        return self.pages.get((query, start), (200, "{}"))


def _read(payload: str | None) -> dict:
    try:
        page = json.loads(payload or "")
    except ValueError:
        page = None
    if not isinstance(page, dict):
        raise Failed("the answer can't be read")
    return page


def _items(page: dict, kind: str, most: int | None = None) -> int:
    found = page.get(ITEMS[kind]) or []
    if not isinstance(found, list):
        raise Failed("the answer can't be read")
    if most is not None and len(found) > most:
        page[ITEMS[kind]] = found[:most]
    return len(page.get(ITEMS[kind]) or [])


def by_offset(answers: Answers, kind: str, most: int) -> list[tuple[int, int, str]]:
    """(query, start, payload) of the pages that count."""
    out, have, total = [], 0, None
    while have < most:
        status, payload = answers.get(0, have)
        if status != 200:
            raise Failed(f"HTTP {status}")
        page = _read(payload)
        wanted = min(SIZES[kind], most - have) if kind == "smartrecruiters" else None
        n = _items(page, kind, wanted)
        if total is None:
            total = page.get("total") or 0
        if not n:
            break
        out.append((0, have, json.dumps(page)))
        have += n
        if (n < SIZES[kind]) if kind == "smartrecruiters" else (total and have >= total):
            break
    return out


def by_number(answers: Answers, queries: list[int], pages: int) -> list[tuple[int, int, str]]:
    out = []
    for query in queries:
        for number in range(1, pages + 1):
            status, payload = answers.get(query, number)
            if status == 429:
                return out
            if status == 200:
                try:
                    if _items(_read(payload), "jsearch"):
                        out.append((query, number, payload))
                except Failed:
                    break
    return out


def scanned(board: str, kind: str, answers: Answers, most: int, pages: int) -> Iterator[tuple]:
    """The rows of one board: its pages, or its failure."""
    try:
        if kind not in ITEMS:
            raise Failed(f"no reader for {kind}")
        found = by_number(answers, sorted({q for q, _ in answers.pages}), pages) if kind == "jsearch" else by_offset(answers, kind, most)
    except Failed as e:
        yield board, kind, None, None, None, str(e)
        return
    yield from ((board, kind, *page, None) for page in found)


@dataclass
class File(InputPartition):
    path: str


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most, self.pages = options["path"], int(options.get("most", 300)), int(options.get("pages", 2))

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        return [File(x.path) for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")]

    def read(self, partition: File) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        board, kind, answers = None, "", Answers()
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(1000):
                for row in batch.to_pylist():
                    if board is not None and row["board"] != board:
                        yield from scanned(board, kind, answers, self.most, self.pages)
                        answers = Answers()
                    board, kind = row["board"], row["kind"]
                    answers.pages.setdefault((row["query"] or 0, row["start"]), (row["status"], row["payload"]))
        if board is not None:
            yield from scanned(board, kind, answers, self.most, self.pages)


class RecordedBoards(DataSource):
    """``spark.read.format("recorded_boards").option("path", folder)``: the pages that count, and a row for each board that failed. Options: most, pages."""

    @classmethod
    def name(cls) -> str:
        return "recorded_boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)


def record(pages: DataFrame, name: str) -> str:
    """Writes fetched pages (``PAGE``) so that those of a board follow each other in one file; the folder's address."""
    folder = f"{work_folder(pages.sparkSession)}/millrace/{name}-{uuid.uuid4().hex}"
    named = pages.where("board is not null").select(*[c.split()[0] for c in PAGE.split(", ")])
    named.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "board").sortWithinPartitions("board", "query", "start", F.col("status")).write.parquet(folder)
    return folder


def read(spark: SparkSession, folder: str, most: int = 300, pages: int = 2) -> DataFrame:
    spark.dataSource.register(RecordedBoards)
    return spark.read.format("recorded_boards").option("path", folder).option("most", str(most)).option("pages", str(pages)).load()
