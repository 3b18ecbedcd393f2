"""Steps that are written to the cluster's shared folder, and decisions that are taken over links in rounds."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset (local runs and tests) is a temporary
    folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: The lists of steps of the contexts that are open in this thread, the outermost first.
_open: ContextVar[tuple[list[tuple[DataFrame, str]], ...]] = ContextVar("open steps", default=())


def _written(df: DataFrame, path: str) -> DataFrame:
    for steps in _open.get():
        steps.append((df, path))
    return df


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is materialised inside, by this thread, is deleted at the end, save what is given to the function that this yields. For work that ends
    inside, so that nothing lazy needs the steps any more. Other threads' steps are theirs."""
    steps: list[tuple[DataFrame, str]] = []
    kept: list[DataFrame] = []
    before = _open.set((*_open.get(), steps))
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _open.reset(before)
        for df, path in steps:
            if not any(df is k for k in kept):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    This cuts the lineage in a way that survives lost executors: what follows rereads files and recomputes nothing.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _written(spark.read.schema(df.schema).parquet(path), path)


def materialise_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``materialise``, but bucketed by ``key``, so that later joins on it move only the other side."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    table, buckets = f"millrace_{name}_{tag}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{work_folder(spark)}/millrace/{name}-{tag}"
    try:
        df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
        found = spark.table(table)
        found.schema  # resolved now: the files stay when the name goes
    finally:
        spark.sql(f"drop table if exists {table}")
    return _written(found, path)


#: Bytes of the batches of rows that go to Python at once.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of a batch to ``BATCH_BYTES``: texts may be long, and the bound by rows alone lets a
    batch of them take a tenth of an executor."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgtp]?)[a-z]*", spark.conf.get(name, "1g").lower()).groups()
    if int(number) * 1024 ** "bkmgtp".index(unit or "b") > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Links that one task settles to the end.
FEW_LINKS = 200_000


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links that are left -> b of the rows that go: each row is decided once all rows before it are."""
    after: dict[object, list[object]] = {}
    waits: dict[object, int] = {}
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            after.setdefault(a, []).append(b)
            waits[b] = waits.get(b, 0) + 1
    ready, gone, done = [a for a in after if a not in waits], set(), 0
    while ready:
        a = ready.pop()
        done += 1
        for b in after.get(a, ()):
            waits[b] -= 1
            if a not in gone:
                gone.add(b)
            if not waits[b]:
                ready.append(b)
    if done < len(after.keys() | waits.keys()):
        raise ValueError("links run in a circle")
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(gone), kind)], ["b"])


def settle(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """b of the rows that go, each once. links (a, b): b is like a, and a comes before b.

    In order, a row goes if one that is like it and comes before stays. In each round the rows that nothing before is left for stay, and what is
    like them goes; the first row of all is one of these, so each round settles some. Rounds settle all but long chains soon; the last ``few`` links, a
    fixed bound, are settled in order by one task, so that a chain costs no round a link. Only a chain of more than ``few`` links takes more rounds, one for every second link beyond.
    """
    gone: list[DataFrame] = []
    links = materialise(links.select("a", "b").distinct(), "links")
    while (left := links.count()) > few:
        stay = links.select("a").distinct().join(links.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = materialise(links.join(stay, "a", "left_semi").select("b").distinct(), "gone")
        if now.isEmpty():
            raise ValueError("links run in a circle")
        gone.append(now)
        links = materialise(links.join(now, "b", "left_anti").join(now.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"), "links")
    found = links.select("b").limit(0) if not left else links.coalesce(1).mapInArrow(_in_order, f"b {links.schema['b'].dataType.simpleString()}")
    for x in gone:
        found = found.union(x)
    return found
