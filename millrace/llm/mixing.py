"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words: the budget is shared by weight, a source takes at most ``most`` times its own words, and
what it can't take is shared again. A document of a source with rate r = target / words is taken floor(r) times, and
once more with probability r - floor(r). Those fractions are rounded in pairs: words are moved at random between two documents of a
source until one of the two fractions is 0 or 1. A pair's words stay as they are, and so does each document's expectation;
of a whole source one fraction is left at the end, so the words taken miss the target by one document at most.

How it scales: a source's documents are dealt by hash to chunks of about ``chunk_rows``, so a hot source is many tasks.
Each chunk streams through one task that holds a single open document. The one left of each chunk goes to the next level
of a tree, ``fan`` chunks to one, until every source has one. The random numbers are hashes of the documents, so reruns agree.

Defined cases: a null or empty text has size 0 and is never taken; null sources are a source, the last one; repeated rows are
documents of their own; weights repeat in the order of the sources' code points; an empty table gives no rows; a corpus without
words has targets 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialise, partitions_for

EPS = 1e-9
ROWS = "row long, source string, chunk long, doc_id {id}, size long, source_size long, target double, copies long, fraction double, left boolean"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, source, size in words, row (``row_col`` or null)."""
    row = (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).cast("binary").alias("text"), row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(t.split()) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(3)], ["doc_id", "source", "size", "row"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, size long, row long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n_docs, source_size, target: a row for each source.

    Sources whose limit is reached first come first: with limits and weights summed up in that order, the level (words for
    each unit of weight) at which the budget is spent follows in closed form.
    """
    plan = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    plan = plan.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    plan = plan.withColumn("own", level).withColumn("full", F.col("limit") <= F.col("own") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.struct(-F.col("limit") / F.col("weight"), "own"))).over(Window.partitionBy(F.lit(1)))["own"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), level * F.col("weight")))
    return plan.select("source", "n_docs", "source_size", target.alias("target"))


def _chance(seed: int, *parts) -> float:
    return xxhash.xxh64_intdigest(repr(parts).encode(), seed) / 2**64


def _pivotal(seed: int, last: bool):
    """Rows sorted by (source, chunk): all fractions become 0 or 1 but one a chunk, which is ``left``, or rounded if last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict | None = None
        key = None

        def close(row: dict) -> dict:
            if last:
                return row | {"fraction": 0.0, "left": False, "copies": row["copies"] + (_chance(seed, row["doc_id"], row["size"]) < row["fraction"])}
            return row | {"left": True}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["source"], row["chunk"]) != key:
                    if open_:
                        out.append(close(open_))
                    open_, key = None, (row["source"], row["chunk"])
                if not EPS < row["fraction"] < 1 - EPS:
                    out.append(_settled(row))
                    continue
                if open_ is None:
                    open_ = row
                    continue
                a, b = open_, row
                up = min((1 - a["fraction"]) * a["size"], b["fraction"] * b["size"])  # words that can go from b to a
                down = min(a["fraction"] * a["size"], (1 - b["fraction"]) * b["size"])
                moved = up if _chance(seed, a["doc_id"], a["size"], b["doc_id"], b["size"]) * (up + down) < down else -down
                a = a | {"fraction": a["fraction"] + moved / a["size"]}
                b = b | {"fraction": b["fraction"] - moved / b["size"]}
                open_ = None
                for x in (a, b):
                    if EPS < x["fraction"] < 1 - EPS and open_ is None:
                        open_ = x
                    else:
                        out.append(_settled(x))
            if out:
                yield pa.RecordBatch.from_pylist(out, batch.schema)
        if open_:
            yield pa.RecordBatch.from_pylist([close(open_)], batch.schema)

    return run


def _settled(row: dict) -> dict:
    return row | {"copies": row["copies"] + round(row["fraction"]), "fraction": 0.0, "left": False}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, chunk_rows: int = 2000, fan: int = 1000, seed: int = 7, row_col: str | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target (its source's), copies, taken (copies x size); row if there is a ``row_col``,
    an own number of each row, by which rows without a doc_id or with the same one are told apart."""
    spark = docs.sparkSession
    sized = materialise(sizes(docs, id_col, text_col, source_col, row_col), "sizes")
    plan = materialise(targets(sized, weights, share, most), "targets")
    p = plan.withColumnRenamed("source", "of")
    rate = F.least(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)), F.lit(float(most)))
    rows = sized.join(p, F.col("source").eqNullSafe(F.col("of")))
    chunk = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("n_docs") / chunk_rows))
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    rows = rows.select(
        "row", "source", chunk.cast("long").alias("chunk"), "doc_id", "size", "source_size", "target", F.floor("rate").alias("copies"),
        (F.col("rate") - F.floor("rate")).alias("fraction"), F.lit(False).alias("left"),
    )
    schema = ROWS.format(id=sized.schema["doc_id"].dataType.simpleString())
    chunks = plan.agg(F.max(F.ceil(F.col("n_docs") / chunk_rows))).first()[0] or 1
    done: list[DataFrame] = []
    while True:
        last = chunks <= 1
        dealt = rows.repartition(partitions_for(spark), "source", "chunk").sortWithinPartitions("source", "chunk", "doc_id", "size", "row")
        out = dealt.mapInArrow(_pivotal(seed + len(done), last), schema)
        if last:
            done.append(out)
            break
        out = materialise(out, "rounded")
        done.append(out.where("not left"))
        rows, chunks = out.where("left").withColumn("chunk", F.floor(F.col("chunk") / fan)), -(-chunks // fan)
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    return found.select(*["row"] * bool(row_col), "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
