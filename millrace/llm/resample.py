"""Resampling documents towards a target distribution by the importance of their hashed word runs.

Every run of 1 to ``longest`` words is a feature, in the bucket of its bytes' crc32. One scan over a document keeps a ring of the zlib states of
the last ``longest`` starts: the next word and the space before it extend each of them, and every state is the crc32 of one feature, so
no feature is ever put together as a string. The ratio of a bucket's share in the target to its share in the documents is its gain, a document's weight is the mean gain of its features,
and Gumbel noise from the document's id on top makes the documents with the highest scores a weighted draw without replacement.

How it scales: the documents are scanned once; two bytes a feature are written (four from 65,536 buckets on), and texts never
travel. Tasks sum their buckets' counts before the shuffle, so it moves ``buckets`` rows a task at most and the gains, ``buckets`` numbers, are
broadcast. Ranks come from a range sort of (score, doc_id) that is written once; each part's first rank is the number of rows in the parts before, so no task and no
driver sees the order as a whole. Equal scores are split between parts by doc_id.

Defined cases: a null or empty text has no words, weight 0 and is never drawn; a null doc_id counts as an empty one in the noise and comes last among equal scores; repeated rows
are documents of their own, with ranks of their own; without a target all gains follow from the documents alone; an empty table gives no
rows; a very long text takes memory for its words and its buckets; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.rounds import materialise
from millrace.llm.common import partitions_for, pick
from millrace.llm.decontaminate import words_of

#: Bits of a row's place within its part in a monotonically increasing id.
PLACE = 33


def crc_ring(words: list[bytes], longest: int, buckets: int) -> list[int]:
    """The buckets of all runs of 1 to ``longest`` words."""
    out: list[int] = []
    ring: list[int] = []  # the states of the last starts, newest first
    more = longest - 1
    for word in words:
        spaced = b" " + word
        ring = [crc32(word), *[crc32(spaced, state) for state in ring[:more]]]
        out += ring
    return [state % buckets for state in out]


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _scan(longest: int, buckets: int):
    """(doc_id, text) -> doc_id, n_words, n_features, the buckets of the features as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                n_words, sizes, found = [], [], []
                for text in batch.column(1).to_pylist():
                    words = words_of(text) if text else []
                    own = crc_ring(words, longest, buckets)
                    n_words.append(len(words))
                    sizes.append(len(own))
                    found.append(np.array(own, _kind(buckets)).tobytes())
                cols = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "found"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words, n_features and ``found``, the features' buckets in the order of the text."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scan(longest, buckets), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, found binary")


def bucket_counts(scanned: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: how many features of all rows are in it, buckets without any left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(found, _kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return scanned.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the documents, floored."""
    s_all, t_all = float(sum(own.values())), float(sum(target.values()))
    return np.array([floor(1000 * log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((own.get(b, 0) + 1.0) * (t_all + buckets)))) for b in range(buckets)], np.int64)


def _weights(shared, buckets: int):
    """(doc_id, n_words, n_features, found) -> the same with the weight instead of the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_pylist()
            sums = [int(shared.value[np.frombuffer(x, _kind(buckets))].sum()) for x in batch.column(3).to_pylist()]
            weight = pa.array([x // k if k else 0 for x, k in zip(sums, n, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank``, the place (from 1) of each row in the order, without a task for all of them."""
    n = partitions_for(rows.sparkSession)
    parts = materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", PLACE).alias("__part")
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    firsts = parts.groupBy(part).agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.col("__at").bitwiseAND(F.lit((1 << PLACE) - 1)) + 1
    return parts.select("*", part).join(F.broadcast(firsts), "__part").withColumn("rank", F.col("__before") + place).drop("__part", "__before", "__at")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 2, buckets: int = 10_000,
    least_words: int = 20, percent: int = 25, seed: int = 7,
) -> DataFrame:
    """A row for each document: doc_id, n_words, n_features, weight, score, rank. Of the documents with ``least_words`` words or more,
    ``percent`` in a hundred are drawn (rounded down) and have a rank, from 1 by falling score, then doc_id."""
    spark = docs.sparkSession
    scanned = materialise(scan(docs, id_col, text_col, longest, buckets), "buckets")
    wanted = scan(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text")), longest=longest, buckets=buckets)
    tables = [{r["bucket"]: r["n"] for r in bucket_counts(x, buckets).collect()} for x in (scanned, wanted)]  # ``buckets`` rows at most
    shared = spark.sparkContext.broadcast(gains(*tables, buckets))
    kind = scanned.schema["doc_id"].dataType.simpleString()
    weighed = scanned.mapInArrow(_weights(shared, buckets), f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight")]
    first = ranked(able, *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
