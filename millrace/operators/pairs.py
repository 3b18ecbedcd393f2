"""All pairs of similar sets within blocks, each compared once: for low similarities, where nearly all pairs share a token that would make them meet.

The rows of a block are dealt to chunks of about ``ROWS``, and each two chunks of it, or one with itself, are a cell. A cell counts what its sets share: the tokens that most
of them have are bits of a few words, so a pair costs an AND and a popcount for each word, and the others add one where they meet. The work grows with the square of a block
as the pairs do; a cell holds two chunks and counts for ``TILE`` rows at a time, and what it finds leaves it in batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.rounds import materialise, small_batches

#: Rows of a chunk, rows that are counted against a chunk at once, pairs that are compared for each partition, pairs of a batch.
ROWS, TILE, PAIRS, BATCH = 16_000, 64, 20_000_000, 100_000
#: Words of bits at most, and the time of a shared token of the others to that of a word.
WORDS, DEAR = 16, 3


class Side:
    """Rows of a cell, the smaller sets first: their sizes, the bits of the tokens that many have, and the others' tokens by row and rows by token."""

    def __init__(self, order: np.ndarray, size: np.ndarray, row: np.ndarray, code: np.ndarray, place: np.ndarray, words: int) -> None:
        self.order = order[np.argsort(size[order], kind="stable")]
        self.size = size[self.order]
        at = np.full(len(size), -1, np.int64)
        at[self.order] = np.arange(len(order))
        own = at[row] >= 0
        row, code = at[row[own]], place[code[own]]
        self.bits = np.zeros((words, len(order)), np.uint64)
        many = code < 64 * words
        np.bitwise_or.at(self.bits, (code[many] // 64, row[many]), np.uint64(1) << (code[many] % 64).astype(np.uint64))
        row, code = row[~many], code[~many] - 64 * words
        by_row, by_code = np.argsort(row, kind="stable"), np.lexsort((row, code))
        self.codes, self.of_row = code[by_row], np.searchsorted(row[by_row], np.arange(len(order) + 1))
        self.rows, self.of_code = row[by_code], np.searchsorted(code[by_code], np.arange(len(place) + 1))


def _needed(most: int, least: float) -> np.ndarray:
    """How many tokens two sets must share, by the sum of their sizes."""
    out = np.empty(most + 1, np.int64)
    for total in range(most + 1):
        k = max(1, math.floor(least * total / (1 + least)) - 1)
        while 2 * k <= total and k / (total - k) < least:
            k += 1
        out[total] = k
    return out


def met(sets: pa.ListArray, of: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x, y and the similarity of the pairs with at least ``least``: of rows of side 0 with those of side 1, or with each other if there is no side 1."""
    size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    found = sets.flatten().dictionary_encode()
    code, row = found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
    both = of.any()
    counts = [np.bincount(code[of[row] == s], minlength=len(found.dictionary)).astype(np.float64) for s in ((0, 1) if both else (0, 0))]
    shared = counts[0] * counts[1]
    order = np.argsort(-shared, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    gain = np.add.reduceat(shared[order], np.arange(0, len(order), 64)) if len(order) else np.zeros(0)
    words = min(WORDS, max(1, int((gain * DEAR > np.count_nonzero(of == 0) * np.count_nonzero(of == both)).sum())))
    a = Side(np.flatnonzero(of == 0), size, row, code, place, words)
    b = Side(np.flatnonzero(of == 1), size, row, code, place, words) if both else a
    most = int(size.max(initial=0))
    kind = np.uint8 if most < 255 else np.int32
    needed = _needed(2 * most, least)
    edges = np.flatnonzero(np.diff(a.size, prepend=-1, append=-1)) if len(a.size) else np.zeros(1, np.int64)
    for start, end in zip(edges[:-1], edges[1:], strict=True):  # rows of one size need the same
        own = needed[a.size[start] + b.size]
        enough = np.where(own <= np.minimum(a.size[start], b.size), own, most + 1).astype(kind)
        for k in range(start, end, TILE):
            rows = np.arange(k, min(k + TILE, end))
            first = 0 if both else k  # among themselves, pairs with later rows only
            count = np.zeros((len(rows), len(b.size) - first), kind)
            for w in range(words):
                count += np.bitwise_count(a.bits[w, rows][:, None] & b.bits[w, first:][None, :])
            codes = a.codes[a.of_row[k] : a.of_row[rows[-1] + 1]]
            line = np.repeat(np.arange(len(rows)), np.diff(a.of_row[k : rows[-1] + 2]))
            many = b.of_code[codes + 1] - b.of_code[codes]
            at = b.rows[np.repeat(b.of_code[codes + 1] - np.cumsum(many), many) + np.arange(many.sum())] - first
            line = np.repeat(line, many)[at >= 0]
            np.add.at(count.reshape(-1), line * count.shape[1] + at[at >= 0], kind(1))
            x, y = np.nonzero(count >= enough[first:])
            n = count[x, y].astype(np.int64)
            x, y = x + k, y + first
            if not both:
                x, y, n = (v[y > x] for v in (x, y, n))  # y last
            if len(x):
                yield a.order[x], b.order[y], n / (a.size[x] + b.size[y] - n)


def _in_cells(least: float, kind: pa.DataType):
    """Rows (cell, side, ord, tokens), each cell's together -> x, y, similarity"""

    def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids, sets = rows.column("ord").combine_chunks(), rows.column("tokens").combine_chunks()
        for x, y, similarity in met(sets, rows.column("side").to_numpy(), least):
            for k in range(0, len(x), BATCH):
                one = slice(k, k + BATCH)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[one])).cast(kind), ids.take(pa.array(y[one])).cast(kind), pa.array(similarity[one])], ["x", "y", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("no", "i", "j")], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if parts and cell != tuple(keys[a]):
                    yield from found(parts)
                    parts = []
                cell = tuple(keys[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from found(parts)

    return run


def compared(rows: DataFrame, least: float, chunk: int | None = None) -> DataFrame:
    """a, b, similarity: pairs of ``rows`` (block, tokens, ord) of a block with at least the similarity, each once. Rows without a block or order value meet none."""
    spark = rows.sparkSession
    small_batches(spark)
    chunk = chunk or ROWS
    rows = rows.where("block is not null and ord is not null")
    blocks = rows.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    blocks = materialise(blocks.select("block", "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"), F.monotonically_increasing_id().alias("no")), "blocks")
    pairs = blocks.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    partitions = min(5000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS)))
    dealt = rows.join(blocks, "block").withColumn("own", F.pmod(F.xxhash64("ord"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    side = (F.col("own") > F.col("other")).cast("int").alias("side")
    dealt = dealt.select("no", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "ord", "tokens")
    dealt = dealt.repartition(partitions, "no", "i", "j").sortWithinPartitions("no", "i", "j", "side")
    kind = rows.schema["ord"].dataType
    found = dealt.mapInArrow(_in_cells(least, to_arrow_type(kind)), f"x {kind.simpleString()}, y {kind.simpleString()}, similarity double")
    return found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
