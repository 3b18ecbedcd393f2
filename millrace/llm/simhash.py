"""SimHash near-duplicate groups by a Gray-order hierarchical index.

A document's fingerprint has a bit for every bit position that is set in more than half of the XXH64 hashes (seed 42) of
its word shingles. Documents whose fingerprints differ in few bits are linked; a group is a connected component.

How it scales: documents with the same fingerprint collapse to one row (partial aggregation, so a hot group of copies is
no hot task). The 64 bits are cut into ``max_bits + 2`` blocks; two fingerprints within ``max_bits`` bits agree in at least two blocks, so
every pair of blocks gives a bucket key and no link is lost. In a bucket the fingerprints are sorted by Gray rank and
factored into a tree whose nodes hold the bits that all their members share. Two nodes whose shared bits differ in more
than ``max_bits`` places are dropped with all pairs below them. A bucket above ``bucket_rows`` is split into cells, and each
pair of cells is searched by a task of its own. A bucket gives a spanning forest rooted at smallest nodes, never all its pairs, and a pair of cells
only joins the trees of its cells, so the edges for each fingerprint stay few however large its group is. Components come from
alternating large-star and small-star steps over the forest's edges. The block keys are a pre-split of the tree: by ranges of Gray rank alone a task would have to meet all ranges within
``max_bits`` bits of its own leading bits, thousands of them at scale.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other; fewer words than a shingle
give one shingle of the whole sequence; repeated rows each give a row; an empty table gives no rows; extra columns are
ignored; rows with a null doc_id get a fingerprint and, alone under it, a null component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounds import passing_steps
from millrace.llm.common import LOWER_BYTES, materialise, partitions_for, pick

#: Hashes whose bits are unpacked at once.
BLOCK = 1 << 15
#: Members of a leaf node and children of an upper node.
FAN = 16
#: Pairs of nodes that are opened at once.
PAIRS = 2048


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed number; 0 without hashes."""
    hashes, ones = hashes.astype(">u8"), np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp: a row for each document."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of each 64-bit pattern in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _level(bits: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parents of FAN nodes each: the bits that all members share, and where they are."""
    at = np.arange(0, len(bits), FAN)
    ones = np.bitwise_and.reduceat(bits & masks, at)
    zeros = np.bitwise_and.reduceat(~bits & masks, at)
    return ones, ones | zeros


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place the smallest place that the earlier labels and the pairs connect it with."""
    a, b = label[a], label[b]
    a, b = a[a != b], b[a != b]
    while len(a):
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def bucket_labels(fps: np.ndarray, max_bits: int, label: np.ndarray | None = None) -> np.ndarray:
    """For each place in ``fps`` the smallest place that links within ``max_bits`` bits reach; the search runs from the top
    of the tree. label: places that are known to be connected. Two nodes below which all is connected aren't opened."""
    label = np.arange(len(fps)) if label is None else label
    order = np.argsort(gray_rank(fps), kind="stable")
    levels = [(fps[order], np.full(len(fps), ~np.uint64(0)))]
    while len(levels[-1][0]) > 1:
        levels.append(_level(*levels[-1]))
    a = b = np.zeros(1, np.int64)
    leaves = np.arange(0, len(fps), FAN)
    for depth in range(len(levels) - 2, -1, -1):
        bits, masks = levels[depth]
        near_first = np.argsort(b - a, kind="stable")
        a, b = a[near_first], b[near_first]
        kept, at = [], 0
        while at < len(a):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            at += PAIRS
            if not depth:
                own = label[order]
                low, high = np.minimum.reduceat(own, leaves), np.maximum.reduceat(own, leaves)
                open_ = (low[x] != high[x]) | (low[y] != high[y]) | (low[x] != low[y])
                x, y = x[open_], y[open_]
            i = (x[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
            j = (y[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
            keep = (i <= j) & (j < len(bits))
            i, j = i[keep], j[keep]
            near = np.bitwise_count((bits[i] ^ bits[j]) & masks[i] & masks[j]) <= max_bits
            if depth:
                kept.append((i[near], j[near]))
            else:
                label = forest(label, order[i[near]], order[j[near]])
        if depth:
            a, b = (np.concatenate(x) for x in zip(*kept, strict=True))
    return label


def _least(label: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each place the smallest node of its tree."""
    low = node.copy()
    np.minimum.at(low, label, node)
    return low[label]


def _search(max_bits: int):
    """The function for ``mapInArrow`` over rows sorted by (bucket, lo, hi): edges (node, smallest node of its tree) of a forest
    by bucket. A pair of different cells gives no edges within a cell, only one for each of the cells' trees that it joins."""

    def edges(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        node, fp, cell, _, lo, hi = cols
        found_a, found_b = [], []
        sizes = np.diff(starts)
        whole = lo[starts[:-1]] == hi[starts[:-1]]
        small = np.repeat((sizes <= FAN) & whole, sizes)
        run = np.repeat(np.arange(len(sizes)), sizes)
        for d in range(1, FAN):  # a leaf alone: all its members
            at = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if len(run) > d else np.empty(0, np.int64)
            if not len(at):
                break
            at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= max_bits]
            found_a.append(at)
            found_b.append(at + d)
        label = forest(np.arange(len(fp)), np.concatenate([*found_a, np.empty(0, np.int64)]), np.concatenate([*found_b, np.empty(0, np.int64)]))
        u, v = [node], [_least(label, node)]
        for k in np.flatnonzero((sizes > FAN) | ~whole):
            part = slice(starts[k], starts[k + 1])
            fps, own = fp[part], node[part]
            if whole[k]:
                u.append(own)
                v.append(_least(bucket_labels(fps, max_bits), own))
                continue
            inner = np.arange(len(fps))
            for side in (lo[starts[k]], hi[starts[k]]):
                at = np.flatnonzero(cell[part] == side)
                inner[at] = at[bucket_labels(fps[at], max_bits)]
            u.append(_least(inner, own))
            v.append(_least(bucket_labels(fps, max_bits, inner), own))
        u, v = np.concatenate(u), np.concatenate(v)
        pairs = np.unique(np.stack([u, v])[:, u != v], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[1] = cols[1].view(np.uint64)
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[3:]], axis=0)) + 1
            last = new[-1] if len(new) else 0
            rest = [c[last:] for c in cols]
            if last:
                yield edges([c[:last] for c in cols], np.concatenate([[0], new]))
        if rest is not None:
            yield edges(rest, np.array([0, len(rest[0])]))

    return run


def near_links(nodes: DataFrame, max_bits: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """Edges (u, v) that connect just the rows of ``nodes`` (node, fp; fp distinct) within ``max_bits`` bits."""
    spark = nodes.sparkSession
    blocks = max_bits + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for k, (i, j) in enumerate(combinations(range(blocks), 2)):
        wide = cuts[j + 1] - cuts[j]
        keys.append(F.lit(k << 48).bitwiseOR(F.shiftleft(part[i], wide)).bitwiseOR(part[j]))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("bucket"))
    hot = rows.groupBy("bucket").count().where(F.col("count") > 1)
    cells = rows.join(hot, "bucket").withColumn("cells", F.ceil(F.col("count") / bucket_rows).cast("int"))
    cells = cells.withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cells = cells.select("node", "fp", "cell", "bucket", F.least("cell", "other").alias("lo"), F.greatest("cell", "other").alias("hi"))
    cells = cells.repartition(partitions_for(spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return cells.mapInArrow(_search(max_bits), "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node reachable) for each node of ``edges`` (u, v)."""
    with passing_steps(edges.sparkSession) as keep:
        edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        state = None
        for _ in range(max_rounds):
            both = edges.union(edges.select("v", "u"))
            low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("low"))
            small = large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", "low"))
            edges = materialise(small.distinct(), "edges")
            after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first())
            if after == state:
                break
            state = after
        else:
            raise RuntimeError(f"components have not settled in {max_rounds} rounds")
        return keep(edges).select(F.col("u").alias("node"), F.col("v").alias("component"))


def grouped(prints: DataFrame, max_bits: int = 4, bucket_rows: int = 8192) -> DataFrame:
    """fp, component_id (the smallest doc_id that links reach) of each fingerprint of ``prints`` (doc_id, fp)."""
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    groups = components(near_links(nodes.where("node is not null"), max_bits, bucket_rows))
    return nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, bucket_rows: int = 8192, seed: int = 42,
) -> DataFrame:
    """A row for each document: doc_id, fp, component_id (the smallest doc_id that links reach, its own included)."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return prints.join(grouped(prints, max_bits, bucket_rows), "fp").select("doc_id", "fp", "component_id")
