"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan within probed lists.

A further component turns the largest inner product into the smallest distance; all vectors are rotated by one random
rotation, so that a few leading components tell about the whole distance. Lists come from k-means. A query probes its
nearest lists: first its own, which gives the distance of its k-th best so far, then the others, which start from that distance. In a list, distances grow column block by column block; after each block a hypothesis test compares the
partial distance, scaled up to all components, with the distance of the query's k-th best, and candidates that are too far with high confidence are abandoned.
The survivors' inner products are computed in full, in double precision on the original vectors, and only those that beat the k-th best so far are passed on.

How it scales: equal vectors collapse to one with its ``k + 1`` smallest ids (no more can be among the k nearest), so a hot
vector is one row; queries with equal vectors are searched once. Centroids are fitted on a bounded sample
(``sample_rows``); every vector is indexed. Lists above ``list_rows`` vectors are dealt to several tasks, and so are their
queries above ``query_rows``. Only what may be among a query's best k + 1 is shuffled. What grows fastest is the work on data without clusters: there nearly half of the lists must be probed for
the recall asked for, so that with queries in proportion to the rows the scan is quadratic, however early candidates are abandoned.

Defined cases: vectors that are null, zero, of another length than most (the smaller one of equally frequent lengths), or that hold a null or non-finite component take no part, nor do
rows with a null id; repeated ids with equal vectors count once; an id with several vectors takes part with each of them; ties go to the smaller id; fewer
candidates than k give them all; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialise, pick

#: Components that are added to the partial distances at once.
COLUMNS = 16
#: Confidence of the test: candidates are abandoned beyond 1 + EPSILON / sqrt(components seen).
EPSILON = 1.2
#: Pairs of a query and a vector whose partial distances are held at once.
PAIRS = 1 << 20


def _collapsed(k: int, dims: int):
    """(vec_id, vec) -> equal vectors of a batch as one row with their k + 1 smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[bytes, list] = {}
            for i, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(vec, np.float64) + 0.0  # no negative zeros
                if len(x) == dims and np.isfinite(x).all() and x.any():
                    rows.setdefault(x.tobytes(), []).append(i)
            ids = [sorted(set(v))[: k + 1] for v in rows.values()]
            keys = [hashlib.md5(v).digest() for v in rows]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(rows), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["key", "vec", "ids"])

    return run


def _keyed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, vec in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(vec, np.float64) + 0.0
                if len(x) == dims and np.isfinite(x).all() and x.any():
                    ids.append(i)
                    keys.append(hashlib.md5(x.tobytes()).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["query_id", "key"])

    return run


def k_means(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """n centroids of the sample; empty ones are moved to random rows."""
    rng = np.random.default_rng(seed)
    centers = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centers, 1)[:, 0]
        counts = np.bincount(near, minlength=n)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, sample)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], sample[rng.integers(0, len(sample), n)])
    return centers


def nearest(rows: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    out = np.empty((len(rows), n), np.int64)
    square = (centers**2).sum(axis=1)
    step = max(1, (1 << 22) // len(centers))
    for at in range(0, len(rows), step):
        d = square - 2 * rows[at : at + step] @ centers.T
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(centers) else np.tile(np.arange(len(centers)), (len(d), 1))
        out[at : at + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


class Space:
    """The rotated space: the longest squared norm, the rotation, and the lists' centers."""

    def __init__(self, dims: int, longest: float, seed: int = 3) -> None:
        self.longest = longest
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims + 1, dims + 1)))
        self.turn = q * np.sign(np.diag(r))
        self.centers = np.zeros((1, dims + 1))

    def rows(self, vecs: np.ndarray) -> np.ndarray:
        """Rotated indexed vectors."""
        more = np.sqrt(np.maximum(0, self.longest - (vecs**2).sum(axis=1)))
        return np.hstack([vecs, more[:, None]]) @ self.turn

    def queries(self, vecs: np.ndarray) -> np.ndarray:
        """Rotated queries."""
        return np.hstack([vecs, np.zeros((len(vecs), 1))]) @ self.turn


def scan(queries: np.ndarray, rows: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the query's k nearest, by the adaptive dimension scan; queries ascend. limit: the squared distances
    of the queries' k-th best elsewhere."""
    n, dims = rows.shape
    limit = np.full(len(queries), np.inf) if limit is None else limit
    if n <= 2 * k and not np.isfinite(limit).all():
        return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
    edges = [*range(0, dims, COLUMNS), dims]
    partial = np.zeros((len(queries), n))
    of, at = None, None
    for a, b in zip(edges, edges[1:], strict=False):
        if of is None:  # all pairs are left
            q, r = queries[:, a:b], rows[:, a:b]
            partial += (q**2).sum(axis=1)[:, None] + (r**2).sum(axis=1) - 2 * q @ r.T
            if n > 2 * k:
                best = np.argpartition(partial, k - 1, axis=1)[:, :k]
                limit = np.minimum(limit, ((rows[best] - queries[:, None]) ** 2).sum(axis=2).max(axis=1))
        else:
            partial += ((rows[at, a:b] - queries[of, a:b]) ** 2).sum(axis=1)
        slack = (1 + (EPSILON / np.sqrt(b) if b < dims else 1e-9)) ** 2
        if of is None:
            keep = partial * (dims / b) <= (limit * slack)[:, None]
            if b == dims or keep.mean() < 0.5:
                of, at = np.nonzero(keep)
                partial = partial[of, at]
        else:
            keep = partial * (dims / b) <= limit[of] * slack
            of, at, partial = of[keep], at[keep], partial[keep]
    return of, at


def _search(shared, k: int):
    """(cell, rows) with (cell, queries) -> the best k of each query in the cell that may be among its best k so far."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(rows) or not len(queries):
            return none
        space: Space = shared.value
        ids, least = rows["did"].to_numpy(), rows["least"].to_numpy()
        vecs = np.stack([np.frombuffer(v) for v in rows["vec"]])
        asked = np.stack([np.frombuffer(v) for v in queries["vec"]])
        turned, turned_queries = space.rows(vecs), space.queries(asked)
        least_score = queries["kth"].to_numpy(np.float64)
        limit = (asked**2).sum(axis=1) + space.longest - 2 * np.where(np.isnan(least_score), -np.inf, least_score)
        out, step = [], max(1, PAIRS // len(rows))
        for a in range(0, len(asked), step):
            of, at = scan(turned_queries[a : a + step], turned, k, limit[a : a + step] * (1 + 1e-9) + 1e-9)
            score = np.einsum("ij,ij->i", asked[a + of], vecs[at])
            keep = ~(score < least_score[a + of])
            of, at, score = of[keep], at[keep], score[keep]
            order = np.lexsort((least[at], -score, of))
            of, at, score = of[order], at[order], score[order]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            best = place < k
            out.append(pd.DataFrame({"query": queries["did"].to_numpy()[a + of[best]], "row": ids[at[best]], "score": score[best]}))
        return pd.concat(out)

    return run


def calibrated_probes(space: Space, sample: np.ndarray, k: int, share: float, queries: int = 200) -> int:
    """The fewest lists with which ``share`` of the sample's own k nearest neighbours (by brute force) are met."""
    asked = sample[: min(queries, len(sample))]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    top = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if not top.size:
        return 1
    home = nearest(space.rows(sample), space.centers, 1)[:, 0]
    order = nearest(space.queries(asked), space.centers, len(space.centers))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    need = np.sort(np.take_along_axis(place, home[top], 1).ravel())
    return int(need[min(len(need) - 1, int(share * len(need)))]) + 1


def _listed(shared, sizes: np.ndarray | None, probes: int, enough: int):
    """Adds the list of each vector, or, given the lists' sizes, the lists that a query probes: ``probes``, and more until
    they hold ``enough`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = np.stack([np.frombuffer(v) for v in batch.column(1).to_pylist()])
            if sizes is None:
                lists = nearest(space.rows(vecs), space.centers, 1).tolist()
            else:
                order = nearest(space.queries(vecs), space.centers, len(space.centers) if sizes.min() * probes < enough else probes)
                need = np.maximum(probes, (np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1)
                lists = [o[:n].tolist() for o, n in zip(order, need, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, "lists"])

    return run


def search(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", is_query: Column | None = None, k: int = 20, sample_rows: int = 20_000,
    lists: int | None = None, probes: int | None = None, recall: float = 0.95, list_rows: int = 4096, query_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query, which is a row of the table itself.

    is_query: a condition on the column ``vec_id``; by default every id that is divisible by 20. lists: by default the square
    root of the number of vectors, 16,384 at most. probes: by default as many as the share ``recall`` of the sample's own neighbours
    needs, 16 at least; data without clusters needs up to half of the lists.
    """
    spark = table.sparkSession
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows = pick(table, vec_id=id_col, vec=vec_col).where("vec_id is not null and vec is not null and not exists(vec, x -> x is null)")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    usual = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = usual["n"] if usual else 0
    own = rows.mapInArrow(_collapsed(k, dims), "key binary, vec binary, ids array<long>")
    own = own.groupBy("key").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    # Vectors are numbered as they are written, so that joins are on exact, short keys.
    own = materialise(own.select(F.col("ids")[0].alias("least"), "key", "vec", "ids", F.monotonically_increasing_id().alias("did")), "vectors")
    asked = rows.where(is_query).mapInArrow(_keyed(dims), "query_id long, key binary").distinct()
    asked = materialise(asked.join(own.select("key", "did"), "key").drop("key"), "queries")
    n = own.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    # A bounded sample, by hash, for the longest norm's scale and the centers.
    share = min(1.0, sample_rows / n)
    sample = own.where(F.pmod(F.xxhash64("did"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("vec").toArrow()["vec"].to_pylist()
    sample = np.stack([np.frombuffer(v) for v in sample or [own.first()["vec"]]])
    square = own.select("vec").mapInArrow(_longest, "x double").agg(F.max("x")).first()[0]
    space = Space(dims, square)
    lists = min(len(sample), lists or min(16_384, max(1, round(n**0.5))))
    space.centers = k_means(space.rows(sample), lists)
    probes = min(lists, probes or max(16, calibrated_probes(space, sample, k, recall)))
    shared = spark.sparkContext.broadcast(space)
    more = "did long, vec binary, lists array<int>"
    placed = own.select("did", "vec", "least").mapInArrow(_listed(shared, None, 1, 0), more.replace("vec binary", "vec binary, least long"))
    placed = placed.select("did", "vec", "least", F.col("lists")[0].alias("list"))
    placed = materialise(placed, "placed")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list at most
        sizes[r["list"]] = r["count"]
    searched = own.join(asked.select("did").distinct(), "did", "left_semi").select("did", "vec")
    searched = materialise(searched.mapInArrow(_listed(shared, sizes, probes, 2 * k + 2), more), "probes")
    home = searched.select("did", "vec", F.slice("lists", 1, 1).alias("lists"), F.lit(None).cast("double").alias("kth"))
    found = materialise(_scanned(shared, placed, home, sizes, k, list_rows, query_rows), "home")
    # The k-th best of what is found at home, where there are k.
    kth = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = found.withColumn("place", F.row_number().over(kth)).where(F.col("place") == k + 1).select(F.col("query").alias("did"), F.col("score").alias("kth"))
    away = searched.select("did", "vec", F.slice("lists", 2, lists).alias("lists")).join(kth, "did", "left")
    found = found.union(_scanned(shared, placed, away, sizes, k, list_rows, query_rows))
    ids = own.select(F.col("did").alias("row"), "least", "ids")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    found = found.join(ids, "row").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    found = found.join(asked.select("query_id", F.col("did").alias("query")), "query")
    found = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scanned(shared, placed: DataFrame, searched: DataFrame, sizes: np.ndarray, k: int, list_rows: int, query_rows: int) -> DataFrame:
    """query, row, score: the best k + 1 of each of the ``searched`` (did, vec, lists, kth) in each of its lists' parts."""
    searched = searched.select("did", "vec", "kth", F.explode("lists").alias("list"))
    asked_sizes = np.zeros(len(sizes), np.int64)
    for r in searched.groupBy("list").count().collect():  # a row for each list at most
        asked_sizes[r["list"]] = r["count"]
    parts = lambda x, most: F.element_at(F.array(*[F.lit(int(v)) for v in np.maximum(1, -(-x // most))]), F.col("list") + 1)
    row_parts, query_parts = parts(sizes, list_rows), parts(asked_sizes, query_rows)
    cell = lambda r, q: F.concat_ws(":", "list", r, q).alias("cell")
    spread = placed.withColumn("r", F.pmod(F.xxhash64("did"), row_parts)).withColumn("q", F.explode(F.sequence(F.lit(0), query_parts - 1)))
    met = searched.withColumn("q", F.pmod(F.xxhash64("did"), query_parts)).withColumn("r", F.explode(F.sequence(F.lit(0), row_parts - 1)))
    left, right = spread.select("did", "vec", "least", cell("r", "q")), met.select("did", "vec", "kth", cell("r", "q"))
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(_search(shared, k + 1), "query long, row long, score double")


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float((np.frombuffer(v) ** 2).sum()) for v in batch.column(0).to_pylist()], pa.float64())], ["x"])
