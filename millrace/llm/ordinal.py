"""Quality grades by ordinal cumulative-link regression over hashed text.

P(grade <= g) = logistic(threshold_g - w . x): one weight vector for all grades and ordered thresholds (each is the one before
plus the exponential of a free number). x marks the hashed words of a text and the hashed endings of its words. The model gives
the expected grade and the tail probabilities P(grade >= g), by which documents are selected.

How it scales: fitting takes a bounded sample of the labelled rows (``train_rows``, chosen by hash), whose features are made in many tasks and fitted in one by limited-memory BFGS,
to a slope below ``SETTLED``; a fit that hasn't got there in ``rounds`` evaluations says so. Grading is one narrow pass over the whole texts.

Defined cases: null and empty texts have no features and get the thresholds' own grade; labels without a document, or with a
null grade, train nothing; repeated labels train once each; without labels every document gets null grades and isn't
selected; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounds import passing_steps
from millrace.llm.common import LOWER_BYTES, materialise, pick

#: Bits of a feature's hash.
BITS = 18
#: ASCII punctuation, which words lose at both ends.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The largest slope of the mean likelihood at which a fit has settled, and rows whose gradients are summed at once.
SETTLED, ROWS = 1e-4, 5000
#: Rows up to which the chosen labels are broadcast; the sample's own bound is ``train_rows``.
BROADCAST_ROWS = 100_000


def features(text: bytes | None) -> np.ndarray:
    """The distinct hashed features of a text: its words without punctuation, and the endings of its raw words."""
    raw = set(text.translate(LOWER_BYTES).split()) if text else set()
    hashes = [xxhash.xxh32_intdigest(w) for w in {w.strip(MARKS) for w in raw}]
    hashes += [xxhash.xxh32_intdigest(e, 1) for e in {w[-3:] for w in raw}]
    return np.unique(np.array(hashes, np.uint32) >> np.uint32(32 - BITS))


class Ordinal:
    """Weights, the first threshold and the logarithms of the steps to the next ones."""

    def __init__(self, grades: int) -> None:
        self.grades = grades
        self.weights = np.zeros(1 << BITS)
        self.steps = np.zeros(grades - 1)

    def thresholds(self) -> np.ndarray:
        return np.cumsum(np.concatenate([self.steps[:1], np.exp(self.steps[1:])]))

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1.., [n, grades - 1]."""
        return 1 / (1 + np.exp(np.clip(self.thresholds()[None] - x[:, None], -35, 35)))

    def gradient(self, grade: np.ndarray, bags: list[np.ndarray]) -> np.ndarray:
        """Of the summed negative log likelihood: by weight, by step, and that sum itself."""
        return self.slope(grade, *laid_out(bags))

    def slope(self, grade: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``gradient`` of bags that are laid out."""
        run = np.concatenate([[0.0], np.cumsum(self.weights[flat])])
        ends = np.cumsum(sizes)
        n = len(sizes)
        tail = np.hstack([np.ones((n, 1)), self.tails(run[ends] - run[ends - sizes]), np.zeros((n, 1))])
        at = np.arange(n)
        upper, lower = tail[at, grade], tail[at, grade + 1]  # P(>= grade), P(>= grade + 1)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_x = -(du - dl)
        by_threshold = np.zeros(self.grades + 1)
        np.add.at(by_threshold, grade, du)
        np.add.at(by_threshold, grade + 1, -dl)
        by_threshold = by_threshold[1:-1]
        by_step = np.cumsum(by_threshold[::-1])[::-1] * np.concatenate([[1.0], np.exp(self.steps[1:])])
        by_weight = np.bincount(flat, np.repeat(by_x, sizes), 1 << BITS)
        return np.concatenate([by_weight, by_step, [-np.log(p).sum()]])


def laid_out(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bags' features in one line, and their numbers."""
    return np.concatenate(bags).astype(np.int64), np.array([len(b) for b in bags])


def _fitted(grades: int, rounds: int, penalty: float):
    """All (grade, bag) of the sample, in one task -> the weights and steps, and whether they have settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            parts.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), *laid_out([np.frombuffer(b, np.uint32) for b in batch.column(1).to_pylist()])))
            n += batch.num_rows
        if not n:
            return
        model = Ordinal(grades)

        def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
            """The mean negative log likelihood with its penalty, and the gradient."""
            model.weights, model.steps = x[: 1 << BITS], x[1 << BITS :]
            total = sum(model.slope(*part) for part in parts) / n
            by_x = total[:-1]
            by_x[: 1 << BITS] += penalty * model.weights
            return float(total[-1] + penalty / 2 * (model.weights**2).sum()), by_x

        x, settled = minimise(slope, np.concatenate([np.zeros(1 << BITS), [-2.0], np.zeros(grades - 2)]), rounds)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([settled])], ["x", "settled"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, rounds: int = 100, penalty: float = 1e-3) -> Ordinal | None:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, grade: 0, 1, ..)."""
    spark = docs.sparkSession
    with passing_steps(spark):
        labels = labels.where("grade is not null and doc_id is not null")
        about = labels.agg(F.count("*").alias("n"), F.max("grade").alias("top")).first()
        if not about["n"]:
            return None
        share = min(1.0, train_rows / about["n"])
        chosen = materialise(labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))), "labels")
        few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen

        def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [features(t).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["grade", "bag"])

        met = docs.join(few, "doc_id").select(F.col("grade").cast("int"), F.col("text").cast("binary"))
        rows = materialise(met.mapInArrow(bags, "grade int, bag binary"), "features")
        grades = max(2, int(about["top"]) + 1)
        found = rows.coalesce(1).sortWithinPartitions("grade", "bag").mapInArrow(_fitted(grades, rounds, penalty), "x binary, settled boolean").first()
        if found is None:
            return None
        if not found["settled"]:
            warnings.warn(f"the grades' model hasn't settled in {rounds} evaluations", stacklevel=2)
        model, x = Ordinal(grades), np.frombuffer(bytes(found["x"]))
        model.weights, model.steps = x[: 1 << BITS], x[1 << BITS :]
        return model


def minimise(slope, x: np.ndarray, rounds: int, memory: int = 8) -> tuple[np.ndarray, bool]:
    """Limited-memory BFGS with halved steps; ``slope`` is called ``rounds`` times at most. Also whether the slope has become ``SETTLED``."""
    value, by_x = slope(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    calls = 1
    while calls < rounds and np.abs(by_x).max() > SETTLED:
        way, shares = by_x.copy(), []
        for s, y in reversed(moves):
            shares.append((s @ way) / (s @ y))
            way -= shares[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 0.02 / np.abs(by_x).max()
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            way += (share - (y @ way) / (s @ y)) * s
        size = 1.0
        while calls < rounds:
            after, by_after = slope(x - size * way)
            calls += 1
            if after < value - 1e-4 * size * (by_x @ way):
                break
            size /= 2
        else:
            return x, False
        if -size * way @ (by_after - by_x) > 1e-12:
            moves = [*moves, (-size * way, by_after - by_x)][-memory:]
        x, value, by_x = x - size * way, after, by_after
    return x, bool(np.abs(by_x).max() <= SETTLED)


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2, likely: float = 0.5, **options) -> DataFrame:
    """doc_id, expected_grade, p_tail (P(grade >= ``least``)), selected (p_tail at least ``likely``), tails (P(grade >= g) for g = 1..): a row for each document."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    model = fit(rows, labels.select("doc_id", "grade"), **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ordinal | None = shared.value
        for batch in batches:
            if model is None:
                tails = [None] * batch.num_rows
            else:
                x = np.array([model.weights[features(t)].sum() for t in batch.column(1).to_pylist()])
                tails = model.tails(x).tolist()
            cols = [
                [None if t is None else sum(t) for t in tails], [None if t is None else t[min(least, len(t)) - 1] for t in tails],
                [t is not None and t[min(least, len(t)) - 1] >= likely for t in tails], tails,
            ]
            kinds = [pa.float64(), pa.float64(), pa.bool_(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "expected_grade", "p_tail", "selected", "tails"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, expected_grade double, p_tail double, selected boolean, tails array<double>")


def grades_of(labels: DataFrame) -> DataFrame:
    """doc_id, grade from quality and toxic: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
