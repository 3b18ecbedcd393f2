"""Language identification with interpolated Kneser-Ney character models, one for each language.

Characters become symbols: a letter is its lower case, everything else is a blank, and runs of blanks are one. The models
count n-grams of up to ``ORDER`` symbols. All languages share one table for each order: the sorted 64-bit hashes of the
n-grams that any language has, and beside each its log probability in every language (back-off already applied), so one
look-up serves all languages. A second table holds the back-off weights of the contexts. A text goes to the language with the
lowest cross-entropy per symbol; it is rejected when that cross-entropy lies above the language's calibrated limit.

The limits are calibrated on labelled documents that no model has seen. How far a document's cross-entropy lies above its language's median is measured in units of
sqrt(a^2 + ``NOISE``^2 / symbols), a being the language's own spread, since short texts vary more; the limit is the conformal quantile of these distances over all calibration documents,
so about ``reject_rate`` of documents in the known languages are rejected.

How it scales: the models are fitted on a bounded sample of labelled rows (about ``train_docs`` and ``calibrate_docs`` for each
language, chosen by hash), each language in a task of its own. A language stops to learn when it has its share of ``cells``, so the tables, which go through the driver, have
about ``cells`` numbers however many languages and documents there are. Prediction is one narrow pass over the whole texts, in blocks of bounded size; a very long text is cut into
blocks that carry their context over.

Defined cases: null, empty and letterless texts are ``und`` with score 0, rejected; ties go to the language that sorts first; rows
with a null language train nothing; a corpus without labelled text gives ``und`` for every row; repeated rows each give a
row; an empty table gives no rows; extra columns are ignored by ``predict`` and kept by ``keep_identified``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rounds import passing_steps
from millrace.llm.common import materialise, pick

ORDER = 5
#: Symbols that are scored at once.
BLOCK = 1 << 18
#: Types that are held before equal ones are summed.
HELD = 100_000
#: Documents that are scored together.
ROWS = 500
#: The spread of a symbol's cross-entropy in nats, neighbours taken together.
NOISE = 2.5
_STEPS = [pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(ORDER)]
_SYMBOLS: np.ndarray | None = None


def _symbol_table() -> np.ndarray:
    """By code point: the lower-case letter's code point, 0 for anything that is no letter."""
    global _SYMBOLS
    if _SYMBOLS is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if unicodedata.category(chr(c))[0] == "L":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _SYMBOLS = table
    return _SYMBOLS


def symbols(text: str | None) -> np.ndarray:
    """The text's symbols; blanks come once and not at the start."""
    if not text:
        return np.zeros(0, np.uint32)
    s = _symbol_table()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    blank = s == 0
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    return s[keep]


def suffix_sums(s: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER: an unmixed hash of the k symbols that end at each place; before the start there are blanks."""
    x = s.astype(np.uint64) + np.uint64(1)
    out: list[np.ndarray] = []
    for k, step in enumerate(_STEPS):
        shifted = x if k == 0 else np.concatenate([np.ones(min(k, len(x)), np.uint64), x[: max(0, len(x) - k)]])
        out.append(shifted * np.uint64(step) + (out[-1] if out else np.uint64(0)))
    return out


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A well-spread hash of order k's sums."""
    x = x ^ np.uint64(k * 0x632BE59BD9B4E019 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class SortedHashes:
    """A sorted array of 64-bit hashes with an index over their leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        lead = (keys >> self.shift).astype(np.int64)
        counts = np.bincount(lead, minlength=1 << (64 - int(self.shift)))
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is; -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        lead = (keys >> self.shift).astype(np.int64)
        at, end = self.start[lead], self.start[lead + 1]
        left = np.arange(len(keys))
        for k in range(self.longest):
            place = at[left] + k
            inside = place < end[left]
            left, place = left[inside], place[inside]
            if not len(left):
                break
            hit = self.keys[place] == keys[left]
            out[left[hit]] = place[hit]
            left = left[~hit]
        return out


class Models:
    """Kneser-Ney models of all languages. counts: by language, the order-ORDER types as arrays of their sums, of the sums
    of all their suffixes and contexts, and their counts."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """counts[l] = (suffix sums [ORDER, n], context sums [ORDER, n] (of length k - 1, row 0 unused), counts [n])."""
        self.langs, n_langs = langs, len(langs)
        by_order: list[list[tuple]] = []
        for suffixes, contexts, n in counts:
            types, levels = (suffixes, contexts, n), []
            for k in range(ORDER, 0, -1):
                suffixes, contexts, n = types
                own, first, back = np.unique(suffixes[k - 1], return_index=True, return_inverse=True)
                if k < ORDER:  # how many different symbols stand before it
                    n = np.bincount(back, minlength=len(own))
                else:
                    n = np.bincount(back, n, len(own))
                types = (suffixes[:, first], contexts[:, first], n)
                levels.append((own, suffixes[k - 2][first] if k > 1 else None, contexts[k - 1][first] if k > 1 else None, n.astype(float)))
            by_order.append(levels[::-1])
        self.tables, self.logs, self.contexts, self.backs = [], [], [], []
        lower: tuple[np.ndarray, np.ndarray] | None = None  # (sorted sums of order k - 1, their probabilities)
        alphabet = np.unique(np.concatenate([x[0][0] for x in by_order] or [np.zeros(0, np.uint64)]))
        self.unseen = -float(np.log(len(alphabet) + 1))
        for k in range(1, ORDER + 1):
            grams = [x[k - 1] for x in by_order]
            own, at = np.unique(np.concatenate([g[0] for g in grams]), return_index=True)
            p = np.zeros((len(own), n_langs))
            if k == 1:
                for i, (sums, _, _, n) in enumerate(grams):
                    d = self._discount(n)
                    total = max(1.0, n.sum())
                    p[:, i] = d * len(n) / total / (len(alphabet) + 1) if len(n) else 1 / (len(alphabet) + 1)
                    p[np.searchsorted(own, sums), i] += np.maximum(n - d, 0) / total
            else:
                suffix = np.concatenate([g[1] for g in grams])[at]
                context = np.concatenate([g[2] for g in grams])[at]
                ctx = np.unique(context)
                back = np.ones((len(ctx), n_langs))
                below = lower[1][np.searchsorted(lower[0], suffix)]
                for i, (sums, _, own_ctx, n) in enumerate(grams):
                    if not len(n):
                        p[:, i] = below[:, i]
                        continue
                    d, where = self._discount(n), np.searchsorted(ctx, own_ctx)
                    total = np.bincount(where, n, len(ctx))
                    kinds = np.bincount(where, minlength=len(ctx))
                    has = total > 0
                    back[has, i] = d * kinds[has] / total[has]
                    p[:, i] = back[np.searchsorted(ctx, context), i] * below[:, i]
                    p[np.searchsorted(own, sums), i] += np.maximum(n - d, 0) / total[where]
                keys = mixed(ctx, k - 1)
                order = np.argsort(keys)
                self.contexts.append(SortedHashes(keys[order]))
                self.backs.append(np.log(back[order]).astype(np.float32))
            lower = (own, p)
            keys = mixed(own, k)
            order = np.argsort(keys)
            self.tables.append(SortedHashes(keys[order]))
            self.logs.append(np.log(p[order]).astype(np.float32))

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        once, twice = float((n == 1).sum()), float((n == 2).sum())
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5

    def log_p(self, s: np.ndarray) -> np.ndarray:
        """ln p of each symbol given those before it, [n, languages]."""
        sums = suffix_sums(s)
        place = self.tables[-1].places(mixed(sums[-1], ORDER))
        out = self.logs[-1][place]
        left = np.flatnonzero(place < 0)
        out[left] = 0
        for k in range(ORDER - 1, -1, -1):  # the n-grams of order k + 1 aren't known: add the context's weight
            if not len(left):
                break
            if k:
                before = np.where(left > 0, sums[k - 1][left - 1], self._start(k))
                at = self.contexts[k - 1].places(mixed(before, k))
                known = at >= 0
                out[left[known]] += self.backs[k - 1][at[known]]
                place = self.tables[k - 1].places(mixed(sums[k - 1][left], k))
                found = place >= 0
                out[left[found]] += self.logs[k - 1][place[found]]
                left = left[~found]
            else:
                out[left] += self.unseen
        return out

    @staticmethod
    def _start(k: int) -> np.uint64:
        """The sum of k blanks."""
        return np.uint64(sum(_STEPS[:k]) & (2**64 - 1))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: sum of ln p by language, and the number of symbols (0 if it has no letter)."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        pending: list[tuple[int, np.ndarray]] = []
        held = 0

        def work() -> None:
            gap = np.zeros(ORDER, np.uint32)
            line = np.concatenate([x for _, s in pending for x in (gap, s)])
            sizes = np.array([len(s) for _, s in pending])
            ends = np.cumsum(sizes + ORDER)
            run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.log_p(line), axis=0, dtype=np.float64)])
            for (i, s), e in zip(pending, ends, strict=True):
                out[i] += run[e] - run[e - len(s)]
            pending.clear()

        for i, text in enumerate(texts):
            s = symbols(text)
            if not (s > 0).any():
                continue
            n[i] = len(s)
            for at in range(0, len(s), BLOCK):
                if at:  # the block's context goes before it and isn't counted again
                    out[i] += self.log_p(s[at - ORDER : at + BLOCK])[ORDER:].sum(axis=0, dtype=np.float64)
                else:
                    pending.append((i, s[:BLOCK]))
                    held += min(len(s), BLOCK)
            if held >= BLOCK:
                work()
                held = 0
        if pending:
            work()
        return out, n


def _types(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal order-ORDER types as one, with their counts summed."""
    _, first, back = np.unique(rows[ORDER - 1], return_index=True, return_inverse=True)
    return rows[:, first], np.bincount(back, n, len(first)).astype(np.int64)


def _counted(most: int):
    """All (lang, place, text) of a language -> its order-ORDER types: their sums and those of their contexts, and their counts. Documents come in the order of
    their places, until there are ``most`` types."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts, held = [], 0
        for text in rows.sort_values(["place", "text"])["text"]:
            s = symbols(text)
            for at in range(0, len(s), BLOCK):
                sums = suffix_sums(s[max(0, at - ORDER) : at + BLOCK])
                before = [np.concatenate([[Models._start(k)], x[:-1]]).astype(np.uint64) for k, x in enumerate(sums[:-1], 1)]
                table = np.stack([*sums, *before])[:, min(at, ORDER) :]
                parts.append(_types(table, np.ones(table.shape[1])))
                held += len(parts[-1][1])
            if parts and held > len(parts[0][1]) + min(HELD, most):
                parts = [_types(np.concatenate([t for t, _ in parts], axis=1), np.concatenate([n for _, n in parts]))]
                held = len(parts[0][1])
                if held > most:
                    break
        if not parts:
            return pd.DataFrame({"lang": [], "sums": [], "counts": []})
        table, n = _types(np.concatenate([t for t, _ in parts], axis=1), np.concatenate([n for _, n in parts]))
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "sums": [table.tobytes()], "counts": [n.tobytes()]})

    return run


Limits = dict[str, tuple[float, float, float]]


def accepted_at(limits: Limits, lang: str, nats: float, n: int) -> bool:
    """Whether a text of n symbols with this cross-entropy is within its language's limit; a language without one has none."""
    if lang not in limits:
        return True
    middle, own, times = limits[lang]
    return nats <= middle + times * (own**2 + NOISE**2 / n) ** 0.5


def calibrated(checked: list[tuple[str, float, int]], reject_rate: float) -> Limits:
    """By language the median cross-entropy, its own spread and how many spreads above the median the limit lies, from (lang, nats, symbols) of documents
    that no model has seen. With fewer of them than 1 / reject_rate the limit lies at the farthest of them, at six spreads at least."""
    found: Limits = {}
    far = []
    for lang in sorted({x for x, _, _ in checked}):
        nats, n = np.array([[y, k] for x, y, k in checked if x == lang]).T
        middle = float(np.median(nats))
        long = nats[n >= np.median(n)]
        own = max(0.01, 1.4826 * float(np.median(np.abs(long - np.median(long)))))
        found[lang] = (middle, own, 0.0)
        far.append((nats - middle) / np.sqrt(own**2 + NOISE**2 / n))
    far = np.sort(np.concatenate([*far, np.zeros(0)]))
    rank = int(np.ceil((len(far) + 1) * (1 - reject_rate)))
    times = float(far[rank - 1]) if rank <= len(far) else max(6.0, float(far[-1])) if len(far) else 0.0
    return {lang: (middle, own, times) for lang, (middle, own, _) in found.items()}


def learn(rows: DataFrame, train_docs: int = 2000, calibrate_docs: int = 500, reject_rate: float = 0.001, cells: int = 1 << 25) -> tuple[Models, Limits] | None:
    """Models and rejection limits from ``rows`` (doc_id, lang, text), or None."""
    named = rows.where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}
    if not counts:
        return None
    # Each row has a place in 0..1 by hash; a language's first places train, the next ones calibrate.
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (train_docs + calibrate_docs) / n))])[F.col("lang")]
    with passing_steps(rows.sparkSession):
        sample = materialise(named.withColumn("place", place).where(F.col("place") < share).select("lang", "text", (F.col("place") / share).alias("place")), "sample")
        return _learnt(sample, sorted(counts), train_docs / (train_docs + calibrate_docs), reject_rate, cells)


def _learnt(sample: DataFrame, langs: list[str], train_share: float, reject_rate: float, cells: int) -> tuple[Models, Limits]:
    """From the ``sample`` (lang, text, place): the first ``train_share`` of the places train, the others calibrate."""
    trained = F.col("place") < train_share
    # A table has a number for each type and language, orders and contexts together about 3.5 for each type of the highest order.
    most = int(cells / 3.5 / len(langs) ** 2)
    table = sample.where(trained).groupBy("lang").applyInPandas(_counted(most), "lang string, sums binary, counts binary").toArrow().to_pylist()
    found = {r["lang"]: r for r in table}
    counts = []
    for lang in langs:
        r = found.get(lang)
        sums = np.frombuffer(r["sums"], np.uint64).reshape(2 * ORDER - 1, -1) if r else np.zeros((2 * ORDER - 1, 0), np.uint64)
        counts.append((sums[:ORDER], np.concatenate([np.zeros((1, sums.shape[1]), np.uint64), sums[ORDER:]]), np.frombuffer(r["counts"], np.int64) if r else np.zeros(0, np.int64)))
    models = Models(langs, counts)
    checked = predict_with(sample.where(~trained), models, {}, ["lang"]).where("nats is not null")
    return models, calibrated([(r["lang"], r["nats"], r["symbols"]) for r in checked.select("lang", "nats", "symbols").collect()], reject_rate)


def _predicted(models: Models | None, limits: Limits, texts: list[str | None]) -> tuple[list, np.ndarray, list, list, np.ndarray]:
    """lang_pred, score, nats and accepted of each text, and its symbols."""
    preds, scores, nats, accepted, n = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts), [False] * len(texts), np.zeros(len(texts), np.int64)
    if models:
        total, n = models.totals(texts)
        some = np.flatnonzero(n)
        mean = total[some] / n[some, None]
        best = mean.argmax(axis=1)
        # Neighbouring symbols tell much the same, so a symbol counts for a fifth, and a text for 100 symbols at most.
        odds = (mean - mean.max(axis=1, keepdims=True)) * np.minimum(n[some], 500)[:, None] / ORDER
        scores[some] = 1 / np.exp(odds).sum(axis=1)
        for i, b, m in zip(some.tolist(), best.tolist(), (-mean.max(axis=1)).tolist(), strict=True):
            preds[i], nats[i] = models.langs[b], m
            accepted[i] = bool(accepted_at(limits, models.langs[b], m, int(n[i])))
    return preds, scores, nats, accepted, n


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that few texts are open at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def predict_with(rows: DataFrame, models: Models | None, limits: Limits, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` (which has text) plus lang_pred, score, nats, accepted and symbols."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            preds, scores, nats, accepted, n = _predicted(shared.value, limits, batch.column(0).to_pylist())
            cols = [pa.array(preds), pa.array(scores), pa.array(nats, pa.float64()), pa.array(accepted), pa.array(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*keep, "lang_pred", "score", "nats", "accepted", "symbols"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("text", *keep).mapInArrow(run, f"{kinds}, lang_pred string, score double, nats double, accepted boolean, symbols long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_fold: int) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return pick(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("held_out", F.coalesce(fold == held_fold, F.lit(False)))


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), nats (cross-entropy per symbol), accepted, symbols: a row for each document.

    Only rows that aren't held out (crc32(doc_id as text) mod ``folds`` is not ``held_fold``) are learnt from.
    """
    rows = _labelled(docs, id_col, text_col, lang_col, folds, held_fold)
    learnt = learn(rows.where("not held_out"), **options)
    models, limits = learnt or (None, {})
    return predict_with(rows, models, limits, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2, **options) -> DataFrame:
    """``docs`` without the rows that the models reject; without any labelled text nothing can be told, and all rows stay."""
    rows = _labelled(docs, id_col, text_col, lang_col, folds, held_fold)
    learnt = learn(rows.where("not held_out"), **options)
    if learnt is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(learnt)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            yield batch.filter(pa.array(_predicted(*shared.value, batch.column(place).to_pylist())[3], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
