"""Phrases of words that occur together more often than their parts tell, from bitmaps of the words' positions.

Texts are cut into pieces at punctuation and line ends and into words within pieces. A task deals the words of its texts to shards of about ``shard_words``
positions, a free position after each piece, so that nothing reaches over a piece's end. A shard has a bitmap of positions for each word of each
language, stored as the varint-coded runs of zeros between its ones. A phrase's bitmap has the positions of its last word: that of the phrase shifted by one, AND that of the next word, is the bitmap of the
longer phrase, its popcount the number of occurrences in the shard, and the sum of popcounts over all shards the number in the corpus.

1. Words: popcounts are summed over shards; words below the least count, and all phrases with them, are out.
2. Pairs and triples: a shard has hundreds of thousands of different ones, most of them once, and a bitmap each would cost more than the text. So the words at the shifted ones of all
   bitmaps are looked up at once, which gives the popcounts of all pairs, then of all triples of two frequent pairs. They are summed over shards, and each shard learns which of its own are frequent in the corpus.
3. Longer phrases: each shard extends its frequent triples depth-first by shift, AND and popcount, by words that make a frequent triple with the last two; sums are taken over shards again.

How it scales: a shard gives a word or a phrase one row, so no key of the sums can hold more rows than there are shards, however frequent it is.
Bitmaps are shuffled by shard, three times, never by word. A task holds one shard. Nothing is collected or broadcast but the number of words of each language where Spark finds it small. From a position come four phrases at most.
Ranks are cut by language in the tasks before rows meet.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count again; equal scores go by count, then by the phrase's bytes; ties between cuts go to the shortest first part; an
empty table gives no rows; very long texts are cut between pieces, a piece stays whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.rounds import materialise
from millrace.llm.common import partitions_for, pick

#: Bytes: ASCII letters in lower case, the ends of pieces as full stops.
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Bytes of text after which a very long one is cut at the next piece's end.
SLICE = 8 << 20
#: Bits of a word's number within its shard, and of a shard's number within its task.
WORD_BITS, SHARD_BITS = 24, 16
BITMAPS = "shard long, no int, lang string, word string, n long, gaps binary"


def pieces_of(text: bytes) -> list[bytes]:
    """The words, a full stop after each piece."""
    return text.translate(PIECE_BYTES).replace(b".", b" . ").split() + [b"."]


def _slices(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SLICE:
        end = re.compile(rb"[.,;:!?\n\x0b\x0c\r]").search(text, at + SLICE)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, the lowest first, the top bit where more follow; and the bytes of each number."""
    n = 1 + sum((gaps >= 1 << 7 * i).astype(np.int64) for i in range(1, 5))
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for i in range(5):
        some = n > i
        out[first[some] + i] = ((gaps[some] >> 7 * i) & 127) | np.where(n[some] > i + 1, 128, 0)
    return out, n


def unpacked(raw: np.ndarray) -> np.ndarray:
    """The numbers of ``packed`` bytes."""
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first) if len(ends) else np.zeros(0, np.int64)


class Bitmap:
    """Bits in words of 64, without the words that are zero: the places of the others, and the words."""

    __slots__ = ("at", "words")

    def __init__(self, at: np.ndarray, words: np.ndarray) -> None:
        self.at, self.words = at, words

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        at = positions >> 6
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return cls(at[first], np.bitwise_or.reduceat(np.uint64(1) << (positions & 63).astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64))

    def shifted(self) -> Bitmap:
        """All bits one place on."""
        over = self.at[(self.words >> np.uint64(63)) > 0] + 1  # words that get a bit from the one before
        at, words = self.at, self.words << np.uint64(1)
        if len(over):
            to = np.searchsorted(at, over)
            new = at[np.minimum(to, len(at) - 1)] != over
            at, words = np.insert(at, to[new], over[new]), np.insert(words, to[new], np.uint64(0))
            words[np.searchsorted(at, over)] |= np.uint64(1)
        return Bitmap(at, words)

    def __and__(self, other: Bitmap) -> Bitmap:
        few, many = (self, other) if len(self.at) <= len(other.at) else (other, self)
        if not len(few.at):
            return few
        to = np.searchsorted(many.at, few.at)
        to[to == len(many.at)] = 0
        words = np.where(many.at[to] == few.at, few.words & many.words[to], np.uint64(0))
        some = words != 0
        return Bitmap(few.at[some], words[some])

    def popcount(self) -> int:
        return int(np.bitwise_count(self.words).sum())

    def positions(self) -> np.ndarray:
        bits = np.unpackbits(self.words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lane, bit = np.nonzero(bits)
        return self.at[lane] * 64 + bit


class _Shard:
    """Words and positions of a shard that is being filled."""

    def __init__(self) -> None:
        number = count(1)
        self.numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(number.__next__, {b".": 0}))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.parts)
        n = np.bincount(ids)
        if len(n) >= 1 << WORD_BITS:
            raise ValueError("too many words in a shard")
        order = np.argsort(ids, kind="stable")[n[0] :]
        n, first = n[1:], np.cumsum(n[1:]) - n[1:]
        gaps = np.diff(order, prepend=0)
        gaps[first] = order[first]
        raw, sizes = packed(gaps)
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(sizes, first))]) if len(n) else np.zeros(1, np.int64)
        words: list[bytes] = [b""] * len(n)
        langs: list[str] = [""] * len(n)
        for lang, own in self.numbers.items():
            for word, no in own.items():
                if no:
                    words[no - 1], langs[no - 1] = word, lang
        for a in range(0, len(n), 10_000):
            b = min(a + 10_000, len(n))
            offsets, bits = (ends[a : b + 1] - ends[a]).astype(np.int32), raw[ends[a] : ends[b]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * (b - a), pa.int64()), pa.array(np.arange(a + 1, b + 1), pa.int32()), pa.array(langs[a:b], pa.string()), pa.array(words[a:b], pa.binary()).cast(pa.string()),
                    pa.array(n[a:b], pa.int64()), pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(bits.tobytes())]),
                ],
                ["shard", "no", "lang", "word", "n", "gaps"],
            )


def _fill(shard_words: int):
    """(lang, text) -> the bitmaps of the task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SHARD_BITS
        shard = _Shard()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in _slices(text or b""):
                    shard.add(lang, pieces_of(part))
                    if shard.size >= shard_words:
                        yield from shard.rows(number)
                        shard, number = _Shard(), number + 1
        if shard.size:
            yield from shard.rows(number)

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, pa.Table]]]:
    """The rows of one shard after the other, by kind; they come in the order of shard and kind."""
    held: list[pa.RecordBatch] = []

    def kinds() -> tuple[int, dict[int, pa.Table]]:
        table = pa.Table.from_batches(held)
        kind = table.column("kind").to_numpy()
        edges = np.searchsorted(kind, range(4))
        return table.column("shard")[0].as_py(), {k: table.slice(edges[k], edges[k + 1] - edges[k]) for k in range(3)}

    for batch in batches:
        shard = batch.column(0).to_numpy()
        for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
            if not len(part):
                continue
            if held and held[0].column(0)[0].as_py() != shard[part[0]]:
                yield kinds()
                held = []
            held.append(batch.slice(part[0], len(part)))
    if held:
        yield kinds()


def _positions(rows: dict[int, pa.Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the frequent words in order, the positions of all of them one after the other, and where each word's begin (and the end)."""
    known, bits = np.sort(rows[0].column("no").to_numpy()), rows[1]
    no = bits.column("no").to_numpy()
    mine = np.flatnonzero(np.isin(no, known))
    mine = mine[np.argsort(no[mine])]
    raw = bits.column("gaps").take(pa.array(mine)).to_pylist()
    gaps = unpacked(np.frombuffer(b"".join(raw), np.uint8))
    n = np.array([np.count_nonzero(np.frombuffer(x, np.uint8) < 128) for x in raw], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    total = np.cumsum(gaps)
    return known, total - np.repeat(total[first[:-1]] - gaps[first[:-1]], n), first


def _transposed(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The frequent word at each position, counted from 1 in the order of their numbers; 0 where there is none."""
    at = np.zeros(int(places.max()) + 2, np.int32)
    at[places] = np.repeat(np.arange(1, len(first), dtype=np.int32), np.diff(first))
    return at


def _ids(rows: dict[int, pa.Table]) -> np.ndarray:
    """The corpus numbers of the frequent words, in the order of their numbers in the shard."""
    return rows[0].column("id").to_numpy()[np.argsort(rows[0].column("no").to_numpy())]


def _local(rows: dict[int, pa.Table], ids: np.ndarray, *columns: str) -> list[np.ndarray]:
    """Words of the frequent pairs or triples, counted from 1 in the order of their numbers in the shard."""
    by_id = np.argsort(ids)
    return [by_id[np.searchsorted(ids, rows[2].column(c).to_numpy(), sorter=by_id)] + 1 for c in columns]


def _runs(shard: int, n: np.ndarray, **words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(n), 50_000):
        part = slice(k, k + 50_000)
        cols = [pa.array(np.full(len(n[part]), shard)), *[pa.array(w[part]) for w in words.values()], pa.array(n[part])]
        yield pa.RecordBatch.from_arrays(cols, ["shard", *words, "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards -> shard, a, b, n: the popcounts of all pairs of frequent words."""
    for shard, rows in _shards(batches):
        if rows[0].num_rows:
            _, places, first = _positions(rows)
            ids, at = _ids(rows), _transposed(places, first)
            met = np.flatnonzero((at[:-1] > 0) & (at[1:] > 0))
            both, n = np.unique(at[met].astype(np.int64) * len(first) + at[met + 1], return_counts=True)
            yield from _runs(shard, n, a=ids[both // len(first) - 1], b=ids[both % len(first) - 1])


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with their frequent pairs -> shard, a, b, c, n: the popcounts of all triples of two frequent pairs."""
    for shard, rows in _shards(batches):
        if rows[2].num_rows:
            _, places, first = _positions(rows)
            ids, at = _ids(rows), _transposed(places, first).astype(np.int64)
            a, b = _local(rows, ids, "a", "b")
            known = np.sort(a * len(first) + b)
            keys = at[:-1] * len(first) + at[1:]
            pair = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            pair = np.where(known[pair] == keys, pair + 1, 0)  # the frequent pair that starts at each position, from 1
            met = np.flatnonzero((pair[:-1] > 0) & (pair[1:] > 0))
            both, n = np.unique(pair[met] * (len(known) + 1) + pair[met + 1], return_counts=True)
            left, right = known[both // (len(known) + 1) - 1], known[both % (len(known) + 1) - 1]
            yield from _runs(shard, n, a=ids[left // len(first) - 1], b=ids[right // len(first) - 1], c=ids[right % len(first) - 1])


def _deepened(longest: int):
    """Shards with their frequent triples -> lang, phrase, k, n: the popcounts of all phrases of 4 to ``longest`` words that are made of frequent triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            if not rows[2].num_rows:
                continue
            _, places, first = _positions(rows)
            ids = _ids(rows)
            triples = list(zip(*(x.tolist() for x in _local(rows, ids, "a", "b", "c")), strict=True))
            follow: dict[tuple[int, int], set[int]] = defaultdict(set)
            for a, b, c in triples:
                follow[a, b].add(c)
            order = np.argsort(rows[0].column("no").to_numpy())
            names = [x.take(pa.array(order)).to_pylist() for x in (rows[0].column("lang"), rows[0].column("word"))]
            bitmaps: dict[int, Bitmap] = {}
            at = _transposed(places, first)

            def bitmap(word: int) -> Bitmap:
                if word not in bitmaps:  # noqa: B023
                    bitmaps[word] = Bitmap.of(places[first[word - 1] : first[word]])  # noqa: B023
                return bitmaps[word]  # noqa: B023

            out: list[tuple[str, str, int, int]] = []
            moved_a, last = None, 0
            for a, b in sorted(follow):
                if a != last:
                    moved_a, last = bitmap(a).shifted(), a
                stack = [((a, b), moved_a & bitmap(b))] if any((b, c) in follow for c in follow[a, b]) else []
                while stack:
                    path, own = stack.pop()
                    moved, nexts = own.shifted(), follow[path[-2:]]
                    if len(nexts) > 2:  # only those that stand there
                        nexts = sorted(set(at[own.positions() + 1].tolist()).intersection(nexts))  # noqa: B023
                    for word in nexts:
                        to = (*path, word)
                        deeper = len(to) < longest and to[-2:] in follow
                        if len(to) == 3 and not deeper:
                            continue  # counted before
                        longer = moved & bitmap(word)
                        n = longer.popcount()
                        if n and len(to) > 3:
                            out.append((names[0][word - 1], " ".join(names[1][w - 1] for w in to), len(to), n))
                        if n and deeper:
                            stack.append((to, longer))
                if len(out) >= 20_000:
                    yield _phrases(out)
                    out = []
            if out:
                yield _phrases(out)

    return run


def _phrases(out: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    cols = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["lang", "phrase", "k", "n"])


def _gathered(words: DataFrame, bitmaps: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """The frequent words, bitmaps and frequent pairs or triples of a shard as kinds 0, 1 and 2, one shard after the other."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = words.select("shard", F.lit(0).alias("kind"), "no", "id", "lang", "word", none("binary", "gaps"), *[none("long", c) for c in "abc"])
    rows = rows.unionByName(bitmaps.select("shard", F.lit(1).alias("kind"), "no", "gaps"), allowMissingColumns=True)
    if runs is not None:
        rows = rows.unionByName(runs.drop("f").withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return rows.repartition(partitions_for(words.sparkSession), "shard").sortWithinPartitions("shard", "kind")


def _frequent(runs: DataFrame, words: list[str], least: int, name: str) -> DataFrame:
    """The runs (shard, words, n) that occur ``least`` times in all shards, with f, how often."""
    summed = runs.withColumn("f", F.sum("n").over(Window.partitionBy(*words))).where(F.col("f") >= least)
    return materialise(summed.select("shard", *words, "f"), name)


def _named(runs: DataFrame, words: list[str], known: DataFrame) -> DataFrame:
    """lang, phrase, k, a of each of the runs once."""
    out = runs.select(*words, "f").distinct()
    names = known.select("id", "lang", "word").distinct()
    for c in words:
        out = out.join(names.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), *[F.col("lang")] * (c == words[0])), c)
    return out.select("lang", F.concat_ws(" ", *[f"word_{c}" for c in words]).alias("phrase"), F.lit(len(words)).alias("k"), F.col("f").alias("a"))


def count_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, shard_words: int = 4_000_000) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, a: all phrases of 1 to ``longest`` (3 or more) words that occur ``least`` times or more, and how often; and lang, n: the words of each language."""
    rows = pick(docs, lang=lang_col, text=text_col).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    bitmaps = materialise(rows.mapInArrow(_fill(shard_words), BITMAPS), "bitmaps")
    words = bitmaps.groupBy("lang").agg(F.sum("n").alias("n"))
    uid = F.shiftleft("shard", WORD_BITS) + F.col("no")
    by_word = Window.partitionBy("lang", "word")
    light = bitmaps.select("shard", "no", "lang", "word", "n")
    known = light.withColumn("f", F.sum("n").over(by_word)).withColumn("id", F.min(uid).over(by_word)).where(F.col("f") >= least)
    known = materialise(known.select("shard", "no", "id", "lang", "word", "f"), "words")
    two, three = ["a", "b"], ["a", "b", "c"]
    pairs = _frequent(_gathered(known, bitmaps).mapInArrow(_pairs, "shard long, a long, b long, n long"), two, least, "pairs")
    triples = _frequent(_gathered(known, bitmaps, pairs).mapInArrow(_triples, "shard long, a long, b long, c long, n long"), three, least, "triples")
    found = _gathered(known, bitmaps, triples).mapInArrow(_deepened(longest), "lang string, phrase string, k int, n long")
    longer = found.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    single = known.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("f").alias("a")).distinct()
    counted = single.unionByName(_named(pairs, two, known)).unionByName(_named(triples, three, known)).unionByName(longer)
    return materialise(counted, "phrases"), words


def _run(first: Column, size: Column) -> Column:
    """``size`` words of a phrase from the ``first`` one on (from 1)."""
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def _cuts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, k, a, n and of the lowest-scoring cut l, r, score."""
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("part_a"))
    cut = phrases.where("k > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("*", _run(F.lit(1), F.col("cut")).alias("left"), _run(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    cut = cut.join(parts.withColumnsRenamed({"part": "left", "part_a": "l"}), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "part_a": "r"}), ["lang", "right"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("over", (F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * wide("n")).cast("decimal(38,0)")).withColumn("under", (wide("l") * F.col("r").cast("decimal(19,0)")).cast("decimal(38,0)"))
    cut = cut.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "cut", "l", "r")).alias("best")
    return cut.groupBy("lang", "phrase", "k", "a", "n").agg(best).select("lang", "phrase", "k", "a", "n", "best.l", "best.r", "best.score")


def _covered(phrases: DataFrame, cover: int) -> DataFrame:
    """lang, phrase of those that stand in a longer phrase which occurs ``cover`` in a hundred times as often, or more."""
    inner = phrases.where("k > 2").select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    most = inner.groupBy("lang", _run(F.col("first"), F.col("size")).alias("inner")).agg(F.max("a").alias("most"))
    met = phrases.where("k > 1").join(most.withColumnRenamed("inner", "phrase"), ["lang", "phrase"])
    return met.where(F.col("most") * 100 >= F.col("a") * cover).select("lang", "phrase")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, cover: int = 100, top: int = 2000, shard_words: int = 4_000_000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language; see the module."""
    phrases, words = count_phrases(docs, text_col, lang_col, longest, least, shard_words)
    kept = _cuts(phrases, words).join(_covered(phrases, cover), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
