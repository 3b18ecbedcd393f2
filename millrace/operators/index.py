"""A positional inverted index over texts, and look-ups of quoted phrases in it with a broader fallback.

``build`` writes the words of each text by their places, and a row for each word of a text with the positions at which it stands. Rows are dealt to buckets by word; a word that is in more than ``HOT``
texts is dealt by word and text, so no bucket holds a hot word alone, and a look-up that names both still reads one bucket of it.

``search`` never reads the texts. Equal queries are answered once. The index is dealt to blocks of texts by id, ``BLOCK`` positions in each, and a query is sent to the blocks that hold its
rarest word. There the positions of the rarest word of a phrase are tried one after the other; queries that find no text with all their phrases take the texts that hold all their words. What leaves a block
is a query's ``most`` best texts of it, so what is written grows with queries and blocks, not with the texts that hold a hot word. A block's positions are what a task holds; queries pass it in batches.

Words are runs of letters and digits in lower case. Defined cases: null and empty texts have no words; phrases without words ask for nothing, and a query without any finds nothing; repeated phrases
and words count once; repeated ids are one text each, told apart by nothing, so ids must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions.rounds import materialise, materialise_by, small_batches

#: Texts of a word from which on its rows are dealt by text too.
HOT = 100_000
#: Positions of a block of texts (about 200 MB of a Python process).
BLOCK = 1_500_000


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, id, at (array of positions, from 0), slot
    terms: DataFrame  # term, df, slots
    texts: DataFrame  # id, words (by their places, joined by blanks), n


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(X.text(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _slot(id_col: str, slots: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.col(slots))


def build(docs: DataFrame, id_col: str, text: Column | str, hot: int = HOT) -> Index:
    """The index of ``docs``, written to the shared folder."""
    own = docs.select(F.col(id_col).alias("id"), words(text).alias("words")).where("id is not null and size(words) > 0")
    texts = materialise(own.select("id", F.array_join("words", " ").alias("words"), F.size("words").alias("n")), "texts")
    at = texts.select("id", F.posexplode(F.split("words", " ")).alias("at", "term"))
    rows = materialise(at.groupBy("term", "id").agg(F.array_sort(F.collect_list("at")).alias("at")), "positions")
    terms = rows.groupBy("term").agg(F.count("*").alias("df")).withColumn("slots", F.ceil(F.col("df") / hot))
    terms = materialise(terms, "terms")
    several = terms.where("slots > 1").select("term", "slots")
    dealt = rows.join(several, "term", "left").withColumn("slot", F.coalesce(_slot("id", "slots"), F.lit(0)))
    dealt = dealt.withColumn("bucket", F.concat_ws(" ", "term", "slot")).drop("slots")
    return Index(materialise_by(dealt, "postings", "bucket"), terms, texts)


class Block:
    """The positions of the texts of one block: words by number, texts by the order of their ids, and which word stands at each place, with a gap after each text."""

    def __init__(self, parts: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(parts)
        ids = rows.column("id").combine_chunks()
        order = pc.array_sort_indices(ids)
        self.ids = ids.take(order)
        texts = pc.split_pattern(rows.column("words").combine_chunks().take(order), " ")
        length = pc.list_value_length(texts).to_numpy().astype(np.int64)
        own = texts.flatten().dictionary_encode()
        self.number = {w: k for k, w in enumerate(own.dictionary.to_pylist())}
        word = own.indices.to_numpy().astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(length + 1)])  # of each text
        self.text_at = np.repeat(np.arange(len(length)), length + 1)
        at = np.arange(len(word)) + np.repeat(np.arange(len(length)), length)
        self.word_at = np.full(self.start[-1], -1, np.int64)
        self.word_at[at] = word
        by_word = np.argsort(word, kind="stable")
        self.places = at[by_word]  # by word, then in order
        self.first_place = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(self.number)))])
        word, text = word[by_word], self.text_at[self.places]
        runs = np.flatnonzero(np.concatenate([[True], (np.diff(word) != 0) | (np.diff(text) != 0)]))
        self.texts, self.n = text[runs], np.diff(np.concatenate([runs, [len(text)]]))  # by word, then in order
        self.first_text = np.concatenate([[0], np.cumsum(np.bincount(word[runs], minlength=len(self.number)))])

    def stands(self, phrase: list[int]) -> np.ndarray:
        """Where a phrase starts, in order."""
        sizes = [self.first_place[w + 1] - self.first_place[w] for w in phrase]
        rare = int(np.argmin(sizes))
        at = self.places[self.first_place[phrase[rare]] : self.first_place[phrase[rare] + 1]] - rare
        at = at[(at >= 0) & (at + len(phrase) <= len(self.word_at))]
        for k, w in enumerate(phrase):
            if k != rare and len(at):
                at = at[self.word_at[at + k] == w]
        return at

    def exact(self, phrases: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """texts with all phrases, where the first one starts first, how often they stand there"""
        texts = at = n = None
        for k, phrase in enumerate(phrases):
            places = self.stands(phrase)
            if not len(places):
                return None
            text = self.text_at[places]
            first = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
            own, count = text[first], np.diff(np.concatenate([first, [len(text)]]))
            if k == 0:
                texts, at, n = own, places[first] - self.start[own], count
            else:
                texts, a, b = np.intersect1d(texts, own, assume_unique=True, return_indices=True)
                at, n = at[a], n[a] + count[b]
        return (texts, at, n) if len(texts) else None

    def broad(self, words: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """texts with all words, and how many of theirs these are; where the first one stands is left to ``first``"""
        spans = sorted(((self.first_text[w], self.first_text[w + 1]) for w in words), key=lambda s: s[1] - s[0])
        texts, n = self.texts[slice(*spans[0])], self.n[slice(*spans[0])]
        for a, b in spans[1:]:
            own = self.texts[a:b]
            k = np.searchsorted(own, texts)
            held = own[np.minimum(k, len(own) - 1)] == texts
            texts, n = texts[held], n[held] + self.n[a:b][k[held]]
        return (texts, n) if len(texts) else None

    def first(self, text: int, words: list[int]) -> int:
        return int(np.argmax(np.isin(self.word_at[self.start[text] : self.start[text + 1] - 1], words)))

    def answer(self, phrases: list[list[str]], most: int) -> tuple[bool, list[tuple[int, int, int]]]:
        """Whether they are broad, and the bests: text, at, n."""
        try:
            asked = [[self.number[w] for w in p] for p in phrases]
        except KeyError:
            return False, []
        if found := self.exact(asked):
            texts, at, n = found
            return False, [(texts[k], at[k], n[k]) for k in _top(texts, n, most)]
        words = list({w for p in asked for w in p})
        if found := self.broad(words):
            texts, n = found
            return True, [(texts[k], self.first(texts[k], words), n[k]) for k in _top(texts, n, most)]
        return False, []


def _top(texts: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """Which have the largest n, the earlier text on ties; ``texts`` are in order."""
    return np.argsort(-n, kind="stable")[:most]


def _in_blocks(most: int, id_type: pa.DataType):
    """Rows of whole blocks, each block's texts before its queries -> cid, broad, id, at, n"""
    names = ["cid", "broad", "id", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, made = None, [], None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1), len(block)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if own != block[a]:
                    own, parts, made = block[a], [], None
                if kind[a] == 0:
                    parts.append(batch.slice(a, b - a).select(["id", "words"]))
                    continue
                made = made or Block(parts)
                parts = []
                out = []
                for cid, phrases in zip(batch.column("cid").slice(a, b - a).to_pylist(), batch.column("phrases").slice(a, b - a).to_pylist(), strict=True):
                    broad, bests = made.answer(phrases, most)
                    out += [(cid, broad, *x) for x in bests]
                if out:
                    cid, broad, text, at, n = zip(*out, strict=True)
                    ids = made.ids.take(pa.array(np.array(text, np.int64))).cast(id_type)
                    yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(broad, pa.bool_()), ids, pa.array(np.array(at, np.int32)), pa.array(np.array(n, np.int64))], names)

    return run


def search(index: Index, queries: DataFrame, most: int = 5, block: int = BLOCK) -> DataFrame:
    """qid, rank (from 1), id, at, n, broad: the ``most`` best texts of each of the ``queries`` (qid, phrases: array of texts).

    n is how often the phrases stand there, at where the first one starts first. Most finds first, then the smaller id. Broad ones (only where nothing has all
    phrases) hold all words, n counts these, and at is the first of any.
    """
    spark = queries.sparkSession
    small_batches(spark)
    wanted = F.array_distinct(F.filter(F.transform("phrases", words), lambda w: F.size(w) > 0))
    asked = materialise(queries.select("qid", wanted.alias("phrases")).where("size(phrases) > 0"), "asked")
    classes = materialise(asked.select("phrases").distinct().withColumn("cid", F.monotonically_increasing_id()), "classes")
    terms = classes.select("cid", F.explode(F.array_distinct(F.flatten("phrases"))).alias("term")).join(index.terms.select("term", "df"), "term", "left")
    rare = terms.groupBy("cid").agg(F.count_if(F.col("df").isNull()).alias("unknown"), F.min(F.struct("df", "term")).alias("rare")).where("unknown = 0")
    rare = rare.select("cid", F.col("rare.term").alias("term"))
    positions = index.texts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-positions // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    sent = index.postings.select("term", own).distinct().join(rare, "term").select("cid", "block").join(classes, "cid")
    rows = index.texts.select(own, F.lit(0).alias("kind"), "id", "words", F.lit(None).cast("long").alias("cid"), F.lit(None).cast("array<array<string>>").alias("phrases"))
    rows = rows.unionByName(sent.select("block", F.lit(1).alias("kind"), "cid", "phrases"), allowMissingColumns=True)
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "kind")
    kind = index.texts.schema["id"].dataType
    met = materialise(rows.mapInArrow(_in_blocks(most, to_arrow_type(kind)), f"cid long, broad boolean, id {kind.simpleString()}, at int, n long"), "met")
    exact = met.where("not broad").select("cid").distinct()
    bests = _bests(met.where("not broad").unionByName(met.where("broad").join(exact, "cid", "left_anti")), most)
    return asked.join(classes, "phrases").select("qid", "cid").join(bests, "cid").select("qid", "rank", "id", "at", "n", "broad")


def _bests(rows: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("cid").orderBy(F.desc("n"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("cid", "rank", "id", "at", "n", "broad")


def snippets(found: DataFrame, docs: DataFrame, id_col: str, text: Column | str, before: int = 5, length: int = 30, most: int = 3000) -> DataFrame:
    """qid, text: ``length`` words of each find, from ``before`` words before it, in the order of the ranks."""
    own = docs.join(found.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi").select(F.col(id_col).alias("id"), words(text).alias("words"))
    cut = F.array_join(F.slice("words", F.greatest(F.col("at") - before, F.lit(0)) + 1, length), " ")
    rows = found.join(own, "id").select("qid", "rank", cut.alias("body"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("rank", "body"))), lambda x: x["body"])
    return rows.groupBy("qid").agg(F.left(F.array_join(bodies, " "), F.lit(most)).alias("text"))
