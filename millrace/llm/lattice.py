"""Language-model scores by a subword lattice: the probability of a text summed over all its segmentations.

The pieces are those of an existing public vocabulary. Its file holds merge ranks, not probabilities, so the
unigram scores are the log relative frequencies of the pieces in the training words (each word segmented by the public
tokenizer itself), smoothed so that no piece has probability zero. A word, led by the word mark, gets the sum over all
its segmentations by a forward recursion in log space; characters without a piece go through the vocabulary's byte pieces. A
text is its words and one end. Pieces never cross words, so a text's log probability is the sum over its words, and each distinct word
runs through the recursion once.

How it scales: word counts combine in the tasks before the shuffle. The most frequent words, ``head_words`` at most, are
broadcast and scored where the texts are read; the remaining words, each of which is rarer than all of those, meet the
word table in a shuffle join and their sums go back to the documents with partial aggregation.

Defined cases: null and empty texts have the end token alone; a null doc_id is a training document and not held out; repeated rows
each train and each give a row; without training documents all counts are zero; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER_BYTES, materialise, pick

MARK = "▁"
#: Distinct words that a task holds before it passes its counts on.
FLUSH = 300_000
#: Count that every piece and the end have besides their own.
SMOOTH = 0.1


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_BYTES).split() if text else []


class PieceLattice:
    """Log probabilities of pieces in a trie; ``word`` sums over all segmentations."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_: list[float]) -> None:
        self.trie: dict = {}
        self.bytes = bytes_
        for piece, score in pieces:
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def word(self, word: str) -> float:
        """Natural log of the probability of the marked word."""
        text = MARK + word
        n, trie = len(text), self.trie
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            terms = into[i]
            if not terms:  # inside a character sequence that no piece ends at
                continue
            if len(terms) == 1:
                here = terms[0]
            else:
                top = max(terms)
                here = top + log(sum([exp(x - top) for x in terms]))
            into[i] = terms = []
            c = text[i]
            node = trie.get(c)
            if node is None or "" not in node:
                into[i + 1].append(here + sum(self.bytes[b] for b in c.encode("utf-8", "replace")))
            k = i
            while node is not None:
                k += 1
                if "" in node:
                    into[k].append(here + node[""])
                node = node.get(text[k]) if k < n else None
        top = max(into[n])
        return top + log(sum(exp(x - top) for x in into[n]))


def _vocabulary(path: str) -> tuple[bytes, list[str], list[int]]:
    """The model file's bytes, its pieces by id, and the ids of its 256 byte pieces."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return model, pieces, [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def default_vocabulary() -> str:
    """The public vocabulary's place on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(train, text) -> word, training count (0 for words that only other documents have), count in all documents."""
    counts: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = [*counts, *(other.keys() - counts.keys())]
        cols = [pa.array(words, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in words], pa.int64()), pa.array([counts[w] + other[w] for w in words], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["word", "c", "seen"])

    for batch in batches:
        for train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (counts if train else other).update(words_of(text))
            if len(counts) + len(other) > FLUSH:
                yield out()
                counts, other = Counter(), Counter()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over the training documents and seen over all of ``docs`` (train boolean, text binary)."""
    return docs.select("train", "text").mapInArrow(_count_words, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def train_lattice(words: DataFrame, n_ends: int, vocabulary: str) -> tuple[PieceLattice, float]:
    """The lattice and the end's log probability from training counts ``words`` (word, c)."""
    spark = words.sparkSession
    model, pieces, byte_ids = _vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            ids = sp.encode(batch.column(0).to_pylist(), num_threads=1)
            flat = np.fromiter((x for y in ids for x in y), np.int64)
            weights = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(y) for y in ids])
            if len(flat):
                total += np.bincount(flat, weights, len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counted = words.where("c > 0").select("word", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(pieces))
    for row in counted.collect():  # one row for each piece of the vocabulary at most
        counts[row["id"]] = row["n"]
    usable = [i for i, p in enumerate(pieces) if MARK not in p[1:] and p not in ("<unk>", "<s>", "</s>") and i not in set(byte_ids)]
    total = sum(counts[i] for i in usable) + sum(counts[i] for i in byte_ids) + n_ends + SMOOTH * (len(usable) + 257)
    score = lambda n: log((n + SMOOTH) / total)
    return PieceLattice([(pieces[i], score(counts[i])) for i in usable], [score(counts[i]) for i in byte_ids]), score(n_ends)


def _with_lattice(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = shared.value.word
        for batch in batches:
            scores = [word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["word", "c", "ln_p"])

    return run


def _score_documents(shared, end: tuple[int, float]):
    """(doc_id, train, text) -> a row with the sums over the head words, led by a blank so that it meets no word, and a
    row for each other word of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, uid = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, flat, tf, rows = [], [], [], []
                for doc, train, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    uid += 1
                    words = words_of(text)
                    known, base, ln_p = int(end[0] > 0), log10(end[0] + 0.5), end[1]
                    for word, n in Counter(words).items():
                        if (h := head.get(word)) is None:
                            ids.append(uid)
                            flat.append(word)
                            tf.append(n)
                        else:
                            known += n * h[0]
                            base += n * h[1]
                            ln_p += n * h[2]
                    rows.append((uid, doc, train, len(words) + 1, known, base, ln_p))
                n, m = len(rows), len(ids)
                uids, docs, trains, tokens, knowns, bases, lns = (list(x) for x in zip(*rows, strict=True))
                pad = [None] * m
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(uids + ids, pa.int64()), pa.array([b" %d" % u for u in uids] + flat, pa.binary()).cast(pa.string()), pa.array([None] * n + tf, pa.int32()),
                        pa.array(docs + pad, part.schema.field(0).type), pa.array(trains + pad, pa.bool_()), pa.array(tokens + pad, pa.int64()), pa.array(knowns + pad, pa.int64()),
                        pa.array(bases + pad, pa.float64()), pa.array(lns + pad, pa.float64()),
                    ],
                    ["uid", "word", "tf", "doc_id", "train", "n_tokens", "known", "base", "ln_p0"],
                )

    return run


def _least_count(words: DataFrame, most: int) -> int:
    """How often a word must be seen, training documents or not, so that at most ``most`` words are; found from a histogram of fixed size."""
    step = F.floor(F.log2("seen") * 16)
    rows = words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("seen").alias("c")).collect()
    least, held = (1 << 62), 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    return least


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, head_words: int = 50_000, folds: int = 5, held_fold: int = 1) -> DataFrame:
    """A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; see the module.

    Documents whose crc32(doc_id as text) mod ``folds`` is ``held_fold`` are held out; the others train.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(fold != held_fold, F.lit(True)).alias("train"), F.col("text").cast("binary").alias("text"))
    n_ends = rows.where("train").count()
    words = materialise(word_counts(rows), "words")
    total = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (total["n"] or 0) + n_ends, total["v"] + (n_ends > 0)
    lattice, end = train_lattice(words, n_ends, vocabulary or default_vocabulary())
    top = words.where(F.col("seen") >= _least_count(words, head_words)).collect()
    head = {r["word"].encode(): (int(r["c"] > 0), log10(r["c"] + 0.5), lattice.word(r["word"])) for r in top}
    shared, shared_head = spark.sparkContext.broadcast(lattice), spark.sparkContext.broadcast(head)
    schema = f"uid long, word string, tf int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, train boolean, n_tokens long, known long, base double, ln_p0 double"
    parts = rows.mapInArrow(_score_documents(shared_head, (n_ends, end)), schema)
    scored = words.select("word", "c").mapInArrow(_with_lattice(shared), "word string, c long, ln_p double")
    met = parts.join(scored, "word", "left")
    tf = F.col("tf")
    sums = met.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("c") > 0, tf).otherwise(0)).cast("long")).alias("n_known"),
        F.sum(F.coalesce("base", tf * F.log10(F.col("c") + 0.5))).alias("base"),
        F.sum(F.coalesce("ln_p0", tf * F.col("ln_p"))).alias("ln_p"),
    )
    return sums.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(log10(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("ln_p") / F.lit(log(10))).alias("score"),
    )
