"""Exact token counts of whole documents under a public byte-level tokenizer, huge documents in overlapping chunks.

A *stable boundary* is the place before a single space between two characters that aren't white space. The tokenizer's
pattern has no match that holds a space anywhere but in front or in a run of white space, so the match before must end there, and the next
one begins with that space; merges never cross matches, and a special string that holds no space can't reach over it. What stands on both sides of a
stable boundary is therefore tokenized on its own. Whether a place is one is told by the three characters around it.

Texts of more than ``chunk_chars`` characters are cut into chunks, each reaching ``overlap`` characters into the next, and the chunks are dealt to tasks, so one huge
document is work for many. A chunk is encoded by its stretches between stable boundaries, with their offsets; equal stretches are encoded once in a task. Neighbours are spliced
at the first stable boundary that both have found in their overlap: the tokens of the left one behind it and of the right one before it don't count. If the overlap
has none, alignment fails: then the overlap is widened until one is found, chunk by chunk, over what the chunks kept of their texts for this case, and the widened chunk
is encoded instead of its parts. A text without any stable boundary ends as one chunk, as it must: its merges may depend on all of it.

How it scales: only texts of huge documents are shuffled, each once, by chunk; overlaps' boundaries and counts are all that meets again, by document. A task holds a chunk, or a
document where nothing can be cut. The tokenizer's file is read by each Python process from its path, never broadcast.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give a row each; a null doc_id is kept; very long texts, of white space or one letter too, are counted whole; bytes
that aren't UTF-8 are replaced; special strings within texts are taken as the library takes them by default; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import partitions_for, pick

#: Characters that some tables count as white space, besides those of Python's ``\s``.
ODD_SPACES = "\u180e\u200b\u2060\ufeff"
STABLE = re.compile(rf"(?<=[^\s{ODD_SPACES}])(?= [^\s{ODD_SPACES}])")
#: Stretches that a task remembers, and characters of the longest such.
KNOWN, SHORT = 400_000, 60
CHUNKS = "uid long, k int, last boolean, doc_id {id}, n_bytes long, text string"
MARKS = "array<struct<at: int, n: long>>"
PIECES = f"uid long, k int, last boolean, doc_id {{id}}, n_bytes long, n long, head {MARKS}, tail {MARKS}, text string"


def default_tokenizer() -> str:
    """The public tokenizer's place on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Counter:
    """Token counts of stretches of text, equal short ones encoded once."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, int] = {}

    def learn(self, stretches: set[str]) -> None:
        """Encodes what isn't known yet, together."""
        new = [s for s in stretches if s not in self.known]
        if len(self.known) + len(new) > KNOWN:
            self.known, new = {}, list(stretches)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, map(len, _tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str]) -> list[tuple[list[str], list[int]]]:
        """Of each text its stretches and how many tokens each has."""
        cut = [STABLE.split(text) for text in texts]
        self.learn({s for stretches in cut for s in stretches if len(s) <= SHORT})
        known = self.known
        return [(stretches, [known[s] if len(s) <= SHORT else self.whole(s) for s in stretches]) for stretches in cut]

    def whole(self, stretch: str) -> int:
        return len(_tokenizer(self.path).encode(stretch, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        return sum(self.counts([text])[0][1])


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") if x else "" for x in column.to_pylist()]


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about ``most`` characters together, as ranges."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _short(path: str):
    """(doc_id, text) -> doc_id, n_bytes, n_tokens of texts that are no longer than a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            raw = batch.column(1).to_pylist()
            texts = _texts(batch.column(1))
            n = [sum(c) for a, b in _groups(texts) for _, c in counter.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk_chars: int, overlap: int):
    """(doc_id, text) -> the chunks of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for row in range(batch.num_rows):
                uid += 1
                raw = batch.column(1)[row].as_py()
                text = raw.decode("utf-8", "replace")
                starts = range(0, max(1, len(text) - overlap), chunk_chars - overlap)
                for a in range(0, len(starts), 64):
                    ks = range(a, min(a + 64, len(starts)))
                    m = len(ks)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid] * m, pa.int64()), pa.array(ks, pa.int32()), pa.array([k == len(starts) - 1 for k in ks]), pa.array([batch.column(0)[row].as_py()] * m, batch.schema.field(0).type),
                            pa.array([len(raw)] * m, pa.int64()), pa.array([text[starts[k] : starts[k] + chunk_chars] for k in ks], pa.string()),
                        ],
                        ["uid", "k", "last", "doc_id", "n_bytes", "text"],
                    )

    return run


def _marks(ends: list[int], sums: list[int], first: int, last: int, start: int) -> list[dict]:
    """The boundaries at ``first`` to ``last``, as offsets from ``start``, and the tokens before each."""
    return [{"at": at - start, "n": n} for at, n in zip(ends, sums, strict=True) if first <= at <= last]


def _encode(path: str, chunk_chars: int, overlap: int):
    """Chunks -> their token counts and the boundaries in their overlaps; the text stays where an overlap has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in (b.slice(at, 32) for b in batches for at in range(0, b.num_rows, 32)):
            texts = batch.column(5).to_pylist()
            step, out = chunk_chars - overlap, []
            for text, k, last, (stretches, n) in zip(texts, batch.column(1).to_pylist(), batch.column(2).to_pylist(), counter.counts(texts), strict=True):
                ends, sums = list(accumulate(map(len, stretches))), list(accumulate(n))
                # both neighbours see the three characters around these places
                head = _marks(ends, sums, 1, overlap - 2, 0) if k else []
                tail = [] if last else _marks(ends, sums, step + 1, chunk_chars - 2, step)
                aside = k and not head or not last and not tail
                out.append((sums[-1], head, tail, text if aside else None))
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int64())]))] * 2, pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *cols], ["uid", "k", "last", "doc_id", "n_bytes", "n", "head", "tail", "text"])

    return run


def _widened(path: str, overlap: int):
    """Runs of chunks that couldn't be aligned are put together and encoded as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            at = batch.schema.get_field_index("n")
            n = [
                n if len(parts) == 1 else counter.count("".join(p["text"][overlap * bool(i) :] for i, p in enumerate(sorted(parts, key=lambda p: p["k"]))))
                for n, parts in zip(batch.column(at).to_pylist(), batch.column("parts").to_pylist(), strict=True)
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(n, pa.int64())).drop_columns(["parts"])

    return run


def _spliced(pieces: DataFrame, path: str, overlap: int, kind: str) -> DataFrame:
    """uid, doc_id, n_bytes, n_tokens: neighbours joined at common boundaries, runs of chunks without any widened."""
    by = Window.partitionBy("uid").orderBy("k")
    places = lambda c: F.transform(c, lambda x: x["at"])
    at = F.array_min(F.array_intersect(places(F.col("tail")), places(F.lead("head").over(by))))
    linked = pieces.withColumn("after", F.lead("head").over(by)).withColumn("cut", at)
    n_at = lambda c: F.filter(c, lambda x: x["at"] == F.col("cut"))[0]["n"]
    twice = F.when(F.col("cut").isNotNull(), F.col("n") - n_at(F.col("tail")) + n_at(F.col("after"))).otherwise(0)
    runs = F.sum(F.col("cut").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    linked = linked.withColumn("twice", twice).withColumn("run", F.coalesce(runs, F.lit(0)))
    grouped = linked.groupBy("uid", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("twice").alias("twice"), F.sum("n").alias("n"), F.collect_list(F.struct("k", "text")).alias("parts")
    )
    whole = grouped.mapInArrow(_widened(path, overlap), f"uid long, run long, doc_id {kind}, n_bytes long, twice long, n long")
    return whole.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum(F.col("n") - F.col("twice")).alias("n_tokens"))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = 1024, chunk_chars: int = 32_768, overlap: int = 512) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens); see the module."""
    if not 8 <= overlap <= chunk_chars // 2:
        raise ValueError("an overlap is 8 characters at least and half a chunk at most")
    path = tokenizer or default_tokenizer()
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    length = F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), length.alias("length"))
    short = rows.where(F.col("length") <= chunk_chars).select("doc_id", "text").mapInArrow(_short(path), f"doc_id {kind}, n_bytes long, n_tokens long")
    cut = rows.where(F.col("length") > chunk_chars).select("doc_id", "text").mapInArrow(_cut(chunk_chars, overlap), CHUNKS.format(id=kind))
    pieces = cut.repartition(partitions_for(docs.sparkSession), "uid", "k").mapInArrow(_encode(path, chunk_chars, overlap), PIECES.format(id=kind))
    found = short.unionByName(_spliced(pieces, path, overlap, kind).drop("uid"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
