"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark's items are normalised to words and put into one suffix automaton; every document's words stream through
it while the length of the longest match that ends at each word is tracked. A word is *hit* when an occurrence of a
window covers it. A window is any run of ``window`` words of one item; an item with fewer words (but not none) is a
window as a whole.

Only narrow transformations touch the documents: no shuffle, and they are read once and never written. A task holds one automaton of at most ``MAX_AUTOMATON_WORDS`` words. Of a
larger benchmark it holds the items' texts and the sorted hashes of their windows: these tell which items can have a window in a document (a few documents have any), and the automaton of just
these items, made when it is first needed, tells which do. So hashes only spare work, words decide. A benchmark of more than ``MAX_WORDS`` words, about 150 MB of a Python process, is cut into parts that the documents pass
one after the other, each pass written.

Defined cases: a null or empty text has no words and no hits; a benchmark that is empty, or holds only nulls, hits
nothing; very long texts are scanned whole; ``longest`` is 0 where no window occurs; repeated benchmark rows count once by ``item_id``; repeated documents each give their own row; rows with a null
``doc_id`` are kept; extra columns are ignored by ``scan_documents`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import free_name, materialise, pick

#: Words that one automaton holds at most (an automaton has at most two states for each), and words of the benchmark that a task holds at most.
MAX_AUTOMATON_WORDS, MAX_WORDS = 200_000, 4_000_000
_STEPS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Bytes of words, ASCII letters in lower case; everything else becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD_PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(WORD_BYTES).split()


class WindowAutomaton:
    """All words of all items in one automaton; ``scan`` finds the covered spans and the items whose windows occur."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.back, self.size = [-1], [0]
        for _, words in items:
            at = 0
            for word in words:
                at = self._append(at, word)
        # By state: the items that have a window there; whole short items as (length, item).
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            at = 0
            for n, word in enumerate(words, 1):
                at = self.step[at][word]
                if n >= window:
                    self.items.setdefault(self._at_length(at, window), set()).add(item)
            if 0 < len(words) < window:
                self.short.setdefault(at, []).append((len(words), item))
        # The nearest state with a short item, from the state itself towards the root.
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.near = [-1] * len(self.size)
        for state in order:
            self.near[state] = state if state in self.short else self.near[self.back[state]] if state else -1

    def _append(self, last: int, word: bytes) -> int:
        """The state of the current item's words so far plus ``word``."""
        if (known := self.step[last].get(word)) is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, known, word)
        new = len(self.size)
        self.step.append({})
        self.size.append(self.size[last] + 1)
        self.back.append(0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.back[last]
        if last >= 0:
            known = self.step[last][word]
            self.back[new] = known if self.size[known] == self.size[last] + 1 else self._split(last, known, word)
        return new

    def _split(self, last: int, known: int, word: bytes) -> int:
        """Takes the shorter strings out of state ``known``."""
        new = len(self.size)
        self.step.append(dict(self.step[known]))
        self.size.append(self.size[last] + 1)
        self.back.append(self.back[known])
        self.back[known] = new
        while last >= 0 and self.step[last].get(word) == known:
            self.step[last][word] = new
            last = self.back[last]
        return new

    def _at_length(self, state: int, length: int) -> int:
        """The state that holds the last ``length`` words of ``state``'s strings."""
        while self.size[self.back[state]] >= length:
            state = self.back[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Covered spans (first word, word after the last) in order, items found, and the longest match in words."""
        step, back, size, near, window = self.step, self.back, self.size, self.near, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        state = length = longest = 0
        root = step[0]
        for i, word in enumerate(words):
            to = step[state].get(word)
            if to is None:
                if state == 0:
                    continue
                if word not in root:
                    state = length = 0
                    continue
                while to is None:
                    state = back[state]
                    to = step[state].get(word)
                length = size[state]
            state = to
            length += 1
            if length > longest:
                longest = length
            reach = 0
            if length >= window:
                reach = length
                full = self._at_length(state, window)
                if full not in seen:
                    seen.add(full)
                    found |= self.items[full]
            at = near[state]
            while at >= 0:
                for n, item in self.short[at]:
                    if n <= length:
                        found.add(item)
                        reach = max(reach, n)
                at = near[back[at]] if at else -1
            if reach:
                first = i + 1 - reach
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, found, longest


def _window_hashes(words: list[bytes], sizes: list[int]) -> dict[int, np.ndarray]:
    """By size the hashes of all runs of so many words."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out: dict[int, np.ndarray] = {}
    run = np.zeros(0, np.uint64)
    for k in range(min(max(sizes, default=0), len(words))):
        run = (run[:-1] if k else np.zeros(len(own), np.uint64)) + own[k:] * (_STEPS[k % 64] + np.uint64(k))
        if k + 1 in sizes:
            out[k + 1] = run
    return out


class RoutedItems:
    """Items of any number of words: hashes of windows choose those whose automaton scans a document."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, most: int) -> None:
        self.window, self.most = window, most
        self.names = [item for item, _ in items]
        self.texts = [b" ".join(words) for _, words in items]
        found: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        for k, (_, words) in enumerate(items):
            size = min(window, len(words))
            for n, hashes in _window_hashes(words, [size]).items():
                keys, owners = found.setdefault(n, ([], []))
                keys.append(np.unique(hashes))
                owners.append(np.full(len(keys[-1]), k, np.int32))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, (keys, owners) in found.items():
            all_, own = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(all_, kind="stable")
            self.tables[n] = all_[order], own[order]
        self.made: dict[tuple[int, ...], WindowAutomaton] = {}
        self.held = 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}, "held": 0}

    def _candidates(self, words: list[bytes]) -> list[int]:
        out: set[int] = set()
        for n, hashes in _window_hashes(words, list(self.tables)).items():
            keys, owners = self.tables[n]
            hashes = np.unique(hashes)
            first, end = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            for a, b in zip(first[end > first].tolist(), end[end > first].tolist(), strict=True):
                out.update(owners[a:b].tolist())
        return sorted(out)

    def _automaton(self, items: tuple[int, ...], n: int) -> WindowAutomaton:
        if items not in self.made:
            if self.held + n > self.most:
                self.made, self.held = {}, 0
            self.made[items] = WindowAutomaton([(self.names[k], self.texts[k].split(b" ")) for k in items], self.window)
            self.held += n
        return self.made[items]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """As an automaton's; candidates of more words than one may hold are scanned part by part."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        longest = n = 0
        part: list[int] = []
        candidates = self._candidates(words)
        for at, k in enumerate(candidates):
            part.append(k)
            n += self.texts[k].count(b" ") + 1
            if n >= self.most or at == len(candidates) - 1:
                own, items, size = self._automaton(tuple(part), n).scan(words)
                spans, found, longest = _union(spans + own), found | items, max(longest, size)
                part, n = [], 0
        return spans, found, longest


def _matcher(automaton_of, text_name: str, match_name: str):
    """The function for ``mapInArrow`` over rows with a text in bytes and earlier matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: WindowAutomaton | RoutedItems = automaton_of.value
        for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            texts = batch.column(batch.schema.get_field_index(text_name)).to_pylist()
            before = batch.column(batch.schema.get_field_index(match_name)).to_pylist()
            out = []
            for text, match in zip(texts, before, strict=True):
                words = words_of(text) if text else []
                spans, found, longest = automaton.scan(words)
                longest = longest if spans else 0
                if match:
                    found |= set(match["items"])
                    longest = max(longest, match["longest"])
                    spans = _union(spans + list(zip(match["starts"], match["ends"], strict=True)))
                out.append(
                    {"n_words": len(words), "longest": longest, "starts": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted(found)}
                )
            at = batch.schema.get_field_index(match_name)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_words: int, automaton_words: int):
    """What the documents pass, one after the other, each collected within the bound."""
    items = pick(benchmark, item=id_col, text=text_col).select(F.col("item").cast("string").alias("item"), "text").where("text is not null")
    n_words = F.size(F.split(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "))
    total = items.select(F.sum(n_words).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // max_words))
    for shard in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard) if shards > 1 else items
        rows = sorted({(r["item"] or "", r["text"]) for r in part.collect()})
        own = [(item, words_of(text.encode())) for item, text in rows]
        small = sum(len(words) for _, words in own) <= automaton_words
        yield WindowAutomaton(own, window) if small else RoutedItems([(item, words) for item, words in own if words], window, automaton_words)


def match_documents(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, max_words: int = MAX_WORDS, automaton_words: int = MAX_AUTOMATON_WORDS, then=None,
) -> DataFrame:
    """``docs`` with all its columns, with its texts in bytes and, last, the struct of its matches: see ``MATCHES``. then: makes
    what the last pass does with these rows in the same task, giving rows of ``docs``."""
    spark = docs.sparkSession
    text_name, match_name = free_name(docs, "__text"), free_name(docs, "__match")
    out = docs.withColumn(text_name, docs[text_col].cast("binary")).withColumn(match_name, F.lit(None).cast(MATCHES))
    before = None
    for automaton in _automata(benchmark, item_col, item_text_col, window, max_words, automaton_words):
        if before is not None:
            out = materialise(out.mapInArrow(before, out.schema), "matches")
        before = _matcher(spark.sparkContext.broadcast(automaton), text_name, match_name)
    if then is None:
        return out.mapInArrow(before, out.schema)
    return out.mapInArrow(lambda batches: then(before(batches)), docs.schema)


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, longest, items (found item_ids), starts and ends of hit spans."""
    found = match_documents(pick(docs, doc_id=id_col, text=text_col), benchmark, "text", **options)
    m = F.col("__match")
    covered = F.aggregate(F.zip_with(m["ends"], m["starts"], lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", m["n_words"].alias("n_words"), covered.alias("n_hit"), m["longest"].alias("longest"), m["items"].alias("items"), m["starts"].alias("starts"), m["ends"].alias("ends"))


def _cutter(text_col: str, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, matches = batch.column(at).to_pylist(), batch.columns[-1].to_pylist()
            keep, out = [], []
            for text, m in zip(texts, matches, strict=True):
                hit = sum(m["ends"]) - sum(m["starts"])
                keep.append(hit == 0 or hit <= max_coverage * m["n_words"])
                out.append(cut_spans(text, m["starts"], m["ends"]) if hit and keep[-1] else text)
            done = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            yield done.select(list(range(done.num_columns - 2))).filter(pa.array(keep, pa.bool_()))

    return run


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """``text`` without the words from each start to before each end, and without what stands between those words."""
    places = [m.span() for m in WORD_PATTERN.finditer("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    out, at = [], 0
    for a, b in zip(starts, ends, strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join(out) + text[at:]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = 0.5, **options,
) -> DataFrame:
    """``docs`` without benchmark passages: hit spans are cut from the text; a document of which more than
    ``max_coverage`` of the words are hit goes. Documents without a hit, null texts too, stay unchanged."""
    return match_documents(docs, benchmark, text_col, then=_cutter(text_col, max_coverage), **options)
