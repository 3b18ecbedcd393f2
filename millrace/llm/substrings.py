"""Repeated passages by prefix-partitioned suffix trees over words.

Every word position with at least ``window`` words left is a suffix, and what is asked of it is its window, its leading ``window`` words. Suffixes are split into groups by
variable-length prefixes: a window goes by the suffix within it whose leading four words have the least hash (its anchor); where too many have such an anchor, by the one with the least
eight words; else by all its words; so that each group fits into memory. Equal windows have equal anchors and meet. Ten windows in a row mostly share their anchor, so a group gets
stretches of text instead of each suffix' words. It builds the part of the suffix tree that its suffixes span: the suffixes in the order of their words, and the
lengths of the prefixes that neighbours share. A run of neighbours that share ``window`` words is what lies below one deep node; if a node has leaves in several
documents, those of all but the smallest doc_id start repeated windows. Neighbouring repeated windows join to maximal repeats, and their words are removed. Words are
compared as they are; hashes only choose groups and spare work.

How it scales:

1. Texts are packed by a few megabytes and written once, bucketed by ``home`` (a few packs of one task), so that what is found comes back to the packs by joins that don't move the texts.
2. A suffix without an equal elsewhere can't lie below a deep node. A pack sends the leading bits of the hashes of its distinct windows (sorted, two to three bytes each), by hash
   range; back comes a bit for each: some other pack has it. The same pass counts all prefixes, as fixed-size histograms that are summed in slices.
3. Only suffixes with an equal one travel, once for each pack and distinct window, as stretches of text by group (about four words for each suffix). Places come back.

A single window that stands in more than ``group_rows`` packs can't be split by a longer prefix; for such windows the smallest doc_id is found by an aggregation that
combines in the tasks, and since each holds at least a fixed share of all, this list is bounded and sent to the readers of the texts, which then decide by themselves.

Defined cases: a null text has no words; a text of fewer than ``window`` words loses none; repeats inside one document stay;
rows with equal doc_id don't remove each other; rows with a null doc_id lose nothing and remove nothing; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, materialise_by, pick

#: Bytes of text whose suffixes are packed together (compressed, less than what makes an object huge to the JVM), packs that share a home, and bytes of a long text that are cut into words at once.
PACK_BYTES, HOME_PACKS, PIECE = 1 << 20, 16, 1 << 20
#: Parts that a histogram is summed in.
SLICES = 64
#: Windows whose words are compared at once.
ROWS = 1 << 15
_ODD = [pow(0xD1B54A32D192ED03, 2 * k + 1, 1 << 64) for k in range(64)]
BLANKS = b" \t\n\x0b\x0c\r"


def depths_for(window: int) -> tuple[int, ...]:
    """The lengths of prefixes in words."""
    return tuple(d for d in (4, 8) if d < window) + (window,)


def path_codes(words: np.ndarray, window: int, places: np.ndarray) -> list[np.ndarray]:
    """For each depth and each of the windows at ``places`` the least code of that many words in a row within the window."""
    out, total = [], np.zeros(len(words), np.uint64)
    for k in range(window):
        total[: max(0, len(words) - k)] += words[k:] * np.uint64(_ODD[k])
        if k + 1 in depths_for(window):
            x = (total ^ (total >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
            x = x ^ (x >> np.uint64(28))
            least = x[places]
            for shift in range(1, window - k):
                np.minimum(least, x[places + shift], out=least)
            out.append(least)
    return out


def bits_for(chars: int, group_rows: int) -> int:
    """Bits of a histogram's bins: enough that a bin holds a small part of a group."""
    return min(20, max(12, int(chars * 4 // group_rows).bit_length()))


def _bins(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes >> np.uint64(64 - bits)).astype(np.int64)


# --- packs ---


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> packs of documents: their ids, which of them are null, and the lengths of their texts; the texts."""
    zip_, task, k = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33, 0

    def send(docs: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
        ids = np.array([i or 0 for i, _ in docs], np.int64)
        table = np.stack([np.diff(ids, prepend=0), np.array([i is None for i, _ in docs], np.int64), np.array([len(t) for _, t in docs], np.int64)])
        row = [task + k // HOME_PACKS, task + k, zlib.compress(table.tobytes(), 1), zip_.compress(b"".join(t for _, t in docs))]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["home", "pack", "ids", "texts"])

    held, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.append((doc, text or b""))
            size += 16 + len(text or b"")
            if size > PACK_BYTES:
                yield send(held)
                held, size, k = [], 0, k + 1
    if held:
        yield send(held)


def _opened(ids: bytes, texts: bytes) -> Iterator[tuple[int | None, bytes]]:
    """The documents of a pack and their texts."""
    table = np.frombuffer(zlib.decompress(ids), np.int64).reshape(3, -1)
    line, at = zstandard.ZstdDecompressor().decompress(texts), 0
    for doc, null, n in zip(np.cumsum(table[0]).tolist(), table[1].tolist(), table[2].tolist(), strict=True):
        yield None if null else doc, line[at : at + n]
        at += n


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[at:end].split()
        at = end


class Pack:
    """The suffixes of a pack: their places (counting all words of the pack), documents and path codes, and the words by number."""

    def __init__(self, ids: bytes, texts: bytes, window: int) -> None:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        flat, places, docs, at = [], [], [], 0
        for doc, text in _opened(ids, texts):
            parts = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in _pieces(text)]
            n = sum(map(len, parts))
            flat += parts
            if doc is not None and n >= window:
                places.append(np.arange(at, at + n - window + 1))
                docs.append(np.full(n - window + 1, doc))
            at += n
        self.words = list(number)
        self.flat = np.concatenate([*flat, np.zeros(0, np.int32)])
        self.places = np.concatenate([*places, np.zeros(0, np.int64)])
        self.docs = np.concatenate([*docs, np.zeros(0, np.int64)])
        codes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))[self.flat]
        self.codes = path_codes(codes, window, self.places)
        self.window = window

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The numbers of the words of these suffixes' windows."""
        return self.flat[self.places[at][:, None] + np.arange(self.window)]

    def cut(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct leading ``width`` bits of the windows' codes, in order; for each a suffix, and whether several documents have it; and where each suffix's are."""
        short = self.codes[-1] >> np.uint64(64 - width)
        own, first, back = np.unique(short, return_index=True, return_inverse=True)
        low, high = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(low, back, self.docs)
        np.maximum.at(high, back, self.docs)
        return own, first, low < high, back


def _small(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _large(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _zipped(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unzipped(x: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


# --- which windows have an equal one, and how many suffixes begin alike ---


def _shorts(window: int, bits: int, width: int, ranges: int):
    """Packs -> by pack and hash range the gaps between the distinct codes' leading bits; as ranges below 0 slices of the histograms."""
    names, kinds = ["range", "home", "pack", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def rows(x: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*x, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(depths_for(window)), 1 << bits), np.int64)
        for batch in batches:
            for home, number, ids, texts in zip(*batch.columns, strict=True):
                pack = Pack(ids.as_py(), texts.as_py(), window)
                own, first, _, _ = pack.cut(width)
                for d, codes in enumerate(pack.codes):
                    total[d] += np.bincount(_bins(codes[first], bits), minlength=1 << bits)
                at = np.searchsorted(own, np.arange(1, ranges, dtype=np.uint64) << np.uint64(width - (ranges - 1).bit_length()))
                parts = np.split(own, at)
                if out := [(k, home.as_py(), number.as_py(), _small(np.diff(x.astype(np.int64) - (k << (width - (ranges - 1).bit_length())), prepend=0))) for k, x in enumerate(parts) if len(x)]:
                    yield rows(out)
        if total.any():
            yield rows([(-1 - k, 0, 0, _zipped(x)) for k, x in enumerate(np.split(total.ravel(), len(total) * SLICES))])

    return run


def _elsewhere(rows: pd.DataFrame) -> pd.DataFrame:
    """A range -> for each pack the bits of those of its codes that another pack has; a slice -> its sum."""
    if rows["range"].iloc[0] < 0:
        total = sum(_unzipped(x, np.int64) for x in rows["data"])
        return rows.iloc[:1].assign(data=[_zipped(total)])
    codes = [np.cumsum(_large(x)) for x in rows["data"]]
    own, n = np.unique(np.concatenate(codes), return_counts=True)
    again = own[n > 1]
    bits = [np.packbits(np.isin(x, again, assume_unique=True)).tobytes() for x in codes]
    return rows.assign(data=bits)


class Plan:
    """Which group a suffix goes to: ``group[depth][bin]``, or -1 if its prefix must be longer."""

    def __init__(self, counts: np.ndarray, group_rows: int) -> None:
        self.bits = counts.shape[1].bit_length() - 1
        self.group = np.full(counts.shape, -1, np.int32)
        self.hot_bins: np.ndarray = counts[-1] > group_rows
        group, held = 0, 0
        for d in range(len(counts)):
            for b in np.flatnonzero(counts[d]):
                n = int(counts[d, b])
                if n > group_rows and d < len(counts) - 1:
                    continue
                if held + n > group_rows and held:
                    group, held = group + 1, 0
                self.group[d, b] = group
                held += n
        self.groups = group + 1

    def of(self, codes: list[np.ndarray]) -> np.ndarray:
        out = self.group[0][_bins(codes[0], self.bits)]
        for d in range(1, len(codes)):
            left = np.flatnonzero(out < 0)
            if not len(left):
                break
            out[left] = self.group[d][_bins(codes[d][left], self.bits)]
        return out


# --- subtrees ---


def distinct(pack: Pack, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes ``at``: the first one of each distinct window, and for each suffix the place of its window among these. Equal codes are
    compared by words; a suffix whose words differ from the first one's counts as distinct."""
    _, first, back = np.unique(pack.codes[-1][at], return_index=True, return_inverse=True)
    copies = np.flatnonzero(first[back] != np.arange(len(at)))
    other = [x[(pack.windows(at[x]) != pack.windows(at[first[back[x]]])).any(axis=1)] for x in np.split(copies, range(ROWS, len(copies), ROWS))]
    other = np.concatenate(other)
    back[other] = len(first) + np.arange(len(other))
    first = np.concatenate([first, other])
    order = np.argsort(first)
    turn = np.empty_like(order)
    turn[order] = np.arange(len(order))
    return at[first[order]], turn[back]


def stretches(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that the windows at the ascending ``starts`` cover, each once, and where each window starts among these."""
    new = np.concatenate([[True], np.diff(starts) > window])
    begin = starts[new]
    end = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + window
    ahead = np.concatenate([[0], np.cumsum(end - begin)])
    run = np.cumsum(new) - 1
    places = np.arange(ahead[-1]) + np.repeat(begin - ahead[:-1], end - begin)
    return places, starts - begin[run] + ahead[run]


def _spread(shared, window: int, width: int):
    """Packs with the bits of their codes -> by pack and group: the smallest doc_id of each distinct window, the windows' words, and the places.
    What the pack can decide alone goes out as group -1."""
    names = ["home", "pack", "grp", "least", "places", "more", "starts", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def send(home: int, number: int, pack: Pack, masks: list[dict]) -> Iterator[tuple]:
        plan, hot = shared.value
        own, _, several, back = pack.cut(width)
        bits = [np.unpackbits(np.frombuffer(m["data"], np.uint8)) for m in sorted(masks, key=lambda m: m["range"])]
        size = np.bincount((own >> np.uint64(width - shared_bits)).astype(np.int64), minlength=1 << shared_bits)
        known = np.concatenate([*[b[:n] for b, n in zip(bits, size[size > 0].tolist(), strict=True)], np.zeros(0, np.uint8)]) > 0
        at = np.flatnonzero((known | several)[back])
        if not len(at):
            return
        first, of = distinct(pack, at)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, of, pack.docs[at])
        if hot:
            codes = pack.codes[-1][first].tolist()
            for k, code in enumerate(codes):
                if code in hot:
                    line = b" ".join(pack.words[w] for w in pack.windows(first[k : k + 1])[0])
                    least[k] = min(int(least[k]), hot[code].get(line, int(least[k])))
        gone = pack.docs[at] > least[of]
        if gone.any():
            yield home, number, -1, b"", _small(np.diff(pack.places[at[gone]], prepend=0)), b"", b"", b""
        is_hot = np.array([c in hot for c in pack.codes[-1][first].tolist()]) if hot else np.zeros(len(first), bool)
        group = plan.of([c[first] for c in pack.codes])
        group[is_hot] = -1
        lead = np.zeros(len(at), bool)
        lead[np.unique(of, return_index=True)[1]] = True  # a window's first place; first ascends
        more_of, more_at = of[~lead], pack.places[at[~lead]]
        order = np.argsort(group, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-2)), len(order))
        turn = np.empty_like(order)
        by_group = np.argsort(group[more_of], kind="stable")
        more_cuts = np.searchsorted(group[more_of][by_group], np.append(group[order][cuts[:-1]], np.iinfo(np.int32).max))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = order[a:b]
            if group[part[0]] < 0:
                continue
            turn[part] = np.arange(len(part))
            rest = by_group[more_cuts[k] : more_cuts[k + 1]]
            covered, starts = stretches(pack.places[first[part]], window)
            yield (
                home, number, int(group[part[0]]), _zipped(np.diff(least[part], prepend=0)), _small(np.diff(pack.places[first[part]], prepend=0)),
                _small(np.concatenate([turn[more_of[rest]], more_at[rest]])), _small(np.diff(starts, prepend=0)),
                zstandard.ZstdCompressor(level=3).compress(b" ".join(map(pack.words.__getitem__, pack.flat[covered].tolist()))),
            )

    shared_bits = shared.value[0].range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, number, ids, texts, masks in zip(*batch.columns, strict=True):
                rows = list(send(home.as_py(), number.as_py(), Pack(ids.as_py(), texts.as_py(), window), masks.as_py() or []))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def subtree(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes' order by their words, and how many leading words each shares with the one before it (0 for the first)."""
    order = np.lexsort(windows.T[::-1])
    ahead = windows[order]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        shared[1:] = np.logical_and.accumulate(ahead[1:] == ahead[:-1], axis=1).sum(axis=1)
    return order, shared


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """Where the leaves of each node of at least the depth begin, in the suffixes' order; a suffix without such a node is one by itself."""
    return np.flatnonzero(shared < depth) if len(shared) else np.zeros(0, np.int64)


def _repeats(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One group's subtree: by pack the places whose node also has a leaf of a smaller doc_id."""
        if rows["grp"].iloc[0] < 0:
            return rows[["home", "pack", "places"]]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        least, tables = [], []
        for steps, starts, text in zip(rows["least"], rows["starts"], rows["text"], strict=True):
            words = zstandard.ZstdDecompressor().decompress(text).split(b" ")
            ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            tables.append(ids[np.cumsum(_large(starts))[:, None] + np.arange(window)])
            least.append(np.cumsum(_unzipped(steps, np.int64)))
        sizes = [len(x) for x in least]
        doc, table = np.concatenate(least), np.concatenate(tables)
        del tables
        order, shared = subtree(table)
        node = deep_nodes(shared, window)
        first = np.empty_like(doc)
        first[order] = np.repeat(np.minimum.reduceat(doc[order], node), np.diff(np.append(node, len(doc))))
        found = []
        for home, pack, places, more, again in zip(rows["home"], rows["pack"], rows["places"], rows["more"], np.split(doc > first, np.cumsum(sizes)[:-1]), strict=True):
            if again.any():
                of, at = _large(more).reshape(2, -1)
                gone = np.sort(np.concatenate([np.cumsum(_large(places))[again], at[again[of]]]))
                found.append((home, pack, _small(np.diff(gone, prepend=0))))
        return pd.DataFrame({"home": np.array([x[0] for x in found], np.int64), "pack": np.array([x[1] for x in found], np.int64), "places": [x[2] for x in found]})

    return run


def _hot_windows(packs: DataFrame, plan: Plan, window: int, group_rows: int) -> dict[int, dict[bytes, int]]:
    """By code and words the smallest doc_id of the windows that more than a quarter of ``group_rows`` packs have, among the bins that no prefix makes
    small enough: at most four for each ``group_rows`` windows."""
    shared = packs.sparkSession.sparkContext.broadcast(plan.hot_bins)
    bits = plan.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in zip(batch.column(0), batch.column(1), strict=True):
                pack = Pack(ids.as_py(), texts.as_py(), window)
                first, of = distinct(pack, np.flatnonzero(shared.value[_bins(pack.codes[-1], bits)]))
                at = np.flatnonzero(shared.value[_bins(pack.codes[-1], bits)])
                least = np.full(len(first), np.iinfo(np.int64).max)
                np.minimum.at(least, of, pack.docs[at])
                lines = [b" ".join(pack.words[w] for w in x) for x in pack.windows(first)]
                cols = [pa.array(pack.codes[-1][first].view(np.int64)), pa.array(lines, pa.binary()), pa.array(least)]
                yield pa.RecordBatch.from_arrays(cols, ["code", "words", "least"])

    found = packs.select("ids", "texts").mapInArrow(run, "code long, words binary, least long")
    found = found.groupBy("code", "words").agg(F.min("least").alias("least"), F.count("*").alias("n")).where(F.col("n") > group_rows // 4)
    out: dict[int, dict[bytes, int]] = {}
    for r in found.collect():  # bounded, as said above
        out.setdefault(r["code"] % (1 << 64), {})[bytes(r["words"])] = r["least"]
    return out


# --- removal ---


def _removed(kind: str, window: int):
    """(ids, texts, places) -> a row for each document."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, places in zip(*batch.columns, strict=True):
                again = np.unique(np.concatenate([*[np.cumsum(_large(x)) for x in places.as_py() or ()], np.zeros(0, np.int64)]))
                docs, n_words, n_removed, kept, spans, at = [], [], [], [], [], 0
                for doc, text in _opened(ids.as_py(), texts.as_py()):
                    parts = list(_pieces(text)) if len(text) <= PIECE else None
                    n = len(parts[0]) if parts else sum(map(len, _pieces(text)))
                    edge = np.zeros(n + 1, np.int32)
                    own = again[slice(*np.searchsorted(again, [at, at + n]))] - at
                    edge[own] += 1
                    edge[own + window] -= 1
                    gone, at = np.cumsum(edge)[:-1] > 0, at + n
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    docs.append(doc)
                    n_words.append(n)
                    n_removed.append(int(gone.sum()))
                    spans.append([{"start": int(x), "words": int(y - x)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                    lines, k = [], 0
                    for words in parts or _pieces(text):
                        own, k = gone[k : k + len(words)], k + len(words)
                        lines += [b" ".join(w for w, g in zip(words, own.tolist(), strict=True) if not g) if own.any() else b" ".join(words)]
                    kept.append(b" ".join(x for x in lines if x))
                cols = [pa.array(docs, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept", "repeats"])

    return run, f"doc_id {kind}, n_words long, n_removed long, kept string, repeats array<struct<start:int,words:int>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group_rows: int = 2_000_000) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, kept (the kept words, joined by blanks), repeats (array of
    the maximal removed spans as first word and number of words)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    packs = materialise_by(rows.mapInArrow(_packs, "home long, pack long, ids binary, texts binary"), "packs", "home")
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bits_for(chars, group_rows)
    # A pair of unlike windows shares its leading bits once in 256 windows at most; ranges hold about group_rows of them.
    width = min(64, max(24, (chars // 4 + 1).bit_length() + 8))
    range_bits = min(16, max(0, (chars // 6 // group_rows).bit_length()))
    width = min(width, 31 + range_bits)
    shorts = packs.mapInArrow(_shorts(window, bits, width, 1 << range_bits), "range int, home long, pack long, data binary")
    shorts = materialise(shorts.groupBy("range").applyInPandas(_elsewhere, "range int, home long, pack long, data binary"), "elsewhere")
    counts = np.zeros((len(depths_for(window)) * SLICES, (1 << bits) // SLICES), np.int64)
    for r in shorts.where("range < 0").select("range", "data").collect():  # slices of fixed-size histograms
        counts[-1 - r["range"]] = _unzipped(bytes(r["data"]), np.int64)
    plan = Plan(counts.reshape(len(depths_for(window)), -1), group_rows)
    plan.range_bits = range_bits
    hot = _hot_windows(packs, plan, window, group_rows) if plan.hot_bins.any() else {}
    shared = spark.sparkContext.broadcast((plan, hot))
    own = lambda c: F.filter(c, lambda x: x["pack"] == F.col("pack"))
    masks = shorts.where("range >= 0").groupBy("home").agg(F.collect_list(F.struct("pack", "range", "data")).alias("masks"))
    met = packs.join(masks.hint("shuffle_hash"), "home").select("home", "pack", "ids", "texts", own("masks").alias("masks"))
    spread = met.mapInArrow(_spread(shared, window, width), "home long, pack long, grp int, least binary, places binary, more binary, starts binary, text binary")
    salt = F.when(F.col("grp") < 0, F.col("pack")).otherwise(0)
    found = spread.groupBy("grp", salt.alias("salt")).applyInPandas(_repeats(window), "home long, pack long, places binary")
    found = found.groupBy("home").agg(F.collect_list(F.struct("pack", "places")).alias("found"))  # as large as the packs' own windows at most
    back = packs.join(found.hint("shuffle_hash"), "home", "left").select("ids", "texts", F.transform(own("found"), lambda x: x["places"]).alias("places"))
    return back.mapInArrow(*_removed("long", window))
