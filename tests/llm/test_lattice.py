import math
import random
import zlib
from collections import Counter

from millrace.llm import lattice as L


def all_segmentations(text, pieces):
    if not text:
        return 1.0
    return sum(math.exp(pieces[text[:k]]) * all_segmentations(text[k:], pieces) for k in range(1, len(text) + 1) if text[:k] in pieces)


def test_forward_sums_all_segmentations():
    r = random.Random(2)
    pieces = {p: -r.random() * 5 - 0.1 for p in [L.MARK, L.MARK + "a", "a", "b", "ab", "ba", "aba", "bb", "abc", "c"]}
    lattice = L.PieceLattice(list(pieces.items()), [-9.0] * 256)
    for _ in range(50):
        w = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
        assert math.isclose(lattice.word(w), math.log(all_segmentations(L.MARK + w, pieces)), rel_tol=1e-9)
    assert math.isclose(lattice.word("é"), pieces[L.MARK] - 18)


def brute(docs):
    train = {i: zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs}
    tokens = {k: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in (t or "").split(" ") if w] + [None] for k, (_, t) in enumerate(docs)}
    c = Counter(x for k, (i, _) in enumerate(docs) if train[i] for x in tokens[k])
    n, v = sum(c.values()), len(c)
    return sorted((i, not train[i], len(tokens[k]), sum(c[x] > 0 for x in tokens[k]), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens[k]), 6)) for k, (i, _) in enumerate(docs))


def test_against_brute_force(spark):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["The", "the", "ende", "héy", "x1", "日本", "q" * 40, f"w{r.randint(0, 60)}"]) for _ in range(r.choice([0, 1, 9, 80])))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "the  the"), (62, "the  the")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, word int, train string").repartition(3)
    for head in (3, 50_000):
        got = L.score_texts(df, head_words=head).collect()
        assert sorted((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == brute(docs)
        assert all(x.score < 0 and math.isfinite(x.score) for x in got)
        by = {x.doc_id: x.score for x in got}
        assert math.isclose(by[60], by[61]) and by[62] < by[61]
    assert L.score_texts(df.limit(0)).count() == 0


def test_document_scores_are_sums_over_all_segmentations(spark):
    """The whole score: by brute force over the segmentations of every word, and the end of the text."""
    r = random.Random(9)
    docs = [(i, " ".join(r.choice(["ab", "ba", "aba", "Babe", "cab", "new", "x"] if i % 3 else ["held", "ab"]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t.lower().split())
    words = spark.createDataFrame([(w, n, n) for w, n in counts.items()], "word string, c long, seen long")
    lattice, end = L.train_lattice(words, len(train), L.default_vocabulary())
    model, pieces, byte_ids = L._vocabulary(L.default_vocabulary())
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = Counter()
    for w, c in counts.items():
        for p in sp.encode(w):
            n[p] += c
    usable = [i for i, p in enumerate(pieces) if L.MARK not in p[1:] and p not in ("<unk>", "<s>", "</s>") and i not in byte_ids]
    total = sum(n[i] for i in usable) + sum(n[i] for i in byte_ids) + len(train) + L.SMOOTH * (len(usable) + 257)
    weights = {pieces[i]: math.log((n[i] + L.SMOOTH) / total) for i in usable}
    assert math.isclose(end, math.log((len(train) + L.SMOOTH) / total))
    for head in (2, 50_000):
        got = {x.doc_id: x.score for x in L.score_texts(df, head_words=head).collect()}
        for i, t in docs:
            want = end + sum(math.log(all_segmentations(L.MARK + w, weights)) for w in t.lower().split())
            assert math.isclose(got[i], want / math.log(10), rel_tol=1e-9)
