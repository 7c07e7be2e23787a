"""Repeated byte strings against plain counting of windows, and the transform against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np

from tributary.llm import suffix_dedup


def plain(texts, width):
    raws = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + width] for r in raws for i in range(len(r) - width + 1))
    out = []
    for r in raws:
        hit = bytearray(len(r) + 1)
        for i in range(len(r) - width + 1):
            if n[r[i : i + width]] > 1:
                hit[i : i + width] = b"\1" * width
        kept = bytes(b for b, h in zip(r, hit) if not h)
        spans = sum(h and not p for p, h in zip(b"\0" + hit, hit))
        out.append((len(r), len(r) - len(kept), spans, kept))
    return out


def removed(spark, texts, width, gram, most=suffix_dedup.MOST_PIECES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_bytes", "'x' AS digest", "2 AS spans").repartition(5)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, width=width, gram=gram, most=most).collect()}
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for _, r in sorted(got.items())]


def corpus(seed, size=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(size):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if rng.random() < 0.7:
            p = rng.choice(passage)
            a = rng.randint(0, len(p) // 2)
            p = p[a : a + rng.randint(30, 160)]
            if rng.random() < 0.5:
                i = rng.randint(0, len(p) - 1)
                p = p[:i] + "X" + p[i + 1 :]
            parts.append(p)
        parts.append(" ".join(word() for _ in range(rng.randint(0, 20))))
        texts.append(" ".join(parts))
    return texts + [None, "", "short", texts[3], texts[3], "a" * 300, "ab" * 100, "z" * 41]


def test_equals_counting_every_window(spark):
    texts = corpus(1)
    assert removed(spark, texts, 40, 20) == plain(texts, 40)


def test_divided_anchors_give_the_same(spark):
    texts = corpus(2, 60)
    assert removed(spark, texts, 40, 20, most=2) == plain(texts, 40)


def test_long_texts_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(1_300_000))
    texts = [long, "q" * 10 + long[600_000:600_900] + "r" * 10, long[5:404], long[1_299_500:]]
    (got, *others) = removed(spark, texts, 400, 200)
    assert got[:3] == (1_300_000, 1_400, 2) and got[3] == (long[:600_000] + long[600_900:1_299_500]).encode()
    assert [x[:3] for x in others] == [(920, 900, 1), (399, 0, 0), (500, 500, 1)]
    assert removed(spark, [], 400, 200) == []


def test_equal_rows_are_copies(spark):
    docs = spark.createDataFrame([(1, "abcdefgh" * 9), (1, "abcdefgh" * 9), (None, "unique text of some length, not found again")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs, width=20, gram=10).collect()) == [0, 72, 72]


def test_transform_equals_sorted_suffixes():
    rng = np.random.default_rng(2)
    pieces = [bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(50)]
    left = [int(rng.integers(0, len(p))) for p in pieces]
    made = suffix_dedup.Collection(pieces, left)
    for (c, order, prefix), (_, before, _) in zip(made.segments(), made.transform()):
        suffix = [pieces[i][c - made.base + left[i] :] for i in order]
        assert suffix == sorted(suffix)
        common = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(suffix, suffix[1:])]
        assert prefix.tolist() == [0, *common]
        at = [c - made.base + left[i] for i in order]
        assert before.tolist() == [pieces[i][a - 1] if a else 0 for i, a in zip(order, at)]


def test_query_on_the_smallest_table(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for r, x in zip(rows, plain([r.text for r in rows], 400))}
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.op12_suffix_dedup(spark, tiny).collect()} == expected
