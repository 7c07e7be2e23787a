"""Token alignment against loops over all token pairs."""

import hashlib
import json
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from tributary.llm import token_alignment

OWN = Tokenizer.from_file(f"{token_alignment.TOKENIZERS}/{token_alignment.A_FILE}")
OWN.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.TOKENIZERS}/{token_alignment.B_FILE}")


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


LETTERS = letters()
ENTRIES = {i: bytes(LETTERS[c] for c in e) for e, i in json.load(open(f"{token_alignment.TOKENIZERS}/{token_alignment.A_FILE}"))["model"]["vocab"].items() if i != 50256}


def piece(i):
    p = PIECES.id_to_piece(i)
    return bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()


def spread(ids, spelled):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(spelled(i))))
        at = out[-1][2]
    return out


def plain(texts):
    docs = []
    for t in texts:
        a = spread(OWN.encode(f" {t}", add_special_tokens=False).ids, ENTRIES.__getitem__) if t else []
        b = spread(PIECES.encode(t), piece) if t else []
        if t and not b"".join(ENTRIES[i] for i, _, _ in a) == f" {t}".encode() == b"".join(piece(i) for i, _, _ in b):
            a = b = []
        docs.append((a, b, [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]))
    n = Counter(p for _, _, links in docs for p in set(links))
    most = {}
    for (x, _), c in n.items():
        most[x] = max(most.get(x, 0), c)
    out = []
    for a, b, links in docs:
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in own if lo < e <= hi) for own in (a, b)) for lo, hi in zip([0, *ends], ends)]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(ends), len(links), sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links), sha))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_all_pairs_of_tokens(spark):
    texts = [
        "The quick brown fox jumps over the lazy dog.", "Unbelievable misunderstandings", "naïve café — déjà vu 東京タワー 🙂", None, "", " ", "  two  spaces\n\ttab ", "<|endoftext|> <s> </s> <unk>", "<0x41>",
        "The quick brown fox jumps over the lazy dog.", "▁ low line", "x" * 900, "á​﻿", "word " * 300, "\x00\x01",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS n_a", "'r' AS row", "2 AS pairs").repartition(4)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.scored(docs).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)
    assert token_alignment.scored(docs.limit(0)).count() == 0
    odd = plain(["▁ low line"])[0]
    assert odd[-1] == "" and got[10][0] == 0


def test_units_equal_whole_texts(spark, small):
    """Cutting before spaces changes nothing: texts with and without runs of spaces, and whole documents."""
    texts = ["don't  stop", "a\n b", "a \nb", "\n\n x  \n y", "tab\t two", "1 2.5 3,000 x's I'LL", "a\u00a0 b \u00a0c", "end ", " begin", "é\u0301 e", "☃ snow ☃☃", "\u2581 \u2581x y", "a. \r\n b", "it 's", "x \u3000 y", "\u00a0 \u00a0 b", "n\n \n \n b", "a\t \t \u00a0b"]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(150).collect() if r.text]
    one, other = token_alignment.Aligner(), token_alignment.Aligner()
    other.uncut = {""}
    assert one.uncut == {"  ", "\u00a0 "}
    a, b = (sorted((r["doc"], r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"], sorted(zip(r["pairs"], r["times"]))) for r in x.align(texts).to_pylist()) for x in (one, other))
    assert a == b and len(a) > 150


def test_equals_all_pairs_on_documents(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(15)
    rows = rows.unionByName(rows.limit(5))
    texts = [r.text for r in rows.collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in token_alignment.scored(rows).collect()) == sorted(plain(texts))
