"""Benchmark decontamination: a hash set of normalised test n-grams, broadcast to
the scan of the training texts; hits are verified word by word."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunks, mix, table, texts, unused

#: Words in a window; an item of fewer words is one window.
WIDTH = 13
#: The part of the words that makes a document contaminated: hits * SHARE >= words.
SHARE = 20
#: Characters of items in one broadcast set; larger benchmarks are scanned in
#: blocks of about this size, every block against all documents.
BLOCK_CHARS = 64_000_000

_SEPARATORS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_SEPARATORS).split(b" ")


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z in lower case) and all beyond ASCII."""
    return [w for w in _tokens(text) if w]


class Windows:
    """The windows of a benchmark: word ids, hashes by length, and who has them."""

    def __init__(self, items: Iterable[tuple[int | None, str]], width: int = WIDTH):
        self.ids: dict[bytes, int] = {}
        self.items: list[str | None] = []
        owners: dict[tuple[int, ...], list[int]] = {}
        known: dict[str | None, int] = {}
        for item_id, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words((text or "").encode())]
            if not ids:
                continue
            name = None if item_id is None else str(item_id)
            k = known.setdefault(name, len(self.items))
            if k == len(self.items):
                self.items.append(name)
            size = min(width, len(ids))
            for i in range(len(ids) - size + 1):
                held = owners.setdefault(tuple(ids[i : i + size]), [])
                if k not in held:
                    held.append(k)
        self.owners = owners
        self.hashes: dict[int, np.ndarray] = {}
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for w in owners:
            by_size.setdefault(len(w), []).append(w)
        for size, found in by_size.items():
            self.hashes[size] = np.unique(self._hash(np.array(found, np.uint64).reshape(-1, size).T))

    @staticmethod
    def _hash(columns: Iterable[np.ndarray]) -> np.ndarray:
        total = None
        for c in columns:
            total = mix(c if total is None else total * np.uint64(0x9E3779B97F4A7C15) + c)
        return total

    def scan(self, text: bytes) -> tuple[list[bytes], np.ndarray, set[int]]:
        """Words, which of them are hit, and the items that hit."""
        found = words(text)
        n = len(found)
        hit = np.zeros(n + 1, np.int32)
        items: set[int] = set()
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, n)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, hashes in self.hashes.items():
            if n < size:
                continue
            # Only windows all of whose words the benchmark has.
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            h = self._hash(ids[at + k] for k in range(size))
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[near] == h].tolist():
                held = self.owners.get(tuple(ids[i : i + size].tolist()))
                if held:
                    items.update(held)
                    hit[i] += 1
                    hit[i + size] -= 1
        return found, np.cumsum(hit[:-1]) > 0, items


def _blocks(items: DataFrame, block_chars: int) -> list[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size; each is fetched when its turn comes."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    for i in range(max(1, n)):
        part = items if n <= 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        yield [tuple(r) for r in part.select("item_id", "text").collect()]


def _scan(batches: Iterator[pa.RecordBatch], windows: list, row: Callable, new: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = [row(windows, x) for x in texts(batch)]
        added = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), new)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *new.names])


def _judge(windows: list, text: bytes) -> tuple:
    names: set[str | None] = set()
    hit = None
    for w in windows:
        found, mask, items = w.value.scan(text)
        hit = mask if hit is None else hit | mask
        names.update(w.value.items[i] for i in items)
    n, hits = len(found), int(hit.sum())
    digest = hashlib.sha256(",".join(sorted(x for x in names if x is not None)).encode()).hexdigest()
    return n, hits, len(names), digest, hits > 0 and SHARE * hits >= n


def _clean(windows: list, text: bytes) -> tuple:
    """The text without the hit words, and the verdict."""
    hit = None
    for w in windows:
        found, mask, _ = w.value.scan(text)
        hit = mask if hit is None else hit | mask
    n, hits = len(found), int(hit.sum())
    if not hits:
        return text.decode(), False
    lowered, out, end = text.translate(_SEPARATORS), [], 0
    spans = [m.span() for m in _WORDS.finditer(lowered)]
    for i in np.flatnonzero(hit).tolist():
        out.append(text[end : spans[i][0]])
        end = spans[i][1]
        # White space and signs between two hit words go with them.
        if i + 1 < n and hit[i + 1]:
            end = spans[i + 1][0]
    out.append(text[end:])
    return b"".join(out).decode(), SHARE * hits >= n


def _apply(docs: DataFrame, items: DataFrame, row: Callable, result: str, block_chars: int) -> DataFrame:
    added = StructType.fromDDL(result)
    new = to_arrow_schema(added)
    # Blocks are separate broadcasts, so that no single one grows with the benchmark.
    windows = [docs.sparkSession.sparkContext.broadcast(Windows(b)) for b in _blocks(items, block_chars)]
    schema = StructType([*docs.schema.fields, *added.fields])
    return docs.mapInArrow(lambda batches: _scan(batches, windows, row, new), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (doc_id, text) -> doc_id with n_words, n_hit, n_items, items_sha256, contaminated.

    A window is 13 consecutive words of an item, or all of a shorter one that
    has any; a document's word in any occurrence of a window is hit. A null or
    empty text has no words and no hit. Items without words have no window;
    items with a null item_id hit and count as one in n_items but are not named in the
    digest; rows that repeat an item_id are one item. An empty benchmark hits nothing.
    Each document is judged on its own, so repeated rows come out repeated.
    """
    return _apply(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), _judge, RESULT, block_chars).drop("text")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the contaminated documents, and without the hit words of the rest."""
    columns, clean, gone = docs.columns, unused(docs, "clean"), unused(docs, "contaminated")
    judged = _apply(docs, benchmark.select("item_id", "text"), _clean, f"{clean} string, {gone} boolean", block_chars)
    return judged.where(~F.col(gone)).withColumn("text", F.when(F.col("text").isNotNull(), F.col(clean))).select(columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = f"""
WITH items AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_W}') AS w FROM benchmark),
grams AS (SELECT item_id, least(len(w), {WIDTH}) AS n, unnest(list_transform(range(len(w) - least(len(w), {WIDTH}) + 1),
    lambda i: array_to_string(w[i + 1 : i + least(len(w), {WIDTH})], ' '))) AS g FROM items WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_W}'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT r, n, unnest(range(len(w) - n + 1)) AS i, w FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT r, i, n, g, item_id FROM (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM windows) JOIN grams USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
    FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)"""
