"""Repeated byte strings, by column-wise construction of collection transforms.

Every 400-byte window has an anchor, the first of its 200-byte strings with the least
hash, so equal windows have equal anchors in the same place. Windows in a row with one
anchor are a piece. Spark drops pieces whose anchor occurs once and adds up equal pieces;
different pieces with one anchor are collections. A task inserts one byte of every
piece of a block a round, from the right, and so updates the collection's
Burrows-Wheeler transform and its common prefixes: see Collection. A window whose
common prefix with a neighbour is as long as itself is repeated.

Anchors with very many pieces are divided first, by the strings that extend the anchor
to the left or to the right, so that no block grows with a group: see _divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import _LETTERS, BROADCAST_ROWS, bounded_broadcast, chunks, drop_stash, mix, stash, table, texts, unused

#: Bytes of a string that must not start twice, and of its anchor.
WIDTH, GRAM = 400, 200
#: Pieces of a block, at most; anchors with more are divided.
MOST_PIECES = 4096
#: Bytes whose anchors are found at once.
_PIECE = 1 << 19
_AT = np.uint64((1 << 20) - 1)
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(_PIECE + 2 * WIDTH, _FACTOR, np.uint64))
_INVERSE = np.cumprod(np.full(_PIECE + 2 * WIDTH, pow(_FACTOR, -1, 1 << 64), np.uint64))

PLACES = "digest binary, key bigint, piece binary, start bigint, windows int, left int"
_PLACES = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("piece", pa.binary()), ("start", pa.int64()), ("windows", pa.int32()), ("left", pa.int32())])
#: A piece with its bytes; its anchor, of `gram` bytes, begins after `left` bytes.
PIECES = "key bigint, piece binary, n bigint, left int, gram int, bytes binary"
_PIECES = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("n", pa.int64()), ("left", pa.int32()), ("gram", pa.int32()), ("bytes", pa.binary())])
#: Windows of a piece that are repeated: from, to (inclusive).
RUNS = "key bigint, piece binary, first int, last int"
_RUNS = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def anchors(raw: np.ndarray, valid: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, windows, anchors, keys): runs of windows with one anchor, among those that `valid` allows."""
    idx = np.flatnonzero(valid)
    if not len(idx):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_LETTERS[raw] * _POWERS[: len(raw)])))
    grams = mix((sums[gram:] - sums[:-gram]) * _INVERSE[: len(raw) - gram + 1])
    span = width - gram + 1
    # The least hash of each window, the first of equal ones; minima of blocks from both sides.
    packed = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    whole = np.full(-(-len(packed) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(packed)] = packed
    blocks = whole.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    at = (np.minimum(behind[idx], ahead[idx + span - 1]) & _AT).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (idx[1:] != idx[:-1] + 1))))
    return idx[new], np.diff(np.append(new, len(idx))), at[new], grams[at[new]]


def _places(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, budget=_PIECE):
        found, names = texts(batch), batch.column("digest")
        sizes = np.array([len(t) for t in found])
        ends = np.cumsum(sizes)
        raw = b"".join(found)
        letters = np.frombuffer(raw, np.uint8)
        # Windows that end inside their text: all starts but the last width - 1 of each.
        valid = np.ones(len(raw), bool)
        for end, size in zip(ends.tolist(), sizes.tolist()):
            valid[end - min(size, width - 1) : end] = False
        for a in range(0, len(raw), _PIECE):
            b = min(len(raw), a + _PIECE + width - 1)
            if b - a < width:
                break
            own = valid[a : a + _PIECE]
            starts, windows, at, keys = anchors(letters[a:b], own, width, gram)
            left = at - starts
            starts = starts + a
            doc = np.searchsorted(ends, starts, side="right")
            piece = [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(starts.tolist(), (starts + windows + width - 1).tolist())]
            columns = [names.take(pa.array(doc)), keys.view(np.int64), pa.array(piece, pa.binary()), starts - (ends - sizes)[doc], windows.astype(np.int32), left.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_PLACES)


class Collection:
    """The transform of a collection of pieces, built column by column.

    Pieces stand with their anchors one above the other and columns are counted from
    there. A symbol is a byte together with its column: equal windows of a collection have the
    same columns, and the rows of the transform that begin in one column lie in a row.
    A round inserts the next symbol to the left of every piece. Its rows are sorted by
    that symbol and then as the round before has sorted the rest, so the new segment
    follows from the last one, read once from front to back, and is appended; segments
    once written never change. A row's common prefix with the one before is one
    more than the least prefix between the two in the last segment, or 0 where the symbols differ.
    """

    def __init__(self, pieces: list[bytes], left: list[int]):
        self.left = np.array(left, np.int64)
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.base = int(self.left.max(initial=0))
        self.columns = int((self.sizes - self.left).max(initial=0)) + self.base
        rows = np.zeros((len(pieces), self.columns), np.uint8)
        for row, p, a in zip(rows, pieces, self.left.tolist()):
            row[self.base - a : self.base - a + len(p)] = np.frombuffer(p, np.uint8)
        self.symbols = np.ascontiguousarray(rows.T)

    def segments(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, pieces in the order of their suffixes from here, common prefix with the row before), right to left."""
        begins, ends = self.base - self.left, self.base - self.left + self.sizes
        enters = np.argsort(-ends, kind="stable")
        at = np.searchsorted(-ends[enters], -np.arange(self.columns + 1), side="right")
        order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for c in range(self.columns - 1, -1, -1):
            stay = np.flatnonzero(begins[order] <= c)
            if len(stay) < len(order):  # what has ended leaves; prefixes close over it
                closed = np.minimum.reduceat(prefix, np.concatenate(([0], stay[:-1] + 1))) if len(stay) else prefix[:0]
                order, prefix = order[stay], closed
            new = enters[at[c + 2] if c + 2 <= self.columns else 0 : at[c + 1]]
            if len(new):  # empty suffixes come first
                order, prefix = np.concatenate((new, order)), np.concatenate((np.zeros(len(new), np.int32), prefix))
                prefix[len(new) : len(new) + 1] = 0
            if not len(order):
                continue
            symbols = self.symbols[c, order]
            moved = np.argsort(symbols, kind="stable")
            sorted_ = symbols[moved]
            same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
            after = np.zeros(len(order), np.int32)
            after[same] = 1 + _least(prefix, moved[same - 1] + 1, moved[same])
            order, prefix = order[moved], after
            yield c, order, prefix

    def transform(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(column, symbols before the rows, common prefixes) of every segment; 0 before a piece's first byte."""
        begins = self.base - self.left
        return [(c, np.where(begins[o] < c, self.symbols[c - 1, o], 0), p) for c, o, p in self.segments()]

    def repeated(self, width: int) -> np.ndarray:
        """Which windows of which pieces occur twice or more."""
        out = np.zeros((len(self.sizes), max(1, int(self.sizes.max(initial=0)) - width + 1)), bool)
        for c, order, prefix in self.segments():
            long = prefix >= width
            if long.any():
                both = order[long | np.append(long[1:], False)]
                out[both, c - self.base + self.left[both]] = True
        return out


def _least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a..b] for each pair, by minima of stretches of powers of two."""
    if not len(a):
        return np.zeros(0, values.dtype)
    size = b - a + 1
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(a), values.dtype)
    stretch, k = values, 0
    while True:
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(stretch[a[own]], stretch[b[own] - (1 << k) + 1])
        k += 1
        if k > level.max():
            return out
        half = 1 << (k - 1)
        stretch = np.minimum(stretch[:-half], stretch[half:])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[dict]]:
    """Pieces that come sorted by key, in blocks of whole keys."""
    block: list[dict] = []
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if len(block) >= most:
                    yield block
                    block = []
                key = row["key"]
            block.append(row)
    if block:
        yield block


def _runs_of(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, most):
        found = Collection([r["bytes"] for r in block], [r["left"] for r in block]).repeated(width)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        # What has several places is whole already and only a partner here.
        columns = [[block[i]["key"] for i in row], [block[i]["piece"] for i in row], first.astype(np.int32), last.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS)], schema=_RUNS)


def _cut(batches: Iterator[pa.RecordBatch], gram: int, width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the pieces that are asked of a text."""
    for batch in batches:
        for text, asked in zip(texts(batch), batch.column("asked").to_pylist()):
            rows = [(r["key"], r["piece"], r["n"], r["left"], gram, text[r["start"] : r["start"] + r["windows"] + width - 1]) for r in asked]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def _halves(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each piece as two: windows that reach far to the left of the anchor, and the others."""
    schema = pa.schema([*[pa.field(f"of_{f.name}", f.type) for f in _PIECES if f.name in ("key", "piece")], pa.field("shift", pa.int32()), *_PIECES])
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            raw, left, gram = r["bytes"], r["left"], r["gram"]
            windows, slack = len(raw) - width + 1, width - gram
            ahead = -(-slack // 2)
            behind = slack - ahead + 1
            split = min(windows, max(0, left - ahead + 1))  # windows below it hold `ahead` bytes before the anchor
            for a, b, begin, size in ((0, split, left - ahead, gram + ahead), (split, windows, left, gram + behind)):
                if a < b:
                    own = raw[a : b + width - 1]
                    at = begin - a
                    key = xxhash.xxh3_64_intdigest(raw[begin : begin + size]) - (1 << 63)
                    rows.append((r["key"], r["piece"], a, key, xxhash.xxh3_128_digest(own + at.to_bytes(4, "little")), r["n"], at, size, own))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _settled(pieces: DataFrame, width: int, most: int) -> DataFrame:
    """RUNS of a written table of PIECES with one row a (key, piece).

    Where a key has too many pieces, their halves go under longer anchors, equal halves are
    added up, and what is found of them is told to the pieces they come from. Anchors as
    long as a window end this, since different pieces cannot share one.
    """
    by_key = stash(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1"), "keys")
    counted = pieces.join(by_key, "key")
    # A block takes whole keys until it is full, so it holds 2 * most pieces at most.
    small = counted.where(F.col("pieces") <= most).select(*_PIECES.names).repartition("key").sortWithinPartitions("key")
    runs = small.mapInArrow(lambda batches: _runs_of(batches, width, most), RUNS)
    large = by_key.where(F.col("pieces") > most)
    if large.isEmpty():
        return stash(runs, "runs")
    halves = pieces.join(bounded_broadcast(large), "key").select(*_PIECES.names).mapInArrow(lambda batches: _halves(batches, width), f"of_key bigint, of_piece binary, shift int, {PIECES}")
    halves = stash(halves, "halves")
    merged = stash(halves.groupBy("key", "piece").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("left", "gram", "bytes")]), "merged")
    whole = merged.where("n > 1").selectExpr("key", "piece", "0 AS first", f"cast(length(bytes) - {width} AS int) AS last")
    below = _settled(merged, width, most)
    below = below.join(whole.select("key", "piece"), ["key", "piece"], "left_anti").unionByName(whole)
    told = halves.join(below, ["key", "piece"]).selectExpr("of_key AS key", "of_piece AS piece", "cast(first + shift AS int) AS first", "cast(last + shift AS int) AS last")
    found = stash(runs.unionByName(told), "runs")
    for t in (by_key, halves, merged):
        drop_stash(t)
    return found


def repeated_spans(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST_PIECES) -> DataFrame:
    """(digest, spans) of the distinct texts that hold a string of `width` bytes which also starts
    elsewhere in docs, in the same text or another row: spans are the maximal runs of
    bytes under such strings, as (begin, end). Texts are told apart by `digest`; null counts as empty."""
    texts_of = docs.select(digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    places = stash(texts_of.where(F.length("text") >= width).mapInArrow(lambda batches: _places(batches, width, gram), PLACES), "places")
    twice = places.groupBy("key").agg(F.count(F.lit(1)).alias("places"), F.min(F.xxhash64("piece")).alias("low"), F.max(F.xxhash64("piece")).alias("high"))
    twice = bounded_broadcast(twice.where("places > 1").selectExpr("key", "low <> high AS several"))
    # Copies of a text are one from here on, with a count.
    kept = stash(places.join(twice, "key").groupBy(*_PLACES.names, "several").agg(F.count(F.lit(1)).alias("n")), "kept")
    drop_stash(places)
    pieces = stash(kept.groupBy("key", "piece", "several").agg(F.sum("n").alias("n"), F.min(F.struct("digest", "start", "windows", "left")).alias("one")), "counted")
    asked = pieces.where("several").groupBy("one.digest").agg(F.collect_list(F.struct("key", "piece", "n", "one.start", "one.windows", "one.left")).alias("asked"))
    asked = stash(asked, "asked")
    held = texts_of.join(bounded_broadcast(asked.select("digest")), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    cut = held.join(asked, "digest").select("text", "asked").mapInArrow(lambda batches: _cut(batches, gram, width), PIECES)
    cut = stash(cut, "pieces")
    runs = _settled(cut, width, most)
    several = pieces.where("n > 1").select("key", "piece", F.lit(0).alias("first"), (F.col("one.windows") - 1).alias("last"))
    single = runs.join(several.select("key", "piece"), ["key", "piece"], "left_anti")
    spans = kept.join(single.unionByName(several), ["key", "piece"]).select("digest", (F.col("start") + F.col("first")).alias("begin"), (F.col("start") + F.col("last") + width).alias("end"))
    found = stash(merged_spans(spans.distinct()), "spans")
    for t in (kept, pieces, asked, cut, runs):
        drop_stash(t)
    return found


def merged_spans(spans: DataFrame) -> DataFrame:
    """(digest, begin, end) -> (digest, spans): overlapping or touching ones as one, in order."""
    ahead = Window.partitionBy("digest").orderBy("begin", "end")
    reach = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.coalesce((F.col("begin") > reach).cast("int"), F.lit(1)))
    one = apart.withColumn("at", F.sum("new").over(ahead)).groupBy("digest", "at").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return one.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _kept(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        rows = []
        for raw, spans in zip(texts(batch), batch.column("spans").to_pylist()):
            ends = [0, *[x for s in spans or [] for x in (s["begin"], s["end"])], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
            rows.append((len(raw), len(raw) - len(kept), len(spans or []), kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), f.type) for c, f in zip(zip(*rows), list(schema)[1:])]], schema=schema)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST_PIECES) -> DataFrame:
    """Each row of docs with n_bytes, n_removed, n_spans and kept (binary): its bytes without those covered
    by a `width`-byte string that also starts anywhere else.

    Null and empty texts have no bytes, none removed, and kept is empty; texts
    shorter than width keep all. All copies of a repeated text, equal rows as well, lose it. Matches
    never cross rows, and strings are judged on the input. Columns of docs with these names are replaced; ids are not read.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept"]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in new and c != text])
    spans = repeated_spans(docs, text, width, gram, most)
    held = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    mark = unused(rows, "digest")
    spans = spans.select(F.col("digest").alias(mark), "spans")
    joined = rows.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), digest(F.col(text)).alias(mark))
    joined = joined.join(F.broadcast(spans) if held <= BROADCAST_ROWS else spans, mark, "left").select("row", "text", "spans")
    schema = StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    schema = StructType([joined.schema["row"], *schema.fields])
    arrow = to_arrow_schema(schema)
    return joined.mapInArrow(lambda batches: _kept(batches, arrow), schema).select("row.*", *new)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of it; see remove_repeats for odd rows."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
