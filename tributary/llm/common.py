"""What several of the training-data operators share: written tables, text
batches, word hashes and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: the six ASCII white-space characters, and no others.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once by a Python worker, in bytes; one document at least.
CHUNK_BYTES = 2_000_000

#: Rows of ids (about 30 bytes each in memory) that are broadcast at most.
BROADCAST_ROWS = 2_000_000
#: Ids (about 70 bytes each in the driver's memory) that `likely_among` broadcasts as they are, and
#: those of which it sends four bytes each.
BROADCAST_IDS, FILTER_IDS = 100_000, 16_000_000
#: Bytes, as they are shuffled, of what Spark may broadcast inside `small_broadcasts`; the driver holds some ten times as many.
BROADCAST_BYTES = 1 << 20

_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, one for this session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and
    a lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing will read again."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """What runs inside runs with these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches_of(spark: SparkSession, rows: int, size: int = 16_000_000) -> AbstractContextManager[None]:
    """What runs inside hands at most so many rows and about so many bytes at once to Python; for wide rows."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)})


def bounded_broadcast(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows; else joined by shuffle."""
    df = stash(df, "small")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def small_broadcasts(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs inside lets Spark broadcast BROADCAST_BYTES of a table at most, or what the session allows if that is less."""
    wanted, name = {}, "spark.sql.autoBroadcastJoinThreshold"
    adaptive = name.replace("sql.", "sql.adaptive.")
    for name, now in ((name, spark.conf.get(name)), (adaptive, spark.conf.get(adaptive, None) or "")):
        found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)[a-z]*\s*", now.lower())
        if found and int(found[1]) << 10 * " kmgtp".index(found[2] or " ") > BROADCAST_BYTES:
            wanted[name] = str(BROADCAST_BYTES)
    return settings(spark, wanted)


def likely_among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is in the one column of `ids`, and, where there are more than BROADCAST_IDS,
    hardly any others: then 32 bits of a hash stand for an id, so the driver holds four bytes of each."""
    spark, [c] = df.sparkSession, ids.columns
    ids = stash(ids, "ids")
    n = ids.count()
    if n <= BROADCAST_IDS or n > FILTER_IDS:
        return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, c, "left_semi")
    short = F.shiftright(F.xxhash64(c), 32).cast("int")
    held = spark.sparkContext.broadcast(np.unique(ids.select(short.alias("h")).toArrow().column("h").to_numpy()))

    @F.pandas_udf("boolean")
    def there(h: pd.Series) -> pd.Series:
        return pd.Series(held.value[np.minimum(np.searchsorted(held.value, h), len(held.value) - 1)] == h.to_numpy())

    return df.where(there(short))


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower
    case; empty for null and for a url without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", budget: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `budget` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        begin = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > budget:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n) + 64
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts in UTF-8; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of each word; starts afresh when it holds `most` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): 64-bit hashes of the words of all texts in a row, A-Z in lower case,
    and where each text's end. A word's hash is the mixed sum of a product for each byte
    and its place, so whole pieces of text are hashed at once; a word of over
    `_PIECE` bytes takes some 40 bytes of memory for each of its own."""
    stops = np.cumsum([len(t) + 1 for t in found])
    raw = np.frombuffer(b" ".join([b"", *found, b""]).translate(_ASCII_LOWER), np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    bounds = np.unique(np.concatenate(([0], np.searchsorted(starts, np.arange(_PIECE, len(raw), _PIECE)), [len(starts)]))).tolist()
    for i, j in zip(bounds[:-1], bounds[1:]):
        a, b, size = starts[i], ends[j - 1], ends[i:j] - starts[i:j]
        offsets = np.cumsum(size) - size
        letters = raw[a:b][inside[a:b]]
        place = np.arange(len(letters)) - np.repeat(offsets, size)
        factors = _PLACES if (longest := size.max()) <= len(_PLACES) else _factors(longest)
        out[i:j] = mix(np.add.reduceat(_LETTERS[letters] * factors[place], offsets) + size.astype(np.uint64))
    return out, np.searchsorted(starts, stops)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; of the whole where it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
    return total


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


_PIECE = 1 << 18
_IN_WORD = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
_LETTERS = mix(np.arange(1 << 20, (1 << 20) + 256, dtype=np.uint64))
_PLACES = _factors(1024)


def text_shingles(found: list[bytes], width: int) -> list[np.ndarray]:
    """Hashes of the runs of `width` words of every text, worked out over all at once."""
    words, ends = word_hashes(found)
    flat = shingles(words, width)
    begins = np.concatenate(([0], ends))
    return [flat[a : b - width + 1] if b - a >= width else shingles(words[a:b], width) for a, b in zip(begins.tolist(), ends.tolist())]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component) for every id in edges (a, b): the smallest id reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a
    join, until every edge leads to the root of its component. A node with very
    many neighbours is reduced before the shuffle, and its join can be split.
    """
    spark = edges.sparkSession
    now = stash(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), label)
    seen = None
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").selectExpr("v AS u", "m AS v")
        after = stash(small.unionByName(root.selectExpr("u", "m AS v")).distinct(), label)
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        now = after
        if state == seen:
            break
        seen = state
    return now.selectExpr("u AS id", "v AS component").unionByName(now.selectExpr("v AS id", "v AS component").distinct())
