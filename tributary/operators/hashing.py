"""Hashes of 64 signs, what is within a few bits, and results that are used again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import pair_blocks

BITS = 64
#: Hashes of one side that are compared with a block at once.
_STRIP = 256


def sign_hash(v: Column) -> Column:
    """A long whose bit i (0 to 63) says whether component i is greater than 0; null for a null vector, missing components count as none."""
    signs = F.transform(F.slice(v, 1, BITS), lambda x, i: F.when(F.coalesce(x > 0, F.lit(False)), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(signs, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _linked(scope: list[str], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        low = (pdf["k"] == pdf["i"].iloc[0]).to_numpy()
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        (x, n_x), (y, n_y) = ((p["hash"].to_numpy(), p["n"].to_numpy()) for p in (pdf[low], pdf if same else pdf[~low]))
        given = {c: pdf[c].iloc[0] for c in scope}
        for s in range(0, len(x), _STRIP):
            # Of a signed number numpy counts the bits of its absolute value.
            distance = np.bitwise_count((x[s : s + _STRIP, None] ^ y[None, :]).view(np.uint64))
            at, to = np.nonzero(distance <= most)
            # Hashes of a scope are different, so of a pair within one block this is one of its two places.
            kept = x[s + at] < y[to] if same else slice(None)
            near = distance[at, to][kept]
            at, to = s + at[kept], to[kept]
            turned = x[at] > y[to]
            yield pd.DataFrame({
                **given, "a": np.where(turned, y[to], x[at]), "b": np.where(turned, x[at], y[to]), "distance": near.astype(np.int32),
                "n_a": np.where(turned, n_y[to], n_x[at]), "n_b": np.where(turned, n_x[at], n_y[to]),
            })

    return run


def near_hashes(rows: DataFrame, scope: list[str], most: int) -> DataFrame:
    """(*scope, a, b, distance, n_a, n_b) with a < b: different hashes of rows (*scope, hash) at most `most` bits apart, and how many rows have each.

    Every two blocks of a scope's hashes are compared by one task, a strip at a time: bands of so few bits as many
    differing ones leave are shared by nearly all. Rows with one hash are one before they meet, however many they are;
    rows without a hash or a scope are left out.
    """
    there = [F.col(c).isNotNull() for c in scope]
    counts = rows.where("hash IS NOT NULL").where(reduce(lambda a, b: a & b, there, F.lit(True))).groupBy(*scope, "hash").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(*scope).count().agg(F.max("count"), F.count(F.lit(1))).first()
    blocks = pair_blocks(groups[0] or 1, groups[1])
    k = counts.withColumn("k", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = k.select(*scope, "hash", "n", "k", F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"))
    kinds = "".join(f"{c} {kind}, " for c, kind in counts.select(*scope).dtypes)
    return met.groupBy("i", "j", *scope).applyInPandas(_linked(scope, most), f"{kinds}a long, b long, distance int, n_a long, n_b long")


def reused(rows: DataFrame, results: DataFrame, scope: list[str]) -> DataFrame:
    """rows (*scope, hash) with `result` and `source` of the first result (*scope, hash, id, result) of the same hash in their scope, or nulls."""
    first = results.where("hash IS NOT NULL").groupBy(*scope, "hash").agg(F.min_by(F.struct(F.col("id").alias("source"), "result"), "id").alias("r"))
    return rows.join(first, [*scope, "hash"], "left").select(*rows.columns, F.col("r.source").alias("source"), F.col("r.result").alias("result"))


def not_seen(rows: DataFrame, seen: DataFrame, keys: list[str], at: str, ttl_seconds: int) -> DataFrame:
    """Rows whose keys were not processed (seen: keys, seen_at) within ttl_seconds before them, one a key: the first by time."""
    last = seen.groupBy(*keys).agg(F.max("seen_at").alias("seen_at"))
    alive = F.unix_micros(at) - F.unix_micros("seen_at") <= ttl_seconds * 1_000_000
    fresh = rows.join(last, keys, "left").where(~F.coalesce(alive, F.lit(False))).drop("seen_at")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), at).alias("row")).select(*keys, "row.*")
