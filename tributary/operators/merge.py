"""Keyed merges: the upserts of a store without row updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_non_null(column: str, order: str) -> Column:
    """The latest value that is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], **merged: Column) -> DataFrame:
    """Rows of both by key, each column merged by an aggregate over `__turn` (old 0,
    new 1): one shuffle, combined before it; applying a batch twice changes nothing
    if the aggregates are idempotent. (U01-U04, U06, U07)"""
    both = old.withColumn("__turn", F.lit(0)).unionByName(new.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[c.alias(n) for n, c in merged.items()])


def upsert_if_changed(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], stamp: str) -> DataFrame:
    """New rows replace old ones, but a row whose values are equal keeps its stamp."""
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in [*values, stamp]], F.lit(True).alias("__old"))
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in [*values, stamp]], F.lit(True).alias("__new"))
    both = o.join(n, keys, "full")
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"__o_{c}").eqNullSafe(F.col(f"__n_{c}"))
    keep = F.col("__new").isNull() | (F.col("__old").isNotNull() & same)
    return both.select(*keys, *[F.when(keep, F.col(f"__o_{c}")).otherwise(F.col(f"__n_{c}")).alias(c) for c in [*values, stamp]])


def expire(df: DataFrame, ts: str, now: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows younger than so many days, and the tombstones of the rest."""
    old = F.col(ts) < now - F.make_interval(days=F.lit(days))
    return df.where(~F.coalesce(old, F.lit(False))), df.where(old)
