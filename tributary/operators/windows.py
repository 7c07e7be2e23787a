"""Window operators: sessions that end when idle, latest rows, bests of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Seconds of time whose rows of a key are ordered in one task; earlier blocks come in as a summary each.
BLOCK = 600


def _blocks(df: DataFrame, key: str, ts: str) -> DataFrame:
    """df with __block, the key and the stretch of BLOCK seconds that a row is in; never null, so that it can be joined."""
    return df.withColumn("__block", F.struct(F.col(key).alias("key"), F.floor(F.unix_micros(ts) / (BLOCK * 1_000_000)).alias("at")))


def _begins(df: DataFrame, ts: str, tie: str, idle: dict[str, int]) -> DataFrame:
    """For each name 1 where a session begins, else 0: the row before in the block, or the last one of the key's block before, is so many seconds old or older."""
    ends = df.groupBy("__block").agg(F.max(ts).alias("__end"))
    ends = ends.withColumn("__end", F.lag("__end").over(Window.partitionBy("__block.key").orderBy("__block.at")))
    before = F.coalesce(F.lag(ts).over(Window.partitionBy("__block").orderBy(ts, tie)), "__end")
    rows = df.join(ends, "__block").withColumn("__gap", F.unix_micros(ts) - F.unix_micros(before))
    return rows.withColumns({name: F.coalesce((F.col("__gap") >= seconds * 1_000_000).cast("long"), F.lit(1).cast("long")) for name, seconds in idle.items()}).drop("__gap", "__end")


def _since(df: DataFrame, ts: str, tie: str, sums: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """For each name the sum of a column over the rows of the key up to this one, from the last that begins a session on
    (where the column is 1), or from the key's first if no such condition is given. A block is summed up by itself; what
    came before it follows from one row a block."""
    run = Window.partitionBy("__block").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"__sum_{n}": F.sum(value).over(run) for n, (value, _) in sums.items()})
    rows = rows.withColumns({f"__from_{n}": F.max(F.when(begins, F.col(f"__sum_{n}"))).over(run) for n, (_, begins) in sums.items() if begins is not None})
    started = [n for n, (_, begins) in sums.items() if begins is not None]
    blocks = rows.groupBy("__block").agg(*[F.max(f"__sum_{n}").alias(f"__all_{n}") for n in sums], *[F.max(f"__from_{n}").alias(f"__last_{n}") for n in started])
    earlier = Window.partitionBy("__block.key").orderBy("__block.at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"__all_{n}": F.coalesce(F.sum(f"__all_{n}").over(earlier), F.lit(0)) for n in sums})
    blocks = blocks.withColumns({f"__last_{n}": F.max(F.col(f"__all_{n}") + F.col(f"__last_{n}")).over(earlier) for n in started})
    rows = rows.join(blocks, "__block")
    total = {n: F.col(f"__all_{n}") + F.col(f"__sum_{n}") for n in sums}
    rows = rows.withColumns(total | {n: total[n] + 1 - F.coalesce(F.col(f"__all_{n}") + F.col(f"__from_{n}"), F.col(f"__last_{n}")) for n in started})
    return rows.drop(*[f"__{part}_{n}" for part in ("sum", "from", "all", "last") for n in sums])


def idle_sessions(df: DataFrame, key: str, ts: str, tie: str, idle_seconds: int, session: str = "session") -> DataFrame:
    """Number the sessions of each key: a new one begins when the last row is
    idle_seconds old or older, as a counter does whose life every hit renews. (ST02)"""
    rows = _begins(_blocks(df, key, ts), ts, tie, {"__begins": idle_seconds})
    return _since(rows, ts, tie, {session: (F.col("__begins"), None)}).drop("__begins", "__block")


def idle_counts(df: DataFrame, key: str, ts: str, tie: str, idle_seconds: dict[str, int]) -> DataFrame:
    """The counters' values after each hit, by name. (ST02)"""
    rows = _begins(_blocks(df, key, ts), ts, tie, {f"__begins_{n}": s for n, s in idle_seconds.items()})
    rows = _since(rows, ts, tie, {n: (F.lit(1).cast("long"), F.col(f"__begins_{n}") == 1) for n in idle_seconds})
    return rows.drop("__block", *[f"__begins_{n}" for n in idle_seconds])


def idle_count(df: DataFrame, key: str, ts: str, tie: str, idle_seconds: int, count: str) -> DataFrame:
    """The counter's value after each hit."""
    return idle_counts(df, key, ts, tie, {count: idle_seconds})


def idle_distinct(df: DataFrame, key: str, value: str, ts: str, tie: str, idle_seconds: int, count: str) -> DataFrame:
    """Distinct values of a set that empties when idle, after each hit. (ST03)"""
    rows = _begins(_blocks(df, key, ts), ts, tie, {"__begins": idle_seconds})
    rows = _since(rows, ts, tie, {"__session": (F.col("__begins"), None)})
    first = F.row_number().over(Window.partitionBy(key, "__session", value).orderBy(ts, tie)) == 1
    rows = _since(rows.withColumn("__first", first.cast("long")), ts, tie, {count: (F.col("__first"), F.col("__begins") == 1)})
    return rows.drop("__first", "__session", "__begins", "__block")


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; ties must be broken by it."""
    return ranked(df, keys, *order, name="__rank").where("__rank = 1").drop("__rank")


def ranked(df: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def best_of_group(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """The best row of each group; rows without a group all stay."""
    grouped = latest(df.where(F.col(group).isNotNull()), [group], *order)
    return df.where(F.col(group).isNull()).unionByName(grouped)


def greedy_prefix(df: DataFrame, size: str, target: float, *order: Column, within: list[str]) -> DataFrame:
    """Rows in order until their sizes reach the target; the one that reaches it is in."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(F.col("__before") < target).drop("__before")
