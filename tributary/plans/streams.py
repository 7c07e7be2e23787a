"""Streams over the events, and their limits and budgets in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.adapters import POSTS_SQL, posts, table
from ..streaming import jobs
from .registry import query


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, as a stream's source is a folder or a pattern. The table is finished, its
    # files in any order: all are one batch, so no watermark is ahead of rows unread.
    return jobs.read_new(spark, f"{sf_dir}/events.parque[t]", schema, jobs.ALL_FILES).withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"""WITH {POSTS_SQL}, b AS (SELECT *, CASE WHEN epoch_us(posted_at) - lag(epoch_us(posted_at)) OVER (PARTITION BY topic ORDER BY posted_at, post_id) < 300000000 THEN 0 ELSE 1 END AS b FROM posts),
    s AS (SELECT *, sum(b) OVER (PARTITION BY topic ORDER BY posted_at, post_id) AS s FROM b) SELECT topic, post_id AS id, row_number() OVER (PARTITION BY topic, s ORDER BY posted_at, post_id) AS count FROM s""")
def stream_idle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02 as a stream with state and timers: equal to the batch form."""
    rows = _stream(spark, sf_dir).select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("id")).withWatermark("ts", "1 hour")
    return jobs.drain(jobs.idle_counts(rows, "topic", 300))


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D07, ST12: every event once."""
    rows = _stream(spark, sf_dir).select("event_id", "user_id", "ts")
    twice = rows.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    return jobs.drain(jobs.deduplicated(twice, "ts", ["event_id"], "40 days")).select("event_id", "user_id")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the inventory: windows that the watermark has closed."""
    found = jobs.drain(jobs.windowed_counts(_stream(spark, sf_dir), "ts", "event_type", "1 day", "1 hour"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query(f"""WITH {POSTS_SQL}, d AS (SELECT channel_id, post_id, date_trunc('day', posted_at) AS day, row_number() OVER (PARTITION BY channel_id, date_trunc('day', posted_at) ORDER BY posted_at, post_id) AS k,
    sum(views) OVER (PARTITION BY channel_id, date_trunc('day', posted_at) ORDER BY posted_at, post_id) AS tokens FROM posts) SELECT post_id, k <= 3 AND tokens <= 200 AS allowed FROM d""")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST08, ST09, ST21: running counts and sums within a day; what is over is deferred."""
    w = Window.partitionBy("channel_id", F.date_trunc("day", "posted_at")).orderBy("posted_at", "post_id")
    return posts(spark, sf_dir).select("post_id", ((F.row_number().over(w) <= 3) & (F.sum("views").over(w) <= 200)).alias("allowed"))


def _greedy(rows: DataFrame, decide, schema: str) -> DataFrame:
    """Decide on each key's hits in order of time; a key's state is one small object."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["micros", "post_id"])
        return pdf[["channel_id", "post_id"]].assign(allowed=decide(pdf["micros"].tolist()))

    return rows.groupBy("channel_id").applyInPandas(run, schema)


def sliding(limit: int, seconds: int):
    """Accept while fewer than `limit` accepted hits are within the window; equal times count once. (ST07)"""

    def decide(times: list[int]) -> list[bool]:
        held: list[int] = []
        out = []
        for t in times:
            held = [h for h in held if h > t - seconds * 1_000_000]
            ok = len(held) < limit
            if ok and t not in held:
                held.append(t)
            out.append(ok)
        return out

    return decide


def fixed_from_first(limit: int, seconds: int):
    """A window opens at the first hit after the last one ended; every hit counts. (ST22)"""

    def decide(times: list[int]) -> list[bool]:
        start, n, out = None, 0, []
        for t in times:
            if start is None or t - start >= seconds * 1_000_000:
                start, n = t, 0
            n += 1
            out.append(n <= limit)
        return out

    return decide


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("channel_id", "post_id", F.unix_micros("posted_at").alias("micros"))


@query()
def sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST07, X07."""
    return _greedy(_hits(spark, sf_dir), sliding(2, 86_400), "channel_id long, post_id long, allowed boolean")


@query()
def fixed_window_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST22."""
    return _greedy(_hits(spark, sf_dir), fixed_from_first(2, 86_400), "channel_id long, post_id long, allowed boolean")


@query(f"WITH {POSTS_SQL} SELECT channel_id, max(posted_at) AS high, count(*) AS n, CASE WHEN max(posted_at) < (SELECT max(posted_at) FROM posts) - INTERVAL 1 DAY THEN 'historical' ELSE 'incremental' END AS mode FROM posts GROUP BY 1")
def high_watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11, ST14: the newest post of a channel, and how to read on."""
    rows = posts(spark, sf_dir)
    now = F.broadcast(rows.agg(F.max("posted_at").alias("now")))
    high = rows.groupBy("channel_id").agg(F.max("posted_at").alias("high"), F.count(F.lit(1)).alias("n")).crossJoin(now)
    mode = F.when(F.col("high") < F.col("now") - F.expr("INTERVAL 1 DAY"), "historical").otherwise("incremental")
    return high.select("channel_id", F.col("high").cast("timestamp_ntz").alias("high"), "n", mode.alias("mode"))


@query("""WITH i AS (SELECT l_orderkey AS album, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS expected FROM lineitem), a AS (SELECT album, expected, count(*) FILTER (l_linenumber <= 6) AS analysed FROM i GROUP BY 1, 2)
    SELECT album, expected, analysed, analysed >= expected AS complete FROM a""")
def album_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06, A17: albums whose items have all been analysed."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("album")).agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("l_linenumber") <= 6).alias("analysed"))
    return rows.withColumn("complete", F.col("analysed") >= F.col("expected"))


@query(f"""WITH {POSTS_SQL}, d AS (SELECT channel_id, post_id, posted_at, views, views - lag(views) OVER (PARTITION BY channel_id ORDER BY posted_at, post_id) AS diff FROM posts)
    SELECT channel_id, sum(CASE WHEN diff IS NULL THEN 0 WHEN diff < 0 THEN views ELSE diff END)::BIGINT AS increase FROM d GROUP BY 1""")
def counter_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The increase of a counter that may begin anew."""
    diff = F.col("views") - F.lag("views").over(Window.partitionBy("channel_id").orderBy("posted_at", "post_id"))
    rows = posts(spark, sf_dir).withColumn("diff", diff)
    return rows.groupBy("channel_id").agg(F.sum(F.when(F.col("diff").isNull(), 0).when(F.col("diff") < 0, F.col("views")).otherwise(F.col("diff"))).cast("long").alias("increase"))


@query("""WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([10.0, 50.0, 100.0, 200.0, 1000.0]::DOUBLE[]) AS le) GROUP BY 1, 2),
    c AS (SELECT *, lag(n, 1, 0) OVER (PARTITION BY event_type ORDER BY le) AS below, lag(le, 1, 0.0) OVER (PARTITION BY event_type ORDER BY le) AS low, 0.9 * max(n) OVER (PARTITION BY event_type) AS rank FROM b)
    SELECT event_type, round(low + (le - low) * (rank - below) / (n - below), 6) AS p90 FROM c WHERE n >= rank AND below < rank""")
def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantile from cumulative buckets, by interpolation."""
    bounds = [10.0, 50.0, 100.0, 200.0, 1000.0]
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"n{i}") for i, b in enumerate(bounds)])
    rank = 0.9 * F.col(f"n{len(bounds) - 1}")
    out = F.lit(None).cast("double")
    for i in reversed(range(len(bounds))):
        low, below = (bounds[i - 1], F.col(f"n{i - 1}")) if i else (0.0, F.lit(0))
        out = F.when(F.col(f"n{i}") >= rank, low + (bounds[i] - low) * (rank - below) / (F.col(f"n{i}") - below)).otherwise(out)
    return rows.select("event_type", F.round(out, 6).alias("p90"))
