"""Trends: statistics by topic, counters that expire when idle, bursts, gaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scoring
from ..operators import windows
from ..sources.adapters import POSTS_SQL, posts
from .registry import query

#: Windows in seconds, and the thresholds of an emerging trend.
WINDOWS = {"5m": 300, "1h": 3600, "24h": 86_400}
MIN_RATIO, MIN_SOURCES, COOLDOWN_SECONDS = 3.0, 3, 900


@query(
    f"""WITH {POSTS_SQL} SELECT topic, count(*) AS frequency, round(avg(value), 6) AS avg_value, count(DISTINCT channel_id) AS n_channels
    FROM posts GROUP BY topic HAVING count(*) >= 5 ORDER BY avg_value DESC, frequency DESC LIMIT 20"""
)
def trend_stats_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, distinct channels; the top twenty."""
    stats = posts(spark, sf_dir).groupBy("topic").agg(F.count(F.lit(1)).alias("frequency"), F.round(F.avg("value"), 6).alias("avg_value"), F.countDistinct("channel_id").alias("n_channels"))
    return stats.where("frequency >= 5").orderBy(F.desc("avg_value"), F.desc("frequency")).limit(20)


@query(
    f"""WITH {POSTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY posted_at, post_id) AS k FROM posts)
    SELECT topic, string_agg(post_id::VARCHAR, ',' ORDER BY posted_at, post_id) AS samples FROM ranked WHERE k <= 10 GROUP BY topic"""
)
def trend_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten posts of a topic, found before they are gathered."""
    rows = windows.ranked(posts(spark, sf_dir), ["topic"], F.col("posted_at"), F.col("post_id")).where("rank <= 10")
    ordered = F.array_sort(F.collect_list(F.struct("posted_at", "post_id")))
    return rows.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda x: x["post_id"].cast("string")), ",").alias("samples"))


def _idle_sql(seconds: int, name: str, source: str = "posts") -> str:
    return f"""SELECT post_id, row_number() OVER (PARTITION BY topic, s ORDER BY posted_at, post_id) AS {name}, s AS s_{name} FROM (
        SELECT *, sum(b) OVER (PARTITION BY topic ORDER BY posted_at, post_id) AS s FROM (
        SELECT *, CASE WHEN epoch_us(posted_at) - lag(epoch_us(posted_at)) OVER (PARTITION BY topic ORDER BY posted_at, post_id) < {seconds * 1_000_000} THEN 0 ELSE 1 END AS b FROM {source}))"""


@query(
    f"""WITH {POSTS_SQL}, a AS ({_idle_sql(300, "freq_5m")}), b AS ({_idle_sql(3600, "freq_1h")}), c AS ({_idle_sql(86_400, "freq_24h")})
    SELECT post_id, freq_5m, freq_1h, freq_24h FROM a JOIN b USING (post_id) JOIN c USING (post_id)"""
)
def idle_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02: counters of 5 minutes, an hour and a day whose life every hit renews."""
    rows = posts(spark, sf_dir).select("post_id", "topic", "posted_at")
    rows = windows.idle_counts(rows, "topic", "posted_at", "post_id", {f"freq_{name}": seconds for name, seconds in WINDOWS.items()})
    return rows.drop("topic", "posted_at")


_DIVERSITY = f"""s AS (SELECT p.*, x.s_n AS s FROM posts p JOIN ({_idle_sql(86_400, "n")}) x USING (post_id)),
    f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY topic, s, channel_id ORDER BY posted_at, post_id) = 1 THEN 1 ELSE 0 END AS first FROM s),
    d AS (SELECT post_id, sum(first) OVER (PARTITION BY topic, s ORDER BY posted_at, post_id)::BIGINT AS n_sources FROM f)"""


@query(f"WITH {POSTS_SQL}, {_DIVERSITY} SELECT post_id, n_sources FROM d")
def idle_window_source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST03, A18: distinct channels in a set that empties after an idle day."""
    rows = posts(spark, sf_dir).select("post_id", "topic", "channel_id", "posted_at")
    return windows.idle_distinct(rows, "topic", "channel_id", "posted_at", "post_id", 86_400, "n_sources").select("post_id", "n_sources")


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("post_id", "topic", "channel_id", "posted_at")
    rows = windows.idle_counts(rows, "topic", "posted_at", "post_id", {f"freq_{name}": seconds for name, seconds in WINDOWS.items()})
    rows = windows.idle_distinct(rows, "topic", "channel_id", "posted_at", "post_id", 86_400, "n_sources")
    expected = scoring.expected_baseline(F.col("freq_24h"), 300)
    rows = rows.withColumn("ratio", scoring.burst(F.col("freq_5m"), expected)).withColumn("roc", scoring.rate_of_change(F.col("freq_5m"), F.col("freq_1h")))
    reasons = F.array_compact(F.array(F.when(F.col("ratio") >= MIN_RATIO, "burst"), F.when(F.col("n_sources") >= MIN_SOURCES, "sources"), F.when(F.col("roc") > 0, "growth")))
    return rows.withColumn("reasons", F.array_join(reasons, ","))


@query(
    f"""WITH {POSTS_SQL}, a AS ({_idle_sql(300, "freq_5m")}), b AS ({_idle_sql(3600, "freq_1h")}), c AS ({_idle_sql(86_400, "freq_24h")}), {_DIVERSITY},
    r AS (SELECT post_id, round(freq_5m / greatest(1.0, freq_24h / 288.0), 2) AS ratio, freq_5m - greatest(freq_1h, 1) AS roc, n_sources FROM a JOIN b USING (post_id) JOIN c USING (post_id) JOIN d USING (post_id))
    SELECT post_id, round(ratio, 6) AS ratio, roc, n_sources, concat_ws(',', CASE WHEN ratio >= 3 THEN 'burst' END, CASE WHEN n_sources >= 3 THEN 'sources' END, CASE WHEN roc > 0 THEN 'growth' END) AS reasons FROM r"""
)
def burst_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed against expected, change, and which thresholds hold."""
    return _bursts(spark, sf_dir).select("post_id", F.round("ratio", 6).alias("ratio"), "roc", "n_sources", "reasons")


def cooldown(df: DataFrame, key: str, ts: str, seconds: int, schema: str) -> DataFrame:
    """Per key, rows in time order that come seconds or more after the last one let through. (ST04)"""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([ts, "post_id"], kind="stable")
        keep, until = [], None
        for t in rows[ts]:
            ok = until is None or t >= until
            keep.append(ok)
            if ok:
                until = t + pd.Timedelta(seconds=seconds)
        return rows[keep]

    return df.groupBy(key).applyInPandas(run, schema)


@query()
def emerging_with_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST04, ST05: rows over the thresholds, at most one in 15 minutes for a topic.
    Only rows over the thresholds are gathered by topic."""
    rows = _bursts(spark, sf_dir).where(f"n_sources >= {MIN_SOURCES} AND freq_1h >= 2").select("post_id", "topic", "posted_at", "n_sources")
    return cooldown(rows, "topic", "posted_at", COOLDOWN_SECONDS, rows.schema.simpleString()[7:-1].replace(":", " "))


@query(
    f"""WITH {POSTS_SQL} SELECT topic, date_trunc('minute', posted_at) AS metrics_at, arg_max(value, (posted_at, post_id)) AS last_value, count(*) AS n
    FROM posts GROUP BY 1, 2"""
)
def minute_metric_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST20, F40: one row a topic and minute, the last write wins."""
    rows = posts(spark, sf_dir).groupBy("topic", F.date_trunc("minute", "posted_at").cast("timestamp_ntz").alias("metrics_at"))
    return rows.agg(F.max_by("value", F.struct("posted_at", "post_id")).alias("last_value"), F.count(F.lit(1)).alias("n"))


_GAPS = """gaps AS (SELECT channel_id, posted_at, post_id, date_diff('microsecond', lag(posted_at) OVER (PARTITION BY channel_id ORDER BY posted_at, post_id), posted_at) / 1e6 AS gap FROM posts),
    recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY posted_at DESC, post_id DESC) AS k FROM gaps) WHERE k <= 200 AND gap > 0),
    stats AS (SELECT channel_id, count(*) AS n, quantile_cont(gap, 0.5) AS median, quantile_cont(gap, 0.95) AS p95, avg(gap) AS ewma FROM recent GROUP BY channel_id HAVING count(*) >= 3)"""


def interarrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each channel's newest 200 gaps, the exact median, p95 and mean."""
    w = Window.partitionBy("channel_id").orderBy("posted_at", "post_id")
    gap = (F.unix_micros("posted_at") - F.lag(F.unix_micros("posted_at")).over(w)) / 1e6
    rows = windows.ranked(posts(spark, sf_dir).withColumn("gap", gap), ["channel_id"], F.desc("posted_at"), F.desc("post_id")).where("rank <= 200 AND gap > 0")
    stats = rows.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("gap", 0.5).alias("median"), F.percentile("gap", 0.95).alias("p95"), F.avg("gap").alias("ewma"))
    return stats.where("n >= 3")


@query(
    f"""WITH {POSTS_SQL}, {_GAPS} SELECT channel_id, n, round(median, 4) AS median, round(p95, 4) AS p95, round(ewma, 4) AS ewma,
    round(least(43200.0, greatest(1800.0, 1.5 * p95)), 4) AS threshold, round(least(600.0, greatest(120.0, 0.5 * p95)), 4) AS overlap FROM stats"""
)
def interarrival_adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01, A05, F52, F53."""
    no = F.lit(False)
    r6 = lambda c: F.round(c, 4)
    stats = interarrival(spark, sf_dir)
    return stats.select("channel_id", "n", r6("median").alias("median"), r6("p95").alias("p95"), r6("ewma").alias("ewma"), r6(scoring.adaptive_threshold(F.col("p95"), no, no)).alias("threshold"), r6(scoring.overlap_seconds(F.col("p95"))).alias("overlap"))


@query(
    f"""WITH {POSTS_SQL}, {_GAPS}, now AS (SELECT max(posted_at) AS t FROM posts), last AS (SELECT channel_id, max(posted_at) AS seen FROM posts GROUP BY 1),
    j AS (SELECT channel_id, date_diff('microsecond', seen, t) / 1e6 AS idle, p95, isodow(t + INTERVAL 3 HOUR) >= 6 AS weekend, hour(t + INTERVAL 3 HOUR) >= 22 OR hour(t + INTERVAL 3 HOUR) < 8 AS night FROM last LEFT JOIN stats USING (channel_id), now),
    x AS (SELECT *, coalesce(least(86400.0, least(43200.0, greatest(1800.0, 1.5 * p95)) * CASE WHEN weekend THEN 1.8 ELSE 1.0 END * CASE WHEN night THEN 1.5 ELSE 1.0 END), 3600.0) AS threshold FROM j)
    SELECT channel_id, round(idle, 6) AS idle, round(threshold, 6) AS threshold, idle > threshold AS is_gap FROM x"""
)
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13, P22, F41: channels idle for longer than their threshold; now is the last post."""
    rows = posts(spark, sf_dir)
    now = rows.agg(F.max("posted_at").alias("now"))
    last = rows.groupBy("channel_id").agg(F.max("posted_at").alias("seen")).join(interarrival(spark, sf_dir), "channel_id", "left").crossJoin(F.broadcast(now))
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), F.col("now").cast("timestamp_ntz"))
    threshold = scoring.adaptive_threshold(F.col("p95"), F.weekday(local) >= 5, (F.hour(local) >= 22) | (F.hour(local) < 8))
    idle = (F.unix_micros("now") - F.unix_micros("seen")) / 1e6
    return last.withColumn("idle", idle).withColumn("threshold", threshold).select("channel_id", F.round("idle", 6).alias("idle"), F.round("threshold", 6).alias("threshold"), (F.col("idle") > F.col("threshold")).alias("is_gap"))


@query(
    f"""WITH {POSTS_SQL} SELECT post_id, round(log10(1 + views) + 2 * log10(1 + reactions) + 3 * log10(1 + forwards) + log10(1 + replies), 6) AS engagement FROM posts"""
)
def engagement_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F45."""
    score = scoring.engagement(*(F.col(c) for c in ("views", "reactions", "forwards", "replies")))
    return posts(spark, sf_dir).select("post_id", F.round(score, 6).alias("engagement"))


@query(
    f"""WITH {POSTS_SQL}, t AS (SELECT *, hour(posted_at + INTERVAL 3 HOUR) AS h, isodow(posted_at + INTERVAL 3 HOUR) >= 6 AS weekend FROM posts)
    SELECT count(*) FILTER (weekend OR h >= 22 OR h < 8) AS quiet, count(*) FILTER (NOT (weekend OR h >= 22 OR h < 8)) AS loud,
    sum(CASE WHEN h >= 2 AND h < 6 THEN 2.0 WHEN h >= 10 AND h < 18 THEN 0.5 WHEN h >= 18 AND h < 22 THEN 0.75 ELSE 1.0 END)::DOUBLE AS batches FROM t"""
)
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P22, F41, F44."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), F.col("posted_at").cast("timestamp_ntz"))
    quiet = scoring.is_quiet_hour(F.col("posted_at"))
    return posts(spark, sf_dir).agg(F.count_if(quiet).alias("quiet"), F.count_if(~quiet).alias("loud"), F.sum(scoring.batch_multiplier(F.hour(local))).alias("batches"))


@query(
    f"""WITH {POSTS_SQL}, w AS (SELECT topic, channel_id, count(*) AS q, max(posted_at) AS seen FROM posts GROUP BY 1, 2), now AS (SELECT max(posted_at) AS t FROM posts),
    x AS (SELECT channel_id, topic, least(1.0, greatest(0.0, 0.4 * (q / 100.0) + 0.3 * (q / 200.0) + 0.3 * greatest(0.0, 1 - date_diff('microsecond', seen, t) / 8.64e10 / 30))) AS weight FROM w, now)
    SELECT channel_id, topic, round(weight / sum(weight) OVER (PARTITION BY channel_id), 6) AS weight FROM x"""
)
def interest_weights_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of (user, topic), summing to 1 for a user."""
    rows = posts(spark, sf_dir)
    now = F.broadcast(rows.agg(F.max("posted_at").alias("now")))
    counts = rows.groupBy("channel_id", "topic").agg(F.count(F.lit(1)).alias("q"), F.max("posted_at").alias("seen")).crossJoin(now)
    days = (F.unix_micros("now") - F.unix_micros("seen")) / 8.64e10
    weighted = counts.withColumn("w", scoring.interest_weight(F.col("q") / 100, F.col("q") / 200, days))
    total = F.sum("w").over(Window.partitionBy("channel_id"))
    return weighted.select("channel_id", "topic", F.round(F.when(total == 0, F.col("w")).otherwise(F.col("w") / total), 6).alias("weight"))


@query(
    f"""WITH {POSTS_SQL}, i AS (SELECT channel_id, topic, count(*) AS w, row_number() OVER (PARTITION BY channel_id ORDER BY count(*) DESC, topic) AS k FROM posts GROUP BY 1, 2),
    e AS (SELECT post_id, topic, value, row_number() OVER (PARTITION BY topic ORDER BY value DESC, post_id) AS k FROM posts),
    s AS (SELECT i.channel_id, e.post_id, max(0.8 * i.w * e.value) AS score FROM i JOIN e ON i.topic = e.topic AND i.k <= 3 AND e.k <= 20 GROUP BY 1, 2)
    SELECT channel_id, post_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY score DESC, post_id) AS k FROM s) WHERE k <= 10"""
)
def recommendations_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's three interests, the best posts of each, the maximum a post."""
    rows = posts(spark, sf_dir)
    interests = windows.ranked(rows.groupBy("channel_id", "topic").agg(F.count(F.lit(1)).alias("w")), ["channel_id"], F.desc("w"), F.col("topic")).where("rank <= 3").drop("rank")
    best = windows.ranked(rows.select("post_id", "topic", "value"), ["topic"], F.desc("value"), F.col("post_id")).where("rank <= 20").drop("rank")
    scored = interests.join(best, "topic").groupBy("channel_id", "post_id").agg(F.max(0.8 * F.col("w") * F.col("value")).alias("score"))
    return windows.ranked(scored, ["channel_id"], F.desc("score"), F.col("post_id")).where("rank <= 10").select("channel_id", "post_id", F.round("score", 4).alias("score"))


@query(
    """WITH b AS (SELECT c_custkey, ('0x' || sha256('exp:' || c_custkey::VARCHAR)[1:8])::BIGINT / 4294967295.0 AS bucket FROM customer)
    SELECT c_custkey, round(bucket, 9) AS bucket, CASE WHEN bucket < 0.5 THEN 'control' WHEN bucket < 0.8 THEN 'a' ELSE 'b' END AS variant FROM b"""
)
def experiment_bucketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants by a cumulative scale on a hash."""
    bucket = scoring.experiment_bucket("exp", F.col("c_custkey").cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", bucket.alias("bucket"))
    return rows.select("c_custkey", F.round("bucket", 9).alias("bucket"), F.when(F.col("bucket") < 0.5, "control").when(F.col("bucket") < 0.8, "a").otherwise("b").alias("variant"))
