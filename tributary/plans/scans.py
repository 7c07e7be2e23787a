"""Bounded scans and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import graph, scans, windows
from ..sources.adapters import POSTS_SQL, posts, table
from .graphs import _EDGES, edges, tags
from .registry import query


@query(f"""WITH {POSTS_SQL}, r AS (SELECT channel_id, post_id, row_number() OVER (PARTITION BY channel_id ORDER BY posted_at DESC, post_id DESC) AS k FROM posts WHERE posted_at >= TIMESTAMP '2024-01-10')
    SELECT channel_id, (k - 1) // 5 AS batch, count(*) AS n, max(post_id) AS newest FROM r WHERE k <= 500 GROUP BY 1, 2""")
def history_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's history from a date on, newest first, in batches, up to a bound."""
    found = scans.history(posts(spark, sf_dir), "channel_id", "posted_at", "post_id", F.lit("2024-01-10").cast("timestamp"), "incremental", 5)
    return found.groupBy("channel_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("post_id").alias("newest"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' GROUP BY 1")
def period_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A period is read again."""
    rows = scans.period(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-09 12:00:00").cast("timestamp_ntz"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""WITH stored AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-20' AND event_id % 5 <> 0), s AS (SELECT user_id, max(ts) - INTERVAL 48 HOUR AS since FROM stored GROUP BY 1)
    SELECT event_id, user_id FROM events LEFT JOIN s USING (user_id) WHERE (since IS NULL OR ts >= since) AND event_id NOT IN (SELECT event_id FROM stored)""")
def overlap_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST12: rows that came late are found by reading two days again; what is stored is not read twice."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    stored = rows.where("ts < timestamp_ntz'2024-01-20' AND event_id % 5 <> 0")
    twice = rows.unionByName(rows.where("event_id % 3 = 0"))
    return scans.reread(stored, twice, "user_id", "event_id", "ts", F.expr("INTERVAL 48 HOURS")).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_returnflag IN ('A', 'N') AND l_linestatus = 'O' AND l_quantity >= 10 AND l_quantity < 40")
def tenant_payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: a tenant's rows by equality, any of a list, and a range."""
    wanted = {"l_returnflag": ["A", "N"], "l_linestatus": "O", "l_quantity": {"range": {"gte": 10, "lt": 40}}}
    return table(spark, sf_dir, "lineitem").where(scans.payload_filter(F.col("l_suppkey"), 7, wanted)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"""WITH {POSTS_SQL}, n AS (SELECT max(posted_at) AS now FROM posts), d AS (SELECT channel_id, topic, max(posted_at) AS seen FROM posts GROUP BY 1, 2)
    SELECT channel_id, count(*) AS topics, count(*) FILTER (now - seen <= INTERVAL 72 HOUR) AS valid FROM d, n GROUP BY 1""")
def fresh_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a dialogue hold for 72 hours."""
    rows = posts(spark, sf_dir)
    now = F.broadcast(rows.agg(F.max("posted_at").alias("now")))
    last = rows.groupBy("channel_id", "topic").agg(F.max("posted_at").alias("at")).crossJoin(now)
    return last.groupBy("channel_id").agg(F.count(F.lit(1)).alias("topics"), F.count_if(F.unix_micros("now") - F.unix_micros("at") <= 72 * 3_600_000_000).alias("valid"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events, n WHERE ts >= now - INTERVAL 14 DAY),
    c AS (SELECT user_id, event_type, count(*) AS n FROM r WHERE k <= 100 GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS kinds, sum(n)::BIGINT AS interactions FROM c GROUP BY 1""")
def recent_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a user's last hundred interactions within fourteen days."""
    rows = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    now = F.broadcast(rows.agg(F.max("at").alias("now")))
    recent = rows.crossJoin(now).where(F.col("at") >= F.col("now") - F.expr("INTERVAL 14 DAYS"))
    counts = windows.ranked(recent, ["user_id"], F.desc("at"), F.desc("event_id")).where("rank <= 100").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit("="), x["n"].cast("string"))), ",")
    return counts.groupBy("user_id").agg(kinds.alias("kinds"), F.sum("n").alias("interactions"))


@query("""WITH s AS (SELECT c_custkey, c_nationkey, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 10000 END, 0.5) AS score, c_custkey % 7 <> 0 AS good FROM customer)
    SELECT c_custkey, c_nationkey, round(score, 6) AS score FROM s WHERE good QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey) <= 3""")
def quality_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is good, by relevance, which is 0.5 where unknown, three of a nation."""
    score = F.coalesce(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") / 10000), F.lit(0.5))
    rows = table(spark, sf_dir, "customer").withColumn("score", score).where("c_custkey % 7 <> 0")
    return windows.ranked(rows, ["c_nationkey"], F.desc("score"), F.col("c_custkey")).where("rank <= 3").select("c_custkey", "c_nationkey", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS tokens, md5(text[1:400]) AS cut FROM documents""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens by length, and a text cut to a hundred of them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1).cast("long"), F.floor(F.length("text") / 4)).alias("tokens"), F.md5(F.substring("text", 1, 400)).alias("cut"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    s AS (SELECT *, sum((k % 3 = 2)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS section FROM l)
    SELECT doc_id, section::BIGINT AS section, trim(replace(max(line) FILTER (k % 3 = 2), '##', '')) AS title, count(*) FILTER (k % 3 = 0) AS items, coalesce(md5(string_agg(trim(replace(line, '-', '')), '|' ORDER BY k) FILTER (k % 3 = 0)), md5('')) AS hash FROM s WHERE section > 0 GROUP BY 1, 2""")
def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every second line of three begins a section, every third is an item."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), F.replace(x, F.lit("##"), F.lit("")))).when(i % 3 == 2, F.concat(F.lit("- "), x)).otherwise(F.lit("plain")))
    found = scans.sections(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("md")), "doc_id", "md")
    return found.select("doc_id", "section", "title", F.size("items").cast("long").alias("items"), F.md5(F.array_join("items", "|")).alias("hash"))


@query(f"""WITH {POSTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY posted_at DESC, post_id DESC) AS k FROM posts)
    SELECT topic, string_agg(post_id || '@' || strftime(posted_at, '%Y-%m-%dT%H:%M:%S'), ',' ORDER BY k) FILTER (k <= 5) AS examples, string_agg(DISTINCT 'post ' || (post_id % 3), ' ') FILTER (k = 1) AS summary FROM r GROUP BY 1""")
def example_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the five newest posts of a topic as they are shown, and a summary of snippets."""
    rows = windows.ranked(posts(spark, sf_dir), ["topic"], F.desc("posted_at"), F.desc("post_id")).where("rank <= 5")
    shown = F.concat(F.col("post_id").cast("string"), F.lit("@"), F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss"))
    snippet = F.when(F.col("rank") == 1, F.concat(F.lit("post "), (F.col("post_id") % 3).cast("string")))
    listed = rows.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("s"), snippet.alias("t")))).alias("x"))
    return listed.select("topic", F.array_join(F.transform("x", lambda e: e["s"]), ",").alias("examples"), labels.sample_summary(F.transform("x", lambda e: e["t"])).alias("summary"))


@query(f"""WITH {_EDGES}, around AS (SELECT t1, t2, weight FROM edges UNION ALL SELECT t2, t1, weight FROM edges),
    i AS (SELECT o_custkey, tag, count(*) AS w FROM tags JOIN orders ON post_id = o_orderkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, tag) <= 5),
    s AS (SELECT t1, t2, weight FROM around QUALIFY row_number() OVER (PARTITION BY t1 ORDER BY weight DESC, t2) <= 5),
    c AS (SELECT o_custkey, t2 AS topic, max(w * weight) AS w FROM i JOIN s ON tag = t1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY max(w * weight) DESC, t2) <= 10),
    p AS (SELECT tag, max(post_id) AS post_id FROM tags GROUP BY 1)
    SELECT o_custkey, count(*) AS topics, min(post_id) AS post_id FROM c JOIN p ON topic = tag GROUP BY 1""")
def collaborative_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a user's five topics to the five nearest of each, the ten best of these, and their posts (the newest of each)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), "o_custkey")
    named = tags(spark, sf_dir)
    mine = named.join(o, "post_id").groupBy("o_custkey", "tag").agg(F.count(F.lit(1)).alias("w"))
    mine = windows.ranked(mine, ["o_custkey"], F.desc("w"), F.col("tag")).where("rank <= 5").select("o_custkey", F.col("tag").alias("t1"), "w")
    near = windows.ranked(graph.both_ways(edges(spark, sf_dir).select("t1", "t2", "weight")), ["t1"], F.desc("weight"), F.col("t2")).where("rank <= 5").select("t1", "t2", "weight")
    found = mine.join(near, "t1").groupBy("o_custkey", F.col("t2").alias("tag")).agg(F.max(F.col("w") * F.col("weight")).alias("w"))
    best = windows.ranked(found, ["o_custkey"], F.desc("w"), F.col("tag")).where("rank <= 10")
    newest = named.groupBy("tag").agg(F.max("post_id").alias("post_id"))
    return best.join(newest, "tag").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("topics"), F.min("post_id").alias("post_id"))
