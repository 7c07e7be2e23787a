"""Upserts and maintenance: two batches of one table are merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources.adapters import POSTS_SQL, posts, table
from .registry import query

_TWO = f"""{POSTS_SQL}, old AS (SELECT post_id % 4000 AS id, * FROM posts WHERE post_id < 6000), new AS (SELECT post_id % 4000 AS id, * FROM posts WHERE post_id >= 3000)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = posts(spark, sf_dir).withColumn("id", F.col("post_id") % 4000)
    return rows.where("post_id < 6000"), rows.where("post_id >= 3000")


@query(f"""WITH {_TWO}, b AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT id, max(views) AS views, max(forwards) AS forwards, arg_max(nullif(topic, 'error'), post_id) AS topic, min(posted_at) AS first_seen FROM b GROUP BY id""")
def idempotent_upsert_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters keep the greater value, texts the latest that is there."""
    old, new = _two(spark, sf_dir)
    kept = F.nullif("topic", F.lit("error"))
    return merge.upsert(
        old, new, ["id"], views=F.max("views"), forwards=F.max("forwards"),
        topic=F.max_by(kept, F.when(kept.isNotNull(), F.col("post_id"))), first_seen=F.min("posted_at").cast("timestamp_ntz"),
    )


@query(f"""WITH {_TWO}, o AS (SELECT id, arg_max(topic, post_id) AS topic, max(post_id) AS stamp FROM old GROUP BY id), n AS (SELECT id, arg_max(topic, post_id) AS topic, max(post_id) AS stamp FROM new GROUP BY id)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL OR o.topic IS NOT DISTINCT FROM n.topic THEN o.topic ELSE n.topic END AS topic, CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND o.topic IS NOT DISTINCT FROM n.topic) THEN o.stamp ELSE n.stamp END AS stamp FROM o FULL JOIN n ON o.id = n.id""")
def upsert_only_when_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values keep their stamp."""
    last = [df.groupBy("id").agg(F.max_by("topic", "post_id").alias("topic"), F.max("post_id").alias("stamp")) for df in _two(spark, sf_dir)]
    return merge.upsert_if_changed(last[0], last[1], ["id"], ["topic"], "stamp")


@query("SELECT l_partkey AS object, count(DISTINCT l_orderkey) AS refs_count, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of an object, each bridge row once."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("object")).agg(F.countDistinct("l_orderkey").alias("refs_count"), F.max("l_shipdate").alias("last_seen"))


@query("SELECT l_orderkey AS album, count(*) AS items, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS kind FROM lineitem GROUP BY 1")
def album_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An album's kind is its items' if they have one."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("album")).agg(F.count(F.lit(1)).alias("items"), F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    return rows.select("album", "items", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("kind"))


@query("SELECT count(*) AS kept, (SELECT count(*) FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY) AS gone FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ttl_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows past their time become tombstones."""
    rows = posts(spark, sf_dir)
    dated = rows.crossJoin(F.broadcast(rows.agg(F.max("posted_at").alias("now"))))
    kept, gone = merge.expire(dated, "posted_at", F.col("now"), 7)
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(gone.agg(F.count(F.lit(1)).alias("gone")))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS retry_count, CASE WHEN o_orderstatus = 'F' THEN 'O' ELSE o_orderstatus END AS status FROM orders")
def retry_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows begin again."""
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(failed, 0).otherwise(1).alias("retry_count"), F.when(failed, "O").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"""WITH {_TWO}, c AS (SELECT id, post_id, topic <> 'error' AS live, value FROM old UNION ALL SELECT id, post_id, topic <> 'error', value FROM new)
    SELECT id, value FROM (SELECT id, arg_max(live, post_id) AS live, arg_max(value, post_id) AS value FROM c GROUP BY id) WHERE live""")
def edit_delete_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: the last change of a key wins; deleted keys are gone."""
    old, new = _two(spark, sf_dir)
    last = old.unionByName(new).groupBy("id").agg(F.max_by(F.struct((F.col("topic") != "error").alias("live"), "value"), "post_id").alias("x"))
    return last.where("x.live").select("id", "x.value")


@query("""SELECT l_suppkey AS tenant, CASE WHEN sum(l_extendedprice) > 5e7 THEN 'bucket' WHEN sum(l_quantity) > 15000 THEN 'tenant' WHEN count(*) FILTER (l_returnflag = 'R') > 250 THEN 'type' ELSE 'ok' END AS verdict FROM lineitem GROUP BY 1""")
def quota_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits are checked in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tenant")).agg(F.sum("l_extendedprice").alias("b"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return rows.select("tenant", F.when(F.col("b") > 5e7, "bucket").when(F.col("q") > 15_000, "tenant").when(F.col("r") > 250, "type").otherwise("ok").alias("verdict"))
