"""Deliveries, counters, cards, links and sections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..operators import vectors
from ..sources.adapters import POSTS_SQL, posts, table
from ..sources.shared import shared_dir
from ..streaming import jobs
from ..streaming.deliveries import Deliveries
from .registry import query


def _handled(rows: DataFrame) -> DataFrame:
    """Errors succeed at the delivery that their number asks for; some never do."""
    ok = (F.col("event_type") != "error") | (F.col("deliveries") > F.col("event_id") % 7)
    return rows.withColumns({"ok": ok, "reason": F.when(~ok, "handler_error"), "details": F.when(~ok, F.concat(F.lit("try "), F.col("deliveries").cast("string")))})


@query("""SELECT event_id, CASE WHEN event_type = 'error' AND event_id % 7 >= 5 THEN 'dead' ELSE 'done' END AS status, CASE WHEN event_type <> 'error' THEN 1 WHEN event_id % 7 >= 5 THEN 5 ELSE event_id % 7 + 1 END::INTEGER AS deliveries,
    CASE WHEN event_type = 'error' AND event_id % 7 >= 5 THEN 'handler_error: try 5' ELSE '' END AS why FROM events""")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S06, S08, S09, S10, ST01, ST15, X01: events as messages of a stream; failed ones come again and end as dead letters."""
    schema = table(spark, sf_dir, "events").select("event_id", "event_type").schema
    rows = jobs.read_new(spark, f"{sf_dir}/events.parque[t]", table(spark, sf_dir, "events").schema, jobs.ALL_FILES).select("event_id", "event_type")
    at = f"{shared_dir(spark)}/deliveries-{uuid.uuid4().hex}"
    sink = Deliveries(f"{at}/out", schema, _handled)
    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    # The stream has ended: what waits is delivered again until nothing does, at most so often as a message is tried.
    nothing = spark.createDataFrame([], schema)
    for epoch in range(1, sink.most):
        sink(nothing, epoch)
    dead = sink.dead_letters(spark)
    lost = dead.select(F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"), F.lit("dead").alias("status"), "deliveries", F.concat_ws(": ", "reason", "details").alias("why"))
    return sink.done(spark).select("event_id", "status", "deliveries", F.lit("").alias("why")).unionByName(lost)


@query(f"""WITH {POSTS_SQL}, d AS (SELECT channel_id, topic, date_trunc('day', posted_at) AS day, views, views - lag(views) OVER (PARTITION BY channel_id, topic ORDER BY posted_at, post_id) AS diff FROM posts),
    i AS (SELECT channel_id, topic, day, sum(CASE WHEN diff IS NULL THEN 0 WHEN diff < 0 THEN views ELSE diff END)::BIGINT AS increase FROM d GROUP BY 1, 2, 3)
    SELECT topic, day, count(*) AS series, sum(increase)::BIGINT AS increase, round(sum(increase) / 86400.0, 9) AS rate FROM i GROUP BY 1, 2""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increase and rate a day of counters that may begin anew, added up by topic."""
    series = Window.partitionBy("channel_id", "topic").orderBy("posted_at", "post_id")
    diff = F.col("views") - F.lag("views").over(series)
    rows = posts(spark, sf_dir).withColumn("diff", diff).withColumn("day", F.date_trunc("day", "posted_at").cast("timestamp_ntz"))
    grown = F.sum(F.when(F.col("diff").isNull(), 0).when(F.col("diff") < 0, F.col("views")).otherwise(F.col("diff"))).cast("long")
    each = rows.groupBy("channel_id", "topic", "day").agg(grown.alias("increase"))
    return each.groupBy("topic", "day").agg(F.count(F.lit(1)).alias("series"), F.sum("increase").alias("increase"), F.round(F.sum("increase") / 86400.0, 9).alias("rate"))


_COS = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


@query(f"""WITH c AS (SELECT vec_id, label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
    s AS (SELECT a.vec_id, b.label, {_COS} AS s FROM embeddings a, c b),
    t AS (SELECT vec_id, label, s FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1)
    SELECT vec_id, CASE WHEN s >= 0.55 THEN label END AS cluster, round(CASE WHEN s >= 0.55 THEN s ELSE greatest(s, 0.6) END, 6) AS coherence, round(greatest(0, 1 - s), 6) AS novelty FROM t""")
def cluster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the three nearest clusters if its similarity is 0.55 or more, else a new cluster of coherence 0.6 or more;
    novelty is what the similarity leaves. There is one cluster a label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    centres = rows.groupBy("label").agg(F.min_by("q", "query_id").alias("v"))
    # Labels are few: the clusters, not the vectors, go to every task; their numbers are made distinct from the vectors'.
    scored = rows.drop("label").crossJoin(F.broadcast(centres)).select("query_id", "label", vectors.cosine("q", "v").alias("s"))
    top = scored.groupBy("query_id").agg(F.max_by(F.struct("label", "s"), F.struct("s", (-F.col("label")).alias("k"))).alias("m"))
    near = F.col("m.s") >= 0.55
    return top.select(F.col("query_id").alias("vec_id"), F.when(near, F.col("m.label")).alias("cluster"), F.round(F.when(near, F.col("m.s")).otherwise(F.greatest(F.col("m.s"), F.lit(0.6))), 6).alias("coherence"), F.round(F.greatest(F.lit(0.0), 1 - F.col("m.s")), 6).alias("novelty"))


@query(f"""WITH {POSTS_SQL}, u AS (SELECT channel_id % 10 AS reader, topic, channel_id, post_id, row_number() OVER (PARTITION BY channel_id % 10, topic ORDER BY posted_at DESC, post_id DESC) AS k FROM posts)
    SELECT reader, topic, count(*) AS mentions, count(DISTINCT channel_id) AS sources, max(post_id) FILTER (k = 1) AS newest FROM u WHERE k <= 10 GROUP BY 1, 2""")
def personal_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every topic the ten latest posts of the channels that a reader follows, and how many sources they have."""
    rows = posts(spark, sf_dir)
    follows = rows.select("channel_id", (F.col("channel_id") % 10).alias("reader")).distinct()
    mine = rows.join(follows, "channel_id").withColumn("k", F.row_number().over(Window.partitionBy("reader", "topic").orderBy(F.desc("posted_at"), F.desc("post_id"))))
    return mine.where("k <= 10").groupBy("reader", "topic").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("channel_id").alias("sources"), F.max(F.when(F.col("k") == 1, F.col("post_id"))).alias("newest"))


@query("""WITH h AS (SELECT page_id, 'see [it](' || url || ') or (' || url || ') at ' || url || '.' AS text, url FROM pages)
    SELECT page_id, 1 AS n FROM h""")
def extracted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a page's url in three ways of writing is one url."""
    u = F.col("url")
    text = F.concat(F.lit("see [it]("), u, F.lit(") or ("), u, F.lit(") at "), u, F.lit("."))
    return table(spark, sf_dir, "pages").select("page_id", F.size(urls.extracted(text)).alias("n"))


@query("""WITH t AS (SELECT count(*) AS total FROM customer) SELECT c_custkey, total, ceil(total / 25)::BIGINT AS pages FROM customer, t ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50""")
def page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25, with how many rows and pages there are."""
    rows = table(spark, sf_dir, "customer")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("c_acctbal"), "c_custkey").offset(50).limit(25).select("c_custkey")
    return page.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 25))
