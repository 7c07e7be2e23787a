"""Graph operators over tags of orders: the brands of the parts they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, windows
from ..sources.adapters import table
from .registry import query

_TAGS = "tags AS (SELECT DISTINCT l_orderkey AS post_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 40)"
_EDGES = f"{_TAGS}, edges AS (SELECT a.tag AS t1, b.tag AS t2, count(*) AS weight FROM tags a JOIN tags b ON a.post_id = b.post_id AND a.tag < b.tag GROUP BY 1, 2)"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag"))
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 40").select("l_orderkey", "l_partkey").join(p, "l_partkey").select(F.col("l_orderkey").alias("post_id"), "tag").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.co_occurrence(tags(spark, sf_dir), "post_id", "tag")


@query(f"WITH {_EDGES} SELECT t1, t2, weight, round(CASE WHEN weight = 1 THEN 0.5 ELSE 0.5 + 0.1 * weight END, 6)::DOUBLE AS similarity FROM edges")
def topic_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G01, G02, F57, J19."""
    return edges(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {_EDGES}, strong AS (SELECT t1, t2 FROM edges WHERE weight >= (SELECT quantile_cont(weight, 0.9) FROM edges)), around AS (SELECT t1, t2 FROM strong UNION SELECT t2, t1 FROM strong),
    walk(node, hop) AS (SELECT 'Brand#1', 0 UNION SELECT t2, hop + 1 FROM walk JOIN around ON node = t1 WHERE hop < 2) SELECT node, min(hop)::INT AS hop FROM walk GROUP BY 1""")
def k_hop_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within two steps over strong edges."""
    all_ = edges(spark, sf_dir)
    bound = F.broadcast(all_.agg(F.percentile("weight", 0.9).alias("bound")))
    strong = all_.crossJoin(bound).where("weight >= bound").select("t1", "t2")
    return graph.k_hop(strong, spark.createDataFrame([("Brand#1",)], "node string"), 2)


@query(f"WITH {_TAGS} SELECT post_id, string_agg(tag, ',' ORDER BY tag) AS topics FROM tags WHERE contains(lower(tag), '#1') GROUP BY 1")
def topic_substring_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with a topic that holds the text."""
    rows = tags(spark, sf_dir).where(F.lower("tag").contains("#1"))
    return rows.groupBy("post_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("topics"))


@query(f"""WITH {_EDGES}, around AS (SELECT t1, t2, weight FROM edges UNION ALL SELECT t2, t1, weight FROM edges) SELECT t1 AS topic, t2 AS similar, weight FROM around QUALIFY row_number() OVER (PARTITION BY t1 ORDER BY weight DESC, t2) <= 5""")
def similar_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G05."""
    rows = graph.both_ways(edges(spark, sf_dir).select("t1", "t2", "weight"))
    return windows.ranked(rows, ["t1"], F.desc("weight"), F.col("t2")).where("rank <= 5").select(F.col("t1").alias("topic"), F.col("t2").alias("similar"), "weight")


@query(f"WITH {_TAGS} SELECT count(DISTINCT post_id) AS posts, count(DISTINCT tag) AS topics, count(*) AS edges FROM tags")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, G09."""
    return tags(spark, sf_dir).agg(F.countDistinct("post_id").alias("posts"), F.countDistinct("tag").alias("topics"), F.count(F.lit(1)).alias("edges"))


@query(f"""WITH {_EDGES}, around AS (SELECT t1, t2, weight FROM edges UNION ALL SELECT t2, t1, weight FROM edges),
    i AS (SELECT o_custkey, tag, count(*) AS w FROM tags JOIN orders ON post_id = o_orderkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, tag) <= 2),
    s AS (SELECT t1, t2 FROM around QUALIFY row_number() OVER (PARTITION BY t1 ORDER BY weight DESC, t2) <= 2)
    SELECT DISTINCT o_custkey, t2 AS topic, 0.7::DOUBLE AS score FROM i JOIN s ON tag = t1""")
def collaborative_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics like a user's own."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), "o_custkey")
    i = tags(spark, sf_dir).join(o, "post_id").groupBy("o_custkey", "tag").agg(F.count(F.lit(1)).alias("w"))
    i = windows.ranked(i, ["o_custkey"], F.desc("w"), F.col("tag")).where("rank <= 2").select("o_custkey", F.col("tag").alias("t1"))
    s = windows.ranked(graph.both_ways(edges(spark, sf_dir).select("t1", "t2", "weight")), ["t1"], F.desc("weight"), F.col("t2")).where("rank <= 2").select("t1", "t2")
    return i.join(s, "t1").select("o_custkey", F.col("t2").alias("topic"), F.lit(0.7).alias("score")).distinct()
