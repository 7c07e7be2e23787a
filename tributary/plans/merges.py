"""Merges of stores without row updates, hashes, and identifiers of several forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import hashing
from ..sources.adapters import MESSAGES_SQL, messages, table
from .registry import query

_HASH = "list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i) ELSE 0 END))::BIGINT"


@query(f"""WITH h AS (SELECT vec_id % 4 AS tenant, {_HASH} AS hash FROM embeddings), c AS (SELECT tenant, hash, count(*) AS n FROM h GROUP BY 1, 2)
    SELECT x.tenant, x.hash AS a, y.hash AS b, bit_count(xor(x.hash, y.hash))::INTEGER AS distance, x.n AS n_a, y.n AS n_b FROM c x JOIN c y ON x.tenant = y.tenant AND x.hash < y.hash AND bit_count(xor(x.hash, y.hash)) <= 12""")
def sign_hash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of a tenant's vectors (63 signs, so that they are positive) that differ in twelve bits at most."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("tenant"), hashing.sign_hash(F.slice("embedding", 1, 63)).alias("hash"))
    return hashing.near_hashes(rows, ["tenant"], 12)


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events),
    o AS (SELECT user_id, event_type, event_id, value FROM p WHERE k = 1), n AS (SELECT user_id, event_type, event_id, value FROM p WHERE k = 2)
    SELECT o.user_id, o.event_type AS kind, sha256(o.user_id || '|' || (floor(CASE WHEN n.event_id IS NOT NULL AND floor(n.value / 20) <> floor(o.value / 20) THEN n.value ELSE o.value END / 20))::BIGINT) AS params_hash,
        CASE WHEN n.event_id IS NOT NULL AND floor(n.value / 20) <> floor(o.value / 20) THEN n.event_id ELSE o.event_id END AS updated_by FROM o LEFT JOIN n ON n.user_id = o.user_id AND n.event_type = o.event_type""")
def enrichment_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second enrichment of a user and kind replaces the first only if its parameters' hash is another; the hash is kept."""
    k = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").withColumn("k", k).where("k <= 2")
    params = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.floor(F.col("value") / 20).cast("string")), 256)
    rows = rows.select("user_id", F.col("event_type").alias("kind"), "k", F.struct(params.alias("params_hash"), F.col("event_id").alias("updated_by")).alias("row"))
    both = rows.groupBy("user_id", "kind").agg(F.max(F.when(F.col("k") == 1, F.col("row"))).alias("o"), F.max(F.when(F.col("k") == 2, F.col("row"))).alias("n"))
    changed = F.col("n").isNotNull() & (F.col("n.params_hash") != F.col("o.params_hash"))
    chosen = F.when(changed, F.col("n")).otherwise(F.col("o"))
    return both.select("user_id", "kind", chosen["params_hash"].alias("params_hash"), chosen["updated_by"].alias("updated_by"))


@query("""WITH p AS (SELECT event_type AS cluster, event_id, CASE WHEN event_id % 3 = 0 THEN [] ELSE [user_id::VARCHAR] END AS topics, value FROM events),
    l AS (SELECT cluster, arg_max(topics, event_id) FILTER (len(topics) > 0) AS topics, max(value) AS diversity, arg_max(value, event_id) AS last_value FROM p GROUP BY 1)
    SELECT cluster, array_to_string(topics, ',') AS topics, diversity, last_value FROM l""")
def cluster_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list never replaces one with elements; the greatest diversity and the last value stay."""
    topics = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").withColumn("topics", topics)
    filled = F.when(F.size("topics") > 0, F.col("event_id"))
    found = rows.groupBy(F.col("event_type").alias("cluster")).agg(F.max_by("topics", filled).alias("topics"), F.max("value").alias("diversity"), F.max_by("value", "event_id").alias("last_value"))
    return found.withColumn("topics", F.array_join("topics", ","))


@query("""WITH i AS (SELECT l_orderkey AS album, l_linenumber AS place, arg_max(l_returnflag, (l_shipdate, l_partkey, l_suppkey)) AS kind, arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey)) AS item FROM lineitem GROUP BY 1, 2)
    SELECT album, count(*) AS items, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS kind, sha256(string_agg(item || ':' || kind, ',' ORDER BY place)) AS content_hash, min(item) FILTER (place = 1) AS cover FROM i GROUP BY 1""")
def album_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each place of an album the last item stays; the album's kind, cover and hash of ids and kinds follow from its items."""
    last = F.max_by(F.struct(F.col("l_partkey").alias("item"), F.col("l_returnflag").alias("kind")), F.struct("l_shipdate", "l_partkey", "l_suppkey"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("album"), F.col("l_linenumber").alias("place")).agg(last.alias("x")).select("album", "place", "x.*")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", F.col("item").cast("string"), "kind").alias("s")))), lambda x: x["s"]), ",")
    kind = F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed")
    return items.groupBy("album").agg(F.count(F.lit(1)).alias("items"), kind.alias("kind"), F.sha2(listed, 256).alias("content_hash"), F.min(F.when(F.col("place") == 1, F.col("item"))).alias("cover"))


@query("""SELECT event_id % 4000 AS id, arg_max(value, event_id) FILTER (event_type <> 'error') AS value, count(*) FILTER (event_type <> 'error') - 1 AS edits, arg_max(event_type, event_id) = 'error' AS is_deleted,
    max(ts) FILTER (event_type = 'error') AS deleted_at FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'error') > 0""")
def soft_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U16: edits keep the last value, deletions set a flag and leave the value; a deletion of what never was is nothing."""
    rows = table(spark, sf_dir, "events").withColumn("id", F.col("event_id") % 4000)
    live = F.col("event_type") != "error"
    found = rows.groupBy("id").agg(
        F.max_by("value", F.when(live, F.col("event_id"))).alias("value"), (F.count_if(live) - 1).alias("edits"), (F.max_by("event_type", "event_id") == "error").alias("is_deleted"), F.max(F.when(~live, F.col("ts"))).alias("deleted_at")
    )
    return found.where("edits >= 0")


@query("""WITH c AS (SELECT c_custkey AS id, -1000000000000 - c_custkey AS chat FROM customer WHERE c_custkey % 2 = 0),
    a AS (SELECT o_custkey AS reader, o_orderkey AS place, CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN (-o_custkey)::VARCHAR WHEN 2 THEN '-100' || lpad(o_custkey::VARCHAR, 10, '0') ELSE 'x' || o_custkey END AS asked FROM orders),
    m AS (SELECT reader, place, asked, c.id FROM a LEFT JOIN c ON a.asked IN (c.id::VARCHAR, (-c.id)::VARCHAR, c.chat::VARCHAR))
    SELECT reader, count(DISTINCT id) AS channels, count(*) FILTER (id IS NULL) AS rejected, min(place) FILTER (id IS NOT NULL) AS first_place FROM m GROUP BY 1""")
def channel_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels asked for by number, with a sign, or with the prefix -100, once each; unknown ones are rejected."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    key = F.col("o_custkey")
    form = F.when(F.col("o_orderkey") % 4 == 0, key.cast("string")).when(F.col("o_orderkey") % 4 == 1, (-key).cast("string")).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("-100"), F.lpad(key.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("x"), key.cast("string")))
    asked = table(spark, sf_dir, "orders").select(key.alias("reader"), F.col("o_orderkey").alias("place"), form.alias("asked"))
    # The number that every form stands for: one equi-join in place of three.
    bare = F.regexp_replace(F.regexp_replace("asked", r"^-100(\d{10})$", "$1"), "^-", "")
    number = F.when(bare.rlike(r"^\d+$"), bare.cast("long"))
    found = asked.withColumn("number", number).join(known.withColumn("number", F.col("id")), "number", "left")
    return found.groupBy("reader").agg(F.countDistinct("id").alias("channels"), F.count_if(F.col("id").isNull()).alias("rejected"), F.min(F.when(F.col("id").isNotNull(), F.col("place"))).alias("first_place"))


@query(f"""WITH {MESSAGES_SQL}, m AS (SELECT *, turn // 2 AS window_id FROM messages), w AS (SELECT DISTINCT group_id, window_id FROM m QUALIFY dense_rank() OVER (PARTITION BY group_id ORDER BY window_id DESC) BETWEEN 2 AND 4),
    c AS (SELECT m.* FROM m JOIN w USING (group_id, window_id) QUALIFY row_number() OVER (PARTITION BY m.group_id ORDER BY m.window_id DESC, turn DESC) <= 150)
    SELECT group_id, count(DISTINCT window_id) AS windows, count(*) AS n, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM c GROUP BY 1""")
def window_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three windows before the last one, by identifier, 150 messages at most."""
    rows = messages(spark, sf_dir).withColumn("window_id", F.floor(F.col("turn") / 2))
    windows = rows.select("group_id", "window_id").distinct()
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("window_id")))
    before = windows.withColumn("rank", rank).where("rank BETWEEN 2 AND 4").drop("rank")
    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("window_id"), F.desc("turn")))
    kept = rows.join(before, ["group_id", "window_id"]).withColumn("k", newest).where("k <= 150")
    turns = F.array_join(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t.cast("string")), ",")
    return kept.groupBy("group_id").agg(F.countDistinct("window_id").alias("windows"), F.count(F.lit(1)).alias("n"), turns.alias("turns"))


@query("""WITH s AS (SELECT user_id, event_type, max(ts) AS seen_at FROM events WHERE event_id % 2 = 0 AND ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
    f AS (SELECT e.* FROM events e LEFT JOIN s USING (user_id, event_type) WHERE event_id % 2 = 1 AND (seen_at IS NULL OR e.ts - seen_at > INTERVAL 240 HOUR))
    SELECT user_id, event_type, min(event_id) AS event_id FROM f GROUP BY 1, 2""")
def processed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was processed less than ten days before is passed over; of the rest the first of each key."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    seen = rows.where("event_id % 2 = 0 AND ts < timestamp'2024-01-15'").select("user_id", "event_type", F.col("ts").alias("seen_at"))
    return hashing.not_seen(rows.where("event_id % 2 = 1"), seen, ["user_id", "event_type"], "ts", 240 * 3600).select("user_id", "event_type", "event_id")


@query(f"""WITH h AS (SELECT vec_id, vec_id % 4 AS tenant, {_HASH.replace("range(0, 63)", "range(0, 6)")} AS hash, label FROM embeddings),
    r AS (SELECT tenant, hash, min(vec_id) AS source, arg_min(label, vec_id) AS result FROM h WHERE vec_id % 3 = 0 GROUP BY 1, 2)
    SELECT vec_id, source, result FROM h LEFT JOIN r USING (tenant, hash) WHERE vec_id % 3 <> 0""")
def reused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file takes the result of the first file of its tenant with the same hash (six signs, so that there are some)."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("tenant"), hashing.sign_hash(F.slice("embedding", 1, 6)).alias("hash"), "label")
    results = rows.where("vec_id % 3 = 0").select("tenant", "hash", F.col("vec_id").alias("id"), F.col("label").alias("result"))
    return hashing.reused(rows.where("vec_id % 3 <> 0").drop("label"), results, ["tenant"]).select("vec_id", "source", "result")
