"""Queues, counters and keyed records: outbox, dead letters, eviction, back-fill, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.adapters import table
from .registry import query

#: Deliveries of a message before it becomes a dead letter, and tries of an outbox row.
MOST_TRIES = 3

_OUTBOX = """WITH outbox AS (SELECT event_id AS id, user_id AS aggregate, event_type AS type, ts AS created_at, md5(props) AS content_hash,
    CASE WHEN event_id % 3 = 0 THEN ts END AS processed_at, (event_id % 5)::INT AS retry_count FROM events)"""


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of an outbox: each third is processed, tries go from 0 to 4."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("aggregate"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"), F.md5("props").alias("content_hash"),
        F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("processed_at"), (F.col("event_id") % 5).cast("int").alias("retry_count"),
    )


@query(f"{_OUTBOX} SELECT id, type, retry_count FROM outbox WHERE processed_at IS NULL AND retry_count < {MOST_TRIES} ORDER BY created_at, id LIMIT 100")
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest rows that wait and may still be tried."""
    rows = outbox(spark, sf_dir).where(F.col("processed_at").isNull() & (F.col("retry_count") < MOST_TRIES))
    return rows.orderBy("created_at", "id").limit(100).select("id", "type", "retry_count")


@query(f"""{_OUTBOX} SELECT aggregate, type, content_hash, min(id) AS id FROM outbox o WHERE id % 10 = 9
    AND NOT EXISTS (SELECT 1 FROM outbox p WHERE p.id % 10 <> 9 AND p.processed_at IS NULL AND p.aggregate = o.aggregate AND p.type = o.type AND p.content_hash = o.content_hash) GROUP BY 1, 2, 3""")
def outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the new rows (ids that end in 9) those whose aggregate, type and hash do not
    wait already, each once."""
    key = ["aggregate", "type", "content_hash"]
    rows = outbox(spark, sf_dir)
    new = rows.where("id % 10 = 9").groupBy(key).agg(F.min("id").alias("id"))
    waiting = rows.where("id % 10 <> 9").where(F.col("processed_at").isNull()).select(key)
    return new.join(waiting, key, "left_anti")


@query(f"""{_OUTBOX}, tried AS (SELECT id, type, retry_count + 1 AS deliveries FROM outbox WHERE processed_at IS NULL)
    SELECT type, CASE WHEN deliveries >= {MOST_TRIES} THEN 'dead' ELSE 'again' END AS goes_to, count(*) AS n, min(deliveries) AS least, max(deliveries) AS most FROM tried GROUP BY 1, 2""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15: failed messages go back with one delivery more, or to the dead letters."""
    tried = outbox(spark, sf_dir).where(F.col("processed_at").isNull()).select("type", (F.col("retry_count") + 1).alias("deliveries"))
    goes_to = F.when(F.col("deliveries") >= MOST_TRIES, "dead").otherwise("again").alias("goes_to")
    return tried.groupBy("type", goes_to).agg(F.count(F.lit(1)).alias("n"), F.min("deliveries").alias("least"), F.max("deliveries").alias("most"))


_SCAN = "SELECT c_custkey, max(o_orderdate) AS last_seen, min(c_mktsegment) AS segment FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"


@query(f"SELECT c_custkey FROM ({_SCAN}) ORDER BY last_seen NULLS FIRST, c_custkey DESC LIMIT 50")
def never_seen_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was never read comes first, then the longest ago; newest keys before older."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return rows.orderBy(F.asc_nulls_first("last_seen"), F.desc("c_custkey")).limit(50).select("c_custkey")


@query("""WITH v AS (SELECT vec_id, vec_id % 4 AS tenant, md5(array_to_string(list_transform(embedding[1:2], lambda x: (x > 0)::INT), '')) AS phash FROM embeddings),
    known AS (SELECT tenant, phash, min(vec_id) AS first FROM v GROUP BY 1, 2)
    SELECT vec_id, CASE WHEN first < vec_id THEN first END AS reuses FROM v JOIN known USING (tenant, phash)""")
def result_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result is taken from the first file of the tenant with the same perceptual hash."""
    signs = F.transform(F.slice("embedding", 1, 2), lambda x: (x > 0).cast("int").cast("string"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 4).alias("tenant"), F.md5(F.array_join(signs, "")).alias("phash"))
    known = rows.groupBy("tenant", "phash").agg(F.min("vec_id").alias("first"))
    return rows.join(known, ["tenant", "phash"], "left").select("vec_id", F.when(F.col("first") < F.col("vec_id"), F.col("first")).alias("reuses"))


_STORE = """WITH held AS (SELECT p_partkey AS object, p_size AS refs FROM part WHERE p_partkey % 2 = 0), bridge AS (SELECT DISTINCT l_partkey AS object, l_orderkey AS owner FROM lineitem WHERE l_orderkey % 10 = 0)"""


@query(f"""{_STORE}, new AS (SELECT object, count(*) AS n FROM bridge GROUP BY 1)
    SELECT object, coalesce(refs, 0) + coalesce(n, 0) AS refs, n IS NOT NULL AND refs IS NULL AS inserted FROM held FULL JOIN new USING (object)""")
def reference_count_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new object is put in with its references, a known one gets them added; a
    bridge row counts once."""
    held = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("object"), F.col("p_size").alias("refs"))
    bridge = table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("object"), F.col("l_orderkey").alias("owner")).distinct()
    both = held.join(bridge.groupBy("object").agg(F.count(F.lit(1)).alias("n")), "object", "full")
    total = (F.coalesce("refs", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long")
    return both.select("object", total.alias("refs"), (F.col("n").isNotNull() & F.col("refs").isNull()).alias("inserted"))


@query("SELECT c_custkey, coalesce(status, 'pending') AS status, coalesce(tries, 0) AS tries FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS tries FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def status_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a status row get one that is pending."""
    known = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"), F.count(F.lit(1)).alias("tries"))
    lacking = table(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left_anti").select("c_custkey", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("tries"))
    return known.join(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", "left_semi").unionByName(lacking)


@query(f"""{_STORE}, used AS (SELECT object, refs, n FROM held LEFT JOIN (SELECT object, count(*) AS n FROM bridge GROUP BY 1) USING (object)),
    seen AS (SELECT l_partkey AS object, max(l_shipdate) AS last_used FROM lineitem GROUP BY 1)
    SELECT object, last_used FROM used LEFT JOIN seen USING (object) WHERE n IS NULL AND refs <= 10 ORDER BY last_used NULLS FIRST, object LIMIT 40""")
def eviction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the objects that may go, those that nothing refers to, least recently used first."""
    held = table(spark, sf_dir, "part").where("p_partkey % 2 = 0 AND p_size <= 10").select(F.col("p_partkey").alias("object"))
    lines = table(spark, sf_dir, "lineitem")
    free = held.join(lines.where("l_orderkey % 10 = 0").select(F.col("l_partkey").alias("object")), "object", "left_anti")
    seen = lines.groupBy(F.col("l_partkey").alias("object")).agg(F.max("l_shipdate").alias("last_used"))
    return free.join(seen, "object", "left").orderBy(F.asc_nulls_first("last_used"), "object").limit(40)


@query("""SELECT o_orderkey, coalesce(r, 0) AS reactions, coalesce(f, 0) AS forwards, coalesce(c, 0) AS replies FROM orders
    LEFT JOIN (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS f, count(*) FILTER (l_returnflag = 'N') AS c FROM lineitem GROUP BY 1) ON o_orderkey = k""")
def counters_from_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post's counters from its children; all three kinds in one aggregation."""
    kinds = {"reactions": "R", "forwards": "A", "replies": "N"}
    children = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.count_if(F.col("l_returnflag") == v).alias(k) for k, v in kinds.items()])
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(children, "o_orderkey", "left")
    return rows.select("o_orderkey", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds])


def exclusive_quantile(ordered: Column, q: float) -> Column:
    """Of a sorted array, the quantile whose positions are those of n + 1 parts."""
    n = F.size(ordered)
    j = F.least(n - 1, F.greatest(F.lit(1), F.floor(q * (n + 1)))).cast("int")
    part = q * (n + 1) - j
    return F.get(ordered, j - 1) * (1 - part) + F.get(ordered, j) * part


@query("""WITH v AS (SELECT user_id, list_sort(list(value)) AS v, avg(value) AS mean, median(value) AS median FROM events GROUP BY 1),
    p AS (SELECT *, least(len(v) - 1, greatest(1, floor(0.95 * (len(v) + 1))))::BIGINT AS j FROM v)
    SELECT user_id, round(mean, 6) AS mean, round(median, 6) AS median, round(CASE WHEN len(v) = 1 THEN v[1] ELSE v[j] * (1 - (0.95 * (len(v) + 1) - j)) + v[j + 1] * (0.95 * (len(v) + 1) - j) END, 6) AS p95 FROM p""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and the 95th percentile by the exclusive method, of a user's values; one value is its own percentile."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"), F.median("value").alias("median"))
    p95 = F.when(F.size("v") == 1, F.get("v", 0)).otherwise(exclusive_quantile(F.col("v"), 0.95))
    return rows.select("user_id", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round(p95, 6).alias("p95"))


@query("SELECT event_id FROM events WHERE abs(hour(ts + INTERVAL 3 HOUR) * 60 + minute(ts + INTERVAL 3 HOUR) - 540) <= 5")
def near_scheduled_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within five minutes of nine o'clock, local time; midnight is not crossed."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Moscow"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").where(F.abs(F.hour(local) * 60 + F.minute(local) - 540) <= 5).select("event_id")


@query("SELECT event_id FROM events WHERE ('0x' || md5(event_id::VARCHAR)[1:8])::BIGINT % 100 < 25")
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: a quarter of the keys, the same in every run."""
    bucket = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, sf_dir, "events").where(bucket < 25).select("event_id")


@query("""WITH w AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM w GROUP BY 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's values in the order in which they first came. A group holds one row a value."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(values, ",").alias("types"))


@query("""WITH m AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}') AS words FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 50),
    w AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM m),
    t AS (SELECT conv_id, word FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min((turn, k))) <= 20),
    d AS (SELECT conv_id, arg_max(lower(text), turn) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY 1)
    SELECT conv_id, round(avg(contains(digest, word)::INT), 6) AS coverage FROM t JOIN d USING (conv_id) GROUP BY 1""")
def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of the 20 most frequent words of the first 50 messages, those seen first among equals, the last message holds."""
    rows = table(spark, sf_dir, "conversations")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("rank <= 50")
    words = first.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))).alias("k", "word"))
    counts = words.groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn", "k")).alias("seen"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "seen"))).where("rank <= 20")
    digest = rows.where("text IS NOT NULL").groupBy("conv_id").agg(F.max_by(F.lower("text"), "turn").alias("digest"))
    return top.join(digest, "conv_id").groupBy("conv_id").agg(F.round(F.avg(F.contains("digest", "word").cast("int")), 6).alias("coverage"))
