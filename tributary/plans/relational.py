"""Filters, joins, aggregates, windows, top-k and sets over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import access, windows
from ..sources.adapters import POSTS_SQL, posts, table
from .registry import query

def rows_() -> Column:
    return F.count(F.lit(1))


@query("SELECT nation.n_name AS name, region.r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def renamed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with other column names."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query(f"WITH {POSTS_SQL} SELECT topic, count(*) AS n FROM posts WHERE posted_at >= (SELECT max(posted_at) FROM posts) - INTERVAL 7 DAY GROUP BY topic")
def recency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the last window; now is the last post."""
    rows = posts(spark, sf_dir)
    since = rows.agg((F.max("posted_at") - F.lit(access.parse_window("7d"))).alias("since"))
    return rows.join(F.broadcast(since), F.col("posted_at") >= F.col("since")).groupBy("topic").agg(rows_().alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def optional_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates that are given, and a semi join for IN."""
    rows = access.where_given(table(spark, sf_dir, "orders"), status=F.col("o_orderstatus") == "O", price=F.col("o_totalprice") >= 100_000, date=None)
    members = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return rows.join(members, "o_custkey", "left_semi").agg(rows_().alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT (json_extract_string(props, '$.k')::INT % 10)::INT AS k10, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE json_extract_string(props, '$.k')::INT >= 50 GROUP BY 1")
def json_props_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed predicate and a group on a JSON key."""
    rows = table(spark, sf_dir, "events").select("value", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 50")
    return rows.groupBy((F.col("k") % 10).alias("k10")).agg(rows_().alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%'")
def search_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in any of three columns, whatever its case."""
    return table(spark, sf_dir, "part").where(access.any_ilike(["p_name", "p_brand", "p_type"], "ring")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%rights%'")
def any_word_of_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any word of a topic."""
    words = "license rights".split()
    hit = F.col("text").ilike(f"%{words[0]}%")
    for w in words[1:]:
        hit = hit | F.col("text").ilike(f"%{w}%")
    return table(spark, sf_dir, "documents").where(hit).select("doc_id")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'revoked' WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'expired' ELSE 'active' END AS state, count(*) AS n FROM orders GROUP BY 1""")
def tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state from two columns, and its counts."""
    state = F.when(F.col("o_orderstatus") == "F", "revoked").when(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"), "expired").otherwise("active")
    return table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(rows_().alias("n"))


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 2, 3) AND vec_id >= 10 AND vec_id <= 400")
def payload_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: any-of and a range on a vector's payload."""
    return table(spark, sf_dir, "embeddings").where(access.payload_filter({"label": [1, 2, 3], "vec_id": {"range": {"gte": 10, "lte": 400}}})).select("vec_id")


@query(f"""WITH {POSTS_SQL}, l AS (SELECT channel_id, arg_max(value, (posted_at, post_id)) AS value, count(*) AS n FROM posts GROUP BY 1) SELECT channel_id, value, n FROM l WHERE n >= 30 AND value >= 1.5""")
def stable_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds on the latest metrics of a key."""
    last = posts(spark, sf_dir).groupBy("channel_id").agg(F.max_by("value", F.struct("posted_at", "post_id")).alias("value"), rows_().alias("n"))
    return last.where("n >= 30 AND value >= 1.5")


@query("""SELECT c_nationkey, count(o_orderkey) AS n_orders, greatest(0, CASE WHEN c_nationkey % 4 = 0 THEN 3000 WHEN c_nationkey % 4 = 1 THEN 500 WHEN c_nationkey % 4 = 2 THEN 50 ELSE 3 END - count(o_orderkey)) AS remaining
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey""")
def tier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tier's limit leaves."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    counts = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_nationkey").agg(F.count("o_orderkey").alias("n_orders"))
    k = F.col("c_nationkey") % 4
    limit = F.when(k == 0, 3000).when(k == 1, 500).when(k == 2, 50).otherwise(3)
    return counts.withColumn("remaining", F.greatest(F.lit(0).cast("long"), limit - F.col("n_orders")))


@query(f"""WITH {POSTS_SQL}, l AS (SELECT channel_id, max(posted_at) AS last, CASE WHEN channel_id % 3 = 0 THEN 3600 WHEN channel_id % 3 = 1 THEN 86400 ELSE 10800 END AS every FROM posts GROUP BY 1), now AS (SELECT max(posted_at) AS t FROM posts)
    SELECT channel_id, epoch_us(t) - epoch_us(last) >= every::BIGINT * 1000000 AS due FROM l, now""")
def subscription_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a subscription's time since its last message is up."""
    rows = posts(spark, sf_dir)
    every = F.when(F.col("channel_id") % 3 == 0, 3600).when(F.col("channel_id") % 3 == 1, 86_400).otherwise(10_800)
    last = rows.groupBy("channel_id").agg(F.max("posted_at").alias("last")).crossJoin(F.broadcast(rows.agg(F.max("posted_at").alias("now"))))
    return last.select("channel_id", (F.unix_micros("now") - F.unix_micros("last") >= every.cast("long") * 1_000_000).alias("due"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END), ''), nullif(c_mktsegment, ''), 'Untitled') AS title, coalesce(nullif(c_acctbal, 0), -1.0) AS score FROM customer""")
def card_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that is not blank or zero."""
    name = F.when(F.col("c_custkey") % 5 == 0, "  ").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif("c_mktsegment", F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(F.nullif("c_acctbal", F.lit(0.0)), F.lit(-1.0)).alias("score"),
    )


@query("""SELECT DISTINCT n_name, c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_quantity >= 49 AND n_regionkey = 1""")
def inner_chain_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tables, one tenant, distinct after."""
    l, o, c, n = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "nation"))
    tenant = c.join(F.broadcast(n.where("n_regionkey = 1")), c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    found = l.where("l_quantity >= 49").select("l_orderkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return found.join(tenant, F.col("o_custkey") == F.col("c_custkey")).select("n_name", "c_custkey").distinct()


@query("""SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1""")
def left_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind's predicate is part of the join, not of a filter after it."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(good, "doc_id", "left")


_KINDS = "kinds AS (SELECT user_id, event_type AS kind, max(value) AS value FROM events GROUP BY 1, 2)"


@query(f"""WITH {_KINDS} SELECT user_id, max(value) FILTER (kind = 'view') AS v_view, max(value) FILTER (kind = 'click') AS v_click, max(value) FILTER (kind = 'purchase') AS v_purchase FROM kinds GROUP BY 1""")
def pivot_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pivot in place of three self-joins."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))
    return rows.select("user_id", *[F.col(k).alias(f"v_{k}") for k in ("view", "click", "purchase")])


@query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(l_linenumber) AS n_items FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def star_left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are counted by order first, so that nothing fans out."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows_().alias("items"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(items, "o_orderkey", "left")
    per = o.groupBy("c_custkey").agg(rows_().alias("n_orders"), F.sum("items").alias("n_items"))
    none = F.lit(0).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", none).alias("n_orders"), F.coalesce("n_items", none).alias("n_items"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J07, U09, U11."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation))")
def semi_join_rls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the session's tenant may see."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    first = n.agg(F.min("n_name").alias("n_name"))
    members = c.join(F.broadcast(n.join(first, "n_name")), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("o_custkey"))
    return access.visible(table(spark, sf_dir, "orders"), members, "o_custkey").select("o_orderkey")


@query("""SELECT a.o_custkey, count(*) AS n FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate < a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey < a.o_orderkey))) GROUP BY 1""")
def later_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an earlier one of the same key, by a window in place of an inequality join."""
    rows = windows.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return rows.where("rank > 1").groupBy("o_custkey").agg(rows_().alias("n"))


@query("""WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new FROM part)
    SELECT coalesce(new, l_partkey) AS part, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem LEFT JOIN m ON l_partkey = old GROUP BY 1""")
def key_remap_update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are replaced by the oldest of their kind."""
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.min("p_partkey").over(Window.partitionBy("p_name", "p_brand")).alias("new"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(m, "l_partkey", "left")
    return rows.groupBy(F.coalesce("new", "l_partkey").alias("part")).agg(rows_().alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT c_custkey, (SELECT arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer""")
def correlated_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar subquery as an aggregate and a left join."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS reply, CASE WHEN l_linenumber % 2 = 0 THEN 'Supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') ELSE l_suppkey::VARCHAR END AS ref FROM lineitem)
    SELECT reply, s_suppkey AS target FROM f JOIN supplier ON ref = s_name OR ref = s_suppkey::VARCHAR""")
def reply_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference is a name or a number: two equi joins, not one with OR."""
    padded = F.concat(F.lit("Supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    ref = F.when(F.col("l_linenumber") % 2 == 0, padded).otherwise(F.col("l_suppkey").cast("string"))
    f = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("reply"), ref.alias("ref"))
    s = table(spark, sf_dir, "supplier")
    either = s.select(F.col("s_name").alias("ref"), F.col("s_suppkey").alias("target")).unionByName(s.select(F.col("s_suppkey").cast("string").alias("ref"), F.col("s_suppkey").alias("target")))
    return f.join(either, "ref").select("reply", "target")


@query("""SELECT e.event_id, coalesce(l.quality, -1) AS quality, coalesce(nullif(e.event_type, 'error'), d.lang, 'none') AS kind FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN labels l ON l.doc_id = e.event_id""")
def event_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event's fields win, the stored row fills in."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "lang")
    l = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality")
    return e.join(d, "event_id", "left").join(l, "event_id", "left").select("event_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce(F.nullif("event_type", F.lit("error")), "lang", F.lit("none")).alias("kind"))


@query("""SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50""")
def tenant_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20, T01, S14."""
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return access.page(rows, 2, 50, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "c_name")


@query("""WITH t AS (SELECT p_brand AS trend, l_suppkey AS channel FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size >= 45 AND l_quantity >= 48), sent AS (SELECT DISTINCT p_brand AS trend, c_custkey FROM part JOIN customer ON p_partkey = c_custkey)
    SELECT DISTINCT trend, c_custkey FROM t JOIN supplier ON channel = s_suppkey JOIN customer ON c_nationkey = s_nationkey WHERE (trend, c_custkey) NOT IN (SELECT trend, c_custkey FROM sent)""")
def alert_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends to the subscribers of their channels, without alerts already sent."""
    p, c, s = (table(spark, sf_dir, x) for x in ("part", "customer", "supplier"))
    l = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select("l_partkey", "l_suppkey")
    t = l.join(p.where("p_size >= 45"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    # Trends of a nation are one list, and so are those of a customer: what is many goes by customer, never by nation.
    nations = t.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.collect_set("p_brand").alias("trends"))
    due = c.select("c_nationkey", "c_custkey").distinct().join(F.broadcast(nations), "c_nationkey").groupBy("c_custkey").agg(F.array_distinct(F.flatten(F.collect_list("trends"))).alias("trends"))
    sent = p.join(c, p.p_partkey == c.c_custkey).groupBy("c_custkey").agg(F.collect_set("p_brand").alias("sent"))
    left = F.when(F.col("sent").isNull(), F.col("trends")).otherwise(F.array_except("trends", "sent"))
    return due.join(sent, "c_custkey", "left").select(F.explode(left).alias("trend"), "c_custkey")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_high, count(CASE WHEN value <= 1 THEN 1 END) AS n_low, min(ts) FILTER (value > 100) AS first_high, round(avg(value) FILTER (value > 50), 6) AS mean_high, round(avg(epoch_us(ts) % 1000000 / 1000.0), 3) AS mean_ms FROM events GROUP BY 1""")
def conditional_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A02, A03, A04."""
    high = F.col("value") > 50
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        rows_().alias("n"), F.count_if(high).alias("n_high"), F.count_if(F.col("value") <= 1).alias("n_low"), F.min(F.when(F.col("value") > 100, F.col("ts"))).alias("first_high"),
        F.round(F.avg(F.when(high, F.col("value"))), 6).alias("mean_high"), F.round(F.avg(micros % 1_000_000 / 1000), 3).alias("mean_ms"),
    )


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey::VARCHAR || ':' || o_orderpriority) AS pairs FROM orders GROUP BY 1")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A07, A08."""
    pair = F.concat_ws(":", F.col("o_custkey").cast("string"), "o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(rows_().alias("n"), F.countDistinct("o_custkey").alias("customers"), F.countDistinct(pair).alias("pairs"))


@query("SELECT text, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents have, and the oldest."""
    return table(spark, sf_dir, "documents").groupBy("text").agg(rows_().alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1")
def ordered_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of an order by position."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda x: x["l_partkey"].cast("string")), ",").alias("items"))


@query("SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IN ('ECONOMY', 'SMALL', 'LARGE') GROUP BY 1 HAVING count(DISTINCT p_type) = 3")
def relational_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have all of the types."""
    p = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "SMALL", "LARGE")).select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")
    return rows.groupBy("l_orderkey").agg(F.countDistinct("p_type").alias("n")).where("n = 3").select("l_orderkey")


@query("SELECT o_orderkey, count(l_linenumber) AS actual, coalesce(max(l_linenumber), 0)::BIGINT AS expected FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_linenumber) <> coalesce(max(l_linenumber), 0)")
def expected_against_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows_().alias("actual"), F.max("l_linenumber").cast("long").alias("expected"))
    zero = F.lit(0).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("actual", zero).alias("actual"), F.coalesce("expected", zero).alias("expected")).where("actual <> expected")


@query("SELECT l_returnflag AS kind, l_suppkey AS tenant, count(*) AS n, round(sum(l_extendedprice) / 1073741824, 9) AS gb FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_suppkey))")
def storage_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by type, and by type and tenant."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("tenant")).agg(rows_().alias("n"), F.sum("l_extendedprice").alias("bytes"))
    whole = rows.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn("tenant", F.lit(None).cast("long"))
    return rows.unionByName(whole).select("kind", "tenant", "n", F.round(F.col("bytes") / 2**30, 9).alias("gb"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
    SELECT user_id, event_type, count(*) AS n FROM r WHERE k <= 100 GROUP BY 1, 2""")
def interaction_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of a user's last hundred interactions."""
    rows = windows.ranked(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).where("rank <= 100")
    return rows.groupBy("user_id", "event_type").agg(rows_().alias("n"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def union_of_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28, D01."""
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), rows_().alias("n")) for t in ("orders", "customer", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT avg((quality = 1)::INT) AS success_rate, count(*) FILTER (quality = 0 AND toxic = 1) AS both_bad, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic FROM labels""")
def batch_decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A success rate and counts by reason."""
    q, t = F.col("quality") == 0, F.col("toxic") == 1
    return table(spark, sf_dir, "labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("success_rate"), F.count_if(q & t).alias("both_bad"), F.count_if(q).alias("low"), F.count_if(t).alias("toxic"))


@query("""SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS last_day, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS low, max(value) AS high FROM events""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the table."""
    rows = table(spark, sf_dir, "events")
    last = rows.agg(F.max("ts").alias("last"))
    recent = F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 DAY")
    return rows.crossJoin(F.broadcast(last)).agg(rows_().alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(recent).alias("last_day"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W03, W04."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("x")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "x.*")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def keep_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W06, W02, S21."""
    return windows.ranked(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], F.desc("ts"), F.desc("event_id")).where("rank <= 5").select("user_id", "event_id")


@query("""WITH g AS (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS album FROM lineitem)
    SELECT album, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM g QUALIFY album IS NULL OR row_number() OVER (PARTITION BY album ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1""")
def album_best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group; rows without a group all stay."""
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey")).alias("album"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return windows.best_of_group(rows, "album", F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"))


@query("""WITH b AS (SELECT p_brand, p_partkey, p_retailprice, coalesce(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part)
    SELECT p_brand, p_partkey FROM b WHERE before < 9000""")
def greedy_prefix_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evict in order until enough is free."""
    priority = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    return windows.greedy_prefix(table(spark, sf_dir, "part"), "p_retailprice", 9000, priority, F.col("p_size"), F.col("p_partkey"), within=["p_brand"]).select("p_brand", "p_partkey")


@query("""WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k FROM lineitem)
    SELECT l_orderkey, sum(l_quantity * CASE k WHEN 1 THEN 3.0 WHEN 2 THEN 2.5 WHEN 3 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weighted FROM r GROUP BY 1""")
def position_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W08, A17."""
    rows = windows.ranked(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity"), name="k")
    weight = F.when(F.col("k") == 1, 3.0).when(F.col("k") == 2, 2.5).when(F.col("k") == 3, 2.0).otherwise(1.0)
    return rows.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * weight).alias("weighted"))


@query("SELECT c_custkey, floor(greatest(c_acctbal, 0) / max(c_acctbal) OVER (PARTITION BY c_mktsegment) * 100)::BIGINT AS popularity FROM customer")
def relative_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    share = F.greatest("c_acctbal", F.lit(0.0)) / F.max("c_acctbal").over(Window.partitionBy("c_mktsegment")) * 100
    return table(spark, sf_dir, "customer").select("c_custkey", F.floor(share).cast("long").alias("popularity"))


@query("""SELECT c_custkey, round(sum(o_totalprice), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY spent DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 10""")
def pagination_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, T02."""
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(spent, "c_custkey", "left")
    return rows.orderBy(F.col("s").desc_nulls_last(), "c_custkey").offset(10).limit(20).select("c_custkey", F.col("s").alias("spent"))


@query("""WITH page AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40) SELECT p_partkey FROM page WHERE p_size >= 20 ORDER BY p_retailprice DESC, p_partkey LIMIT 20""")
def over_fetch_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the page is fetched before the filter, as the semantics say."""
    order = (F.desc("p_retailprice"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").orderBy(*order).limit(40).where("p_size >= 20").orderBy(*order).limit(20).select("p_partkey")


@query("""WITH stable AS (SELECT p_partkey FROM part WHERE p_size > 1000), emerging AS (SELECT p_partkey FROM part WHERE p_size >= 45)
    SELECT * FROM stable UNION ALL SELECT * FROM emerging WHERE NOT EXISTS (SELECT 1 FROM stable)""")
def stable_or_emerging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second list where the first is empty."""
    rows = table(spark, sf_dir, "part")
    stable = rows.where("p_size > 1000").select("p_partkey")
    none = stable.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return stable.unionByName(rows.where("p_size >= 45").select("p_partkey").join(F.broadcast(none), how="cross").drop("n"))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
    SELECT o_custkey, o_orderkey FROM n WHERE n <= 2 OR (o_totalprice >= 10240 AND k <= 2)""")
def sample_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of two or fewer; else the two largest that are not too small."""
    rows = windows.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"), name="k").withColumn("n", rows_().over(Window.partitionBy("o_custkey")))
    return rows.where("n <= 2 OR (o_totalprice >= 10240 AND k <= 2)").select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT source, list(DISTINCT lang) AS l, max(n_chars) AS longest FROM documents GROUP BY 1)
    SELECT source, list_sort(list_filter(['en', 'fr', 'it'], lambda x: list_contains(l, x)))::VARCHAR AS kept, len(list_filter(l, lambda x: x NOT IN ('en', 'fr'))) AS added, longest FROM a""")
def title_overlap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a baseline and the present have in common, and what is new."""
    base = F.array(*[F.lit(x) for x in ("en", "fr", "it")])
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"), F.max("n_chars").alias("longest"))
    kept = F.array_sort(F.array_intersect("l", base))
    added = F.size(F.array_except("l", F.array(F.lit("en"), F.lit("fr")))).cast("long")
    return rows.select("source", F.concat(F.lit("["), F.array_join(kept, ", "), F.lit("]")).alias("kept"), added.alias("added"), "longest")


@query("SELECT c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def keep_first_after_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each key after a sort."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(rows, "c_custkey")


@query(f"""WITH {POSTS_SQL} SELECT channel_id, time_bucket(INTERVAL 1 HOUR, posted_at) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM posts GROUP BY 1, 2""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the inventory: tumbling windows of an hour."""
    rows = posts(spark, sf_dir).groupBy("channel_id", F.window("posted_at", "1 hour").alias("w")).agg(rows_().alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select("channel_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")


@query("SELECT n_regionkey AS region, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)")
def segment_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the inventory: a cube."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("segment")).agg(rows_().alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
