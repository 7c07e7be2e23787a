"""Operators that carry a state: albums, breakers, budgets, deferred work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import automaton, budgets
from ..sources.adapters import table
from ..sources.shared import shared_dir
from ..streaming import albums, jobs
from ..streaming.deferred import DeferredQueue
from .registry import query

#: The given orders are years long: a state lives so many hours.
_TTL_HOURS = 9_606


def _album_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as albums, with one to three posts expected, and lineitem as analysed posts, as one stream."""
    read = lambda name: jobs.read_new(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, jobs.ALL_FILES)
    nothing = lambda kind: F.lit(None).cast(kind)
    opened = read("orders").select(
        F.col("o_orderkey").alias("album"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit("album").alias("kind"), nothing("long").alias("post"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("expected"), nothing("string").alias("description"), nothing("array<string>").alias("labels"),
        nothing("boolean").alias("is_meme"), nothing("boolean").alias("has_text"),
    )
    analysed = read("lineitem").select(
        F.col("l_orderkey").alias("album"), F.col("l_shipdate").cast("timestamp").alias("at"), F.lit("analysis").alias("kind"), F.col("l_linenumber").cast("long").alias("post"),
        nothing("int").alias("expected"), F.concat(F.lit(" part "), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("description"), F.array(F.col("l_returnflag"), F.concat(F.lit(" "), F.lower("l_linestatus"))).alias("labels"),
        (F.col("l_quantity") > 45).alias("is_meme"), (F.col("l_discount") > 0.05).alias("has_text"),
    )
    return opened.unionByName(analysed).withWatermark("at", "0 seconds")


@query(f"""WITH e AS (SELECT l_orderkey AS album, l_shipdate AS t, l_linenumber AS post, 'part ' || lpad(l_partkey::VARCHAR, 9, '0') AS description, o_orderdate AS created, o_orderkey % 3 + 1 AS expected,
        row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, lpad(l_partkey::VARCHAR, 9, '0')) AS nth FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate),
    f AS (SELECT *, row_number() OVER w AS k, t - coalesce(lag(t) OVER w, created) >= INTERVAL {_TTL_HOURS} HOUR AS broken FROM e WHERE nth = 1 WINDOW w AS (PARTITION BY album ORDER BY t, post)),
    g AS (SELECT *, row_number() OVER (PARTITION BY album, description ORDER BY k) = 1 AS fresh FROM (SELECT *, bool_or(broken) OVER (PARTITION BY album ORDER BY k) AS lost FROM f) WHERE NOT lost AND k <= expected),
    a AS (SELECT o_orderkey AS album, o_orderkey % 3 + 1 AS expected, o_orderdate AS created, count(k) AS analysed, max(t) AS last_at, min(t) AS first_at, string_agg(description, ' | ' ORDER BY k) FILTER (fresh) AS summary
        FROM orders LEFT JOIN g ON album = o_orderkey GROUP BY ALL),
    w AS (SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS now)
    SELECT album, CASE WHEN analysed = expected THEN 'assembled' ELSE 'expired' END AS status, expected::INTEGER AS expected, analysed::INTEGER AS analysed,
        CASE WHEN analysed = expected THEN last_at ELSE coalesce(last_at, created) + INTERVAL {_TTL_HOURS} HOUR END AS "at", coalesce(date_diff('second', first_at, last_at), 0)::BIGINT AS lag_seconds, summary
    FROM a, w WHERE analysed = expected OR coalesce(last_at, created) + INTERVAL {_TTL_HOURS} HOUR < now""")
def stream_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06, A17: albums as a stream with state, each post counted once, and expiry."""
    found = jobs.drain(albums.assemble(_album_events(spark, sf_dir), _TTL_HOURS * 3600), settings=jobs.ROCKS)
    lag = F.coalesce(F.unix_seconds("last_at") - F.unix_seconds("first_at"), F.lit(0).cast("long"))
    return found.select("album", "status", "expected", "analysed", F.col("at").cast("timestamp_ntz").alias("at"), lag.alias("lag_seconds"), albums.vision_summary(F.col("items"))["summary"].alias("summary"))


#: Services are users modulo this; a breaker of the given events opens at two failures, for an hour.
_SERVICES, _FAILURES, _RECOVERY = 20, 2, 3600


@query(f"""WITH RECURSIVE e AS (SELECT user_id % {_SERVICES} AS service, event_id, epoch_us(ts) // 1000000 AS t, CASE WHEN event_type IN ('error', 'signup') THEN 1 WHEN event_type = 'click' AND value > 60 THEN 2 ELSE 0 END AS x,
        row_number() OVER (PARTITION BY user_id % {_SERVICES} ORDER BY epoch_us(ts) // 1000000, event_id) AS k FROM events),
    r(service, k, event_id, state, c, opened, said) AS (
        SELECT DISTINCT service, 0::BIGINT, NULL::BIGINT, 'closed', 0, 0::BIGINT, '' FROM e
        UNION ALL SELECT service, k, event_id,
            CASE WHEN before = 'open' THEN 'open' WHEN x = 0 THEN 'closed' WHEN x = 2 THEN before WHEN before = 'half_open' OR c + 1 >= {_FAILURES} THEN 'open' ELSE 'closed' END,
            CASE WHEN before = 'open' THEN c WHEN x = 0 THEN 0 WHEN x = 2 THEN c ELSE c + 1 END,
            CASE WHEN before <> 'open' AND x = 1 THEN t ELSE opened END,
            CASE WHEN before = 'open' THEN 'rejected' WHEN x = 0 THEN 'success' ELSE 'failure' END
        FROM (SELECT e.service, e.k, e.event_id, e.x, e.t, r.c, r.opened, CASE WHEN r.state = 'open' AND e.t - r.opened >= {_RECOVERY} THEN 'half_open' ELSE r.state END AS before
            FROM r JOIN e ON e.service = r.service AND e.k = r.k + 1))
    SELECT service, event_id, said, state FROM r WHERE k > 0""")
def circuit_breakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10: what the breaker of a service says to every call, and its state after it."""
    kind = F.when(F.col("event_type").isin("error", "signup"), automaton.FAILURE).when((F.col("event_type") == "click") & (F.col("value") > 60), automaton.UNEXPECTED).otherwise(automaton.SUCCESS)
    calls = table(spark, sf_dir, "events").select((F.col("user_id") % _SERVICES).alias("service"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), "event_id", kind.alias("kind"))
    found = automaton.scan(calls, "service", "second", "event_id", "kind", automaton.circuit_breaker(_FAILURES, _RECOVERY), block_seconds=86_400)
    said = F.element_at(F.array(*[F.lit(x) for x in automaton.SAID]), F.col("said") + 1)
    return found.select(F.col("key").alias("service"), F.col("id").alias("event_id"), said.alias("said"), automaton.breaker_state(F.col("state"), _FAILURES, _RECOVERY).alias("state"))


#: Calls and tokens that a user has in a rolling window, in hours.
_LIMIT, _BUDGET, _WINDOW_HOURS = 3, 120, 48


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("tenant"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.floor("value").cast("long").alias("tokens"))


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, floor(value)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r(user_id, k, event_id, held, allowed) AS (
        SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::STRUCT(t BIGINT, n BIGINT)[], false FROM e
        UNION ALL SELECT user_id, k, event_id, CASE WHEN ok THEN list_append(live, {{'t': t, 'n': n}}) ELSE live END, ok
        FROM (SELECT *, len(live) < {_LIMIT} AND coalesce(list_sum(list_transform(live, lambda x: x.n)), 0) + n <= {_BUDGET} AS ok
            FROM (SELECT e.user_id, e.k, e.event_id, e.t, e.n, list_filter(r.held, lambda x: e.t - x.t <= {_WINDOW_HOURS * 3_600_000_000}) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
    SELECT user_id, event_id, allowed FROM r WHERE k > 0""")
def rolling_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST08: a rolling quota of calls and of tokens; what is refused is not counted."""
    found = budgets.rolling_budget(_calls(spark, sf_dir), "tenant", "micros", "id", "tokens", _LIMIT, _BUDGET, _WINDOW_HOURS * 3600)
    return found.select(F.col("tenant").alias("user_id"), F.col("id").alias("event_id"), "allowed")


@query()
def deferred_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST21: events in batches of ten days; what is over the rolling budget waits for a later batch."""
    calls = _calls(spark, sf_dir)
    queue = DeferredQueue(f"{shared_dir(spark)}/deferred-{uuid.uuid4().hex}", _LIMIT, _BUDGET, _WINDOW_HOURS * 3600, 86_400, 3)
    first, last = calls.agg(F.min("micros"), F.max("micros")).first()
    step = 10 * 86_400_000_000
    epochs = 0 if first is None else (last - first) // step + 1
    for epoch in range(epochs):
        queue(calls.where(F.col("micros").between(first + epoch * step, first + (epoch + 1) * step - 1)), epoch)
    if not epochs:
        return calls.select("tenant", "id", F.lit(0).alias("retries"), F.col("micros").alias("taken_at"), F.lit("").alias("status"))
    done = [queue.accepted(spark).withColumn("status", F.lit("accepted")), queue.given_up(spark).withColumn("status", F.lit("given up"))]
    left = queue.decided(spark, epochs - 1).where("status = 'waiting'")
    return done[0].unionByName(done[1]).drop("epoch").unionByName(left).select("tenant", "id", "retries", "taken_at", "status")
