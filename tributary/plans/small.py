"""Small functions over documents, events, customers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, plain, scoring, text, values
from ..sources.adapters import table
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_FIRST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_SQUEEZED = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query(rf"""WITH d AS (SELECT doc_id, source, text, {_SQUEEZED.format("text")} AS s FROM documents),
    w AS (SELECT *, list_transform(list_filter(string_split(s, ' '), lambda x: regexp_matches(x, '^\p{{L}}{{5,}}$')), lambda x: lower(x)) AS words,
        list_filter([s[1:{labels.POST}], CASE WHEN length(trim(text)) >= 5 THEN s[1:{labels.DESCRIPTION}] END, trim(source)[1:{labels.SEEN}], lower(s)[1:{labels.PAGE}]], lambda p: coalesce(trim(p), '') <> '') AS parts FROM d),
    k AS (SELECT *, {_FIRST.format("words")} AS once, list_filter(parts, lambda p, i: list_position(list_transform(parts, lambda y: trim(lower(y))), trim(lower(p))) = i) AS own FROM w)
    SELECT doc_id, array_to_string(list_filter(once[1:10], lambda x: x NOT IN ({_STOP})), ',') AS keywords, md5({_SQUEEZED.format("array_to_string(own, ' ')")}) AS embedded,
        CASE WHEN regexp_matches(lower(text), 'мем|meme|lol|хаха|рофл|кринж') THEN 'meme' WHEN length(text) > 500 THEN 'document' WHEN regexp_matches(lower(text), 'скриншот|screenshot') THEN 'screenshot' WHEN length(text) > 50 THEN 'text' ELSE 'other' END AS kind FROM k""")
def post_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what is embedded of a document, its fallback keywords and its type."""
    t = F.col("text")
    embedded = labels.embedding_text(t, t, F.col("source"), F.lower(t), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(labels.fallback_keywords(t), ",").alias("keywords"), F.md5(embedded).alias("embedded"), plain.content_type(t).alias("kind"))


@query("""SELECT event_id, (year(ts) * 100 + month(ts))::INTEGER AS month, round(epoch_us(ts) / 1e6 - 1704067200, 6) AS seconds, '10.' || user_id % 256 || '.' || event_id % 256 || '.0/24' AS network, split_part(event_type || ' x', ' ', 1) AS agent,
    sha256('m|' || event_type || '|' || props) AS params, least(value * (0.8 + 0.4 * ((event_id % 10) / 10.0)), 30.0) AS delay, regexp_extract(props, '\\d+', 0)::INTEGER AS k, length(event_type) > 4 AS truncated FROM events""")
def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an address's network, times, a hash of parameters, a delay, an object in a text, a payload's guard."""
    at, start = F.col("ts").cast("timestamp"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    address = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"), F.lit(".7"))
    fenced = values.json_object(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return table(spark, sf_dir, "events").select(
        "event_id", plain.month_number(at).alias("month"), F.round(plain.seconds_between(start, at), 6).alias("seconds"), plain.anonymous_ip(address).alias("network"), plain.agent_family(F.concat("event_type", F.lit(" x"))).alias("agent"),
        plain.params_hash(F.lit("m"), F.col("event_type"), F.col("props")).alias("params"), plain.retry_delay(F.col("value"), (F.col("event_id") % 10) / 10).alias("delay"),
        F.get_json_object(fenced, "$.k").cast("int").alias("k"), (values.guarded_payload(F.col("event_type"), 4) != F.col("event_type")).alias("truncated"),
    )


@query(r"""WITH b AS (SELECT c_custkey, c_mktsegment, c_name, ('0x' || sha256('exp:' || c_custkey::VARCHAR)[1:8])::BIGINT / 4294967295.0 AS bucket FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey = 2 THEN 'control' WHEN c_custkey = 3 THEN 'b' WHEN bucket < 0.25 THEN 'control' WHEN bucket < 0.5 THEN 'a' WHEN bucket < 1 THEN 'b' ELSE 'control' END AS variant, lower(c_name) AS username,
        trim(replace(lower(c_mktsegment || '_x'), '_', ' ')) AS topic, CASE WHEN length(c_mktsegment) > 6 THEN c_mktsegment[1:6] || '…' ELSE c_mktsegment END AS short, c_mktsegment[1:1] || lower(c_mktsegment[2:]) AS calm FROM b""")
def customer_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variants with an excluded and a forced customer, names, topics and shortened texts."""
    tenant, segment = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    variant = plain.assigned_variant(tenant, scoring.experiment_bucket("exp", tenant), {"control": 1, "a": 1, "b": 2}, "control", {"3": "b"}, ["2"])
    return table(spark, sf_dir, "customer").select(
        "c_custkey", variant.alias("variant"), plain.plain_username(F.concat(F.lit("@"), F.lower("c_name"))).alias("username"), text.normalise_topic(F.concat(segment, F.lit("_x"))).alias("topic"),
        plain.shortened(segment, 6).alias("short"), plain.calm(segment).alias("calm"),
    )
