"""Messages against the history of their group, and what a group's context is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import context, similarity
from ..sources.adapters import MESSAGES_SQL, content, messages
from .registry import query

#: Posts of a window, by id; a channel's posts before it are its history.
WINDOW = 100


@query(f"""WITH p AS (SELECT doc_id AS post_id, source AS channel_id, doc_id // {WINDOW} AS w, text FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY post_id) AS place FROM p),
    b AS (SELECT channel_id, w, min(place) - 1 AS before FROM n GROUP BY 1, 2),
    t AS (SELECT post_id, token, count(*) AS c FROM (SELECT post_id, unnest(regexp_extract_all(lower(text), '{similarity.WORD}')) AS token FROM p) GROUP BY 1, 2),
    q AS (SELECT post_id, sum(c * c)::BIGINT AS norm2 FROM t GROUP BY 1),
    pairs AS (SELECT l.post_id, h.post_id AS matched, h.place FROM n AS l JOIN b USING (channel_id, w) JOIN n AS h ON h.channel_id = l.channel_id AND h.place <= before AND h.place > before - {similarity.HISTORY}),
    d AS (SELECT pairs.post_id, matched, place, sum(x.c * y.c)::BIGINT AS dot FROM pairs JOIN t AS x ON x.post_id = pairs.post_id JOIN t AS y ON y.post_id = matched AND y.token = x.token GROUP BY 1, 2, 3),
    s AS (SELECT d.*, dot / (sqrt(a.norm2) * sqrt(o.norm2)) AS similarity FROM d JOIN q AS a ON a.post_id = d.post_id JOIN q AS o ON o.post_id = matched)
    SELECT post_id, matched AS matched_id, round(similarity, 4) AS similarity FROM s WHERE similarity >= {similarity.SOFT}
    QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY similarity >= {similarity.HARD} DESC, place DESC) = 1""")
def historical_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every post against the last 256 of its channel before its window of ids."""
    rows = content(spark, sf_dir).withColumn("w", F.floor(F.col("post_id") / WINDOW))
    return similarity.historical_matches(rows, "channel_id", "w", "post_id", "content", [F.col("post_id")])


#: Turns of conversations as messages with media: as many as turn % 3, of three kinds, some without a description.
_MEDIA_SQL = f"""{MESSAGES_SQL}, media AS (SELECT group_id, turn AS id, username, posted_at, i, (turn + i) % 3 AS nth, CASE (turn + i) % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'document' ELSE 'audio' END AS kind,
        CASE WHEN i = 1 THEN content[1:10] WHEN (turn + i) % 3 = 1 THEN 'l1, l2' ELSE 'Image' || '{context.NO_CAPTION}' END AS said FROM messages, (SELECT unnest([1, 2]) AS i) WHERE i <= turn % 3),
    m AS (SELECT *, CASE WHEN i > 1 AND nth = 2 THEN 'Audio{context.NO_CAPTION}' ELSE said END AS description FROM media)"""


def _with_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(i: Column) -> Column:
        nth = (F.col("turn") + i) % 3
        none = F.lit(None).cast("string")
        return F.struct(
            none.alias("id"), F.when(nth == 0, "image").alias("kind"), F.when(nth == 1, "application/pdf").alias("mime_type"), F.when(nth == 2, "voice:7").alias("hint"),
            F.when(i == 1, F.substring("content", 1, 10)).alias("description"), F.when(nth == 1, F.array(F.lit("l1"), F.lit("l2"))).alias("labels"), none.alias("ocr_text"),
        )

    rows = messages(spark, sf_dir).withColumnRenamed("turn", "id").withColumn("turn", F.col("id"))
    return context.enriched(rows.withColumn("media", F.when(F.col("turn") % 3 > 0, F.transform(F.sequence(F.lit(1), F.col("turn") % 3), one))))


@query(f"""WITH {_MEDIA_SQL}, c AS (SELECT group_id, username, count(*) AS message_count, sum(turn % 3)::BIGINT AS media_count FROM messages GROUP BY 1, 2),
    s AS (SELECT group_id, username, string_agg(description, ' | ' ORDER BY k) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY group_id, username ORDER BY posted_at, id, i) AS k FROM m) WHERE k <= {context.SAMPLES} GROUP BY 1, 2),
    k AS (SELECT group_id, username, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT group_id, username, kind, count(*) AS n FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT c.*, coalesce(kinds, '') AS kinds, coalesce(samples, '') AS samples FROM c LEFT JOIN s USING (group_id, username) LEFT JOIN k USING (group_id, username)""")
def context_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, media by kind and samples of every participant."""
    found = context.participant_stats(_with_media(spark, sf_dir))
    kinds = F.array_join(F.transform(F.map_entries("media_kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.select("group_id", "username", "message_count", "media_count", kinds.alias("kinds"), F.array_join("media_samples", " | ").alias("samples"))


@query(f"""WITH {_MEDIA_SQL}, k AS (SELECT group_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT group_id, kind, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
    h AS (SELECT group_id, string_agg(kind || ': ' || description, '; ' ORDER BY k) AS highlights FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY id % 4 DESC, posted_at DESC, id, i) AS k FROM m) WHERE k <= {context.HIGHLIGHTS} GROUP BY 1)
    SELECT c.group_id, media_total, media_messages, coalesce(kinds, '') AS kinds, coalesce(highlights, '') AS highlights
    FROM (SELECT group_id, sum(turn % 3)::BIGINT AS media_total, count(*) FILTER (turn % 3 > 0) AS media_messages FROM messages GROUP BY 1) c LEFT JOIN k USING (group_id) LEFT JOIN h USING (group_id)""")
def context_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media of every group, by kind, and its highlights."""
    rows = _with_media(spark, sf_dir)
    best = context.media_highlights(rows.withColumn("score", F.col("id") % 4))
    said = best.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("kind", F.lit(": "), "description").alias("s")))), lambda x: x["s"]), "; ").alias("highlights"))
    kinds = F.array_join(F.transform(F.map_entries("media_kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return context.media_stats(rows).join(said, "group_id", "left").select("group_id", "media_total", "media_messages", kinds.alias("kinds"), F.coalesce("highlights", F.lit("")).alias("highlights"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""WITH {MESSAGES_SQL}, t AS (SELECT group_id, turn, username, content, list_filter(regexp_extract_all(lower(content), '{text.TOKEN}'), lambda x: length(x) > 3 AND x NOT IN ({_STOP})) AS words FROM messages),
    w AS (SELECT group_id, turn, unnest(words) AS keyword, generate_subscripts(words, 1) AS k FROM t),
    c AS (SELECT group_id, keyword, count(*) AS n, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min((turn, k))) AS rank FROM w GROUP BY 1, 2 QUALIFY rank <= {context.TOPICS} AND (n >= 2 OR rank = 1)),
    m AS (SELECT c.*, t.turn, t.username, t.content, row_number() OVER (PARTITION BY c.group_id, keyword ORDER BY t.turn) AS place FROM c JOIN t ON t.group_id = c.group_id AND list_contains(words, keyword) QUALIFY place <= {context.MATCHED}),
    o AS (SELECT group_id, keyword, string_agg(username, ', ' ORDER BY n DESC, place) AS owners FROM (SELECT group_id, keyword, username, count(*) AS n, min(place) AS place FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT m.group_id, rank, m.keyword, CASE WHEN rank = 1 THEN 'high' ELSE 'medium' END AS priority, count(*) AS msg_count, trim(string_agg(content[1:{context.DESCRIPTION}], ' ' ORDER BY place) FILTER (place <= {context.SUMMARY}), ' ') AS summary, any_value(owners) AS owners
    FROM m JOIN o ON o.group_id = m.group_id AND o.keyword = m.keyword GROUP BY 1, 2, 3""")
def context_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of every group, how many messages have them, a summary and owners."""
    rows = messages(spark, sf_dir).withColumnRenamed("turn", "id")
    return context.keyword_topics(rows).drop("title", "media_refs")
