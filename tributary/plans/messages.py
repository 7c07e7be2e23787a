"""Nested messages, replies and the edges between what they name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..operators import edges, replies
from ..sources.adapters import MESSAGES_SQL, messages, posts, table
from .registry import query

#: Each turn but the first replies to the one at half its number.
_PARENT = "CASE WHEN turn > 0 THEN (turn - 1) // 2 END"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as nested messages: replies, forwards of every third turn, reactions by its number, and a mention."""
    rows = messages(spark, sf_dir)
    when = lambda test, value: F.when(test, value)
    peer = F.struct(F.col("group_id").alias("channel_id"))
    reply = when(F.col("turn") > 0, F.struct(F.floor((F.col("turn") - 1) / 2).alias("reply_to_msg_id"), peer.alias("reply_to_peer_id")))
    forward = when(F.col("turn") % 3 == 2, F.struct((F.col("turn") + 100).alias("channel_post"), peer.alias("from_id"), F.col("username").alias("from_name"), F.lit("2025-01-01T00:00:00+00:00").alias("date")))
    reactions = F.transform(F.sequence(F.lit(1), F.col("turn") % 3 + 1), lambda k: F.struct(F.struct(k.alias("document_id")).alias("reaction"), (k == 2).alias("chosen"), F.struct((F.col("group_id") + k).alias("user_id")).alias("peer_id")))
    mention = F.array(F.struct(F.lit("MessageEntityMention").alias("type"), F.lit(3).alias("offset"), F.lit(4).alias("length")))
    message = F.struct(F.col("content").alias("message"), reply.alias("reply_to"), forward.alias("fwd_from"), F.struct(reactions.alias("results")).alias("reactions"), mention.alias("entities"))
    return rows.select("group_id", "turn", "username", "posted_at", F.to_json(message).alias("json"))


@query(f"""WITH {MESSAGES_SQL} SELECT group_id, turn, {_PARENT} AS reply_to, CASE WHEN turn > 0 THEN group_id END AS reply_chat_id, CASE WHEN turn % 3 = 2 THEN turn + 100 END AS forwarded_message, CASE WHEN turn % 3 = 2 THEN group_id END AS forwarded_chat,
    CASE WHEN turn % 3 = 2 THEN username END AS forwarded_name, turn % 3 + 1 AS reactions, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS chosen, 'custom_emoji' AS reaction_type, content[4:7] AS mention FROM messages""")
def nested_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """replies, forwards, reactions and mentions of nested messages."""
    rows = _nested(spark, sf_dir).withColumn("v", F.parse_json("json"))
    said = rows.select("group_id", "turn", F.get(nested.replies(F.col("v"), F.col("turn")), 0).alias("r"), F.get(nested.forwards(F.col("v")), 0).alias("f"), nested.reactions(F.col("v")).alias("x"), F.get(nested.mentions(F.col("v")), 0)["text"].alias("mention"))
    return said.select(
        "group_id", "turn", F.col("r.reply_message_id").alias("reply_to"), F.col("r.reply_chat_id").alias("reply_chat_id"), F.col("f.from_message_id").alias("forwarded_message"), F.col("f.from_chat_id").alias("forwarded_chat"),
        F.col("f.from_chat_title").alias("forwarded_name"), F.size("x").alias("reactions"), F.size(F.filter("x", lambda r: r["is_big"])).alias("chosen"), F.get("x", 0)["reaction_type"].alias("reaction_type"), "mention",
    )


@query("""SELECT event_id, regexp_extract(props, '(\\d+)', 1)::INT AS k, true AS has_k, false AS has_seen, '{"k":' || regexp_extract(props, '(\\d+)', 1) || ',"seen":true}' AS merged, event_type IN ('error', 'view') AS tagged FROM events""")
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of a JSON text, its merge with another, and tags of a list of objects."""
    tags = F.parse_json(F.to_json(F.array(F.struct(F.upper("event_type").alias("name")))))
    return table(spark, sf_dir, "events").select(
        "event_id", nested.get(F.parse_json("props"), "k", "int").alias("k"), nested.has_key(F.col("props"), "k").alias("has_k"), nested.has_key(F.col("props"), "seen").alias("has_seen"),
        nested.merged(F.col("props"), F.lit('{"seen": true}')).alias("merged"), nested.any_tag(tags, ["Error", "view"]).alias("tagged"),
    )


@query(f"""WITH RECURSIVE m AS (SELECT conv_id AS group_id, turn::BIGINT AS id, ({_PARENT})::BIGINT AS reply_to FROM conversations),
    tree AS (SELECT group_id, id AS root, id, 0 AS depth, [id] AS path FROM m WHERE reply_to IS NULL
        UNION ALL SELECT t.group_id, t.root, m.id, t.depth + 1, list_append(t.path, m.id) FROM tree t JOIN m ON m.group_id = t.group_id AND m.reply_to = t.id WHERE t.depth < {replies.MOST_DEPTH} AND NOT list_contains(t.path, m.id))
    SELECT group_id, root, id, depth, array_to_string(path, '/') AS path FROM tree""")
def reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replies to the first turn of every conversation, to any depth."""
    rows = messages(spark, sf_dir).select("group_id", F.col("turn").alias("id"), F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2)).alias("reply_to"))
    tree = replies.reply_tree(rows, rows.where("reply_to IS NULL"))
    return tree.select("group_id", "root", "id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


@query(f"""WITH {MESSAGES_SQL}, m AS (SELECT *, {_PARENT} AS parent FROM messages),
    p AS (SELECT event_id, user_id, event_type, ts FROM events),
    e AS (SELECT 'AUTHORED' AS kind, 'user:' || username AS source, 'message:' || group_id || '/' || turn AS target, posted_at AS seen FROM m
        UNION ALL SELECT 'IN_GROUP', 'message:' || group_id || '/' || turn, 'group:' || group_id, posted_at FROM m
        UNION ALL SELECT 'REPLIED_TO', 'message:' || group_id || '/' || turn, 'message:' || group_id || '/' || parent, posted_at FROM m WHERE parent IS NOT NULL
        UNION ALL SELECT 'REACTED', 'user:' || (group_id + k), 'message:' || group_id || '/' || turn, posted_at FROM m, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= turn % 3 + 1
        UNION ALL SELECT 'FORWARDED_FROM', 'message:' || group_id || '/' || turn, 'chat:' || group_id, posted_at FROM m WHERE turn % 3 = 2
        UNION ALL SELECT 'POSTED', 'user:' || user_id, 'topic:' || event_type, ts FROM p)
    SELECT kind, source, target, count(*) AS n, min(seen) AS first_seen, max(seen) AS last_seen FROM e GROUP BY 1, 2, 3""")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors, groups, replies, reactions, forwards and topics as one table of edges."""
    rows = _nested(spark, sf_dir).withColumn("v", F.parse_json("json"))
    rows = rows.withColumns({"r": F.get(nested.replies(F.col("v"), F.col("turn")), 0), "f": F.get(nested.forwards(F.col("v")), 0), "x": nested.reactions(F.col("v"))})
    me = edges.node("message", F.col("group_id"), F.col("turn"))
    # A reaction points from its user to the message: source and target change places below.
    of_messages = edges.edges_of(rows, F.col("posted_at"), {
        "AUTHORED": (edges.node("user", F.col("username")), me),
        "IN_GROUP": (me, edges.node("group", F.col("group_id"))),
        "REPLIED_TO": (me, edges.node("message", F.col("r.reply_chat_id"), F.col("r.reply_message_id"))),
        "REACTED": (me, F.transform("x", lambda r: edges.node("user", r["user_tg_id"]))),
        "FORWARDED_FROM": (me, edges.node("chat", F.col("f.from_chat_id"))),
    })
    turned = F.col("kind") == "REACTED"
    of_messages = of_messages.select("kind", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"), "n", "first_seen", "last_seen")
    of_posts = edges.edges_of(posts(spark, sf_dir), F.col("posted_at"), {"POSTED": (edges.node("user", F.col("channel_id")), edges.node("topic", F.col("topic")))})
    found = edges.merge_edges(of_messages, of_posts)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})
