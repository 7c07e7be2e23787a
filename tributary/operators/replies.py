"""Replies of a message, flat and as a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Replies to one message, and levels of a tree, at most.
MOST_REPLIES, MOST_DEPTH = 100, 10


def direct_replies(messages: DataFrame, order: list[Column], most: int = MOST_REPLIES) -> DataFrame:
    """(group_id, id, reply_to, place): the first `most` replies to each message, in order."""
    place = F.row_number().over(Window.partitionBy("group_id", "reply_to").orderBy(*order))
    return messages.where("reply_to IS NOT NULL").withColumn("place", place).where(F.col("place") <= most).select("group_id", "id", "reply_to", "place")


def reply_tree(messages: DataFrame, roots: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(group_id, root, id, depth, path) of what replies to the roots (group_id, id), directly or not, depth 0 being the root.

    messages: group_id, id, reply_to; a message replies to one at most. A reply that is already on its path is not followed
    again, so rings end. Roots that are no messages have no replies and stand alone; rows that repeat count once.
    """
    spark = messages.sparkSession
    # All rows of a level are wanted, however many they are.
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    edges = messages.where("reply_to IS NOT NULL").select("group_id", F.col("id").cast("long").alias("id"), F.col("reply_to").cast("long").alias("reply_to")).distinct()
    start = roots.select("group_id", F.col("id").cast("long").alias("id")).distinct()
    return spark.sql(
        f"""WITH RECURSIVE tree(group_id, root, id, depth, path) AS (
            SELECT group_id, id, id, 0, array(id) FROM {{start}}
            UNION ALL
            SELECT t.group_id, t.root, e.id, t.depth + 1, concat(t.path, array(e.id))
            FROM tree AS t JOIN {{edges}} AS e ON e.group_id = t.group_id AND e.reply_to = t.id
            WHERE t.depth < {int(most_depth)} AND NOT array_contains(t.path, e.id))
        SELECT * FROM tree""",
        start=start,
        edges=edges,
    )
