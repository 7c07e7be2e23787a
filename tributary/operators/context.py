"""What a group's context says beside its messages: media, participants, highlights, topics.

messages: group_id, id, username, content, posted_at, media (an array of MEDIA, or null). Texts are
taken as they are; mask them before. (A14, A15, A16)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

MEDIA = "struct<id:string,kind:string,mime_type:string,hint:string,description:string,labels:array<string>,ocr_text:string>"
#: Kinds by the first part of a mime type and of a hint; letters of texts; how many of each are kept.
MIME_KINDS = {"image": "image", "video": "video", "audio": "audio", "application": "document"}
HINT_KINDS = {"photo": "image", "video": "video", "voice": "audio", "audio": "audio", "document": "document"}
DESCRIPTION, EXCERPT = 160, 200
LABELS, SAMPLES, HIGHLIGHTS, ATTACHMENTS = 5, 5, 6, 3
COMMON, TOPICS, MATCHED, SUMMARY, OWNERS = 10, 3, 10, 3, 3
NO_CAPTION, ATTACHED, EVERYONE = " без подписи", "Вложения: ", "Активные участники группы"
ABOUT = ("Обсуждение ключевой темы «", "».")


def media_kind(mime_type: Column, hint: Column) -> Column:
    """By mime type, else by the hint before its colon, else unknown."""
    pick = lambda c, kinds: F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), c)
    mime = F.when(mime_type.contains("/"), F.substring_index(mime_type, "/", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MIME_KINDS.items() for x in pair]), mime), pick(F.substring_index(hint, ":", 1), HINT_KINDS), F.lit("unknown"))


def normalised_media(media: Column) -> Column:
    """MEDIA as (id, kind, description, labels, ocr_excerpt): a kind is looked for, and a description is made of labels or text where there is none."""

    def one(m: Column, place: Column) -> Column:
        filled = lambda c: F.when(c != "", c)
        kind = F.coalesce(filled(m["kind"]), media_kind(m["mime_type"], m["hint"]))
        labels = F.coalesce(m["labels"], F.array().cast("array<string>"))
        of_labels = F.when(F.size(labels) > 0, F.array_join(F.slice(labels, 1, 3), ", "))
        said = F.substring(F.coalesce(filled(m["description"]), of_labels, filled(m["ocr_text"])), 1, DESCRIPTION)
        none = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 100)), F.lit(NO_CAPTION))
        return F.struct(
            F.coalesce(filled(m["id"]), filled(m["hint"]), place.cast("string")).alias("id"),
            kind.alias("kind"),
            F.coalesce(said, none).alias("description"),
            F.slice(labels, 1, LABELS).alias("labels"),
            F.substring(filled(m["ocr_text"]), 1, EXCERPT).alias("ocr_excerpt"),
        )

    return F.coalesce(F.transform(media, one), F.array().cast("array<struct<id:string,kind:string,description:string,labels:array<string>,ocr_excerpt:string>>"))


def with_attachments(content: Column, media: Column) -> Column:
    """The trimmed text and, on a line of its own, the first three of its normalised media."""
    listed = F.concat(F.lit(ATTACHED), F.array_join(F.transform(F.slice(media, 1, ATTACHMENTS), lambda m: F.concat(m["kind"], F.lit(": "), m["description"])), "; "))
    own = F.trim(F.coalesce(content, F.lit("")))
    return F.when(F.size(media) == 0, own).otherwise(F.concat_ws("\n", F.nullif(own, F.lit("")), listed))


def enriched(messages: DataFrame) -> DataFrame:
    """messages with normalised media, and content with its attachments."""
    rows = messages.withColumn("media", normalised_media(F.col("media")))
    return rows.withColumn("content", with_attachments(F.col("content"), F.col("media")))


def _kinds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, media_kinds): how many media of each kind; one row a kind is gathered."""
    counts = rows.select(*keys, F.explode("media").alias("m")).groupBy(*keys, "m.kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("media_kinds"))


def participant_stats(messages: DataFrame) -> DataFrame:
    """(group_id, username, message_count, media_count, media_kinds, media_samples) of enriched messages; samples are the first five described media."""
    keys = ["group_id", "username"]
    counts = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("message_count"), F.sum(F.size("media")).cast("long").alias("media_count"))
    media = messages.select(*keys, "posted_at", "id", F.posexplode("media").alias("k", "m"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("posted_at", "id", "k"))
    first = media.withColumn("place", place).where(F.col("place") <= SAMPLES)
    samples = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("m.description", 1, DESCRIPTION).alias("s")))), lambda x: x["s"]).alias("media_samples"))
    found = counts.join(_kinds(messages, keys), keys, "left").join(samples, keys, "left")
    return found.withColumns({"media_kinds": F.coalesce("media_kinds", F.create_map().cast("map<string,bigint>")), "media_samples": F.coalesce("media_samples", F.array().cast("array<string>"))})


def media_stats(messages: DataFrame) -> DataFrame:
    """(group_id, media_total, media_messages, media_with_description, media_without_description, media_kinds) of enriched messages."""
    described = F.size(F.filter("media", lambda m: m["description"] != ""))
    total = F.sum(F.size("media")).cast("long")
    counts = messages.groupBy("group_id").agg(total.alias("media_total"), F.count_if(F.size("media") > 0).alias("media_messages"), F.sum(described).cast("long").alias("media_with_description"))
    found = counts.withColumn("media_without_description", F.col("media_total") - F.col("media_with_description"))
    return found.join(_kinds(messages, ["group_id"]), "group_id", "left").withColumn("media_kinds", F.coalesce("media_kinds", F.create_map().cast("map<string,bigint>")))


def media_highlights(messages: DataFrame) -> DataFrame:
    """(group_id, rank, id, kind, description, labels): a group's six media of the best scored messages (score), the later of equals."""
    media = messages.select("group_id", "id", "score", "posted_at", F.posexplode("media").alias("k", "m"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("score"), F.desc("posted_at"), "id", "k"))
    return media.withColumn("rank", rank).where(F.col("rank") <= HIGHLIGHTS).select("group_id", "rank", "id", "m.kind", "m.description", "m.labels")


def keyword_topics(messages: DataFrame, highlights: DataFrame | None = None, limit: int = TOPICS) -> DataFrame:
    """(group_id, rank, keyword, title, priority, msg_count, summary, owners, media_refs) of enriched messages.

    Keywords are the most frequent words that occur twice, of the ten most frequent, the one seen first among equals; where none does, the
    most frequent word. A keyword's messages are its first ten; three of them are the summary, and their three most frequent
    authors the owners. A group without words has no topic.
    """
    words = messages.select("group_id", "posted_at", "id", F.posexplode(text.keywords(F.coalesce("content", F.lit("")))).alias("k", "keyword"))
    per = words.groupBy("group_id", "keyword", "posted_at", "id").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"))
    counts = per.groupBy("group_id", "keyword").agg(F.sum("n").alias("n"), F.min(F.struct("posted_at", "id", "k")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "seen"))
    top = counts.withColumn("rank", rank).where((F.col("rank") <= min(limit, COMMON)) & ((F.col("n") >= 2) | (F.col("rank") == 1))).select("group_id", "keyword", "rank")
    place = F.row_number().over(Window.partitionBy("group_id", "keyword").orderBy("posted_at", "id"))
    matched = per.join(top, ["group_id", "keyword"]).withColumn("place", place).where(F.col("place") <= MATCHED).select("group_id", "keyword", "rank", "posted_at", "id", "place")
    matched = matched.join(messages.select("group_id", "id", "username", "content"), ["group_id", "id"])
    authors = matched.where("username <> ''").groupBy("group_id", "keyword", "username").agg(F.struct((-F.count(F.lit(1))).alias("n"), F.min("place").alias("place"), F.col("username").alias("name")).alias("a"))
    owners = authors.groupBy("group_id", "keyword").agg(F.array_join(F.slice(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["name"]), 1, OWNERS), ", ").alias("owners"))
    line = F.when(F.col("place") <= SUMMARY, F.struct("place", F.substring("content", 1, DESCRIPTION).alias("line")))
    found = matched.groupBy("group_id", "keyword", "rank").agg(F.count(F.lit(1)).alias("msg_count"), F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), " ")).alias("summary"))
    found = found.join(owners, ["group_id", "keyword"], "left")
    if highlights is None:
        refs = found.select("group_id", "keyword", F.lit(0).cast("long").alias("media_refs"))
    else:
        said = F.lower(F.concat(F.lower("description"), F.lit(" "), F.array_join("labels", " ")))
        refs = highlights.select("group_id", said.alias("said")).join(top, "group_id").where(F.contains("said", "keyword")).groupBy("group_id", "keyword").agg(F.count(F.lit(1)).alias("media_refs"))
    return found.join(refs, ["group_id", "keyword"], "left").select(
        "group_id", "rank", "keyword", F.concat(F.upper(F.substring("keyword", 1, 1)), F.substring("keyword", 2, 1000)).alias("title"), F.when(F.col("rank") == 1, "high").otherwise("medium").alias("priority"), "msg_count",
        F.when(F.col("summary") != "", F.col("summary")).otherwise(F.concat(F.lit(ABOUT[0]), F.col("keyword"), F.lit(ABOUT[1]))).alias("summary"),
        F.coalesce("owners", F.lit(EVERYONE)).alias("owners"), F.coalesce("media_refs", F.lit(0).cast("long")).alias("media_refs"),
    )
