"""Nested messages as VARIANT: keys, merges, tags, and what a message says of forwards, reactions, replies and mentions.

Functions take a VARIANT column (parse_json) or, where they say so, a JSON text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A peer's kinds, in the order in which they are looked for, and the kinds of mentions.
PEERS = ["user_id", "channel_id", "chat_id"]
MENTIONS = ["MessageEntityMention", "MessageEntityMentionName"]
#: Keys of a reply's target, inside `reply_to` and beside it, in order.
REPLY_KEYS, REPLY_FIELDS = ["message_id", "tg_message_id", "id"], ["reply_to_message_id", "reply_to_id", "reply_to"]


def get(v: Column, path: str, kind: str) -> Column:
    """The value at a path; null if there is none or it is of another kind."""
    return F.try_variant_get(v, f"$.{path}", kind)


def has(v: Column, path: str) -> Column:
    """Whether there is a value at a path, and it is not JSON null."""
    found = F.try_variant_get(v, f"$.{path}", "variant")
    return F.coalesce(found.isNotNull() & ~F.is_variant_null(found), F.lit(False))


def has_key(json: Column, key: str) -> Column:
    """Whether a JSON text is an object with this key, null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def merged(left: Column, right: Column) -> Column:
    """JSON texts of objects as one: keys of the right replace those of the left; null counts as empty."""
    one, other = (F.from_json(F.coalesce(x, F.lit("{}")), "map<string,variant>") for x in (left, right))
    kept = F.map_filter(one, lambda k, _: ~F.array_contains(F.map_keys(other), k))
    return F.to_json(F.map_concat(kept, other))


def length(json: Column) -> Column:
    """Elements of a JSON text that is an array; null for anything else."""
    return F.json_array_length(json)


def elements(json: Column) -> Column:
    """Elements of a JSON array as texts, as they are if they are strings, else as JSON; empty for anything else."""
    found = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    text = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")), F.to_json(v))
    return F.coalesce(F.transform(found, text), F.array().cast("array<string>"))


def first_filled(*jsons: Column) -> Column:
    """The first JSON array with elements, else the last column: what an update keeps of a list."""
    return F.coalesce(*[F.when(length(j) > 0, j) for j in jsons], jsons[-1])


def tags(v: Column) -> Column:
    """Tags in lower case, of a list of texts or of objects with `name`; the first element decides which."""
    found = F.try_variant_get(v, "$", "array<variant>")
    lower = lambda x: F.lower(F.coalesce(x, F.lit("")))
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    named = F.transform(F.filter(found, is_object), lambda x: lower(F.try_variant_get(x, "$.name", "string")))
    plain = F.transform(found, lambda x: lower(F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))))
    return F.coalesce(F.when(is_object(F.get(found, 0)), named).otherwise(plain), F.array().cast("array<string>"))


def any_tag(v: Column, wanted: Iterable[str]) -> Column:
    """Whether one of the wanted tags is among them, whatever the case."""
    return F.arrays_overlap(tags(v), F.array(*[F.lit(w.lower()) for w in wanted]))


def _peer(v: Column, path: str) -> Column:
    """{kind: number} of the first kind that is there; null without one."""
    return F.coalesce(*[F.when(has(v, f"{path}.{p}"), F.create_map(F.lit(p), get(v, f"{path}.{p}", "bigint"))) for p in PEERS])


def forwards(v: Column, now: Column | None = None) -> Column:
    """Where a message was forwarded from: an array of one struct, or empty.

    Users have no chat id. A forward without a date is as of `now`.
    """
    one = F.struct(
        F.when(~has(v, "fwd_from.from_id.user_id"), F.coalesce(get(v, "fwd_from.from_id.channel_id", "bigint"), get(v, "fwd_from.from_id.chat_id", "bigint"))).alias("from_chat_id"),
        get(v, "fwd_from.channel_post", "bigint").alias("from_message_id"),
        F.nullif(get(v, "fwd_from.from_name", "string"), F.lit("")).alias("from_chat_title"),
        F.coalesce(get(v, "fwd_from.date", "timestamp"), now if now is not None else F.current_timestamp()).alias("forwarded_at"),
        _peer(v, "fwd_from.from_id").alias("from_id"),
        F.nullif(get(v, "fwd_from.post_author", "string"), F.lit("")).alias("post_author_signature"),
        _peer(v, "fwd_from.saved_from_peer").alias("saved_from_peer"),
        get(v, "fwd_from.saved_from_msg_id", "bigint").alias("saved_from_msg_id"),
        get(v, "fwd_from.psa_type", "string").alias("psa_type"),
    )
    return F.when(has(v, "fwd_from"), F.array(one)).otherwise(F.array().cast(f"array<{_TYPES['forward']}>"))


def reactions(v: Column) -> Column:
    """Reactions to a message: emoji, custom emoji by document, or paid; who, and whether chosen. A plain list holds emoji."""

    def one(r: Column) -> Column:
        kinds = [("reaction.emoticon", "emoji"), ("reaction.document_id", "custom_emoji"), ("reaction.premium_emoji", "paid")]
        kind = F.coalesce(*[F.when(has(r, p), F.lit(k)) for p, k in kinds], F.lit("emoji"))
        value = F.coalesce(*[F.when(has(r, p), get(r, p, "string")) for p, _ in kinds])
        return F.struct(kind.alias("reaction_type"), value.alias("reaction_value"), get(r, "peer_id.user_id", "bigint").alias("user_tg_id"), F.coalesce(get(r, "chosen", "boolean"), F.lit(False)).alias("is_big"))

    plain = lambda r: F.struct(F.lit("emoji").alias("reaction_type"), F.nullif(F.try_variant_get(r, "$", "string"), F.lit("")).alias("reaction_value"), F.lit(None).cast("bigint").alias("user_tg_id"), F.lit(False).alias("is_big"))
    kind = f"array<{_TYPES['reaction']}>"
    return F.coalesce(F.transform(get(v, "reactions.results", "array<variant>"), one).cast(kind), F.transform(get(v, "reactions", "array<variant>"), plain).cast(kind), F.array().cast(kind))


def replies(v: Column, post_id: Column) -> Column:
    """What a message replies to: an array of one struct, or empty."""
    peer = lambda p: get(v, f"reply_to.reply_to_peer_id.{p}", "bigint")
    chat = F.coalesce(peer("channel_id"), peer("chat_id"))
    one = F.struct(
        post_id.cast("string").alias("post_id"),
        get(v, "reply_to.reply_to_msg_id", "bigint").alias("reply_message_id"),
        chat.alias("reply_chat_id"),
        F.when(chat.isNull(), peer("user_id")).alias("reply_author_tg_id"),
        F.nullif(get(v, "reply_to.reply_to_top_id", "bigint"), F.lit(0)).alias("thread_id"),
    )
    return F.when(has(v, "reply_to"), F.array(one)).otherwise(F.array().cast(f"array<{_TYPES['reply']}>"))


def reply_target(v: Column) -> Column:
    """The id of what a message replies to, as a text; 0, '' and null give way to the next key."""
    filled = lambda path: F.nullif(F.nullif(get(v, path, "string"), F.lit("")), F.lit("0"))
    inside = [filled(f"reply_to.{k}") for k in REPLY_KEYS]
    beside = [F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("OBJECT"), F.lit(False)), filled(k)) for k in REPLY_FIELDS]
    return F.coalesce(*inside, *beside)


def mentions(v: Column, utf16: bool = False) -> Column:
    """Mentions among a message's entities: type, text and user.

    Offsets and lengths count letters of the message; with utf16 they count UTF-16 units, as senders write
    them, of which letters beyond U+FFFF have two.
    """
    text = F.coalesce(get(v, "message", "string"), F.lit(""))

    def cut(e: Column) -> Column:
        at, size = get(e, "offset", "int"), get(e, "length", "int")
        if not utf16:
            return F.substring(text, at + 1, size)
        raw = F.substring(F.encode(text, "UTF-16BE"), at * 2 + 1, size * 2)
        return F.decode(raw, "UTF-16BE")

    found = F.filter(get(v, "entities", "array<variant>"), lambda e: get(e, "type", "string").isin(MENTIONS))
    rows = F.transform(found, lambda e: F.struct(get(e, "type", "string").alias("type"), cut(e).alias("text"), get(e, "user_id", "bigint").alias("user_id")))
    return F.coalesce(rows, F.array().cast("array<struct<type:string,text:string,user_id:bigint>>"))


def entity(v: Column) -> Column:
    """A user, channel or chat as one flat struct; null without an id or a kind.

    A channel that does not broadcast is a supergroup. The avatar's hash is of its photo and data centre.
    """
    kind = get(v, "kind", "string")
    peer = F.when(kind == "channel", F.when(F.coalesce(get(v, "broadcast", "boolean"), F.lit(False)), "channel").otherwise("supergroup")).when(kind.isin("user", "chat"), kind)
    flag = lambda name: F.coalesce(get(v, name, "boolean"), F.lit(False))
    photo = F.concat(get(v, "photo.photo_id", "string"), F.lit("_"), get(v, "photo.dc_id", "string"))
    flat = F.struct(
        get(v, "id", "bigint").alias("peer_id"),
        peer.alias("peer_type"),
        get(v, "username", "string").alias("username"),
        F.coalesce(get(v, "title", "string"), F.nullif(F.concat_ws(" ", get(v, "first_name", "string"), get(v, "last_name", "string")), F.lit(""))).alias("name"),
        *[flag(n).alias(f"is_{n}") for n in ("verified", "premium", "scam", "fake", "bot", "restricted")],
        get(v, "photo.dc_id", "int").alias("dc_id"),
        F.sha2(photo, 256).alias("avatar_hash"),
        F.transform(get(v, "restriction_reason", "array<variant>"), lambda r: F.concat_ws(": ", get(r, "platform", "string"), get(r, "reason", "string"))).alias("restrictions"),
        F.transform(get(v, "admins", "array<variant>"), lambda a: F.coalesce(get(a, "user_id", "bigint"), F.try_variant_get(a, "$", "bigint"))).alias("admins"),
    )
    return F.when(get(v, "id", "bigint").isNotNull() & peer.isNotNull(), flat)


_TYPES = {
    "forward": "struct<from_chat_id:bigint,from_message_id:bigint,from_chat_title:string,forwarded_at:timestamp,from_id:map<string,bigint>,post_author_signature:string,saved_from_peer:map<string,bigint>,saved_from_msg_id:bigint,psa_type:string>",
    "reaction": "struct<reaction_type:string,reaction_value:string,user_tg_id:bigint,is_big:boolean>",
    "reply": "struct<post_id:string,reply_message_id:bigint,reply_chat_id:bigint,reply_author_tg_id:bigint,thread_id:bigint>",
}
