"""Nested messages: the reference's own examples as rows, and odd ones."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tributary.functions import nested


@pytest.fixture
def one(spark):
    """one(message, make) -> the value that make says of a message."""

    def run(message, make):
        text = message if isinstance(message, str) or message is None else json.dumps(message)
        return spark.createDataFrame([(text,)], "m string").select(make(F.try_parse_json("m")).alias("x")).first().x

    return run


def test_forwards(one):
    at = "2025-01-01T12:00:00+00:00"
    [f] = one({"fwd_from": {"date": at, "channel_post": 12345, "from_id": {"channel_id": 67890}, "from_name": "Test Channel", "post_author": "", "saved_from_peer": {"user_id": 5}, "saved_from_msg_id": 6}}, nested.forwards)
    assert (f.from_chat_id, f.from_message_id, f.from_chat_title, f.from_id, f.saved_from_peer, f.saved_from_msg_id) == (67890, 12345, "Test Channel", {"channel_id": 67890}, {"user_id": 5}, 6)
    assert f.post_author_signature is None and f.forwarded_at.astimezone(datetime.UTC) == datetime.datetime(2025, 1, 1, 12, tzinfo=datetime.UTC)
    [g] = one({"fwd_from": {"from_id": {"user_id": 1, "channel_id": 2}}}, nested.forwards)
    assert g.from_chat_id is None and g.from_id == {"user_id": 1} and g.forwarded_at is not None
    for empty in ({"fwd_from": None}, {}, None, "not json", "[1]"):
        assert not one(empty, nested.forwards)


def test_reactions(one):
    [r] = one({"reactions": {"results": [{"chosen": False, "reaction": {"emoticon": "👍"}, "peer_id": {"user_id": 12345}}]}}, nested.reactions)
    assert tuple(r) == ("emoji", "👍", 12345, False)
    [c] = one({"reactions": {"results": [{"chosen": True, "reaction": {"document_id": 98765}, "peer_id": None}]}}, nested.reactions)
    assert tuple(c) == ("custom_emoji", "98765", None, True)
    assert [tuple(x) for x in one({"reactions": ["🔥", ""]}, nested.reactions)] == [("emoji", "🔥", None, False), ("emoji", None, None, False)]
    assert not one({"reactions": None}, nested.reactions) and not one({}, nested.reactions)


def test_replies(one):
    [r] = one({"reply_to": {"reply_to_msg_id": 11111, "reply_to_peer_id": {"channel_id": 22222}, "reply_to_top_id": 7}}, lambda v: nested.replies(v, F.lit("test-post-id-123")))
    assert tuple(r) == ("test-post-id-123", 11111, 22222, None, 7)
    [u] = one({"reply_to": {"reply_to_msg_id": 33333, "reply_to_peer_id": {"user_id": 44444}}}, lambda v: nested.replies(v, F.lit("p")))
    assert (u.reply_message_id, u.reply_chat_id, u.reply_author_tg_id) == (33333, None, 44444)
    assert not one({"reply_to": None}, lambda v: nested.replies(v, F.lit("p")))


@pytest.mark.parametrize(
    ("message", "expected"),
    [({"reply_to": {"message_id": 0, "tg_message_id": "", "id": 5}}, "5"), ({"reply_to": {"message_id": "1"}, "reply_to_id": 9}, "1"), ({"reply_to": {}, "reply_to_id": 9}, "9"), ({"reply_to_message_id": 3, "reply_to_id": 9}, "3"), ({"reply_to": 8}, "8"), ({"reply_to": {}}, None), ({}, None)],
)
def test_reply_targets(one, message, expected):
    assert one(message, nested.reply_target) == expected


def test_mentions_by_letters_and_by_utf16_units(one):
    text = "🙂 hi @bob and Ann"
    entities = [{"type": "MessageEntityMention", "offset": 5, "length": 4}, {"type": "MessageEntityBold", "offset": 0, "length": 2}, {"type": "MessageEntityMentionName", "offset": 14, "length": 3, "user_id": 7}]
    assert [tuple(m) for m in one({"message": text, "entities": entities}, nested.mentions)] == [("MessageEntityMention", "@bob", None), ("MessageEntityMentionName", "Ann", 7)]
    shifted = [e | {"offset": e["offset"] + 1} for e in entities]
    assert [m.text for m in one({"message": text, "entities": shifted}, lambda v: nested.mentions(v, True))] == ["@bob", "Ann"]
    assert one({"message": None, "entities": entities[:1]}, nested.mentions)[0].text == "" and one({}, nested.mentions) == []


def test_tags_of_texts_and_of_objects(one):
    assert one(["A", "b", 3], nested.tags) == ["a", "b", "3"]
    assert one([{"name": "X"}, {"other": 1}, "skipped"], nested.tags) == ["x", ""]
    assert one([], nested.tags) == [] and one(None, nested.tags) == [] and one({"a": 1}, nested.tags) == []
    assert one([{"name": "Sale"}], lambda v: nested.any_tag(v, ["SALE"])) is True


def test_objects_and_arrays_as_text(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [1]}}', '{"b": 2, "d": null}'), (None, '{"x": "y"}'), ("[1]", None)], "l string, r string")
    rows = df.select(nested.has_key(F.col("r"), "d").alias("d"), nested.merged(F.when(F.col("l") != "[1]", F.col("l")), F.col("r")).alias("m")).collect()
    assert [r.d for r in rows] == [True, False, False]
    assert [json.loads(r.m) for r in rows] == [{"a": 1, "b": 2, "d": None}, {"x": "y"}, {}]
    lists = spark.createDataFrame([('["x", 1, {"k": 2}]', "[]"), ("{}", "[3]"), (None, None)], "l string, r string")
    got = lists.select(nested.length(F.col("l")).alias("n"), nested.elements(F.col("l")).alias("e"), nested.first_filled(F.col("r"), F.col("l")).alias("f")).collect()
    assert [(r.n, r.e, r.f) for r in got] == [(3, ["x", "1", '{"k":2}'], '["x", 1, {"k": 2}]'), (None, [], "[3]"), (None, [], None)]


def test_entities_become_flat(one):
    user = one({"kind": "user", "id": 5, "first_name": "Ann", "last_name": None, "bot": True, "photo": {"photo_id": 1, "dc_id": 2}, "restriction_reason": [{"platform": "ios", "reason": "x"}]}, nested.entity)
    assert (user.peer_id, user.peer_type, user.name, user.is_bot, user.is_scam, user.dc_id, user.restrictions) == (5, "user", "Ann", True, False, 2, ["ios: x"]) and len(user.avatar_hash) == 64
    assert one({"kind": "channel", "id": 6, "title": "T", "broadcast": False, "admins": [{"user_id": 1}, 2]}, nested.entity)[1:2] == ("supergroup",)
    assert one({"kind": "channel", "id": 6, "broadcast": True, "admins": [{"user_id": 1}, 2]}, nested.entity).admins == [1, 2]
    assert one({"kind": "other", "id": 6}, nested.entity) is None and one({"kind": "user"}, nested.entity) is None
