"""JSON, arrays, policies and other small rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_array(value: Column) -> Column:
    """A JSON list of strings, or the value as its only item."""
    return F.coalesce(F.from_json(value, "array<string>"), F.filter(F.array(F.trim(value)), lambda v: v != ""))


def json_object(value: Column) -> Column:
    """The object in a text, which may stand in a fenced block; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value, r"(?s)^\s*```(?:json)?\s*", ""), r"(?s)\s*```\s*$", ""))
    return F.when(bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), bare)


def guarded_payload(payload: Column, limit: int = 65_536) -> Column:
    """The payload, or a mark in its place if it has more bytes than allowed."""
    return F.when(F.octet_length(payload) <= limit, payload).otherwise(F.lit('{"truncated":true}'))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def params_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def enrichment_reason(has_url: Column, has_tag: Column, words: Column, length: Column, has_media: Column) -> Column:
    """The first reason to enrich a post, by priority; null without one."""
    return F.when(has_url, "url").when(has_tag, "tag").when(words >= 50, "wordcount").when(length >= 200, "textlength").when(has_media, "media")


def media_policy(mime: Column, size: Column, blocked: Column) -> Column:
    """What becomes of a file: type, then size, then channel."""
    return F.when(~mime.startswith("image/"), "skip_mime").when(size > 10_000_000, "skip_size").when(blocked, "skip_channel").when(size > 1_000_000, "ocr").otherwise("vision")


#: Fixed names: exceptions of the network and of wrong values, with those that derive from them.
NETWORK_ERRORS = ["ConnectionError", "BrokenPipeError", "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError", "RemoteDisconnected", "TimeoutError"]
VALUE_ERRORS = ["ValueError", "JSONDecodeError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeTranslateError", "ValidationError", "UnsupportedOperation", "TypeError", "KeyError"]


def error_class(kind: Column, status: Column, text: Column) -> Column:
    """What kind of failure, so whether to try again: by the exception's name, then its
    status, then words of its text; what is left counts as the network's. (F62)"""
    low = F.lower(text)
    return (
        F.when(kind.isin(NETWORK_ERRORS), "retryable_network")
        .when(status == 429, "retryable_rate_limit")
        .when(status.between(500, 599), "retryable_server_error")
        .when(status.between(400, 499), "non_retryable_validation")
        .when(low.contains("quota") | low.contains("limit") | low.contains("exceeded"), "non_retryable_quota")
        .when(kind.isin(VALUE_ERRORS), "non_retryable_validation")
        .otherwise("retryable_network")
    )


def _six_decimals(vector):
    return None if vector is None else "[" + ",".join("%.6f" % x for x in vector if x is not None) + "]"


def vector_text(vector: Column) -> Column:
    """`[0.123456,…]` with six decimals, rounded as C does: of two as near the even one, by the exact value; Java
    rounds these up. Null components are left out. (F56)"""
    return F.udf(_six_decimals, "string", useArrow=True)(vector.cast("array<double>"))


def vector_of(text: Column) -> Column:
    return F.from_json(text, "array<float>")
