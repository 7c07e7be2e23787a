"""Text functions as Column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns and word lists.
PHONE = r"(\+?\d[\d\s\-().]{6,})"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
TOKEN = r"[a-zA-Zа-яА-ЯёЁ0-9]{2,}"
STOP_WORDS = (
    "это или как что так если где нет для про при когда через уже после будет вас они все еще есть эта этот эти "
    "with from have just also about http https"
).split()

#: Bytes of text that a function in Python changes at once.
PIECE = 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more Latin or Cyrillic letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords(text: Column) -> Column:
    """Tokens of more than three letters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens(text), lambda t: (F.length(t) > 3) & ~F.array_contains(stop, t))


def mask_email(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[email masked]")


def _mask(m: re.Match[str]) -> str:
    digits = re.sub(r"\D", "", m[0])
    return f"+{digits[:2]}***{digits[-2:]}" if len(digits) >= 6 else "+***"


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about PIECE bytes, one text at least."""
    begin = held = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)):
        if held and held + n > PIECE:
            yield texts.slice(begin, i - begin).to_pylist()
            begin, held = i, 0
        held += int(n) + 64
    if begin < len(texts):
        yield texts.slice(begin).to_pylist()


def _each(texts: Iterator[pa.Array], change: Callable[[str], str]) -> Iterator[pa.Array]:
    """Every text changed. Results go back by pieces, so that beside a batch only one piece is held."""
    for batch in texts:
        for piece in _pieces(batch):
            yield pa.array([t if t is None else change(t) for t in piece], pa.string())


@F.arrow_udf(T.StringType())
def mask_phone(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Phone numbers but for their first and last two digits."""
    phone = re.compile(PHONE)
    return _each(texts, lambda t: phone.sub(_mask, t))


@F.arrow_udf(T.StringType())
def nfc(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _each(texts, lambda t: unicodedata.normalize("NFC", t))


def clean_unicode(text: Column) -> Column:
    """Composed, without zero-width characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(nfc(text), "​‌‍", ""), r"\s+", " "))


def word_count(text: Column) -> Column:
    """Words between white space."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def cluster_key(terms: Column) -> Column:
    """Of sorted distinct lower-case terms, 32 hexadecimal digits. (F16)"""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.array_distinct(F.transform(terms, F.lower))), "|")), 1, 32)


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)#\w+"), F.lit(0)))


def capitalised(text: Column) -> Column:
    """Up to three capitalised words in a row."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?: [A-Z][a-z]+){0,2}(?![A-Za-z0-9_])"), F.lit(0)))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(0), F.size(words) - n + 1), F.lit(1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def fallback_keywords(text: Column) -> Column:
    """The first ten words of more than four characters; repeats stay."""
    return F.slice(F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " "), lambda w: F.length(w) > 4), 1, 10)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def strip_tags(html: Column) -> Column:
    """Text of a page without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def language_guess(text: Column) -> Column:
    """ru if the first hundred characters hold one beyond ASCII, else en."""
    return F.when(F.substring(text, 1, 100).rlike(r"[^\x00-\x7F]"), "ru").otherwise("en")


def anonymise_ip(ip: Column) -> Column:
    """The network of an address: /24 for v4."""
    return F.regexp_replace(ip, r"^(\d+\.\d+\.\d+)\.\d+$", "$1.0")


def normalise_topic(topic: Column) -> Column:
    """Lower case, spaces for underscores, ё as е, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(topic), "_ё", " е"), r"\s+", " "))


def expand_topic(topic: Column) -> Column:
    """The topic and its parts of three letters or more."""
    parts = F.filter(F.split(topic, r"[\s,/|]+"), lambda p: F.length(p) >= 3)
    return F.array_distinct(F.concat(F.array(topic), parts))


def hash_embedding(text: Column, size: int) -> Column:
    """Sixteen numbers from a digest, padded or cut; zeros for a blank text."""
    digest = F.md5(text)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(digest, 2 * i + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)
    zero = F.array_repeat(F.lit(0.0), size)
    return F.when(F.trim(text) == "", zero).otherwise(F.slice(F.concat(pairs, zero), 1, size))
