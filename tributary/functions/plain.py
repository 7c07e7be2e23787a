"""Small functions of the reference as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import first_by, once, squeezed

#: Words of a meme and of a screen shot, letters of a document and of a text; keywords of a query; letters of a shortened text.
MEME, SCREENSHOT = ["мем", "meme", "lol", "хаха", "рофл", "кринж"], ["скриншот", "screenshot"]
DOCUMENT, TEXT, TRIGGERS, SHORT, LONGEST_DELAY = 500, 50, 60, 280, 30.0


def query_keywords(query: Column, intent: Column) -> Column:
    """Words of three letters, signs `#+-` among them, in lower case, then the intent; each once, 60 at most."""
    words = F.coalesce(F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\w#+\-]{3,}"), F.lit(0)), F.array().cast("array<string>"))
    aim = F.lower(F.trim(intent))
    whole = F.when(F.coalesce(aim, F.lit("")) != "", F.concat(words, F.array(aim))).otherwise(words)
    return F.when(F.coalesce(query, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(first_by(whole), 1, TRIGGERS))


def query_topics(query: Column, topics: Column) -> Column:
    """The first three words in lower case as one topic, then the topics of the sources; each once."""
    first = F.array_join(F.slice(F.split(F.lower(squeezed(query)), " "), 1, 3), " ")
    return F.filter(F.array_distinct(F.concat(F.array(first), F.coalesce(topics, F.array().cast("array<string>")))), lambda t: t != "")


def content_type(seen: Column) -> Column:
    """meme, document, screenshot, text or other, by words and length of what is read off an image."""
    size = F.length(F.coalesce(seen, F.lit("")))
    holds = lambda low, words: reduce(Column.__or__, [low.contains(w) for w in words])
    kind = lambda low: F.when(holds(low, MEME), "meme").when(size > DOCUMENT, "document").when(holds(low, SCREENSHOT), "screenshot").when(size > TEXT, "text").otherwise("other")
    return once(F.lower(F.coalesce(seen, F.lit(""))), kind)


def taxonomy(terms: Column, categories: dict[str, list[str]], most: int = 3) -> Column:
    """The first categories of which a term is a member, whatever its case."""
    low = F.transform(terms, F.lower)
    met = [F.when(F.arrays_overlap(low, F.array(*[F.lit(w.lower()) for w in words])), F.lit(name)) for name, words in categories.items()]
    return F.slice(F.filter(F.array(*met), lambda c: c.isNotNull()), 1, most)


def shortened(text: Column, most: int = SHORT) -> Column:
    """The trimmed text, cut to `most` letters with an ellipsis if it is longer; null as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(F.length(trimmed) <= most, trimmed).otherwise(F.concat(F.regexp_replace(F.substring(trimmed, 1, most), r"(?U)\s+$", ""), F.lit("…")))


def calm(text: Column) -> Column:
    """White space as one space; a text all in capitals as a sentence."""
    one = squeezed(text)
    loud = (F.upper(one) == one) & (F.lower(one) != one)
    return F.when(loud, F.concat(F.upper(F.substring(one, 1, 1)), F.lower(F.substring(one, 2, 1_000_000)))).otherwise(one)


def anonymous_ip(ip: Column) -> Column:
    """The network of an address: the first 24 bits of v4, the first 56 of v6; null for anything else."""
    v4 = F.regexp_extract(ip, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    # Groups of v6, with those that :: stands for.
    left, right = F.split(F.lower(ip), "::")[0], F.try_element_at(F.split(F.lower(ip), "::"), F.lit(2))
    groups = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ":"), lambda g: g != "")
    missing = F.greatest(F.lit(0), 8 - F.size(groups(left)) - F.size(groups(right)))
    whole = F.transform(F.concat(groups(left), F.when(ip.contains("::"), F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), groups(right)), lambda g: F.lpad(g, 4, "0"))
    net = F.transform(F.slice(F.concat(F.slice(whole, 1, 3), F.array(F.concat(F.substring(F.get(whole, 3), 1, 2), F.lit("00")))), 1, 4), lambda g: F.lower(F.hex(F.conv(g, 16, 10).cast("long"))))
    v6 = F.when(ip.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":") & (F.size(whole) == 8), F.concat(F.array_join(net, ":"), F.lit("::/56")))
    return F.when(v4 != "", F.concat(v4, F.lit(".0/24"))).otherwise(v6)


def agent_family(agent: Column) -> Column:
    """The first word of a user agent."""
    return F.substring_index(agent, " ", 1)


def plain_username(name: Column) -> Column:
    """Without @ signs at its start."""
    return F.regexp_replace(name, "^@+", "")


def instant(text: Column, now: Column | None = None) -> Column:
    """An ISO time, Z for UTC, without a zone as of UTC; `now` where there is none or it cannot be read."""
    found = F.try_to_timestamp(F.when(text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z"))))
    return F.coalesce(found, now if now is not None else F.current_timestamp())


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds, with fractions, from start to end."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def month_number(at: Column) -> Column:
    """yyyymm as an int."""
    return (F.year(at) * 100 + F.month(at)).cast("int")


def assigned_variant(tenant: Column, bucket: Column, variants: dict[str, float], default: str, forced: dict[str, str] | None = None, excluded: list[str] | None = None, enabled: bool = True) -> Column:
    """The variant of a tenant: the default if the experiment is off, the tenant unknown or excluded; then the forced one; then by the bucket (0 to 1)
    and the cumulated weights, which count as shares of their sum. (F59)"""
    weights = {k: max(0.0, w) for k, w in variants.items()}
    total = sum(weights.values())
    weights = {k: w / total for k, w in weights.items()} if total > 0 else {"control": 1.0}
    chosen, below = F.lit(default), 0.0
    steps = []
    for name, w in weights.items():
        below += w
        steps.append((below, name))
    for bound, name in reversed(steps):
        chosen = F.when(bucket < bound, name).otherwise(chosen)
    for name, variant in (forced or {}).items():
        chosen = F.when(tenant == name, variant).otherwise(chosen)
    off = F.lit(not enabled) | (F.coalesce(tenant, F.lit("")) == "") | F.coalesce(tenant.isin(excluded or []), F.lit(False))
    return F.when(off, default).otherwise(chosen)


def retry_delay(backoff: Column, share: Column, most: float = LONGEST_DELAY) -> Column:
    """A fifth less to a fifth more than the backoff, by a share from 0 to 1, up to a bound."""
    return F.least(backoff * (0.8 + share * 0.4), F.lit(most))


def params_hash(model: Column, version: Column, inputs: Column) -> Column:
    """SHA-256 of model, version and inputs, a JSON text with sorted keys, joined by bars; null as empty, no inputs as {}."""
    return F.sha2(F.concat_ws("|", F.coalesce(model, F.lit("")), F.coalesce(version, F.lit("")), F.coalesce(inputs, F.lit("{}"))), 256)
