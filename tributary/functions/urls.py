"""Four ways to write a url, which differ and are not to be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed lists: parameters that tell nothing of the page, to the canonical and the cleaned
#: url, and to the normalised one.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "campaign"]
NORMALISER_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
#: Characters of a cleaned url; longer ones are dropped.
MOST_CHARS = 2048
PORTS = {"http": ":80", "https": ":443"}


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))


def host(url: Column) -> Column:
    """Host and port in lower case."""
    return F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def parameters(url: Column) -> Column:
    """Parameters as written, without empty ones."""
    return F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")


def valued(url: Column) -> Column:
    """Parameters as written, without those of a blank value."""
    return F.filter(parameters(url), lambda p: p.rlike("^[^=]*=."))


def bare_path(url: Column) -> Column:
    """The path without slashes at its end, but for the root's."""
    return F.when(F.length(path(url)) > 1, F.regexp_replace(path(url), "/+$", "")).otherwise(path(url))


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(#.*)$", 1)


def _name(p: Column) -> Column:
    return F.lower(F.substring_index(p, "=", 1))


def _with(base: Column, kept: Column) -> Column:
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _decoded(p: Column) -> Column:
    """Percent escapes and plus signs as the letters they stand for; as it is if an escape is malformed."""
    return F.coalesce(F.try_url_decode(p), F.replace(p, F.lit("+"), F.lit(" ")))


def _encoded(p: Column) -> Column:
    return F.replace(F.replace(F.url_encode(p), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _by_name(kept: Column) -> Column:
    """Parameters with values sorted by their decoded name, in their order within a name, and encoded anew."""
    value = lambda p: F.substring(p, F.instr(p, "=") + 1, F.length(p))
    parts = F.transform(kept, lambda p, i: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _decoded(value(p)).alias("v")))
    return F.transform(F.array_sort(parts), lambda e: F.concat(_encoded(e["k"]), F.lit("="), _encoded(e["v"])))


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no trailing slash but the root's,
    parameters by name, without blank ones and those whose name holds a tracking word; no
    fragment. (F31)"""
    default = F.when(scheme(url) == "http", ":80$").otherwise(":443$")
    holds = lambda p: F.exists(F.array(*[F.lit(t) for t in TRACKING]), lambda t: F.lower(_decoded(F.substring_index(p, "=", 1))).contains(t))
    kept = _by_name(F.filter(valued(url), lambda p: ~holds(p)))
    return _with(F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), default, ""), bare_path(url)), kept)


def url_hash(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def normalised(url: Column) -> Column:
    """Without a leading m. or amp. and a trailing slash but the root's, without blank
    parameters and those of exactly these names, case included; by name; no fragment; the
    port stays. (F33)"""
    kept = _by_name(F.filter(valued(url), lambda p: ~_decoded(F.substring_index(p, "=", 1)).isin(NORMALISER_TRACKING)))
    return _with(F.concat(scheme(url), F.lit("://"), F.regexp_replace(host(url), r"^(m|amp)\.", ""), bare_path(url)), kept)


def cleaned(url: Column) -> Column:
    """Parameters of exactly these names and blank ones go; order and fragment stay; null
    beyond MOST_CHARS. (F35)"""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    kept = F.filter(valued(url), lambda p: ~_name(p).isin(TRACKING))
    whole = F.concat(_with(base, kept), fragment(url))
    return F.when(F.length(whole) <= MOST_CHARS, whole)


def crawl_key(url: Column) -> Column:
    """All in lower case, parameters sorted, no fragment."""
    low = F.lower(url)
    return _with(F.regexp_extract(low, r"^([^?#]*)", 1), F.array_sort(parameters(low)))


def links(text: Column) -> Column:
    """Urls in the text in order, each once."""
    found = F.regexp_extract_all(text, F.lit(r"""https?://[^\s<>"')\]]+"""), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def extracted(text: Column) -> Column:
    """Urls of a text, normalised, each once: of markdown links, in quotes, in round brackets, then bare ones without signs at
    their end; percent escapes are decoded first. (F34)"""
    bare = F.transform(F.regexp_extract_all(text, F.lit(r"https?://[^\s)\]]+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"""["'](https?://[^"']+)["']"""), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"\((https?://[^)]+)\)"), F.lit(1)),
        bare,
    )
    # Plus signs are letters here.
    decoded = F.transform(found, lambda u: F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u))
    whole = lambda u: F.when(u.contains("://"), normalised(u)).otherwise(u)
    return F.coalesce(F.filter(F.array_distinct(F.transform(decoded, whole)), lambda u: u != ""), F.array().cast("array<string>"))
