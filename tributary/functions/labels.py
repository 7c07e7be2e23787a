"""Keywords, labels and texts of a trend as Column expressions. Stop words are a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as texts

#: Letters that an embedding's text takes of each part, of labels, summaries and lists; signs cut off a term.
POST, DESCRIPTION, SEEN, PAGE, LEAST_DESCRIPTION = 2000, 500, 300, 1500, 5
LABEL, SUMMARY, KEYWORDS, PHRASES = 120, 600, 10, 10
EDGES = r""".,!?:;"'()[]{}"""
NO_LABEL, BETWEEN = "Тренд", " — "

_EDGE = r"""[.,!?:;"'()\[\]{}]+"""


def _stop(stop: Iterable[str] | None) -> Column:
    return F.array(*[F.lit(w) for w in (texts.STOP_WORDS if stop is None else stop)]).cast("array<string>")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value worked out once for a row: what a lambda takes from outside is worked out anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_by(values: Column, key=lambda x: x) -> Column:
    """Values whose key did not come before, in order."""
    return once(values, lambda v: once(F.transform(v, key), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def squeezed(text: Column) -> Column:
    """White space as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def squeezed_head(text: Column, most: int) -> Column:
    """The first `most` letters of `squeezed`. A stretch of the text that gives as many is enough, as it ends in no white
    space then and what follows changes nothing before it; any other text is squeezed as a whole."""
    return once(squeezed(F.substring(text, 1, 2 * most)), lambda head: F.substring(F.when(F.length(head) >= most, head).otherwise(squeezed(text)), 1, most))


def embedding_text(post: Column, description: Column, seen: Column, page: Column, page_seen: Column) -> Column:
    """What is embedded of a post: its text, an image's description of five letters or more and text, a page's text and its image's text, each
    up to its cap, parts that repeat left out whatever their case, joined by a space; empty if all are. (F08)"""
    long_enough = F.when(F.length(F.trim(description)) >= LEAST_DESCRIPTION, description)
    parts = F.array(*[squeezed_head(c, n) for c, n in ((post, POST), (long_enough, DESCRIPTION), (seen, SEEN), (page, PAGE), (page_seen, SEEN))])
    return squeezed(F.array_join(first_by(F.filter(parts, lambda p: squeezed(p) != ""), lambda p: F.lower(squeezed(p))), " "))


def filtered_terms(terms: Column, stop: Iterable[str] | None = None) -> Column:
    """Terms of three letters or more, no stop words, numbers or @names, without signs at their ends, single words of four
    letters or more, each once whatever its case, in order. (F12)"""
    words = _stop(stop)
    trimmed = F.transform(F.filter(terms, lambda t: t.isNotNull()), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))

    def good(t: Column) -> Column:
        low = F.lower(t)
        core = F.regexp_replace(t, f"^{_EDGE}|{_EDGE}$", "")
        return (F.length(low) >= 3) & ~F.array_contains(words, low) & ~low.rlike(r"(?U)^\d+$") & ~low.startswith("@") & (core != "") & (core.contains(" ") | (F.length(core) >= 4))

    return F.transform(first_by(F.filter(trimmed, good), F.lower), lambda t: F.regexp_replace(t, f"^{_EDGE}|{_EDGE}$", ""))


def fallback_keywords(content: Column, stop: Iterable[str] | None = None) -> Column:
    """Words of more than four letters and nothing else, in lower case, each once, of which the first ten pass `filtered_terms`."""
    plain = F.filter(F.split(squeezed(content), " "), lambda t: t.rlike(r"^\p{L}{5,}$"))
    return filtered_terms(F.slice(F.array_distinct(F.transform(plain, F.lower)), 1, KEYWORDS), stop)


def entities(content: Column) -> Column:
    """Hashtags, then runs of one to three words with a capital, of three letters or more; each once, in order."""
    tags = F.regexp_extract_all(content, F.lit(r"(?U)#[\w_]+"), F.lit(0))
    names = F.regexp_extract_all(content, F.lit(r"(?U)[A-ZА-ЯЁ][\w\-]+(?:\s+[A-ZА-ЯЁ][\w\-]+){0,2}"), F.lit(0))
    return F.coalesce(F.array_distinct(F.concat(tags, F.filter(names, lambda n: F.length(n) >= 3))), F.array().cast("array<string>"))


def keyphrases(content: Column, stop: Iterable[str] | None = None) -> Column:
    """The first ten pairs, then triples, of neighbouring words of four letters or more that are no stop words or numbers."""
    words = _stop(stop)
    found = F.regexp_extract_all(content, F.lit(r"(?U)[A-Za-zА-Яа-яЁё0-9#@][\w\-]+"), F.lit(0))
    kept = F.filter(found, lambda t: (F.length(t) >= 4) & ~F.array_contains(words, F.lower(t)) & ~t.rlike(r"(?U)^\d+$"))
    runs = lambda n: F.transform(F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - (n - 1))), lambda _, i: F.array_join(F.slice(kept, i + 1, n), " "))
    return F.slice(filtered_terms(F.concat(runs(2), runs(3)), stop), 1, PHRASES)


def generic_label(label: Column, stop: Iterable[str] | None = None) -> Column:
    """Whether a label says too little: a stop word, of less than four letters, or one word that is no hashtag."""
    low = F.trim(F.lower(F.coalesce(label, F.lit(""))))
    return F.array_contains(_stop(stop), low) | (F.length(low) < 4) | (~low.contains(" ") & ~low.startswith("#"))


def primary_label(names: Column, topics: Column, keywords: Column, content: Column, stop: Iterable[str] | None = None) -> Column:
    """The first of: a name of several words or a hashtag; two topics, or one of several words; a phrase of the content;
    two keywords, or one; else a fixed word. Generic ones are passed over; 120 letters at most. (F15)"""
    telling = lambda c: F.filter(c, lambda x: ~generic_label(x, stop))
    two = lambda c: F.when(F.size(c) >= 2, F.concat(F.get(c, 0), F.lit(BETWEEN), F.get(c, 1)))
    subjects, words = telling(topics), telling(keywords)
    chosen = F.coalesce(
        F.get(F.filter(telling(names), lambda x: x.contains(" ") | x.startswith("#")), 0),
        two(subjects),
        F.when((F.size(subjects) == 1) & F.get(subjects, 0).contains(" "), F.get(subjects, 0)),
        F.get(telling(keyphrases(content, stop)), 0),
        two(words),
        F.get(words, 0),
        F.lit(NO_LABEL),
    )
    return F.substring(chosen, 1, LABEL)


def sample_summary(snippets: Column) -> Column:
    """The first two distinct snippets, line breaks as spaces, 600 letters at most."""
    flat = F.transform(F.filter(F.transform(snippets, lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)^\s+|\s+$", "")), lambda s: s != ""), lambda s: F.replace(s, F.lit("\n"), F.lit(" ")))
    return F.substring(F.array_join(F.slice(F.array_distinct(flat), 1, 2), " "), 1, SUMMARY)


def why_important(mentions: Column, baseline: Column, start: Column, end: Column) -> Column:
    """How much more often than usual, in one sentence."""
    minutes = F.greatest(F.lit(1), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 60e6))
    ratio = F.round(mentions / F.greatest(F.lit(1.0), baseline), 2)
    usual = F.greatest(F.lit(1), F.bround(baseline).cast("long"))
    return F.format_string("За последние %d мин зафиксировано %d упоминаний — примерно в %.1f× чаще, чем обычные %d за период.", minutes.cast("long"), mentions.cast("long"), ratio, usual)
