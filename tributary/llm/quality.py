"""Quality rules, line first: judge each line, drop the lines that fail, then
reject the documents that lose too much.

Native: DataFrame functions only, one pass over each text, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

#: Fixed values of the line rules.
TERMINAL = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
NAVIGATION = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "we use cookies", "enable javascript", "lorem ipsum", "click here", "sign up", "subscribe to", "powered by",
]
#: What a line must hold for the rules on navigation, symbols and shouting to apply.
SPECIAL = r"[|»›•·#*$%&<>!]"
#: A line is navigation with this many separators, or one for every four words.
NAVIGATION_MARKS = 3
#: Repeated windows of a text that are looked up one by one.
FEW = 32
#: A document that loses more than this share of its word characters is rejected.
MOST_LOST = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, then) -> Column:
    """then(value), with value evaluated once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each worked out once a row: what follows cannot be
    merged into them, nor filters be moved below, as with withColumns."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Only where distinct windows are fewer than windows. The hashes that repeat are
    neighbours once sorted; few are looked up one by one, many by sorting the
    windows themselves. The starts of repeated windows, in text order, each cover
    three words less what the next one covers as well.
    """

    def sorted_starts(windows: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            before = F.get(windows, i - 1)["h"]
            after = F.get(windows, i + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(windows, repeated), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda total, n: total + n,
        )

    def counted(hashes: Column) -> Column:
        several = _let(F.sort_array(hashes), lambda w: F.array_distinct(F.filter(w, lambda x, i: x == F.get(w, i + 1))))
        looked_up = lambda d: F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(d, F.get(hashes, i)))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = _let(several, lambda d: F.when(F.size(d) <= FEW, looked_up(d)).otherwise(_let(pairs, sorted_starts)))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(starts, covered)).otherwise(F.lit(0).cast("long"))

    hashes = F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 2)), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(hashes, counted)


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule: it does not end as a sentence
    does; it is a row of links; it is boilerplate; most of its words shout or
    carry symbols. A line without a word does not fail."""

    def crowded(words: Column) -> Column:
        marks = F.regexp_count(line, F.lit(NAVIGATION))
        return (
            _let(marks, lambda n: (n >= NAVIGATION_MARKS) | (n * 4 >= words) & (n > 0))
            | (F.regexp_count(line, F.lit(SYMBOLS)) >= words)
            | (F.regexp_count(line, F.lit(r"\p{Lu}{2,}!")) * 2 >= words)
        )

    def boilerplate(lower: Column) -> Column:
        return reduce(Column.__or__, [lower.contains(phrase) for phrase in BOILERPLATE])

    return line.rlike(WORD) & (
        ~line.rlike(TERMINAL) | line.rlike(SPECIAL) & _let(F.regexp_count(line, F.lit(WORD)), crowded) | _let(F.lower(line), boilerplate)
    )


def quality_rules(docs: DataFrame, text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Each row of docs with its counts, the cleaned text and the verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, lost_chars (word characters in lines that fail), clean_text
    (the other lines, joined as they were) and kept; columns of these names are
    replaced. Null and empty texts have no words: all counts 0, clean_text
    empty, base_failed true, kept false. Rows are judged one by one, so
    repeated rows come out repeated.
    """
    rows = docs.drop(*BASE, "base_failed", "lost_chars", "clean_text", "kept")
    rows = _once(rows, __text=F.coalesce(F.col(text), F.lit("")))
    rows = _once(rows, __words=_words(F.col("__text")), __lines=F.split("__text", "\n", -1))
    rows = _once(
        rows,
        n_words=F.size("__words").cast("long"),
        word_chars=F.length(F.array_join("__words", "")).cast("long"),
        n_symbols=F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=_let(F.filter("__lines", lambda x: x.rlike(WORD)), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        n_repeat_words=_repeat_words(F.col("__words")),
        clean_text=F.array_join(F.filter("__lines", lambda x: ~line_fails(x)), "\n"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = _once(rows, base_failed=failed, lost_chars=F.when(F.col("clean_text") == F.col("__text"), F.lit(0).cast("long")).otherwise(F.col("word_chars") - F.length(F.array_join(_words(F.col("clean_text")), ""))))
    kept = ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(most_lost) * F.col("word_chars"))
    return rows.withColumn("kept", kept).drop("__text", "__words", "__lines")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", "lost_chars")


_LINE_FAILS = f"""(wn > 0 AND (NOT regexp_matches(line, '{TERMINAL.replace("'", "''")}')
    OR marks >= {NAVIGATION_MARKS} OR (marks * 4 >= wn AND marks > 0)
    OR {" OR ".join(f"contains(lower(line), '{x}')" for x in BOILERPLATE)}
    OR symbols >= wn OR shouted * 2 >= wn))"""

OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w FROM docs),
starts AS (SELECT r, w, unnest(range(greatest(len(w) - 2, 0))) AS i FROM words),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i + 1], w[i + 2], w[i + 3]) AS n FROM starts),
covered AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words
    FROM windows, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs),
judged AS (SELECT r, line, len(regexp_extract_all(line, '{WORD}')) AS wn,
    len(regexp_extract_all(line, '{NAVIGATION}')) AS marks, len(regexp_extract_all(line, '{SYMBOLS}')) AS symbols,
    len(regexp_extract_all(line, '\\p{{Lu}}{{2,}}!')) AS shouted,
    length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars FROM lines),
by_doc AS (SELECT r, count(*) FILTER (wn > 0) - count(DISTINCT line) FILTER (wn > 0) AS n_dup_lines,
    coalesce(sum(chars), 0) AS word_chars, coalesce(sum(symbols), 0) AS n_symbols,
    coalesce(sum(chars) FILTER ({_LINE_FAILS}), 0) AS lost_chars FROM judged GROUP BY r),
counted AS (SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    lost_chars::BIGINT AS lost_chars
    FROM words JOIN by_doc USING (r) LEFT JOIN covered USING (r))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= {MOST_LOST} * word_chars AS kept
FROM counted"""
