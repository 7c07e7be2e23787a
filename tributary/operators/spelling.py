"""Spelling by a symmetric-delete index.

Two words within d edits become equal if at most d letters are deleted from each. So unknown words and
known ones meet in an equi-join on what is left of them, and only what meets is compared letter by letter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters from the start of a word of which some are deleted; what follows is compared only. Edits at most.
PREFIX, EDITS = 10, 2
WORD = r"\p{L}{2,}"


def normalised(text: Column) -> Column:
    """White space as one space, lone signs between spaces dropped, quotes straightened, trimmed; null as empty."""
    once = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{200B}-\x{200D}]+", " ")
    lone = F.regexp_replace(once, r"(?U)\s+[^\w\s]\s+", " ")
    return F.trim(F.translate(lone, "“”„‘’", "\"\"\"''"))


def language(text: Column) -> Column:
    """ru if a letter is Cyrillic, else en."""
    return F.when(text.rlike("[а-яёА-ЯЁ]"), "ru").otherwise("en")


def vocabulary(texts: DataFrame, text: str, least: int) -> DataFrame:
    """(word, n): words in lower case that occur at least so often."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def deletions(word: Column, edits: int = EDITS, prefix: int = PREFIX) -> Column:
    """What is left of a word's first letters when none to `edits` of them are deleted, each once."""
    found = level = F.array(F.substring(word, 1, prefix))
    for _ in range(edits):
        shorter = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def corrections(words: DataFrame, known: DataFrame, edits: int = EDITS, prefix: int = PREFIX) -> DataFrame:
    """(word, correction, distance, n) of words (word) that are not known (word, n): the known word of fewest edits, the most frequent of equals,
    then the first by its letters. Words without one within `edits`, and null, have no row; repeated words have one.
    """
    unknown = words.where("word IS NOT NULL").select("word").distinct().join(known.select("word"), "word", "left_anti")
    one = unknown.select("word", F.explode(deletions(F.col("word"), edits, prefix)).alias("left"))
    other = known.select(F.col("word").alias("correction"), "n", F.explode(deletions(F.col("word"), edits, prefix)).alias("left"))
    met = one.join(other, "left").where(F.abs(F.length("word") - F.length("correction")) <= edits).select("word", "correction", "n").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "correction", edits)).where("distance >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("n")).alias("m"), "correction")).alias("b"))
    return best.select("word", "b.correction", "b.distance", (-F.col("b.m")).alias("n"))


def corrected(texts: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """(id, text) of texts (id, text) with the words of corrections replaced, in order; a corrected word is in lower case."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}|(?:(?!{WORD})[\s\S])+"), F.lit(0))
    rows = texts.select("id", F.posexplode_outer(pieces).alias("k", "piece")).withColumn("word", F.lower("piece"))
    fixed = rows.join(found.select("word", "correction"), "word", "left").withColumn("piece", F.coalesce("correction", "piece"))
    return fixed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias(text))
