"""Pages, objects and spelling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spelling
from ..sources import pages
from ..sources.adapters import table
from ..sources.shared import shared_dir
from .registry import query

#: A word is known if it occurs so often, and asked for if it occurs once.
_KNOWN = 20
#: DuckDB compares bytes: letters of two bytes become capitals, which words in lower case lack.
_LETTERS = "translate({}, 'éèêëàâçôöüäßùûîïñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')"


@query(f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{2,}}')) AS word FROM documents) GROUP BY 1),
    m AS (SELECT a.word, b.word AS correction, levenshtein({_LETTERS.format("a.word")}, {_LETTERS.format("b.word")}) AS distance, b.n FROM w a JOIN w b ON a.n = 1 AND b.n >= {_KNOWN} AND abs(length(a.word) - length(b.word)) <= 2)
    SELECT word, correction, distance::INTEGER AS distance, n FROM m WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, correction) = 1""")
def spelling_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """words that occur once, and the known word that each may stand for."""
    words = spelling.vocabulary(table(spark, sf_dir, "documents"), "text", 1)
    return spelling.corrections(words.where("n = 1"), words.where(F.col("n") >= _KNOWN))


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY 1")
def paged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read page by page."""
    schema = table(spark, sf_dir, "lineitem").schema
    rows = pages.read_pages(spark, f"{sf_dir}/lineitem.parquet", schema)
    return rows.where("l_discount > 0.05").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first, round(sum(value), 4) AS total, 'events/' || event_type || '/' || min(event_id) || '.json' AS key FROM events GROUP BY 1")
def stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are put as packed JSON, listed, and read back; every type has a key."""
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    pages.put_json(rows, path)
    files = [r.key for r in pages.objects(spark, path, "*.json.gz", 100_000).collect()]
    back = pages.get_json(spark, path, rows.schema) if files else rows.limit(0)
    found = back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.round(F.sum("value"), 4).alias("total"))
    return found.withColumn("key", pages.object_key("events", F.col("event_type"), F.col("first").cast("string"), suffix=".json"))
