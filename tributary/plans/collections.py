"""Collections of vectors that are written and searched, and markup in parts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..sources import vector_table
from ..sources.adapters import table
from ..sources.shared import shared_dir
from .registry import query

_UNIT = "(sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)))"


@query(f"""WITH d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 7 <> 3),
    moved AS (SELECT id, CASE WHEN id % 5 = 0 THEN list_transform(v, lambda x: -x) ELSE v END AS v, CASE WHEN id % 5 = 0 THEN label + 100 ELSE label END AS label FROM d),
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, id, label, list_inner_product(q, v) / {_UNIT} AS similarity FROM q, moved)
    SELECT query_id, id, label, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5""")
def vector_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection is made, rows are upserted twice and deleted, and it is searched."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    kept = lambda df: df.select("id", "v", vector_table.payload(label=F.col("label"), text=F.concat(F.lit("vector "), F.col("id").cast("string")), labels=F.array(F.col("label").cast("string"))).alias("payload"))
    held = vector_table.Collection(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}", 64, "struct<label: int, text: string, labels: array<string>>", 16).ensure()
    held.upsert(kept(rows))
    again = rows.where("id % 5 = 0").withColumn("v", F.transform("v", lambda x: -x)).withColumn("label", F.col("label") + 100)
    held.upsert(kept(again))
    held.delete(rows.where("id % 7 = 3").select("id"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return held.search(queries, 5).select("query_id", "id", F.col("payload.label").alias("label"), "rank", F.round("similarity", 6).alias("similarity"))


@query()
def markup_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as html, in parts of 1,000 visible characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", markup.to_html(F.col("text")).alias("markup"))
    return markup.in_parts(rows, "markup", 1000).select("doc_id", "part", "piece")
