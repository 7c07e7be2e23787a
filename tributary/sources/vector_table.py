"""Collections of vectors in buckets of ids: upsert, delete and search.

Rows of a collection lie in `bucket=k` folders by a hash of their id. A write reads the
buckets that it touches and replaces these, by dynamic partition overwrite; the files of all
others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import vectors
from .shared import stash

#: Letters of a text, labels, objects and colours that a payload keeps.
TEXT, LABELS, OBJECTS, COLOURS = 500, 20, 10, 5


def payload(**fields: Column) -> Column:
    """A flat struct of what is kept beside a vector, with the caps above for text, labels, objects and dominant_colors;
    null lists stay null. (S20)"""
    caps = {
        "text": lambda c: F.substring(c, 1, TEXT),
        "labels": lambda c: F.slice(c, 1, LABELS),
        "objects": lambda c: F.slice(c, 1, OBJECTS),
        "dominant_colors": lambda c: F.slice(c, 1, COLOURS),
    }
    return F.struct(*[caps.get(name, lambda c: c)(c).alias(name) for name, c in fields.items()])


class Collection:
    """Rows (id, v, payload) of one size of vectors under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, size: int, payload_type: str, buckets: int = 64):
        self.spark, self.path, self.size, self.buckets = spark, path, size, buckets
        # A null id marks a bucket from which all rows were deleted.
        self.schema = StructType.fromDDL(f"id long, v array<float>, payload {payload_type}, bucket int")

    def ensure(self) -> Collection:
        """Make the collection if there is none."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            self._write(self.spark.createDataFrame([], self.schema))
        return self

    def rows(self) -> DataFrame:
        return self._stored().where("id IS NOT NULL").drop("bucket")

    def upsert(self, rows: DataFrame, newest: Column | None = None) -> None:
        """Rows (id, v, payload) replace those with their ids, payload and all. Of rows with one id the one with the greatest `newest`
        is taken, else any. Rows without an id are left out; a vector of another size is an error."""
        right = F.when(F.size("v") == self.size, F.col("v").cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector has not {self.size} components")))
        order = F.struct(newest if newest is not None else F.lit(0), F.xxhash64("id", "v"))
        new = rows.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.struct(right.alias("v"), F.col("payload").cast(self.schema["payload"].dataType).alias("payload")).alias("row"), order.alias("order"))
        new = stash(new.groupBy("id").agg(F.max_by("row", "order").alias("row")).select("id", "row.*", self._bucket().alias("bucket")), "upserted")
        kept = self._touched(new).join(new.select("id"), "id", "left_anti").select(new.columns)
        self._write(stash(kept.unionByName(new), "merged"))

    def delete(self, ids: DataFrame) -> None:
        """Rows with these ids (id) go; ids that are not there change nothing."""
        gone = stash(ids.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct().withColumn("bucket", self._bucket()), "deleted")
        stored = self._touched(gone)
        hit = stored.join(gone.select("id"), "id", "left_semi").select("bucket").distinct()
        kept = stored.join(F.broadcast(hit), "bucket").join(gone.select("id"), "id", "left_anti").select(self.schema.names)
        marks = hit.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[:-1]], "bucket")
        self._write(stash(kept.unionByName(marks), "merged"))

    def search(self, queries: DataFrame, k: int, where: Column | None = None, at_least: float = -1.0) -> DataFrame:
        """(query_id, id, similarity, rank, payload): the k nearest rows of each query (query_id, q) that meet `where`."""
        rows = self.rows() if where is None else self.rows().where(where)
        queries = queries.select("query_id", F.col("q").cast("array<float>").alias("q"))
        # A query is no row, whatever its number.
        found = vectors.search(queries.withColumn("query_id", -1 - F.col("query_id")), rows.select("id", "v"), k, at_least)
        return found.withColumn("query_id", -1 - F.col("query_id")).join(rows.select("id", "payload"), "id").select("query_id", "id", "similarity", "rank", "payload")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _touched(self, rows: DataFrame) -> DataFrame:
        """Stored rows of the buckets of these; there are at most `buckets` numbers."""
        numbers = [r.bucket for r in rows.select("bucket").distinct().collect()]
        return self._stored().where(F.col("bucket").isin(numbers) & F.col("id").isNotNull())

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
