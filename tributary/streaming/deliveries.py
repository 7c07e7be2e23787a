"""Messages that are handled, delivered again, or end as dead letters. (S09, S10, ST01, ST15, X01)"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DONE, AGAIN, DEAD = "done", "again", "dead"
#: Deliveries after which a message is dead.
MOST_DELIVERIES = 5


class Deliveries:
    """A foreachBatch sink. `handle` gives each row, which has `deliveries` (from 1), ok, reason and details.

    A row that is not ok comes again with the next batch, before new rows, and is a dead letter after `most` deliveries.
    What batch n makes of its rows is written as a whole, from its rows and what batch n - 1 left, so a
    batch that runs again replaces what it wrote.
    """

    def __init__(self, path: str, schema: StructType, handle: Callable[[DataFrame], DataFrame], most: int = MOST_DELIVERIES):
        self.path, self.handle, self.most = path, handle, most
        self.names = schema.names
        self.schema = StructType([*schema.fields, *StructType.fromDDL("deliveries int, reason string, details string, status string").fields])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        waiting = self.decided(batch.sparkSession, epoch - 1).where(F.col("status") == AGAIN).select(*self.names, (F.col("deliveries") + 1).alias("deliveries"))
        tried = self.handle(waiting.unionByName(batch.select(*self.names, F.lit(1).alias("deliveries"))))
        status = F.when(F.col("ok"), DONE).when(F.col("deliveries") >= self.most, DEAD).otherwise(AGAIN)
        kept = tried.withColumn("status", status).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        kept.write.mode("overwrite").partitionBy("status").parquet(f"{self.path}/epoch={epoch}")

    def decided(self, spark: SparkSession, epoch: int) -> DataFrame:
        if epoch < 0:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch}")

    def done(self, spark: SparkSession) -> DataFrame:
        return self._all(spark, DONE)

    def dead_letters(self, spark: SparkSession) -> DataFrame:
        """(payload, reason, details, deliveries, epoch): the whole message as JSON, and why it failed last."""
        return self._all(spark, DEAD).select(F.to_json(F.struct(*self.names)).alias("payload"), "reason", "details", "deliveries", "epoch")

    def _all(self, spark: SparkSession, status: str) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL("epoch long").fields])).parquet(self.path).where(F.col("status") == status)


def published(rows: DataFrame, path: str, newest: int | None = None, order: str = "id") -> None:
    """Rows as messages of a stream's folder; with a bound only the newest, by `order`, are kept: retention is the sink's."""
    kept = rows if newest is None else rows.orderBy(F.desc(order)).limit(newest)
    kept.write.mode("append").parquet(path)
