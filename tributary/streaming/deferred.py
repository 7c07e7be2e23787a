"""Work over the budget is put off to a table that the next batch reads first. (ST21, ST08)

Batch n is decided from its rows and from what batch n - 1 has written, and written as a whole
to `epoch=n`. A batch that runs again therefore finds what it found before and replaces what it
wrote: no row is lost or taken twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budgets import Rolling

ACCEPTED, WAITING, GIVEN_UP, SPENT, CLOCK = "accepted", "waiting", "given up", "spent", "clock"
ROWS = "tenant long, id long, micros long, tokens long"
DECIDED = f"{ROWS}, retries int, taken_at long, status string"


class DeferredQueue:
    """A foreachBatch sink for rows of ROWS, micros being their time.

    Of each tenant, rows are taken in order of time, deferred ones at the time from which they may be tried again,
    or at the batch's begin if that is later. What the rolling budget refuses waits `delay_seconds`
    times the number of its tries; after `most_retries` retries it is given up. Deferred rows that are
    not due by the end of the batch stay as they are.
    """

    def __init__(self, path: str, limit: int, budget: int, window_seconds: int, delay_seconds: int, most_retries: int):
        self.path, self.limit, self.budget = path, limit, budget
        self.window, self.delay, self.most_retries = window_seconds * 1_000_000, delay_seconds * 1_000_000, most_retries

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = self.decided(spark, epoch - 1)
        begin, end = batch.agg(F.min("micros"), F.max("micros")).first()
        last = before.where(F.col("status") == CLOCK).agg(F.max("taken_at")).first()[0]
        end = max([t for t in (end, last) if t is not None], default=0)
        begin = end if begin is None else begin
        none = F.lit(None).cast("long")
        spent = before.where(F.col("status").isin(ACCEPTED, SPENT) & (F.col("taken_at") >= begin - self.window)).withColumns({"status": F.lit(SPENT), "due": none, "kind": F.lit(0)})
        waiting = before.where(F.col("status") == WAITING).withColumn("due", F.greatest("taken_at", F.lit(begin))).withColumn("kind", F.lit(1))
        new = batch.select("tenant", "id", "micros", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.lit(0).alias("retries"), none.alias("taken_at"), F.lit(WAITING).alias("status"), F.col("micros").alias("due"), F.lit(2).alias("kind"))
        rows = spent.unionByName(waiting).unionByName(new)
        ordered = rows.repartition("tenant").sortWithinPartitions("tenant", F.col("kind") > 0, F.when(F.col("kind") == 0, F.col("taken_at")).otherwise(F.col("due")), "kind", "id")
        clock = spark.createDataFrame([(None, None, None, None, None, end, CLOCK)], DECIDED)
        ordered.mapInPandas(self._decide(end), DECIDED).unionByName(clock).write.mode("overwrite").partitionBy("status").parquet(f"{self.path}/epoch={epoch}")

    def decided(self, spark: SparkSession, epoch: int) -> DataFrame:
        """What a batch has decided; none before the first."""
        if epoch < 0:
            return spark.createDataFrame([], DECIDED)
        return spark.read.schema(DECIDED).parquet(f"{self.path}/epoch={epoch}")

    def accepted(self, spark: SparkSession) -> DataFrame:
        """Rows that were taken, and when."""
        return spark.read.schema(f"{DECIDED}, epoch long").parquet(self.path).where(F.col("status") == ACCEPTED).drop("status")

    def given_up(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{DECIDED}, epoch long").parquet(self.path).where(F.col("status") == GIVEN_UP).drop("status")

    def _decide(self, end: int):
        limit, budget, window, delay, most = self.limit, self.budget, self.window, self.delay, self.most_retries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, state = None, None
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    if row.tenant != now:
                        now, state = row.tenant, Rolling(limit, budget, window)
                    retries, taken, status = int(row.retries), row.taken_at, row.status
                    if row.kind == 0:
                        state.add(int(taken), int(row.tokens))
                    elif row.due <= end:
                        taken = int(row.due)
                        if state.allows(taken, int(row.tokens)):
                            status = ACCEPTED
                        elif retries >= most:
                            status = GIVEN_UP
                        else:
                            retries, taken = retries + 1, taken + delay * (retries + 1)
                    out.append((row.tenant, row.id, row.micros, row.tokens, retries, int(taken), status))
                yield pd.DataFrame(out, columns=["tenant", "id", "micros", "tokens", "retries", "taken_at", "status"])

        return run
