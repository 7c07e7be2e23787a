"""Bounded scans: history in batches, periods, overlapping re-reads, typed payload filters, sections of a text. (S01, S03, ST12, P10, F77)"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a batch, and batches of a scan by its mode.
BATCH = 50
MOST_BATCHES = {"historical": 200, "incremental": 100}


def history(rows: DataFrame, key: str, at: str, order: str, since: Column, mode: str = "incremental", batch: int = BATCH) -> DataFrame:
    """Rows of each key from `since` on with `batch` (from 0), newest first, as many as the mode's batches hold."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))
    kept = rows.where(F.col(at) >= since).withColumn("k", k).where(F.col("k") <= batch * MOST_BATCHES[mode])
    return kept.withColumn("batch", F.floor((F.col("k") - 1) / batch)).drop("k")


def period(rows: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Rows from start to end, both included; none if the start is after the end."""
    return rows.where(F.col(at).between(start, end))


def reread(stored: DataFrame, source: DataFrame, key: str, unique: str, at: str, overlap: Column) -> DataFrame:
    """Rows of the source from an overlap before each key's newest stored row on, which are not stored yet, each once; keys
    without stored rows are read whole. Rows that come late, within the overlap, are found. (ST12)"""
    since = stored.groupBy(key).agg((F.max(at) - overlap).alias("since"))
    new = source.join(since, key, "left").where(F.col("since").isNull() | (F.col(at) >= F.col("since"))).drop("since")
    return new.join(stored.select(key, unique), [key, unique], "left_anti").dropDuplicates([key, unique])


def payload_filter(tenant: Column, tenant_id, conditions: dict[str, object], column=F.col) -> Column:
    """A predicate for a payload's fields; the tenant is mandatory. (P10)

    A list means any of its values, {"range": {"gte", "gt", "lte", "lt"}} a range, anything else equality.
    """
    if tenant_id in (None, ""):
        raise ValueError("a search needs a tenant")
    compare = {"gte": Column.__ge__, "gt": Column.__gt__, "lte": Column.__le__, "lt": Column.__lt__}

    def one(name: str, wanted: object) -> Column:
        c = column(name)
        if isinstance(wanted, list):
            return c.isin(wanted)
        if isinstance(wanted, dict) and "range" in wanted:
            return reduce(Column.__and__, [compare[k](c, F.lit(v)) for k, v in wanted["range"].items()], F.lit(True))
        return c == F.lit(wanted)

    return reduce(Column.__and__, [one(n, w) for n, w in conditions.items()], tenant == F.lit(tenant_id))


def sections(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, section, title, items) of markdown: a line that begins with ## begins a section, one with a hyphen is an item, without any
    hyphen; what stands before the first section is left out. (F77)"""
    lines = rows.select(row_id, F.posexplode(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))).alias("k", "line"))
    begins = F.col("line").startswith("##")
    numbered = lines.withColumn("section", F.sum(begins.cast("int")).over(Window.partitionBy(row_id).orderBy("k"))).where("section > 0")
    item = F.when(~begins & F.col("line").startswith("-"), F.struct("k", F.trim(F.replace("line", F.lit("-"), F.lit(""))).alias("item")))
    title = F.max(F.when(begins, F.trim(F.replace("line", F.lit("##"), F.lit("")))))
    return numbered.groupBy(row_id, "section").agg(title.alias("title"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("items"))
