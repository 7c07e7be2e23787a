"""One table of typed edges, from nested records, merged by kind and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ["kind", "source", "target", "n", "first_seen", "last_seen"]


def node(label: str, *key: Column) -> Column:
    """A node's name: its label and key; null where a part of the key is."""
    return F.concat(F.lit(f"{label}:"), F.concat(*[x for k in key for x in (F.lit("/"), k.cast("string"))][1:]))


def edges_of(rows: DataFrame, at: Column, kinds: dict[str, tuple[Column, Column]]) -> DataFrame:
    """EDGES of rows, each giving an edge of every kind whose ends it has; a target may be an array, for an edge to each
    of its elements. One pass over the rows; edges are added up where they meet."""

    def one(kind: str, source: Column, target: Column) -> Column:
        several = rows.select(target.alias("x")).schema["x"].dataType.typeName() == "array"
        ends = F.transform(target if several else F.array(target), lambda t: F.struct(F.lit(kind).alias("kind"), source.alias("source"), t.alias("target")))
        return F.coalesce(ends, F.array().cast("array<struct<kind:string,source:string,target:string>>"))

    flat = rows.select(at.alias("at"), F.inline(F.flatten(F.array(*[one(kind, *ends) for kind, ends in kinds.items()]))))
    met = flat.where("source IS NOT NULL AND target IS NOT NULL")
    return met.groupBy("kind", "source", "target").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """EDGES of both: counts are added, the first and last sight kept. Merging the same edges twice counts them twice."""
    both = old.select(EDGES).unionByName(new.select(EDGES))
    return both.groupBy("kind", "source", "target").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def detach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without those that touch one of the nodes (name)."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("name").alias(end)).distinct(), end, "left_anti")
    return edges.select(EDGES)
