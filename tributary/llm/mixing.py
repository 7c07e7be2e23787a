"""Mixing sources to target weights: a minimum-cost flow from groups of documents
with the same memberships to the sources' quotas, then seeded documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, stash, table

#: Weights of the query, dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: A document is used this often at most; each further use costs more.
MOST_USES = 3
#: Distinct membership patterns (and so sources) that the plan may have: the
#: flow is solved on the driver over one row for each.
MOST_PATTERNS = 20_000
SEED = 20
#: Buckets of the document hash at each of two levels.
BITS = 12


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_USES) -> dict[str | None, float]:
    """What each source should give: shares of the whole by weight, none above
    `most` times its size; what exceeds that is shared among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    whole, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = whole - sum(capped.values())
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: float(capped.get(s, share.get(s, 0.0))) for s in order}
        capped |= {s: most * sizes[s] for s in over}


def min_cost_flow(supply: dict[str, int], members: dict[str, list[str]], quota: dict[str, int], uses: int = MOST_USES) -> dict[tuple[str, str], int]:
    """Words that each pattern gives to each of its sources.

    A pattern's arc for the k-th use of its documents holds its size and costs k,
    the same for all patterns, so the cost of a path depends on that arc alone:
    the successive shortest paths are the augmenting paths with the arcs of the
    first use open, then the second, and so on. Earlier flow may be rerouted.
    """
    flow: dict[tuple[str, str], int] = {}
    left = dict(quota)
    gives: dict[str, set[str]] = {s: set() for s in quota}
    for _ in range(uses):
        room = dict(supply)
        for p in sorted(supply):
            while room[p] > 0:
                # Breadth first: pattern -> source, and back along flow that could move.
                came: dict[tuple[str, str], tuple[str, str] | None] = {("p", p): None}
                queue: list[tuple[str, str]] = [("p", p)]
                end: tuple[str, str] | None = None
                for kind, x in queue:
                    if kind == "s" and left[x] > 0:
                        end = (kind, x)  # x may be None, the source of rows without one
                        break
                    nxt = [("s", s) for s in members[x]] if kind == "p" else [("p", q) for q in sorted(gives[x])]
                    for y in nxt:
                        if y not in came:
                            came[y] = (kind, x)
                            queue.append(y)
                if end is None:
                    break
                path, at = [], end
                while at is not None:
                    path.append(at)
                    at = came[at]
                path.reverse()
                amount = min(room[p], left[end[1]])
                for (k, a), (_, b) in zip(path, path[1:]):
                    if k == "s":
                        amount = min(amount, flow[b, a])
                for (k, a), (_, b) in zip(path, path[1:]):
                    if k == "p":
                        flow[a, b] = flow.get((a, b), 0) + amount
                        gives[b].add(a)
                    else:
                        flow[b, a] -= amount
                        if not flow[b, a]:
                            gives[a].discard(b)
                room[p] -= amount
                left[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _boundary(rows: DataFrame, bucket: str, need: str) -> DataFrame:
    """Per pattern, the bucket in which the words still needed run out, and what
    is needed of it. Grouped sums first: a window sees one row a bucket."""
    sums = rows.groupBy("pattern", bucket).agg(F.sum("size").alias("n"), F.first(need).alias("need"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy(bucket)) - F.col("n")
    return sums.withColumn("before", before).where("before < need AND need <= before + n").select("pattern", F.col(bucket).alias("cut"), (F.col("need") - F.col("before")).alias("rest"))


def mix(docs: DataFrame, memberships: Column | None = None, weights: tuple[int, ...] = WEIGHTS, uses: int = MOST_USES, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, memberships, size, source_size, target, taken.

    memberships: an array of the sources a document belongs to (by default its
    `source` alone; null is a source of its own). Size: words in the text (null:
    0). source_size and target are those of the first membership. taken: words
    the mix takes of it, repeats counted, at most `uses` times its size: whole
    passes, and where a pattern's quota ends within a pass, the documents that
    come first by a seeded hash of doc_id, the last of them in part. An empty
    table gives no rows; empty texts take nothing; documents with equal doc_id
    and size are interchangeable. Reruns agree.

    The text is read once, into a written table of four narrow columns. What
    runs out where is found by sums over hash buckets at two levels, so no task
    orders more than one bucket in 2^24 of a pattern.
    """
    spark = docs.sparkSession
    held = F.array("source") if memberships is None else memberships
    narrow = stash(
        docs.select("doc_id", F.array_sort(F.array_distinct(held)).alias("memberships"), _words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
        .withColumn("pattern", F.to_json("memberships", {"ignoreNullFields": "false"}))
        .withColumns({"b1": F.shiftrightunsigned("h", 64 - BITS).cast("int"), "b2": F.shiftrightunsigned(F.shiftleft("h", BITS), 64 - BITS).cast("int")}),
        "mix",
    )
    found = narrow.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of membership")
    supply = {r.pattern: r.size for r in found}
    members = {p: json.loads(p) for p in supply}
    sizes: dict[str | None, int] = {}
    for p, n in supply.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    target = targets(sizes, weights, uses) if sizes else {}
    quota = {s: round(x) for s, x in target.items()}
    flow = min_cost_flow(supply, members, quota, uses)
    total: dict[str, int] = {}
    for (p, _), n in flow.items():
        total[p] = total.get(p, 0) + n
    rows = [
        (p, sizes[members[p][0]] if members[p] else 0, target[members[p][0]] if members[p] else 0.0, *(divmod(total.get(p, 0), supply[p]) if supply[p] else (0, 0)))
        for p in supply
    ]
    schema = T.StructType.fromDDL("pattern string, source_size long, target double, passes long, need long")
    plan = F.broadcast(spark.createDataFrame(rows, schema))  # a row a pattern: bounded by MOST_PATTERNS
    planned = narrow.join(plan, "pattern")
    first = F.broadcast(_boundary(planned.where("need > 0"), "b1", "need").withColumnRenamed("cut", "cut1").withColumnRenamed("rest", "rest1"))
    edge = planned.join(first, "pattern").where("b1 = cut1")
    second = F.broadcast(_boundary(edge, "b2", "rest1").withColumnRenamed("cut", "cut2").withColumnRenamed("rest", "rest2"))
    placed = planned.join(first, "pattern", "left").join(second, "pattern", "left")
    extra = F.when(F.col("need") == 0, 0).when(F.col("b1") != F.col("cut1"), F.when(F.col("b1") < F.col("cut1"), F.col("size")).otherwise(0)).when(F.col("b2") < F.col("cut2"), F.col("size")).otherwise(0)
    at_edge = "need > 0 AND b1 = cut1 AND b2 = cut2"
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("rest2") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.where(at_edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    whole = placed.where(f"NOT coalesce({at_edge}, false)").withColumn("extra", extra)
    return whole.unionByName(last).select("doc_id", "memberships", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
