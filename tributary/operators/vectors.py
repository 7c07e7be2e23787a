"""Vectors: cosine similarity, top-k searches, near pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stash

#: Vectors of a block, about, while two blocks a task are few tasks; and at most.
BLOCK_VECTORS = 2_000
MOST_BLOCK_VECTORS = 16_000
#: Tasks of two blocks from which on blocks grow instead.
BLOCK_PAIRS = 200
#: Vectors of one side that are compared with a block at once.
_STRIP = 512
#: A cosine from a matrix product may differ from the exact one by this much.
_SLACK = 1e-9


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """The vector at length one, as doubles; null for a zero vector."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def cosine(a: Column | str, b: Column | str) -> Column:
    """1 - distance."""
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fitted(v: Column | str, size: int) -> Column:
    """Padded with zeros or cut."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


class _Side:
    """Vectors in rows, their ids, and what the cosine needs of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(vectors.T)
        self.squares = np.zeros(len(ids))
        for c in self.columns:
            self.squares += c * c
        norms = np.sqrt(self.squares)
        self.units = vectors / np.where(norms > 0, norms, 1)[:, None]


def _side(pdf: pd.DataFrame) -> _Side:
    return _Side(pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy()).astype(float))


def _exact(x: _Side, y: _Side, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cosines of rows `at` of x and `to` of y, added up in order as `dot` does: equal vectors have equal ones, wherever they lie."""
    dots = np.zeros(len(at))
    for p, q in zip(x.columns, y.columns):
        dots += p[at] * q[to]
    norms = np.sqrt(x.squares[at] * y.squares[to])
    return dots / np.where(norms > 0, norms, np.inf)


class _Best:
    """The k best rows of every query so far: most similar first, the smaller id of equals."""

    def __init__(self, queries: _Side, k: int, at_least: float):
        self.queries, self.k = queries, k
        self.low = np.full(len(queries.ids), at_least if at_least > -1 else -np.inf)
        self.held = [np.zeros(0, int), np.zeros(0), np.zeros(0, int)]

    def add(self, rows: _Side) -> None:
        q, found = self.queries, [self.held]
        for s in range(0, len(q.ids), _STRIP):
            similarity = q.units[s : s + _STRIP] @ rows.units.T
            low = self.low[s : s + _STRIP]
            if len(rows.ids) > self.k + 1:
                # One more than k, as a query may be a row.
                low = np.maximum(low, np.partition(similarity, -self.k - 1, axis=1)[:, -self.k - 1])
            at, to = np.nonzero(similarity >= (low - _SLACK)[:, None])
            at += s
            other = q.ids[at] != rows.ids[to]
            at, to = at[other], to[other]
            exact = _exact(q, rows, at, to)
            near = exact >= self.low[at]
            found.append([at[near], exact[near], rows.ids[to[near]]])
        at, similarity, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, -similarity, at))
        at, similarity, ids = at[order], similarity[order], ids[order]
        starts = np.searchsorted(at, np.arange(len(q.ids)))
        place = np.arange(len(at)) - starts[at]
        full = place == self.k - 1
        self.low[at[full]] = similarity[full]
        kept = place < self.k
        self.held = [at[kept], similarity[kept], ids[kept]]


def _nearest(k: int, at_least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, rows = [], []
        for pdf in batches:
            asked.append(pdf[pdf["asked"]])
            rows.append(pdf[~pdf["asked"]])
        asked, rows = pd.concat(asked), pd.concat(rows)
        if len(asked) and len(rows):
            best = _Best(_side(asked), k, at_least)
            for s in range(0, len(rows), MOST_BLOCK_VECTORS):
                best.add(_side(rows[s : s + MOST_BLOCK_VECTORS]))
            at, similarity, ids = best.held
            yield pd.DataFrame({"query_id": best.queries.ids[at], "id": ids, "similarity": similarity})

    return run


def search(queries: DataFrame, rows: DataFrame, k: int, at_least: float = -1.0) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest rows (id, v) of each query
    (query_id, q). Queries are a stated set. A task compares a block of queries with a share of
    the rows, as matrices, and keeps k a query; what it keeps is exact. (T04, T05, J16)"""
    queries, rows = queries.where("q IS NOT NULL").select(F.col("query_id").alias("id"), F.col("q").alias("v")), rows.where("v IS NOT NULL").select("id", "v")
    blocks = max(1, -(-queries.count() // MOST_BLOCK_VECTORS))
    count = rows.count()
    shares = max(1, -(-count // (5 * MOST_BLOCK_VECTORS)), min(-(-count // BLOCK_VECTORS), -(-BLOCK_PAIRS // (4 * blocks))))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = queries.select("id", "v", part(blocks).alias("i"), every(shares).alias("j"), F.lit(True).alias("asked")), rows.select("id", "v", every(blocks).alias("i"), part(shares).alias("j"), F.lit(False).alias("asked"))
    met = sides[0].unionByName(sides[1]).groupBy("i", "j")
    found = met.applyInPandas(_nearest(k, at_least), "query_id long, id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def near_pairs(rows: DataFrame, block: str, threshold: float) -> DataFrame:
    """(a, b, block, similarity) with a < b within a block over the threshold."""
    return all_near_pairs(rows.where(F.col(block).isNotNull()), threshold, by=[block]).select("a", "b", block, "similarity")


def _compare(threshold: float, by: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        low = pdf["k"] == pdf["i"].iloc[0]
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        if not (same or low.any() and not low.all()):
            return
        x = _side(pdf[low])
        y = x if same else _side(pdf[~low])
        given = {c: pdf[c].iloc[0] for c in by}
        for s in range(0, len(x.ids), _STRIP):
            # Of one block with itself, only what stands behind a row.
            behind = s if same else 0
            at, to = np.nonzero(x.units[s : s + _STRIP] @ y.units[behind:].T > threshold - _SLACK)
            at, to = at + s, to + behind
            if same:
                at, to = (z[at < to] for z in (at, to))
            similarity = _exact(x, y, at, to)
            a, b = x.ids[at], y.ids[to]
            near = (similarity > threshold) & (a != b)
            yield pd.DataFrame({"a": np.minimum(a, b)[near], "b": np.maximum(a, b)[near], "similarity": similarity[near], **given})

    return run


def pair_blocks(count: int, groups: int = 1, least: int = BLOCK_VECTORS) -> int:
    """Blocks of each group that has at most `count` rows, so that every two blocks are a task: small ones
    while tasks are few, then larger ones, as each row goes to as many tasks as there are blocks."""
    enough = max(1, round((2 * BLOCK_PAIRS / max(groups, 1)) ** 0.5))
    return max(1, -(-count // MOST_BLOCK_VECTORS), min(-(-count // least), enough))


def all_near_pairs(rows: DataFrame, threshold: float, block_vectors: int = BLOCK_VECTORS, by: list[str] = []) -> DataFrame:
    """(a, b, similarity, *by) with a < b over the threshold, of all pairs of the rows (id, v),
    or all with equal `by`: every two blocks of rows are compared by one task. Exact, so
    the work is quadratic. (J08, D09)"""
    rows = rows.where("v IS NOT NULL").select("id", "v", *by)
    kinds = "".join(f", {c} {kind}" for c, kind in rows.select(*by).dtypes)
    groups = rows.groupBy(*by).count().agg(F.max("count"), F.count(F.lit(1))).first()
    blocks = pair_blocks(groups[0] or 1, groups[1], block_vectors)
    k = rows.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = k.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select("id", "v", "k", F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), *by)
    return met.groupBy("i", "j", *by).applyInPandas(_compare(threshold, by), f"a long, b long, similarity double{kinds}")


def greedy_clusters(rows: DataFrame, threshold: float, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """(id, cluster): within a label, in order of id, a row (id, v, label) joins the first
    earlier cluster whose first member is at least so near, or begins one. (toward D13, D14)

    Settled in rounds: what has a first member among its smaller neighbours is a member;
    what has none but members is a first one. The smallest undecided is always settled."""
    near = stash(all_near_pairs(rows, float(np.nextafter(threshold, -1)), block_vectors, ["label"]).select("a", "b"), "near")
    firsts, rest = [], stash(rows.select("id"), "rest")
    links = near
    while True:
        first = stash(rest.join(links.selectExpr("b AS id"), "id", "left_anti"), "first")
        firsts.append(first)
        member = stash(near.join(first.selectExpr("id AS a"), "a", "left_semi").selectExpr("b AS id").distinct().join(rest, "id", "left_semi"), "member")
        rest = stash(rest.join(first.unionByName(member), "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
        links = stash(links.join(member.selectExpr("id AS a"), "a", "left_anti").join(rest.selectExpr("id AS b"), "b", "left_semi").select("a", "b"), "links")
    first = firsts[0]
    for more in firsts[1:]:
        first = first.unionByName(more)
    first = stash(first, "firsts")
    least = near.join(first.selectExpr("id AS a"), "a").join(first.selectExpr("id AS b"), "b", "left_anti").groupBy("b").agg(F.min("a").alias("cluster"))
    return first.selectExpr("id", "id AS cluster").unionByName(least.selectExpr("b AS id", "cluster"))


def greedy_groups(nodes: DataFrame, near: DataFrame, neighbours: int) -> DataFrame:
    """(id, head, similarity) of nodes (id, place): in order of place, a node that is not taken yet heads a group and takes
    those of its `neighbours` nearest (near: a, b, similarity, each pair once) that are not taken. (D13, D14)

    What a later head would take of earlier nodes is settled already, so links lead from an earlier to a later place. Settled in
    rounds: a node without a link from an undecided or heading node is a head; one with a link from a head is
    taken, in the end by its first. Heads are their own, with similarity 1; near may name other ids, which count as neighbours.
    """
    both = near.select("a", "b", "similarity").unionByName(near.selectExpr("b AS a", "a AS b", "similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    return _grouped(nodes, both.withColumn("rank", rank).where(F.col("rank") <= neighbours))


def nearest_groups(nodes: DataFrame, rows: DataFrame, at_least: float, neighbours: int) -> DataFrame:
    """As greedy_groups, of nodes (id, place) among the rows (id, v): only the `neighbours` nearest of each node that are
    at least so near are ever written, not all near pairs. (D13, D14)"""
    asked = rows.join(nodes.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return _grouped(nodes, search(asked, rows, neighbours, at_least).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "similarity"))


def _grouped(nodes: DataFrame, closest: DataFrame) -> DataFrame:
    """greedy_groups, of the nearest (a, b, similarity) of each node."""
    nodes = stash(nodes.select("id", "place"), "nodes")
    places = closest.join(nodes.selectExpr("id AS a", "place AS p"), "a").join(nodes.selectExpr("id AS b", "place AS q"), "b")
    links = all_links = stash(places.where("p < q").select("a", "b", "p", "similarity"), "links")
    heads, rest = None, nodes.select("id")
    while True:
        first = stash(rest.join(links.selectExpr("b AS id"), "id", "left_anti"), "heads")
        heads = first if heads is None else stash(heads.unionByName(first), "heads")
        taken = stash(all_links.join(first.selectExpr("id AS a"), "a", "left_semi").selectExpr("b AS id").distinct().join(rest, "id", "left_semi"), "taken")
        rest = stash(rest.join(first.unionByName(taken), "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
        links = stash(links.join(taken.selectExpr("id AS a"), "a", "left_anti").join(rest.selectExpr("id AS b"), "b", "left_semi"), "links")
    own = all_links.join(heads.selectExpr("id AS a"), "a").join(heads.selectExpr("id AS b"), "b", "left_anti")
    best = own.groupBy("b").agg(F.min_by(F.struct("a", "similarity"), "p").alias("m"))
    return heads.select("id", F.col("id").alias("head"), F.lit(1.0).alias("similarity")).unionByName(best.selectExpr("b AS id", "m.a AS head", "m.similarity AS similarity"))


def represented(groups: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(cluster, representative, size, members, avg_similarity) of groups with two or more, the first `most` in order of their heads:
    the representative has the greatest `frequency` of nodes (id, place, frequency), the first among equals. (D14)"""
    rows = groups.join(nodes.select("id", "place", "frequency"), "id")
    sums = F.sum(F.when(F.col("id") != F.col("head"), F.col("similarity")).otherwise(0.0)) / F.count(F.lit(1))
    order = F.struct(F.coalesce("frequency", F.lit(0)), -F.col("place"))
    found = rows.groupBy("head").agg(F.max_by("id", order).alias("representative"), F.count(F.lit(1)).alias("size"), F.sort_array(F.collect_list("id")).alias("members"), sums.alias("avg_similarity"), F.min("place").alias("place"))
    found = found.where("size > 1")
    if most is None:
        # Without a bound there is no need to number all clusters in one task.
        return found.select(F.col("head").alias("cluster"), "representative", "size", "members", "avg_similarity")
    return found.orderBy("place").limit(most).select(F.col("head").alias("cluster"), "representative", "size", "members", "avg_similarity")
