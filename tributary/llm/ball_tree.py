"""Centroid clustering by ball-tree filtering.

Vectors become integers and are packed, partition by partition, into metric trees
of bounded size, written once to the shared folder. Each node is a ball: how many
vectors it holds, their integer sum, and the radius around their mean. A round reads
the trees: a ball whose farthest point from one centroid is nearer to it than its
nearest point is to any other goes to that centroid as a whole, by its stored sum and
count; otherwise its children are looked at, down to leaves whose points are compared
one by one with the centroids still possible. What leaves a task in a round is a sum and
a count for every centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stash, settings, stash, table

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Vectors of a tree and of a leaf, at most.
TREE_ROWS, LEAF = 1024, 32
#: Greatest component, so that a squared distance of 64 components fits in a long.
MOST = 1 << 27

TREES = "ids array<bigint>, points binary, counts array<int>, sums binary, radius array<double>"
_TREES = pa.schema([("ids", pa.list_(pa.int64())), ("points", pa.binary()), ("counts", pa.list_(pa.int32())), ("sums", pa.binary()), ("radius", pa.list_(pa.float64()))])
_PARTS = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
#: Trees are wide rows: few are handed over at once.
_FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.parquet.columnarReaderBatchSize": "64"}


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; an error if one is beyond MOST."""
    return F.transform(
        vector.cast("array<double>"),
        lambda x: F.when(F.abs(x) * scale <= MOST, F.floor(x * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component is beyond 2^27 after scaling"))).cast("int"),
    )


def is_whole(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector has exactly dim components, none null or non-finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector.cast("array<double>"), finite), F.lit(False))


class BallTree:
    """A complete binary tree in heap order over the rows of points, which it reorders."""

    def __init__(self, points: np.ndarray, counts: np.ndarray, sums: np.ndarray, radius: np.ndarray, order: np.ndarray | None = None):
        self.points, self.counts, self.sums, self.radius, self.order = points, counts, sums, radius, order

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        n = len(points)
        depth = 0
        while (n + (1 << depth) - 1) >> depth > leaf:
            depth += 1
        order, real = np.arange(n), points.astype(np.float64)
        edges = [np.array([0, n])]
        for _ in range(depth):
            now = edges[-1]
            middle = (now[:-1] + now[1:]) // 2
            for a, m, b in zip(now[:-1].tolist(), middle.tolist(), now[1:].tolist()):
                own = real[order[a:b]]
                one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
                other = own[((own - one) ** 2).sum(1).argmax()]
                order[a:b] = order[a:b][np.argpartition(own @ (other - one), m - a)] if a < m < b else order[a:b]
            edges.append(np.sort(np.concatenate((now, middle))))
        points, real = points[order], real[order]
        counts = np.concatenate([np.diff(e) for e in edges])
        sums = np.concatenate([np.add.reduceat(points, e[:-1], axis=0, dtype=np.int64) for e in edges])
        radius = []
        for i, e in enumerate(edges):
            own = slice((1 << i) - 1, (1 << i + 1) - 1)
            centre = sums[own] / counts[own, None]
            radius.append(np.sqrt(np.maximum.reduceat(((real - np.repeat(centre, np.diff(e), axis=0)) ** 2).sum(1), e[:-1])))
        return cls(points, counts, sums, np.concatenate(radius), order)

    def whole_balls(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, bool]]:
        """(node, begin, end, centroids, is a leaf): balls with one centroid left, and leaves with several."""
        real = centroids.astype(np.float64)
        nodes, live, depth = np.array([0]), np.ones((1, len(real)), bool), (len(self.counts) + 1).bit_length() - 2
        for level in range(depth + 1):
            begins = np.concatenate(([0], np.cumsum(self.counts[(1 << level) - 1 : (1 << level + 1) - 1])))
            centre, r = self.sums[nodes] / self.counts[nodes, None], self.radius[nodes, None]
            d = np.sqrt(((centre[:, None, :] - real[None]) ** 2).sum(2))
            # Rounding of d and of the radius must never rule a centroid out.
            slack = 1e-9 * (1 + np.abs(centre).max(1, keepdims=True) + np.abs(real).max() + r)
            live &= d - r <= np.where(live, d + r, np.inf).min(1, keepdims=True) + slack
            settled = live.sum(1) == 1
            for node, own, alone in zip(nodes.tolist(), live, settled.tolist()):
                if alone or level == depth:
                    at = node - ((1 << level) - 1)
                    yield node, begins[at], begins[at + 1], np.flatnonzero(own), not alone
            nodes, live = nodes[~settled], live[~settled]
            if not len(nodes):
                return
            nodes, live = np.stack((2 * nodes + 1, 2 * nodes + 2), 1).ravel(), np.repeat(live, 2, axis=0)

    def nearest(self, begin: int, end: int, centroids: np.ndarray) -> np.ndarray:
        """For each point of a leaf the first of the nearest centroids, exactly."""
        d = np.stack([((self.points[begin:end].astype(np.int64) - c) ** 2).sum(1) for c in centroids])
        return d.argmin(0)


def _grow(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    def one(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        tree = BallTree.grow(points)
        row = [[ids.take(pa.array(tree.order)).to_pylist()], [tree.points.tobytes()], [tree.counts.tolist()], [tree.sums.tobytes()], [tree.radius.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _TREES)], schema=_TREES)

    for batch in batches:
        points = batch.column("point").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dim)
        for a in range(0, len(points), TREE_ROWS):
            yield one(batch.column("vec_id").slice(a, TREE_ROWS), points[a : a + TREE_ROWS])


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, BallTree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            points = np.frombuffer(row["points"].as_py(), np.int32).reshape(-1, dim)
            sums = np.frombuffer(row["sums"].as_py(), np.int64).reshape(-1, dim)
            yield row["ids"].values, BallTree(points, np.array(row["counts"].as_py()), sums, np.array(row["radius"].as_py()))


def _sum_up(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dim = centroids.shape
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
    for _, tree in _trees(batches, dim):
        for node, a, b, left, open_ in tree.whole_balls(centroids):
            if open_:
                best = left[tree.nearest(a, b, centroids[left])]
                counts += np.bincount(best, minlength=k)
                np.add.at(sums, best, tree.points[a:b])
            else:
                counts[left[0]] += tree.counts[node]
                sums[left[0]] += tree.sums[node]
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(sums[full].tolist(), _PARTS.field(2).type)], schema=_PARTS)


def _label(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for ids, tree in _trees(batches, centroids.shape[1]):
        cluster = np.zeros(len(tree.points), np.int64)
        for _, a, b, left, open_ in tree.whole_balls(centroids):
            cluster[a:b] = left[tree.nearest(a, b, centroids[left])] if open_ else left[0]
        distance = ((tree.points.astype(np.int64) - centroids[cluster]) ** 2).sum(1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], schema=_FOUND)


def plant(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """The kept vectors as trees, one a row."""
    kept = vectors.where(is_whole(F.col(vector), dim)).select(F.col(vec_id).cast("bigint").alias("vec_id"), integer_vector(F.col(vector), scale).alias("point"))
    return kept.mapInArrow(lambda batches: _grow(batches, dim), TREES)


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, dim: int, scale: int, clusters: int, seed: int) -> np.ndarray:
    point = integer_vector(F.col(vector), scale)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(vec_id).cast("string")), 256)
    kept = vectors.where(is_whole(F.col(vector), dim)).select(order.alias("rank"), point.alias("point"))
    found = kept.orderBy(F.col("rank").asc_nulls_last(), "point").limit(clusters).collect()
    return np.array([r.point for r in found], np.int64).reshape(-1, dim)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of the means; those without vectors stay."""
    parts = trees.mapInArrow(lambda batches: _sum_up(batches, centroids), "cluster int, n bigint, sums array<bigint>")
    dims = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    after = centroids.copy()
    for r in dims.collect():  # one row a centroid and component
        after[r.cluster, r.i] = r.x // r.n
    return after


def ball_tree_clusters(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors with exactly dim components, none null or non-finite; others, null
    vectors among them, have no row. Fewer kept vectors than clusters give as many
    clusters; none give an empty result. Rows that repeat, in id or vector, are vectors of their own; a null
    vec_id comes last among the first centroids and is kept. Equal distances go to
    the smaller number. A component beyond 2^27 after scaling is an error. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, vec_id, vector, dim, scale, clusters, seed)
    empty = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], empty)
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(16 * TREE_ROWS)}):
        trees = stash(plant(vectors, vec_id, vector, dim, scale), "trees")
    with settings(spark, _FEW):
        for _ in range(rounds):
            centroids = moved(trees, centroids)
        found = stash(trees.mapInArrow(lambda batches: _label(batches, centroids), "vec_id bigint, cluster int, distance bigint"), "clustered")
    drop_stash(trees)
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    total = int(sum(inertia.values()))
    rows = [(c, int(s), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row a cluster.
    return found.join(F.broadcast(by_cluster), "cluster").select(*[c.split()[0] for c in empty.split(", ")])


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector of embeddings; see ball_tree_clusters for odd rows."""
    return ball_tree_clusters(table(spark, sf_dir, "embeddings"))


def _round_sql(i: int) -> str:
    return f"""a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v.p) AS p, min({{'d': list_sum(list_transform(range(1, {DIM + 1}), lambda j: (v.p[j] - c.p[j]) * (v.p[j] - c.p[j])))::BIGINT, 'c': c.c}}) AS m
    FROM v, c{i} AS c GROUP BY r)"""


def _move_sql(i: int) -> str:
    return f"""s{i} AS (SELECT m.c AS c, j, sum(p[j])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i}, range(1, {DIM + 1}) AS t(j) GROUP BY m.c, j),
n{i} AS (SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS p FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c{i}.c, coalesce(n{i}.p, c{i}.p) AS p FROM c{i} LEFT JOIN n{i} USING (c))"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE}.0::DOUBLE * x::DOUBLE)::BIGINT) AS p
    FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), p) - 1 AS c, p FROM v QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), p) <= {CLUSTERS}),
{", ".join(f"{_round_sql(i)}, {_move_sql(i)}" for i in range(ROUNDS))},
{_round_sql(ROUNDS)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} AS c ON c.c = m.c"""
