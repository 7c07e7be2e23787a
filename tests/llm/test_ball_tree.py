"""Ball-tree clustering against plain rounds over all points and centroids."""

import hashlib
import math

import numpy as np
import pytest

from tributary.llm import ball_tree


def plain(rows, clusters=16, rounds=3, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids, points = np.array([v for _, v in order[:clusters]], object), np.array([v for _, v in kept], object)

    def nearest():
        d = ((points[:, None, :] - centroids[None]) ** 2).sum(2)
        best = [min(range(len(centroids)), key=lambda c: (row[c], c)) for row in d]
        return best, [row[c] for row, c in zip(d, best)]

    for _ in range(rounds):
        best, _ = nearest()
        for c in set(best):
            own = points[[b == c for b in best]]
            centroids[c] = own.sum(0) // len(own)
    best, d = nearest()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, x, sum(y for y, b in zip(d, best) if b == c), sum(d), sha[c]) for (i, _), c, x in zip(kept, best, d))


def clustered(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "'x' AS points")
    return sorted((str(r[0]), *r[1:]) for r in ball_tree.ball_tree_clusters(vectors).collect())


def blobs(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (12, 64))
    return [(i, (centres[i % 12] + rng.normal(0, 0.3, 64)).tolist()) for i in range(n)]


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(3)
    ties = [(i, (np.round(rng.normal(0, 1, 64)) / 2).tolist()) for i in range(400)]
    for rows in (blobs(1500, 1), ties + ties[:50] + [(i + 10**6, ties[0][1]) for i in range(300)]):
        assert clustered(spark, rows) == plain(rows)


def test_odd_rows(spark):
    good = blobs(20, 2)
    odd = [(100, None), (101, []), (102, good[0][1][:63]), (103, good[0][1] + [1.0]), (104, [None] + good[0][1][1:]), (105, [math.nan] + good[0][1][1:]), (106, [math.inf] + good[0][1][1:]), (None, good[3][1]), good[4]]
    assert clustered(spark, good + odd) == plain(good + odd)
    assert clustered(spark, good[:3] + odd[:7]) == plain(good[:3])
    assert clustered(spark, odd[:7]) == [] and clustered(spark, []) == []
    with pytest.raises(Exception, match="beyond 2"):
        clustered(spark, [(1, [1e300] * 64)])


def test_balls_hold_their_points_and_go_whole():
    points = np.array([np.floor(64 * np.array(v)) for _, v in blobs(1000, 5)]).astype(np.int32)
    tree = ball_tree.BallTree.grow(points)
    centroids = np.array([points[i] for i in range(12)], np.int64)
    assert sorted(map(tuple, tree.points.tolist())) == sorted(map(tuple, points.tolist()))
    assert tree.counts[0] == 1000 and (tree.sums[0] == points.sum(0)).all() and (tree.sums[0] == tree.sums[1] + tree.sums[2]).all()
    found = list(tree.whole_balls(centroids))
    assert sum(b - a for _, a, b, _, _ in found) == 1000
    assert sum(b - a for _, a, b, _, leaf in found if not leaf) > 500
