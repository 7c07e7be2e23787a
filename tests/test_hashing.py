"""Hashes of signs and what is near them."""

import random

from pyspark.sql import functions as F

from tributary.operators import hashing


def test_near_hashes_equal_all_pairs(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)]
    signed = [h - (1 << 64) if h >> 63 else h for h in [*near, *near[:10], 0, (1 << 64) - 1]]
    rows = [(k % 2, h) for k, h in enumerate(signed)] + [(0, None)] + [(0, 5)] * 300
    df = spark.createDataFrame(rows, "t long, hash long")
    for most in (0, 3, 7):
        got = {(r.t, r.a, r.b): (r.distance, r.n_a, r.n_b) for r in hashing.near_hashes(df, ["t"], most).collect()}
        expected = {}
        for t in (0, 1):
            own = [h for s, h in rows if s == t and h is not None]
            for a in set(own):
                for b in set(own):
                    d = bin((a ^ b) & (2**64 - 1)).count("1")
                    if a < b and d <= most:
                        expected[t, a, b] = (d, own.count(a), own.count(b))
        assert got == expected


def test_signs_become_bits(spark):
    rows = [([1.0] + [-1.0] * 62 + [2.0],), ([0.0, 3.0, None],), (None,), ([],)]
    got = [r.h for r in spark.createDataFrame(rows, "v array<double>").select(hashing.sign_hash(F.col("v")).alias("h")).collect()]
    assert got == [1 - (1 << 63), 2, None, 0]
