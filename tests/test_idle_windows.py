"""Counters and sets that end when idle, against plain replay, over blocks of time."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from tributary.operators import windows

START = datetime(2024, 1, 1)


def hits(seed):
    rng = random.Random(seed)
    rows, at = [], {k: rng.randint(-3000, 3000) for k in ("a", "b", None)}
    for i in range(700):
        k = rng.choice(["a", "a", "b", None])
        at[k] += rng.choice([0, 0, 1, 7, 299, 300, 301, 599, 600, 601, 3600, 90_000])
        rows.append((i, k, rng.choice(["x", "y", "z", None]), START + timedelta(seconds=at[k]) if rng.random() < 0.98 else None))
    return rows


def replay(rows, idle):
    """(session, count, distinct values) after each hit; hits without a time come first, each a session of its own."""
    out, state = {}, defaultdict(lambda: [None, 0, 0, set()])
    for i, k, v, t in sorted(rows, key=lambda r: (r[3] is not None, r[3] or START, r[0])):
        s = state[k]
        if s[0] is None or t is None or (t - s[0]).total_seconds() >= idle:
            s[1:] = [s[1] + 1, 0, set()]
        s[0] = t
        s[2] += 1
        s[3].add(v)
        out[i] = (s[1], s[2], len(s[3]))
    return out


def test_idle_counts_over_blocks_equal_a_replay(spark):
    for seed in (1, 2):
        rows = hits(seed)
        df = spark.createDataFrame(rows, "i long, k string, v string, t timestamp").repartition(5)
        small, large = replay(rows, 300), replay(rows, 4000)
        got = {r.i: r for r in windows.idle_counts(df, "k", "t", "i", {"n": 300, "m": 4000}).collect()}
        assert {i: (r.n, r.m) for i, r in got.items()} == {i: (small[i][1], large[i][1]) for i in small}
        assert {r.i: r.s for r in windows.idle_sessions(df, "k", "t", "i", 300, "s").collect()} == {i: x[0] for i, x in small.items()}
        assert {r.i: r.d for r in windows.idle_distinct(df, "k", "v", "t", "i", 4000, "d").collect()} == {i: x[2] for i, x in large.items()}


def test_no_task_orders_all_hits_of_a_key(spark):
    df = spark.createDataFrame(hits(1), "i long, k string, v string, t timestamp")
    for rows in (windows.idle_count(df, "k", "t", "i", 300, "n"), windows.idle_distinct(df, "k", "v", "t", "i", 300, "d")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        lines = [line for line in plan.splitlines() if "Window [" in line and "[t#" in line]
        assert lines and not [line for line in lines if ", [k#" in line and "__session" not in line], plan
