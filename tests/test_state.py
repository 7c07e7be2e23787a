"""Operators with a state against loops, as batches and as streams."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.operators import automaton, budgets
from tributary.streaming import albums, jobs
from tributary.streaming.deferred import ROWS, DeferredQueue

MINUTE = 60_000_000


def looped_breaker(calls, failures, recovery, throttled=False):
    """calls (key, second, id, outcome) in order; as the reference's classes do."""
    state, count, since, out = {}, defaultdict(int), {}, {}
    for key, t, i, outcome in calls:
        now = state.get(key, "closed")
        if now == "open" and t - since[key] >= recovery:
            now, tried = "half_open", False
        else:
            tried = True
        if now == "open" or throttled and now == "half_open" and tried:
            out[i] = ("rejected", now)
            continue
        if outcome == automaton.SUCCESS:
            now, count[key] = "closed", 0
        elif outcome == automaton.FAILURE:
            count[key] += 1
            since[key] = t
            if now == "half_open" or count[key] >= failures:
                now = "open"
        state[key] = now
        out[i] = ("success" if outcome == automaton.SUCCESS else "failure", now)
    return out


@pytest.mark.parametrize("throttled", [False, True])
@pytest.mark.parametrize("block", [7, 60, 100_000])
def test_breaker_equals_a_loop_whatever_the_blocks(spark, block, throttled):
    rng = random.Random(block)
    rows = sorted((rng.choice("ab"), 1_000 + rng.randint(0, 900), i, rng.choices((0, 1, 2), (3, 5, 1))[0]) for i in range(600))
    df = spark.createDataFrame([*rows, (None, 1, -1, 0), ("a", None, -2, 0)], "key string, second long, id long, event int")
    machine = automaton.circuit_breaker(3, 20, throttled)
    got = automaton.scan(df, "key", "second", "id", "event", machine, block).withColumn("now", automaton.breaker_state(F.col("state"), 3, 20)).collect()
    assert {r.id: (automaton.SAID[r.said], r.now) for r in got} == looped_breaker(rows, 3, 20, throttled)


def test_a_block_whose_rows_come_from_many_tasks_stays_in_order(spark):
    rows = [("a", t, i, 1) for i, t in enumerate([5] * 64)]
    df = spark.createDataFrame(rows, "key string, second long, id long, event int").repartition(8)
    got = automaton.scan(df, "key", "second", "id", "event", automaton.circuit_breaker(3, 20), 60).collect()
    assert {r.id: automaton.SAID[r.said] for r in got} == {i: "failure" if i < 3 else "rejected" for i in range(64)}


def test_breaker_opens_after_five_failures_and_tries_again_after_a_minute(spark):
    calls = [(t, automaton.FAILURE) for t in range(5)] + [(30, 0), (63, 0), (64, 0), (65, 1)]
    df = spark.createDataFrame([("s", t, i, x) for i, (t, x) in enumerate(calls)], "key string, second long, id long, event int")
    said = [r.said for r in automaton.scan(df, "key", "second", "id", "event", automaton.circuit_breaker()).orderBy("id").collect()]
    assert [automaton.SAID[s] for s in said] == ["failure"] * 5 + ["rejected", "rejected", "success", "failure"]


def test_rolling_budget_on_odd_rows(spark):
    rows = [("a", 0, 1, 60), ("a", 10, 2, 50), ("a", 10, 3, None), ("a", 20, 4, 40), ("a", 3_600_000_000, 5, 41), ("a", 3_600_000_001, 6, 41), (None, 0, 7, 101), (None, 0, 8, 100), (None, 0, 8, 100)]
    df = spark.createDataFrame(rows, "tenant string, micros long, id long, tokens long").repartition(3)
    got = sorted((r.id, r.allowed) for r in budgets.rolling_budget(df, "tenant", "micros", "id", "tokens", 0, 100, 3600).collect())
    assert got == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True), (7, False), (8, False), (8, True)]
    quota = sorted((r.id, r.allowed) for r in budgets.rolling_budget(df.where("tenant = 'a'"), "tenant", "micros", "id", "tokens", 2, 0, 3600).collect())
    assert [i for i, ok in quota if ok] == [1, 2, 6]


def looped_queue(batches, limit, budget, window, delay, most):
    waiting, held, done, clock = [], defaultdict(list), {}, 0
    for batch in batches:
        begin = min(r[2] for r in batch)
        clock = max(clock, *(r[2] for r in batch))
        todo = [(max(due, begin), 1, i, tenant, n, tries) for tenant, i, n, tries, due in waiting] + [(t, 2, i, tenant, n, 0) for tenant, i, t, n in batch]
        waiting = []
        for due, _, i, tenant, n, tries in sorted(todo):
            if due > clock:
                waiting.append((tenant, i, n, tries, due))
                continue
            live = [x for x in held[tenant] if due - x[0] <= window]
            if len(live) < limit and sum(x[1] for x in live) + n <= budget:
                held[tenant] = [*live, (due, n)]
                done[i] = ("accepted", tries, due)
            elif tries >= most:
                done[i] = ("given up", tries, due)
            else:
                waiting.append((tenant, i, n, tries + 1, due + delay * (tries + 1)))
    return done, {i: tries for _, i, _, tries, _ in waiting}


def test_deferred_rows_are_neither_lost_nor_taken_twice(spark, tmp_path):
    rng = random.Random(8)
    rows = sorted((rng.randint(1, 3), i, rng.randint(0, 399) * MINUTE, rng.randint(1, 60)) for i in range(240))
    batches = [[r for r in rows if k * 100 * MINUTE <= r[2] < (k + 1) * 100 * MINUTE] for k in range(4)]
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    queue = DeferredQueue(str(tmp_path / "queue"), 4, 100, 3600, 600, 2)
    for k in range(4):
        for _ in range(1 + k % 2):  # some batches run twice, as after a failure
            queue(spark.read.parquet(str(tmp_path / f"in/{k}")), k)
    done, left = looped_queue(batches, 4, 100, 60 * MINUTE, 10 * MINUTE, 2)
    got = {r.id: ("accepted", r.retries, r.taken_at) for r in queue.accepted(spark).collect()} | {r.id: ("given up", r.retries, r.taken_at) for r in queue.given_up(spark).collect()}
    assert got == done and queue.accepted(spark).count() + queue.given_up(spark).count() == len(done)
    assert {r.id: r.retries for r in queue.decided(spark, 3).where("status = 'waiting'").collect()} == left
    assert set(done) | set(left) == set(range(240)) and any(s == "given up" for s, _, _ in done.values()) and any(t and s == "accepted" for s, t, _ in done.values())


def test_deferred_queue_as_the_sink_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(1, 10 * k + i, (100 * k + i) * MINUTE, 30) for i in range(5)], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    queue = DeferredQueue(str(tmp_path / "queue"), 0, 60, 3600, 600, 9)
    stream = lambda: jobs.read_new(spark, str(tmp_path / "in"), spark.createDataFrame([], ROWS).schema, 1).writeStream.foreachBatch(queue).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    stream()
    first = sorted(map(tuple, queue.accepted(spark).collect()))
    stream()  # nothing new: nothing changes
    assert first and sorted(map(tuple, queue.accepted(spark).collect())) == first


def test_albums_from_a_stream_in_several_batches(spark, tmp_path):
    rows = [
        (0, 1, "analysis", 9, None), (1, 1, "album", None, 2), (2, 1, "analysis", 1, None), (2, 1, "analysis", 1, None), (3, 1, "analysis", 2, None), (4, 1, "analysis", 3, None),
        (1, 2, "album", None, 2), (20, 2, "analysis", 1, None), (43, 2, "analysis", 2, None),
        (1, 3, "album", None, 2), (5, 3, "analysis", 1, None), (30, 3, "analysis", 2, None),
        (60, 4, "album", None, 1),
    ]
    df = spark.createDataFrame([(h, a, k, p, e, f" d{p} " if p else None, ["B", "a ", "b"] if p else None, p == 2, False) for h, a, k, p, e in rows], "h int, album long, kind string, post long, expected int, description string, labels array<string>, is_meme boolean, has_text boolean")
    df = df.withColumn("at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    # Files in order of time, as they would arrive; each is a batch.
    for low, high in ((0, 2), (2, 4), (4, 25), (25, 50), (50, 99)):
        df.where((F.col("h") >= low) & (F.col("h") < high)).drop("h").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_new(spark, str(tmp_path / "in"), df.drop("h").schema, 1).withWatermark("at", "0 seconds")
    found = jobs.drain(albums.assemble(stream), settings=jobs.ROCKS)
    found = found.select("album", "status", "analysed", F.floor((F.unix_seconds("at") - F.unix_seconds(F.expr("timestamp'2024-01-01 00:00:00'"))) / 3600).alias("h"), *[c.alias(n) for n, c in albums.vision_summary(F.col("items")).items()])
    got = {r.album: tuple(r)[1:] for r in found.collect()}
    assert got == {1: ("assembled", 2, 3, "d1 | d2", ["b", "a"], True, False), 2: ("assembled", 2, 43, "d1 | d2", ["b", "a"], True, False), 3: ("expired", 1, 29, "d1", ["b", "a"], False, False)}


def test_failed_messages_come_again_and_end_as_dead_letters(spark, tmp_path):
    from tributary.streaming.deliveries import Deliveries, published

    rows = spark.createDataFrame([(i, f"m{i}") for i in range(6)], "id long, text string")
    handle = lambda df: df.withColumns({"ok": F.col("deliveries") > F.col("id"), "reason": F.lit("late"), "details": F.lit("x")})
    sink = Deliveries(str(tmp_path / "out"), rows.schema, handle, 3)
    for k in (0, 1, 1, 2, 3):  # one batch twice
        sink(rows.where("id < 3") if k == 0 else rows.where("id = 5") if k == 1 else rows.limit(0), k)
    assert {r.id: r.deliveries for r in sink.done(spark).collect()} == {0: 1, 1: 2, 2: 3}
    [dead] = sink.dead_letters(spark).collect()
    assert (dead.payload, dead.reason, dead.deliveries, dead.epoch) == ('{"id":5,"text":"m5"}', "late", 3, 3)
    published(rows, str(tmp_path / "stream"), 2)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "stream")).collect()) == [4, 5]


def test_an_album_that_ends_in_its_batch_reads_its_state_once():
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.calls = []

        def __getattr__(self, name):
            return lambda *a: self.calls.append(name) or (self if name == "getValueState" else None)

    handle, assembler = Handle(), albums.Assembler(10)
    assembler.init(handle)
    handle.calls.clear()
    post = lambda i: Row(album=1, micros=i, kind="analysis", post=i, expected=None, description=f"d{i}", labels=[], is_meme=False, has_text=False)
    album = Row(album=1, micros=0, kind="album", post=None, expected=2, description=None, labels=None, is_meme=None, has_text=None)
    found = list(assembler.handleInputRows((1,), iter([post(2), post(1), album, post(3)]), None))
    assert [(r.status, r.analysed, r.at) for r in found] == [("assembled", 2, 2)] and handle.calls == ["get"]


def test_albums_of_a_block_share_a_state_that_is_written_once_a_batch():
    import pandas as pd

    class State:
        exists, hasTimedOut, get, now, calls = False, False, None, 0, ()
        getCurrentWatermarkMs = lambda self: self.now

        def update(self, x):
            self.exists, self.get, self.calls = True, x, (*self.calls, "update")

        def setTimeoutTimestamp(self, t):
            self.due = t

        def remove(self):
            self.exists, self.calls = False, (*self.calls, "remove")

    columns = ["place", "micros", "follows", "post", "description", "none", "expected", "item"]
    opened = pd.DataFrame([(p, p * 1000, False, 0, "", True, 2, "") for p in range(1000)], columns=columns)
    posts = pd.DataFrame([(p, 2_000_000, True, i, "", False, 1 << 40, "{}") for p in range(500) for i in (1, 2)], columns=columns)
    run, state = albums._blocks(10_000_000), State()
    assert list(run((-3,), iter([opened]), state)) == [] and state.calls == ("update",) and state.due == 10_000
    [found] = run((-3,), iter([posts]), state)
    assert state.calls == ("update", "update") and set(found["status"]) == {"assembled"} and sorted(found["place"]) == list(range(500)) and set(found["items"]) == {"[{},{}]"}
    state.hasTimedOut, state.now = True, 10_700
    [found] = run((-3,), iter([opened.head(0)]), state)
    assert sorted(found["place"]) == list(range(500, 700)) and set(found["status"]) == {"expired"} and state.due == 10_700
    state.now = 99_000
    assert len(next(run((-3,), iter([opened.head(0)]), state))) == 300 and state.calls[-1] == "remove"


def test_albums_by_blocks_are_those_of_a_state_for_each(spark, tmp_path):
    rng = random.Random(11)
    ids = [None, -1500, -1, 0, 1, 2, 1022, 1023, 1024, 5000, 1 << 40]
    rows = []
    for hour in range(120):
        for k in range(rng.randint(0, 6)):
            album, post = rng.choice(ids), rng.choice([None, 0, 1, 2, 3])
            rows.append((hour * 60 + k, album, "album", None, rng.randint(0, 3), None, None, None) if rng.random() < 0.3 else (hour * 60 + k, album, "analysis", post, None, rng.choice([None, "", ' "d\n', "x"]), rng.choice([None, [], ["A ", None]]), rng.choice([None, True])))
    df = spark.createDataFrame(rows, "m int, album long, kind string, post long, expected int, description string, labels array<string>, is_meme boolean").withColumn("has_text", F.lit(False))
    df = df.withColumn("at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)"))
    for low in range(0, 7200, 1440):
        df.where((F.col("m") >= low) & (F.col("m") < low + 1440)).drop("m").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_new(spark, str(tmp_path / "in"), df.drop("m").schema, 1).withWatermark("at", "0 seconds")
    whole, each = (jobs.drain(f(stream(), 36_000), settings=jobs.ROCKS) for f in (albums.assemble, albums.assemble_each))
    assert whole.dtypes == each.dtypes
    got, wanted = (sorted(map(str, x.collect())) for x in (whole, each))
    assert got == wanted and {"assembled", "expired"} == {r.status for r in whole.collect()} and len(got) > 20


def test_idle_counts_give_back_a_batch_in_pieces_and_go_on_from_the_state(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(jobs, "HITS", 2)
    taken = []

    class Rows:
        dtypes = [("k", "string")]
        groupBy = lambda self, key: self
        applyInPandasWithState = lambda self, run, *a: taken.append(run)

    class State:
        exists, hasTimedOut, get = False, False, None
        setTimeoutTimestamp = lambda self, t: None
        getCurrentWatermarkMs = lambda self: 0

        def update(self, x):
            self.exists, self.get = True, x

    jobs.idle_counts(Rows(), "k", 10)
    state = State()
    hits = lambda *x: pd.DataFrame({"ts": pd.to_datetime([t for t, _ in x], unit="s"), "id": [i for _, i in x]})
    first = list(taken[0](("a",), iter([hits((20, 3), (5, 2)), hits((0, 1))]), state))
    assert [len(x) for x in first] == [2, 1] and pd.concat(first)[["id", "count"]].values.tolist() == [[1, 1], [2, 2], [3, 1]]
    again = pd.concat(taken[0](("a",), iter([hits((12, 4), (29, 5), (39, 6))]), state))
    assert again[["id", "count"]].values.tolist() == [[4, 2], [5, 3], [6, 1]] and state.get == (39_000_000, 1)
