"""Albums that are assembled from a stream: keyed state, a set of counted posts, expiry. (ST06, A17)

A row of kind 'album' opens the state of its album; each analysed post counts once and renews the
state's life; the album is assembled when as many posts as expected have been
analysed, else its state expires. Posts without a state (early, late, or of an expired album) are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A state lives a day after it was last written.
TTL_SECONDS = 86_400
#: Descriptions and labels of a summary.
DESCRIPTIONS, LABELS = 5, 20

EVENTS = "album long, at timestamp, kind string, post long, expected int, description string, labels array<string>, is_meme boolean, has_text boolean"
#: Times are microseconds inside the state: a worker's zone does not matter.
ITEM = "post long, at long, description string, labels array<string>, is_meme boolean, has_text boolean"
STATE = f"expected long, written long, items array<struct<{ITEM.replace(' ', ': ').replace(',:', ',')}>>"
FOUND = (
    "album long, status string, at long, expected int, analysed int, first_at long, last_at long, "
    "items array<struct<post: long, at: long, description: string, labels: array<string>, is_meme: boolean, has_text: boolean>>"
)
_NAMES = [c.split()[0] for c in ITEM.split(", ")]
#: Albums whose ids differ in the last so many bits alone have one state.
BLOCK_BITS = 10
#: Of the albums of a block that have a state: the last bits of the id, posts expected, the time of the last write, how many
#: posts are counted; and of all these posts in a row the ids, and the items as JSON.
BLOCK = "places array<int>, expected array<long>, written array<long>, sizes array<int>, posts array<long>, items array<string>"
#: Stands for no number of expected posts: such an album is never assembled.
_NEVER = 1 << 40


def _steps(held: list | None, rows: Iterable[tuple], ttl: int) -> tuple[list[tuple], list | None]:
    """What rows (micros, follows, post, expected, item) of an album find, as (status, micros, held), and what is held after them: expected, written, posts, items."""
    found, seen = [], set(held[2]) if held else set()
    for micros, follows, post, expected, item in rows:
        if held and micros - held[1] >= ttl:
            found.append(("expired", held[1] + ttl, held))
            held = None
        if not follows:
            held, seen = [expected, micros, [], []], set()
        elif held and post not in seen:
            seen.add(post)
            held[2].append(post)
            held[3].append(item)
            held[1] = micros
            if len(held[2]) >= held[0]:
                found.append(("assembled", micros, held))
                held = None
    return found, held


class Assembler(StatefulProcessor):
    """Rows of EVENTS by album to rows of FOUND. Within a batch an album's rows are taken in order of time, the album's own first."""

    def __init__(self, ttl_seconds: int = TTL_SECONDS):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value an album: every use of a state is a message to the JVM.
        self.album = handle.getValueState("album", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        stored = self.album.get()
        held = None
        if stored:
            items = [tuple(i) for i in stored[2]]
            held = [stored[0], stored[1], [i[0] for i in items], items]
        ordered = sorted(rows, key=lambda r: (r.micros, r.kind != "album", r.post or 0, r.description or ""))
        found, held = _steps(held, ((r.micros, r.kind != "album", r.post, r.expected, tuple(r.micros if n == "at" else r[n] for n in _NAMES)) if r.kind != "album" else (r.micros, False, None, _NEVER if r.expected is None else r.expected, None) for r in ordered), self.ttl)
        for status, at, done in found:
            yield self._found(key, (done[0], done[1], done[3]), status, at)
        if stored:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if held:
            self.album.update((held[0], held[1], held[3]))
            self.handle.registerTimer((held[1] + self.ttl) // 1000)
        elif stored:
            self.album.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.album.get()
        if held and (held[1] + self.ttl) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.album.clear()
            yield self._found(key, held, "expired", held[1] + self.ttl)

    def close(self) -> None:
        pass

    def _found(self, key: Any, held: Any, status: str, at: int) -> Row:
        items = [Row(**dict(zip(_NAMES, i))) for i in held[2]]
        times = [i.at for i in items]
        return Row(album=key[0], status=status, at=at, expected=None if held[0] == _NEVER else held[0], analysed=len(items), first_at=min(times, default=None), last_at=max(times, default=None), items=items)


def _blocks(ttl: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Assembler over the albums of a block: the state is one row that comes and goes with the rows."""
    columns = ["place", "micros", "follows", "post", "description", "none", "expected", "item"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, found, now = {}, [], state.getCurrentWatermarkMs()
        if state.exists:
            places, expected, written, sizes, posts, items = state.get
            begin = 0
            for place, e, w, n in zip(places, expected, written, sizes):
                held[place] = [e, w, list(posts[begin : begin + n]), list(items[begin : begin + n])]
                begin += n
        rows = [] if state.hasTimedOut else sorted(r for pdf in batches for r in zip(*(pdf[c].tolist() for c in columns)))
        for place, own in groupby(rows, lambda r: r[0]):
            ended, now_held = _steps(held.pop(place, None), ((r[1], r[2], None if r[5] else r[3], r[6], r[7]) for r in own), ttl)
            found += [(place, *x) for x in ended]
            if now_held:
                held[place] = now_held
        # Rows that came later would be late: nothing can renew these.
        for place in [p for p, h in held.items() if (h[1] + ttl) // 1000 < now]:
            done = held.pop(place)
            found.append((place, "expired", done[1] + ttl, done))
        if held:
            every = held.values()
            flat = lambda k: [x for h in every for x in h[k]]
            state.update((list(held), [h[0] for h in every], [h[1] for h in every], [len(h[2]) for h in every], flat(2), flat(3)))
            state.setTimeoutTimestamp(max(1, now, (min(h[1] for h in every) + ttl) // 1000))
        elif state.exists:
            state.remove()
        if found:
            places, status, at, done = zip(*found)
            yield pd.DataFrame({"block": key[0], "place": places, "status": status, "at": at, "expected": [h[0] for h in done], "analysed": [len(h[2]) for h in done], "items": [f"[{','.join(h[3])}]" for h in done]})

    return run


def assemble(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """A stream of EVENTS with a watermark on `at` to a stream of FOUND; what Assembler does, by blocks of 1,024 ids in a row, so that
    Python is called, and a state read and written, once a block and batch. For ids that are given one after the other; for others
    see assemble_each. Rows without a time are dropped. The state store should be RocksDB, or the state is held in memory."""
    item = F.to_json(F.struct("post", F.unix_micros("at").alias("at"), "description", "labels", "is_meme", "has_text"))
    follows = ~F.col("kind").eqNullSafe("album")
    rows = events.where("at IS NOT NULL").select(
        F.shiftright("album", BLOCK_BITS).alias("block"), F.coalesce(F.col("album").bitwiseAND((1 << BLOCK_BITS) - 1), F.lit(0)).cast("int").alias("place"), "at", F.unix_micros("at").alias("micros"), follows.alias("follows"),
        F.coalesce("post", F.lit(0)).cast("long").alias("post"), F.coalesce("description", F.lit("")).alias("description"), F.col("post").isNull().alias("none"), F.coalesce(F.col("expected").cast("long"), F.lit(_NEVER)).alias("expected"), F.when(follows, item).otherwise("").alias("item"),
    )
    raw = "block long, place int, status string, at long, expected long, analysed int, items string"
    found = rows.groupBy("block").applyInPandasWithState(_blocks(ttl_seconds * 1_000_000), raw, BLOCK, "append", GroupStateTimeout.EventTimeTimeout)
    items = f"array<struct<{ITEM.replace(' ', ': ').replace(',:', ',')}>>"
    album = F.shiftleft("block", BLOCK_BITS).bitwiseOR(F.col("place").cast("long"))
    found = found.select(album.alias("album"), "status", "at", F.when(F.col("expected") != _NEVER, F.col("expected")).cast("int").alias("expected"), "analysed", F.from_json("items", items).alias("items"))
    first, last = (F.timestamp_micros(f("items.at")) for f in (F.array_min, F.array_max))
    return found.select("album", "status", F.timestamp_micros("at").alias("at"), "expected", "analysed", first.alias("first_at"), last.alias("last_at"), "items")


def assemble_each(events: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """assemble with a state of each album's own, for ids that lie far from one another; every album of a batch costs some messages
    between Python and the state store, which must be one with column families (RocksDB)."""
    found = events.withColumn("micros", F.unix_micros("at")).groupBy("album").transformWithState(Assembler(ttl_seconds), FOUND, "append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "first_at", "last_at")})


def vision_summary(items: Column) -> dict[str, Column]:
    """What an assembled album says: the first five distinct descriptions, labels by frequency (the one seen
    first among equals), whether any item is a meme or has text. (A17)"""
    texts = F.transform(F.filter(items, lambda i: F.trim(i["description"]) != ""), lambda i: F.trim(i["description"]))
    flat = F.flatten(F.transform(items, lambda i: F.coalesce(i["labels"], F.array().cast("array<string>"))))
    labels = F.filter(F.transform(flat, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    counted = F.transform(F.array_distinct(labels), lambda x, k: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("n"), k.alias("k"), x.alias("label")))
    some = lambda field: F.exists(items, lambda i: F.coalesce(i[field], F.lit(False)))
    return {
        "summary": F.nullif(F.array_join(F.slice(F.array_distinct(texts), 1, DESCRIPTIONS), " | "), F.lit("")),
        "labels": F.slice(F.transform(F.array_sort(counted), lambda x: x["label"]), 1, LABELS),
        "has_meme": some("is_meme"),
        "has_text": some("has_text"),
    }
