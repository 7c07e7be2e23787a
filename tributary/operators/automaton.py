"""Finite automata over the events of a key, as an associative scan, and the circuit breaker on it.

Every event, and the time before it, is a function from state to state. A key's events are
cut into blocks of time; a task composes the functions of a block, so a block becomes one
function whatever state it begins in. The blocks of a key, one row each, are then
followed from the first state, and each block's events run again from the state that was
handed to it. Every task reads its rows in order and holds one function or one state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Automaton:
    """elapse(d): next state of every state when d seconds pass; react(event): next state of every state, and what is said."""

    start: int
    elapse: Callable[[int], np.ndarray]
    react: Callable[[int], tuple[np.ndarray, np.ndarray]]


def _blocks(rows: DataFrame, key: str, second: str, order: str, event: str, length: int) -> DataFrame:
    named = rows.select(F.col(key).alias("key"), F.col(second).cast("long").alias("second"), F.col(order).alias("id"), F.col(event).cast("int").alias("event"))
    return named.withColumn("block", F.floor(F.col("second") / length).cast("long"))


def _composed(machine: Automaton, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, f, last = None, None, 0
        for pdf in batches:
            done = []
            for key, block, second, event in zip(pdf["key"], pdf["block"], pdf["second"], pdf["event"]):
                if (key, block) != now:
                    if now is not None:
                        done.append((*now, machine.elapse((now[1] + 1) * length - last)[f].tolist()))
                    now, last = (key, block), block * length
                    f = np.arange(len(machine.elapse(0)))
                f = machine.react(event)[0][machine.elapse(second - last)[f]]
                last = second
            yield pd.DataFrame(done, columns=["key", "block", "f"])
        if now is not None:
            yield pd.DataFrame([(*now, machine.elapse((now[1] + 1) * length - last)[f].tolist())], columns=["key", "block", "f"])

    return run


def _handed_out(machine: Automaton, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, expected = None, machine.start, 0
        for pdf in batches:
            begins = []
            for key, block, f in zip(pdf["key"], pdf["block"], pdf["f"]):
                if key != now:
                    now, state = key, machine.start
                elif block > expected:
                    state = int(machine.elapse((block - expected) * length)[state])
                begins.append(state)
                state, expected = int(f[state]), block + 1
            yield pdf[["key", "block"]].assign(begin=begins)

    return run


def _replayed(machine: Automaton, length: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = machine.start, 0
        for pdf in batches:
            said, after = [], []
            calls = pdf["begin"].isna().to_numpy()
            for key, block, second, event, begin, call in zip(pdf["key"], pdf["block"], pdf["second"], pdf["event"], pdf["begin"], calls):
                if not call:
                    state, last = int(begin), block * length
                    continue
                step, words = machine.react(int(event))
                state = int(machine.elapse(second - last)[state])
                said.append(int(words[state]))
                state, last = int(step[state]), second
                after.append(state)
            yield pdf[["key", "id"]][calls].assign(said=said, state=after)

    return run


def scan(rows: DataFrame, key: str, second: str, order: str, event: str, machine: Automaton, block_seconds: int = 3600) -> DataFrame:
    """(key, id, said, state) of every row: what the machine says to its event, and the state after it.

    Rows of a key are taken by second, then by `order`, whose values come back as id. The machine begins in its start
    state at the key's first block; rows that repeat are events of their own. Rows without key, second or event are left out.
    """
    blocks = _blocks(rows.where(F.col(key).isNotNull() & F.col(second).isNotNull() & F.col(event).isNotNull()), key, second, order, event, block_seconds)
    kinds = dict(blocks.dtypes)
    ordered = blocks.repartition("key", "block").sortWithinPartitions("key", "block", "second", "id")
    functions = ordered.mapInPandas(_composed(machine, block_seconds), f"key {kinds['key']}, block long, f array<int>")
    followed = functions.repartition("key").sortWithinPartitions("key", "block")
    begins = followed.mapInPandas(_handed_out(machine, block_seconds), f"key {kinds['key']}, block long, begin int")
    # A block's first state is a row of its own, before its events. After a join by key and block Spark leaves out a
    # repartition by the same columns, and where it then makes the join by broadcast, a block's rows lie in many tasks.
    first = begins.withColumns({"second": F.col("block") * block_seconds, "id": F.lit(0).cast(kinds["id"]), "event": F.lit(0)})
    both = blocks.withColumn("begin", F.lit(None).cast("int")).unionByName(first)
    again = both.repartition("key", "block").sortWithinPartitions("key", "block", F.col("begin").isNull(), "second", "id")
    return again.mapInPandas(_replayed(machine, block_seconds), f"key {kinds['key']}, id {kinds['id']}, said int, state int")


#: Outcomes of a call, what the breaker says, and its limits.
SUCCESS, FAILURE, UNEXPECTED = 0, 1, 2
SAID = ["success", "failure", "rejected"]
FAILURES, RECOVERY_SECONDS = 5, 60


def circuit_breaker(failures: int = FAILURES, recovery_seconds: int = RECOVERY_SECONDS, throttled: bool = False) -> Automaton:
    """Closed with 0 to failures - 1 failures in a row; open for 0 to recovery_seconds; half open.

    Closed, a call that fails adds one and one that succeeds sets zero; at `failures` the breaker opens and calls are rejected.
    The first call after recovery_seconds is let through: success closes, failure opens anew. An
    unexpected error is no failure: it counts nothing, and leaves a breaker it was the trial of half open,
    where each call is a trial, or, if throttled, none is let through any more. (ST10)
    """
    half, ready, n = failures + recovery_seconds + 1, failures + recovery_seconds, failures + recovery_seconds + 2

    def passed(d: int) -> np.ndarray:
        states = np.arange(n)
        states[failures:half] = np.minimum(states[failures:half] + d, ready)
        return states

    def reaction(event: int) -> tuple[np.ndarray, np.ndarray]:
        step, said = np.arange(n), np.full(n, SAID.index("success" if event == SUCCESS else "failure"))
        said[failures:ready] = SAID.index("rejected")
        called = [*range(failures), ready, *([] if throttled else [half])]
        if throttled:
            said[half] = SAID.index("rejected")
        for s in called:
            if event == SUCCESS:
                step[s] = 0
            elif event == FAILURE:
                step[s] = s + 1 if s < failures - 1 else failures
            elif s == ready:
                step[s] = half
        return step, said

    table = [reaction(e) for e in (SUCCESS, FAILURE, UNEXPECTED)]
    return Automaton(0, lambda d: passed(min(int(d), recovery_seconds)), lambda e: table[e])


def breaker_state(state: Column, failures: int = FAILURES, recovery_seconds: int = RECOVERY_SECONDS) -> Column:
    """closed, open or half_open for a state of `circuit_breaker`."""
    return F.when(state < failures, "closed").when(state <= failures + recovery_seconds, "open").otherwise("half_open")
