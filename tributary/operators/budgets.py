"""Rolling quotas and token budgets, taken greedily in order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rolling:
    """What a tenant was allowed within the window: `limit` calls and `budget` tokens, 0 for no bound. (ST08)

    An entry counts while no more than the window has passed since. A call over a bound
    is refused and not counted; one with more tokens than the budget always is.
    """

    def __init__(self, limit: int, budget: int, window_micros: int):
        self.limit, self.budget, self.window = limit, budget, window_micros
        self.entries: deque[tuple[int, int]] = deque()
        self.spent = 0

    def add(self, at: int, tokens: int) -> None:
        self.entries.append((at, tokens))
        self.spent += tokens

    def allows(self, at: int, tokens: int) -> bool:
        while self.entries and at - self.entries[0][0] > self.window:
            self.spent -= self.entries.popleft()[1]
        if self.limit > 0 and len(self.entries) >= self.limit or self.budget > 0 and self.spent + tokens > self.budget:
            return False
        self.add(at, tokens)
        return True


def rolling_budget(calls: DataFrame, tenant: str, micros: str, order: str, tokens: str, limit: int, budget: int, window_seconds: int) -> DataFrame:
    """(tenant, id, allowed) of every call; a tenant's calls in order of time, then of `order`, which comes back as id.

    A task reads its tenants' rows in order and holds the entries of one window. Null tokens count as none; a null
    tenant is a tenant; rows that repeat are calls of their own.
    """
    kinds = dict(calls.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            said = []
            for key, at, n in zip(pdf["tenant"].astype(object).where(pdf["tenant"].notna(), None), pdf["micros"], pdf["tokens"]):
                if key != now:
                    now, state = key, Rolling(limit, budget, window_seconds * 1_000_000)
                said.append(state.allows(int(at), int(n)))
            yield pdf[["tenant", "id"]].assign(allowed=said)

    named = calls.select(F.col(tenant).alias("tenant"), F.col(micros).alias("micros"), F.col(order).alias("id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))
    return named.repartition("tenant").sortWithinPartitions("tenant", "micros", "id").mapInPandas(run, f"tenant {kinds[tenant]}, id {kinds[order]}, allowed boolean")
