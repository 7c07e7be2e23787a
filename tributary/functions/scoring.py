"""Scores and thresholds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def engagement(views: Column, reactions: Column, forwards: Column, replies: Column) -> Column:
    """log10(1+v) + 2 log10(1+r) + 3 log10(1+f) + log10(1+c)."""
    return F.log10(1 + views) + 2 * F.log10(1 + reactions) + 3 * F.log10(1 + forwards) + F.log10(1 + replies)


def expected_baseline(per_day: Column, window_seconds: int) -> Column:
    """What a window should hold, from the day's count; 1 at least."""
    expected = per_day / max(1, 86_400 // window_seconds)
    return F.when(expected <= 0, 1.0).otherwise(expected)


def burst(observed: Column, expected: Column) -> Column:
    """Observed against expected, to two digits, as thresholds compare it."""
    return F.round(observed / F.greatest(F.lit(1.0), expected), 2)


def rate_of_change(short: Column, long: Column) -> Column:
    return short - F.greatest(long, F.lit(1))


def interest_weight(queries: Column, views: Column, days: Column) -> Column:
    """Clamped 0.4 q + 0.3 v + 0.3 * what is left of 30 days."""
    fresh = F.greatest(F.lit(0.0), 1 - days / 30)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * queries + 0.3 * views + 0.3 * fresh))


def is_quiet_hour(ts: Column, zone: str = "Europe/Moscow") -> Column:
    """Weekend, or before 8 or from 22 there."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))
    return (F.weekday(local) >= 5) | (F.hour(local) >= 22) | (F.hour(local) < 8)


def adaptive_threshold(p95: Column, weekend: Column, night: Column) -> Column:
    """Seconds without a post that make a gap: 1.5 p95 within half an hour and
    twelve, 1.8 times at weekends, 1.5 times at night, a day at most; an hour
    where there is no statistic. (F52)"""
    base = F.least(F.lit(43_200.0), F.greatest(F.lit(1_800.0), 1.5 * p95))
    scaled = base * F.when(weekend, 1.8).otherwise(1.0) * F.when(night, 1.5).otherwise(1.0)
    return F.coalesce(F.least(F.lit(86_400.0), scaled), F.lit(3_600.0))


def overlap_seconds(p95: Column) -> Column:
    """How far back to read again: half the p95 within 120 and 600; 300 without."""
    return F.coalesce(F.least(F.lit(600.0), F.greatest(F.lit(120.0), 0.5 * p95)), F.lit(300.0))


def experiment_bucket(salt: Column | str, tenant: Column) -> Column:
    """A number in 0 to 1 from a hash."""
    key = F.concat_ws(":", F.lit(salt) if isinstance(salt, str) else salt, tenant)
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def batch_multiplier(hour: Column) -> Column:
    """Of the batch size by the hour: 2 at night, 0.5 by day, 0.75 in the evening."""
    return F.when((hour >= 2) & (hour < 6), 2.0).when((hour >= 10) & (hour < 18), 0.5).when((hour >= 18) & (hour < 22), 0.75).otherwise(1.0)


def digest_mode(n: Column) -> Column:
    return F.when(n < 20, "micro").when(n <= 200, "normal").otherwise("large")
