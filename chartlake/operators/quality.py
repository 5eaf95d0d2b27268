"""Checks of deliveries: expected counts, freshness, schedules, statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.functions.periods import week_sort_key


def count_check(df: DataFrame, by: Sequence[str], expected: DataFrame, lowest_share: float = 1.0) -> DataFrame:
    """Rows per group against ``expected`` (same columns and ``expected``):
    ``ok`` from ``lowest_share`` of it up to it, else ``short``, ``over``,
    ``missing`` (no rows) or ``unexpected`` (no expectation)."""
    have = df.groupBy(*by).agg(F.count("*").alias("rows"))
    j = have.join(expected.select(*by, "expected"), list(by), "full_outer").fillna(0, ["rows"])
    n, e = F.col("rows"), F.col("expected")
    status = (
        F.when(e.isNull(), "unexpected").when(n == 0, "missing").when(n > e, "over").when(n < e * lowest_share, "short").otherwise("ok")
    )
    return j.withColumn("status", status)


def assert_count(df: DataFrame, expected: int, lowest: int | None = None) -> DataFrame:
    """``df``, of which any use fails unless it has the expected rows."""
    n = df.agg(F.count("*").alias("__n"))
    bad = ~F.col("__n").between(expected if lowest is None else lowest, expected)
    checked = n.select(F.when(bad, F.raise_error(F.format_string("expected %d rows, found %d", F.lit(expected), F.col("__n")))).otherwise(True).cast("boolean").alias("__ok"))
    return df.join(F.broadcast(checked)).where("__ok").drop("__ok")


def freshness(fetched: Column, latest: Column, error: Column, valid: Column) -> Column:
    """Class of a delivery of a weekly source: ``source_error``,
    ``validation_failed``, ``stale_source``, ``already_current``, ``published``."""
    f, l = week_sort_key(F.coalesce(fetched, F.lit(""))), week_sort_key(F.coalesce(latest, F.lit("")))
    return (
        F.when(F.coalesce(error, F.lit(False)), "source_error")
        .when(~F.coalesce(valid, F.lit(True)), "validation_failed")
        .when(f < l, "stale_source")
        .when(f == l, "already_current")
        .otherwise("published")
    )


def in_window(day: Column, weekday: Column, retry_days: Column) -> Column:
    """Whether ``day`` is at most ``retry_days`` after the last ``weekday``."""
    return F.pmod(F.weekday(day) - weekday, F.lit(7)) <= retry_days


def status_histogram(df: DataFrame, by: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """One count per status value."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count("*").alias("total"))
