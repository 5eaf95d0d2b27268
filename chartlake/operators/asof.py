"""As-of selection: the period of every series that is in force at a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions.periods import iso_week


def report_dates(dates: DataFrame, column: str = "chart_date") -> DataFrame:
    """``chart_date, cutoff, week`` of each date: the day before, up to which
    daily periods count, and its ISO week, up to which weekly periods count."""
    d = F.col(column).cast("date")
    return dates.select(F.date_format(d, "yyyy-MM-dd").alias("chart_date"), F.date_format(F.date_sub(d, 1), "yyyy-MM-dd").alias("cutoff"), iso_week(d).alias("week"))


def effective_periods(facts: DataFrame, dates: DataFrame, series: Sequence[str], period: str = "period") -> DataFrame:
    """``chart_date, series..., period``: for each date and series the last
    period that is not after it, carried forward without limit.

    ``dates`` comes from ``report_dates``. Periods are compared as texts, so a
    week outranks every day of its year. A series without such a period gives no
    row for that date; null periods never count; null series columns are values.

    Only the distinct periods meet the dates, sorted with them on one time line
    per series (a window with the last period so far), instead of a theta join.
    """
    series = list(series)
    known = facts.select(*series, period).where(F.col(period).isNotNull()).distinct()
    week = F.contains(F.col(period), F.lit("-W"))
    keys = F.struct(*[F.col(c) for c in series])
    marks = known.select(keys.alias("s"), week.alias("w"), F.col(period).alias("at"), F.lit(0).alias("turn"), F.col(period).alias("p"), F.lit(None).cast("string").alias("chart_date"))
    kinds = known.select(keys.alias("s"), week.alias("w")).distinct()
    # Dates are few (a history of days); each meets the series, not the facts.
    spine = dates.agg(F.collect_set(F.struct("chart_date", "cutoff", "week")).alias("dates"))
    asks = kinds.join(F.broadcast(spine)).select("s", "w", F.inline("dates"))
    asks = asks.select("s", "w", F.when(F.col("w"), F.col("week")).otherwise(F.col("cutoff")).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("string").alias("p"), "chart_date")
    line = W.partitionBy("s", "w").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    found = marks.unionByName(asks).withColumn("p", F.last("p", ignorenulls=True).over(line)).where("chart_date is not null and p is not null")
    best = found.groupBy("chart_date", "s").agg(F.max("p").alias("p"))
    return best.select("chart_date", *[F.col(f"s.{c}").alias(c) for c in series], F.col("p").alias(period))


def latest_with_ties(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of the greatest ``order`` per key; ties stay. Nulls come last."""
    w = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("__r", F.rank().over(w)).where("__r = 1").drop("__r")
