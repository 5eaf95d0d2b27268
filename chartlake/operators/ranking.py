"""Ranks over lists: renumbering, first occurrences, lags and set differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rerank(df: DataFrame, by: Sequence[str], order: Sequence[Column], output: str = "rank_order") -> DataFrame:
    """Ranks 1..n anew within each group."""
    return df.withColumn(output, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def mark_repeats(df: DataFrame, by: Sequence[str], order: Sequence[Column], output: str = "repeated") -> DataFrame:
    """Flags all but the first row of each key."""
    return df.withColumn(output, F.row_number().over(W.partitionBy(*by).orderBy(*order)) > 1)


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rerank(df, by, order, "__k").where(F.col("__k") <= k).drop("__k")


def with_previous(df: DataFrame, by: Sequence[str], order: Column | str, value: str, output: str = "previous") -> DataFrame:
    """``value`` of the row before in each group."""
    return df.withColumn(output, F.lag(value).over(W.partitionBy(*by).orderBy(order)))


def previous_period(df: DataFrame, series: Sequence[str], period: str, place: Column | None = None) -> DataFrame:
    """``series, period, previous``: the period before by ``place`` (the period
    itself if none is given), over distinct periods."""
    w = W.partitionBy(*series).orderBy(F.col(period) if place is None else place)
    return df.select(*series, period).where(F.col(period).isNotNull()).distinct().withColumn("previous", F.lag(period).over(w))


def with_neighbour(df: DataFrame, periods: DataFrame, series: Sequence[str], period: str, item: str, place: Column | None = None) -> DataFrame:
    """``series, period, item, previous, there``: for each item the period
    before (null for the first of a series), and whether it had the item.

    ``periods`` has the periods of every series. The items of a series lie on
    one line of places (one window per series and item), so the rows are
    shuffled once and never joined with themselves; null series columns are
    values, repeated rows count once.
    """
    pairs = previous_period(periods, series, period, place)
    pairs = pairs.withColumn("__n", F.row_number().over(W.partitionBy(*series).orderBy(F.col(period) if place is None else place)))
    here = df.select(*[F.col(c).alias(f"__{c}") for c in series], period, item).distinct()
    same = [here[f"__{c}"].eqNullSafe(pairs[c]) for c in series] + [here[period] == pairs[period]]
    j = here.join(pairs, same).select(*series, here[period], item, "previous", "__n")
    before = F.lag("__n").over(W.partitionBy(*series, item).orderBy("__n"))
    return j.withColumn("there", F.coalesce(before == F.col("__n") - 1, F.lit(False))).drop("__n")


def new_entries(df: DataFrame, series: Sequence[str], period: str, item: str, place: Column | None = None) -> DataFrame:
    """Items of each period that the period before did not have; the first
    period of a series has none."""
    return with_neighbour(df, df, series, period, item, place).where("previous is not null and not there").select(*series, period, item)


def concat_sources(parts: Sequence[DataFrame], key: Column, order: Sequence[Column]) -> DataFrame:
    """Several sources as one: of rows with one key the first by source and
    ``order`` stays; rows without a key all stay."""
    tagged = [p.withColumn("source_no", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    both = both.withColumn("__key", key)
    w = W.partitionBy("__key").orderBy("source_no", *order)
    loose = both.where("__key is null")
    return both.where("__key is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n").unionByName(loose).drop("__key")


def multiset_overlap(left: DataFrame, right: DataFrame, key: str, tokens: str) -> DataFrame:
    """``key, shared, left_n, right_n`` of the token arrays of two tables, as
    multisets, by a join of token counts."""
    count = lambda df, n: df.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias(n))
    j = count(left, "a").join(count(right, "b"), [key, "token"], "full_outer").fillna(0, ["a", "b"])
    return j.groupBy(key).agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("left_n"), F.sum("b").alias("right_n"))
