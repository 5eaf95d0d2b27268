"""Prioritised lookups, merges of ranked lists, and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.runtime import materialize


def first_hit(rows: DataFrame, keys: str, index: DataFrame, key: str, value: str, output: str) -> DataFrame:
    """``rows`` with ``output``: the value of the first key of the array column
    ``keys`` that ``index`` knows; null if it knows none. ``index`` is unique by
    ``key``. Rows with a null or empty array, and repeated rows, stay."""
    tagged = rows.drop(output).withColumn("__row", F.struct(*[c for c in rows.columns if c != output]))
    known = index.select(F.col(key).alias("__key"), F.col(value).alias("__value"))
    pairs = tagged.select("__row", F.posexplode(keys).alias("__pos", "__key")).join(known, "__key")
    best = pairs.groupBy("__row").agg(F.min_by("__value", "__pos").alias(output))
    out = tagged.join(best.withColumnRenamed("__row", "__hit"), F.col("__row").eqNullSafe(F.col("__hit")), "left")
    return out.drop("__row", "__hit")


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def localize(rows: DataFrame, names: DataFrame, lookups: Sequence[Sequence[str]], columns: Sequence[str], order: str) -> DataFrame:
    """``columns`` filled from ``names``, found by the first of ``lookups`` (lists
    of equal-named columns: by id, else by other id, else by rank) that hits; of
    repeated keys the last in ``order`` counts. A found text that is empty does
    not replace what is there."""
    out = rows
    for i, on in enumerate(lookups):
        side = last_of(names, on, [order]).select(*[F.col(c).alias(f"__k{i}_{c}") for c in on], F.struct(*columns).alias(f"__hit{i}"))
        out = out.join(side, [out[c] == side[f"__k{i}_{c}"] for c in on], "left").drop(*[f"__k{i}_{c}" for c in on])
    hit = F.coalesce(*[F.col(f"__hit{i}") for i in range(len(lookups))])
    for c in columns:
        old = [F.col(c)] if c in rows.columns else []
        out = out.withColumn(f"__new_{c}", F.coalesce(F.nullif(hit[c], F.lit("")), *old))
    kept = [F.col(c) for c in rows.columns if c not in columns]
    return out.select(*kept, *[F.col(f"__new_{c}").alias(c) for c in columns])


def merge_ranked(first: DataFrame, second: DataFrame, key: Column, rank: str, attributes: Sequence[str], score: object, limit: int | None = None) -> DataFrame:
    """Two ranked lists as one: rows that share ``key`` meet (full outer), the
    first list's attributes win, ``score(rank_1, rank_2)`` orders them (ties by
    the ranks, then the key), and ``combined_rank`` numbers them.

    The top of the list is cut by ``limit`` if given. Of repeated keys the best
    rank counts."""

    def side(df: DataFrame, n: int) -> DataFrame:
        w = W.partitionBy("__key").orderBy(F.col(rank).asc_nulls_last(), *attributes)
        one = df.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).where("__n = 1")
        return one.select(F.col("__key").alias("key"), F.col(rank).alias(f"rank_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in attributes])

    both = side(first, 1).join(side(second, 2), "key", "full_outer")
    both = both.select("key", "rank_1", "rank_2", *[F.coalesce(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(c) for c in attributes])
    both = both.withColumn("score", score(F.col("rank_1"), F.col("rank_2")))
    order = [F.col("score").desc(), F.col("rank_1").asc_nulls_last(), F.col("rank_2").asc_nulls_last(), F.col("key")]
    if limit is not None:
        both = both.orderBy(*order).limit(limit)
    return both.withColumn("combined_rank", F.row_number().over(W.orderBy(*order))) if limit is not None else number(both, order, "combined_rank")


def number(df: DataFrame, order: Sequence[Column], output: str) -> DataFrame:
    """``df`` with its place 1..n in ``order`` without gathering it in one task:
    range-partitioned, written (both uses must see the same partitions),
    counted per partition, and offset."""
    sortd = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    counts = sortd.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ahead = counts.withColumn("__ahead", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")
    out = sortd.withColumn("__part", part).join(F.broadcast(ahead), "__part")
    return out.withColumn(output, (F.col("__ahead") + F.col("__id").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("__id", "__part", "__ahead")


def diff_by_rank(left: DataFrame, right: DataFrame, by: Sequence[str], fields: Sequence[str], per: Sequence[str] = ()) -> DataFrame:
    """Counts of rows of ``left`` that ``right`` lacks at the same place, and of
    those that differ in each field, apart from case; per group of ``per``."""
    r = right.select(*by, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__there"))
    j = left.join(r, list(by), "left")
    there = F.col("__there").isNotNull()
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return j.groupBy(*per).agg(
        F.count("*").alias("compared"),
        F.count_if(~there).alias("missing"),
        *[F.count_if(there & (low(F.col(f)) != low(F.col(f"__{f}")))).alias(f"{f}_differs") for f in fields],
    )
