"""The rolling report history: inflate, compact, prune, nest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a track and of a ranking in the nested form.
RANKS = ("hype_rank", "hype_index", "apple_rank", "melon_rank", "ytmusic_rank")


def prune(rows: DataFrame, reference: Column, days: int = 31, column: str = "chart_date") -> DataFrame:
    """Rows of the ``days`` days up to ``reference``; later days and texts that
    are no date go."""
    d = F.col(column).try_cast("date")
    return rows.where(d.between(F.date_sub(reference, days - 1), reference))


def track_fields(rows: DataFrame, fields: Sequence[str], key: str = "video_id") -> DataFrame:
    """Per entity the first filled value of each field, latest date and best
    rank first (ties: title)."""
    order = lambda c: F.when(F.col(c) != "", F.struct(-F.unix_date(F.col("chart_date").try_cast("date")), F.col("hype_rank"), F.coalesce("title", F.lit(""))))
    return rows.groupBy(key).agg(*[F.min_by(c, order(c)).alias(c) for c in fields])


def rankings(rows: DataFrame, fields: Sequence[str], key: str = "video_id") -> DataFrame:
    """One ranking per date and entity; of repeated ones the worst rank stays
    (ties: the greater title)."""
    return rows.groupBy("chart_date", key).agg(F.max_by(F.struct(*fields), F.struct("hype_rank", F.coalesce("title", F.lit("")))).alias("x")).select("chart_date", key, "x.*")


def compact(rows: DataFrame, names: Sequence[str], ranks: Sequence[str], key: str = "video_id") -> DataFrame:
    """The nested history as rows ``(kind, id, json)``: one per track and one
    per date, so that no document has to fit into one row."""
    t = track_fields(rows, names, key).select(F.lit("track").alias("kind"), F.col(key).alias("id"), F.to_json(F.struct(*names)).alias("json"))
    r = rankings(rows, ranks, key).groupBy("chart_date").agg(F.sort_array(F.collect_list(F.struct("hype_rank", key, F.struct(*ranks).alias("x")))).alias("xs"))
    r = r.select(F.lit("ranking").alias("kind"), F.col("chart_date").alias("id"), F.to_json(F.map_from_entries(F.transform("xs", lambda x: F.struct(x[key], x["x"])))).alias("json"))
    return t.unionByName(r)


def inflate(compacted: DataFrame, names: str, ranks: str, key: str = "video_id") -> DataFrame:
    """The flat rows of a compacted history; ``names`` and ``ranks`` are the
    schemas (DDL) of a track and of a ranking."""
    t = compacted.where("kind = 'track'").select(F.col("id").alias(key), F.from_json("json", names).alias("t"))
    r = compacted.where("kind = 'ranking'").select(F.col("id").alias("chart_date"), F.from_json("json", f"map<string, struct<{ranks}>>").alias("m"))
    r = r.select("chart_date", F.explode("m").alias(key, "r"))
    return r.join(t, key, "left").select("chart_date", key, "r.*", "t.*")


def inflate_flat(payload: DataFrame, row: str, column: str = "json") -> DataFrame:
    """Rows of the older form: a map from date to an array of rows."""
    m = payload.select(F.from_json(column, f"map<string, array<struct<{row}>>>").alias("m"))
    return m.select(F.explode("m").alias("chart_date", "rows")).select("chart_date", F.inline("rows"))
