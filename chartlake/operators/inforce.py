"""The report over spans: each chart entry once, with the dates it is in force at.

A snapshot is in force at consecutive dates, so an entry is kept once with the
first and last of them. Entries are shuffled once, by video; the dates are
unfolded in the task that sums a video up, and never written. The report is
summed up twice: over the rows of its groups for the first places of each date,
then with names over all rows of these.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions.scoring import rank_score
from chartlake.operators.report import NO_RANK, SERIES, priority, report_order, song_entities
from chartlake.runtime import broadcast_if_small, materialize, never_broadcast

NAMED = ("video_id", "identity", "track_uid", "album_id", "artwork_url", "title", "artist", "album", "yt_title", "yt_artist", "yt_album")
HEAD = ("raw_service", "raw_job_name", "raw_source_variant", "raw_reference_period", "raw_delivered_at")
#: Rows of some 150 bytes that may be broadcast here; the driver holds several of them at once.
SMALL = 50_000


@dataclass
class Spans:
    """``heads``: deliveries in force with ``sid`` (place of their series) and ``first``, ``last`` (places of dates);
    ``songs``: their entities; ``days``: place and text of each date;
    ``entries``: rows as delivered, with the columns of HEAD, ``song_id`` and ``rank_order``."""

    heads: DataFrame
    songs: DataFrame
    days: DataFrame
    entries: DataFrame
    shared: bool


def spans(entries: DataFrame, heads: DataFrame, inforce: DataFrame, bindings: DataFrame, tracks: DataFrame, metadata: DataFrame, jobs: DataFrame) -> Spans:
    """``heads`` has the columns of HEAD with series and period, only those that
    are the snapshot of their period; ``inforce`` comes from ``effective_periods``."""
    # Dates are few (a history of days), series are the charts of the jobs: each is numbered in one task.
    days = materialize(inforce.select("chart_date").distinct().withColumn("day", F.row_number().over(W.orderBy("chart_date"))), "days")
    series = heads.select(*SERIES).distinct().withColumn("sid", F.row_number().over(W.orderBy(priority(), *SERIES)))
    when = inforce.join(F.broadcast(days), "chart_date").groupBy(*SERIES, "period").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    j = jobs.select("job_name", "hype_group", F.col("hype_weight").alias("weight"))
    h = heads.join(never_broadcast(when), [*SERIES, "period"]).join(never_broadcast(series), list(SERIES)).join(j, "job_name", "left")
    h = materialize(h.select(*HEAD, *SERIES, "sid", "first", "last", "hype_group", "weight"), "heads")
    songs = materialize(song_entities(bindings, tracks, metadata), "songs")
    multi = songs.groupBy("identity").agg(F.min("video_id").alias("lo"), F.max("video_id").alias("hi")).where("lo <> hi").select("identity")
    # Only a video with an identity that another video has too can lead or follow one at some date.
    tied = materialize(songs.join(never_broadcast(multi), "identity", "left_semi").select("video_id").distinct(), "tied")
    shared = bool(tied.head(1))
    if shared:
        songs = songs.join(never_broadcast(tied.withColumn("tied", F.lit(True))), "video_id", "left").withColumn("tied", F.coalesce("tied", F.lit(False)))
        songs = materialize(songs, "songs")
    else:
        songs = songs.withColumn("tied", F.lit(False))
    return Spans(h, songs, days, entries, shared)


def _met(s: Spans, songs: DataFrame, *keep: str) -> DataFrame:
    """Entries in force with their song: small sides are broadcast, else shuffled."""
    h = broadcast_if_small(s.heads, SMALL).withColumnRenamed("service", "h_service")
    same = reduce(lambda a, b: a & b, [s.entries[c].eqNullSafe(h[c]) for c in HEAD])
    rows = s.entries.join(h, same).select("h_service", "song_id", "rank_order", *[c for c in h.columns if c not in (*HEAD, "h_service")])
    songs = broadcast_if_small(songs.select(F.col("service").alias("__service"), F.col("song_id").alias("__song"), *keep), SMALL)
    return rows.join(songs, (rows["h_service"] == songs["__service"]) & (rows["song_id"] == songs["__song"])).drop("__service", "__song").withColumnRenamed("h_service", "service")


def placed_songs(s: Spans) -> DataFrame:
    """Songs of videos that are groups of their own at every date, with their place in the video."""
    place = F.row_number().over(W.partitionBy("video_id").orderBy("song_id", "service"))
    return materialize(s.songs.where(~F.col("tied")).withColumn("place", place), "places")


def ranked_songs(s: Spans, songs: DataFrame) -> DataFrame:
    """One row per snapshot and song of ``placed_songs``, partitioned by video."""
    rows = _met(s, songs, "video_id", "place")
    rows = rows.select("video_id", "place", "rank_order", "sid", "first", "last", "hype_group", "weight").repartition("video_id")
    return rows.groupBy(*[c for c in rows.columns if c != "rank_order"]).agg(F.min("rank_order").alias("rank_order"))


def tied_rows(s: Spans) -> DataFrame | None:
    """Rows of each date, as ``report_rows`` has them, of the videos that share
    an identity with others; None without any."""
    if not s.shared:
        return None
    rows = _met(s, s.songs.where("tied"), *NAMED)
    rows = rows.groupBy(*[c for c in rows.columns if c != "rank_order"]).agg(F.min("rank_order").alias("rank_order"))
    rows = rows.withColumn("day", F.explode(F.sequence("first", "last"))).drop("first", "last", "sid")
    return rows.join(F.broadcast(s.days), "day").drop("day")


def _rank() -> Column:
    return F.coalesce("rank_order", F.lit(NO_RANK))


def _part() -> Column:
    return rank_score(F.col("rank_order")) * F.coalesce("weight", F.lit(0.0))


def _unfolded(s: Spans) -> DataFrame:
    """Per date, video and series: least rank, greatest part, entries. Unfolded
    last, in the same task."""
    r = ranked_songs(s, placed_songs(s)).withColumn("__part", _part())
    g = r.groupBy("video_id", "sid", "first", "last", "hype_group").agg(F.min("rank_order").alias("rank_order"), F.max("__part").alias("__part"), F.count("*").alias("n"))
    return g.withColumn("day", F.explode(F.sequence("first", "last")))


def _sums(groups: Sequence[str]) -> list[Column]:
    out = []
    for g in groups:
        at = F.col("hype_group") == g
        out += [F.min(F.when(at, F.col("rank_order"))).alias(f"{g}_rank"), F.coalesce(F.max(F.when(at, F.col("__part"))), F.lit(0.0)).alias(f"__{g}")]
    return out


def _total(groups: Sequence[str]) -> Column:
    return sum((F.col(f"__{g}") for g in groups), F.lit(0.0))


def first_places(s: Spans, groups: Sequence[str], top: int, tied: DataFrame | None) -> DataFrame:
    """``chart_date, day, video_id``: who is within the first ``top`` places of a
    date before names break ties. Rows of other groups do not count, nor do
    repeated ones, so only what has a group is read and summed up here.
    ``tied`` has the grouped rows of ``tied_rows``."""
    heads = s.heads.where(F.col("hype_group").isin(*groups))
    # The jobs of these groups hold a part of all entries; the others are not shuffled.
    jobs = materialize(heads.select("raw_job_name").distinct(), "jobs")
    entries = s.entries.join(broadcast_if_small(jobs, SMALL), "raw_job_name", "left_semi")
    rows = _met(replace(s, heads=heads, entries=entries), s.songs.where(~F.col("tied")), "video_id")
    rows = rows.select("video_id", "first", "last", "hype_group", "rank_order", _part().alias("__part")).repartition("video_id")
    spans = rows.groupBy("video_id", "first", "last").agg(*_sums(groups)).withColumn("day", F.explode(F.sequence("first", "last")))
    each = [F.min(f"{g}_rank").alias(f"{g}_rank") for g in groups] + [F.max(f"__{g}").alias(f"__{g}") for g in groups]
    out = spans.groupBy("day", "video_id").agg(*each)
    if tied is not None:
        t = tied.withColumn("__part", _part()).groupBy("chart_date", "video_id").agg(*_sums(groups)).join(F.broadcast(s.days), "chart_date")
        out = out.unionByName(t.select(*out.columns))
    out = out.withColumn("__total", _total(groups)).where("__total > 0").withColumn("hype_index", F.round("__total", 2))
    order = report_order(groups, "video_id")
    out = out.withColumn("__r", F.rank().over(W.partitionBy("day").orderBy(*order[:-2]))).where(F.col("__r") <= top)
    return materialize(out.select("day", "video_id").join(F.broadcast(s.days), "day"), "first")


def hype_report(s: Spans, groups: Sequence[str], top: int) -> DataFrame:
    """``report.hype_report`` of the first ``top`` places of each date: over all
    rows of those who may be there."""
    from chartlake.operators import report

    tied = tied_rows(s)
    tied = None if tied is None else report.grouped_rows(tied)
    first = first_places(s, groups, top, tied)
    # At most as many as dates and places, but for ties.
    songs = s.songs.where(~F.col("tied")).join(broadcast_if_small(first, SMALL).select("video_id").distinct(), "video_id", "left_semi")
    songs = materialize(songs, "first_songs")
    entries = s.entries.join(broadcast_if_small(songs, SMALL).select("song_id").distinct(), "song_id", "left_semi")
    rows = _met(replace(s, entries=entries), songs, *NAMED)
    at = broadcast_if_small(first, SMALL).withColumnRenamed("video_id", "__video")
    rows = rows.join(at, (rows["video_id"] == at["__video"]) & at["day"].between(rows["first"], rows["last"])).drop("__video", "day", "first", "last", "sid")
    rows = rows.groupBy(*[c for c in rows.columns if c != "rank_order"]).agg(F.min("rank_order").alias("rank_order"))
    if tied is not None:
        rows = rows.unionByName(tied.join(at, (tied["video_id"] == at["__video"]) & (tied["chart_date"] == at["chart_date"]), "left_semi").select(*rows.columns))
    return report.hype_report(rows, groups, top=top)


def components(s: Spans) -> DataFrame:
    """Best rank and weighted score of each entity, date and group."""
    from chartlake.operators import report

    def summed(r: DataFrame, n: Column, day: str) -> DataFrame:
        return r.groupBy(day, "video_id", "hype_group").agg(F.min("rank_order").alias("best_rank"), F.round(F.max("__part"), 6).alias("best_score"), n.alias("n"))

    part = rank_score(F.col("rank_order")) * F.col("weight")
    out = summed(_unfolded(s).where("hype_group is not null"), F.sum("n"), "day").join(F.broadcast(s.days), "day").drop("day")
    if (tied := tied_rows(s)) is not None:
        t = summed(report.grouped_rows(tied).where("hype_group is not null").withColumn("__part", part), F.count("*"), "chart_date")
        out = out.unionByName(t.select(*out.columns))
    return out.select("chart_date", "video_id", "hype_group", "best_rank", "best_score", "n")


def waves(s: Spans, groups: Sequence[str], present: str = "apple_rank", absent: str = "melon_rank") -> DataFrame:
    """``report.wave_flags`` of the whole report, rows with a wave only."""
    from chartlake.operators import report

    out = _unfolded(s).groupBy("day", "video_id").agg(*_sums(groups)).where(_total(groups) > 0)
    if (tied := tied_rows(s)) is not None:
        t = report.grouped_rows(tied).withColumn("__part", _part()).groupBy("chart_date", "video_id").agg(*_sums(groups)).where(_total(groups) > 0)
        t = t.join(F.broadcast(s.days), "chart_date").drop("chart_date")
        out = out.unionByName(t.select(*out.columns))
    wave = F.col(present).isNotNull() & F.col(absent).isNull()
    out = out.select("video_id", "day", wave.alias("wave")).withColumn("prev", F.lag("day").over(W.partitionBy("video_id").orderBy("day")))
    out = materialize(out, "waves")
    # Dates without a report are passed over.
    days = out.select("day").distinct().withColumn("before", F.lag("day").over(W.orderBy("day"))).join(s.days, "day")
    out = out.where("wave").join(F.broadcast(days), "day")
    return out.select("chart_date", "video_id", "wave", (~(F.col("prev").isNotNull() & F.col("prev").eqNullSafe(F.col("before")))).alias("new_wave"))


def newest_names(s: Spans) -> DataFrame:
    """``video_id, name``: the first filled title of each video, newest date,
    best rank and least song first. An entry counts at its last date."""
    from chartlake.operators import history, report

    # The last date before the rank: both fit into one number.
    newest = F.col("last").cast("bigint") * -(1 << 33) + _rank()
    songs = placed_songs(s).where("yt_title <> ''")
    r = ranked_songs(s, songs).groupBy("video_id", "place").agg(F.min(newest).alias("newest"))
    first = r.groupBy("video_id").agg(F.min(F.struct("newest", "place")).alias("x")).select("video_id", "x.place")
    out = first.join(songs.select("video_id", "place", F.col("yt_title").alias("name")), ["video_id", "place"]).select("video_id", "name")
    if (tied := tied_rows(s)) is not None:
        t = report.grouped_rows(tied).select("chart_date", "video_id", F.col("yt_title").alias("name"), F.col("song_id").alias("title"), _rank().alias("hype_rank"))
        out = out.unionByName(history.track_fields(t, ["name"]).where("name is not null").select("video_id", "name"))
    return out
