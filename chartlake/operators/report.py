"""The weighted cross-source popularity report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions.keys import linked_video
from chartlake.functions.scoring import rank_score
from chartlake.functions.text import identity_key
from chartlake.operators.asof import effective_periods
from chartlake.operators.components import resolve_chains
from chartlake.runtime import materialize, never_broadcast

SERIES = ("service", "job_name", "source_variant")
# Services in the order in which their attributes are preferred.
SERVICES = ("apple", "melon", "spotify", "ytmusic")
NO_RANK = 9999


def report_rows(facts: DataFrame, dates: DataFrame, bindings: DataFrame, tracks: DataFrame, metadata: DataFrame, jobs: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """One row per chart entry in force at each date, with its entity, names,
    group and weight. Songs without a binding, and entities without a video,
    drop out; metadata and jobs are left-joined. ``periods`` has the series and
    periods of ``facts`` where these are at hand without reducing all facts."""
    inforce = effective_periods(facts if periods is None else periods, dates, SERIES)
    songs = song_entities(bindings, tracks, metadata)
    j = jobs.select("job_name", "hype_group", F.col("hype_weight").alias("weight"))
    return facts.join(inforce, [*SERIES, "period"]).join(songs, ["service", "song_id"]).join(j, "job_name", "left")


def song_entities(bindings: DataFrame, tracks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Bound songs with the video, names and identity of their entity."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    t = tracks.select("track_uid", linked_video(F.col("canonical_yt_video_id")).alias("video_id"), "yt_title", "yt_artist", "yt_album").where("video_id is not null")
    names = metadata.select(
        "service", "song_id", "album_id", "artwork_url",
        *[F.coalesce(filled(f"{f}_ko"), F.col(f"{f}_en")).alias(f) for f in ("title", "artist", "album")],
    )
    songs = bindings.select("service", "song_id", "track_uid").join(never_broadcast(t), "track_uid").join(never_broadcast(names), ["service", "song_id"], "left")
    return songs.withColumn("identity", identity_key(*[F.coalesce(filled(c), F.col(f"yt_{c}")) for c in ("title", "artist")], F.col("video_id")))


def grouped_rows(rows: DataFrame) -> DataFrame:
    """``rows`` of ``report_rows`` with the video of their group in place of
    their own: that of the group's best-ranked row (ties: service order, then
    the order of rows).

    Rows of a date are grouped first come by video, then by identity, in the
    order of service, job, variant, rank and song. So a video belongs where the
    first video of its own first identity belongs, which came earlier: the
    groups of all dates are one forest, whose roots are found by following
    chains, and no date has to fit in a task.
    """
    rank = F.coalesce("rank_order", F.lit(NO_RANK))
    turn = F.struct("service", "job_name", "source_variant", rank.alias("rank"), "song_id")
    best = F.struct(rank.alias("rank"), priority().alias("prio"), turn.alias("turn"))
    rows = materialize(rows, "rows")  # used by the groups and by the result
    seen = rows.groupBy("chart_date", "video_id", "identity").agg(F.min(turn).alias("turn"), F.min(best).alias("best"))
    videos = seen.groupBy("chart_date", "video_id").agg(F.min_by("identity", "turn").alias("identity"), F.min("best").alias("best"))
    leads = seen.groupBy("chart_date", "identity").agg(F.min_by("video_id", "turn").alias("__lead"))
    videos = materialize(videos.join(never_broadcast(leads), ["chart_date", "identity"]), "videos")
    node = lambda v: F.concat_ws("/", "chart_date", v)
    moves = videos.where("__lead <> video_id").select(node("video_id").alias("old"), node("__lead").alias("new"))
    ends = resolve_chains(moves, "old", "new")
    videos = videos.withColumn("__node", node("video_id")).join(never_broadcast(ends), F.col("__node") == F.col("old"), "left")
    top = F.coalesce("new", "__node")
    mains = videos.groupBy(top.alias("__top")).agg(F.min_by("video_id", "best").alias("__main"))
    main = videos.withColumn("__top", top).join(never_broadcast(mains), "__top").where("__main <> video_id").select("chart_date", "video_id", "__main")
    out = rows.join(never_broadcast(main), ["chart_date", "video_id"], "left")
    return out.withColumn("video_id", F.coalesce("__main", "video_id")).drop("__main")


def priority() -> Column:
    return F.coalesce(*[F.when(F.col("service") == s, i) for i, s in enumerate(SERVICES)], F.lit(len(SERVICES)))


def hype_report(rows: DataFrame, groups: Sequence[str], key: str = "video_id", top: int | None = 200) -> DataFrame:
    """The report of every date: entities by the sum of their best weighted
    scores per group.

    ``rows`` comes from ``report_rows``. Per group an entity has its least rank
    and its greatest ``score * weight``; ``hype_index`` is their sum rounded to
    two places, and only entities above 0 (unrounded) are kept. Names come from
    the best-ranked row (ties: service order, then song id) that has a title,
    else from the video; artwork from the first service that has any. Rows of
    jobs without a group give names only. Ties in the index go by the groups'
    ranks, title and key. ``top`` cuts each date; without it all rows stay.
    """
    out = entity_sums(rows, groups, key)
    total = sum((F.col(f"__{g}") for g in groups), F.lit(0.0))
    out = out.withColumn("__total", total).where("__total > 0").withColumn("hype_index", F.round("__total", 2))
    out = out.withColumn("hype_rank", F.row_number().over(W.partitionBy("chart_date").orderBy(*report_order(groups, key))))
    if top is not None:
        out = out.where(F.col("hype_rank") <= top)
    return out.drop("__total", *[f"__{g}" for g in groups])


def entity_sums(rows: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    """Per date and entity: rank and part of each group, names, entries."""
    prio = priority()
    rank = F.coalesce("rank_order", F.lit(NO_RANK))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    part = rank_score(F.col("rank_order")) * F.coalesce("weight", F.lit(0.0))
    r = rows.withColumn("__part", part).withColumn("__order", F.struct(F.coalesce(filled("title"), F.lit("")) == "", rank, prio, F.col("service"), F.col("job_name"), F.col("source_variant"), F.col("song_id")))
    aggs = []
    for g in groups:
        at = F.col("hype_group") == g
        aggs += [F.min(F.when(at, F.col("rank_order"))).alias(f"{g}_rank"), F.coalesce(F.max(F.when(at, F.col("__part"))), F.lit(0.0)).alias(f"__{g}")]
    best = lambda c, y: F.coalesce(F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("__order"))), F.max(filled(y)))
    art = F.min_by(filled("artwork_url"), F.when(filled("artwork_url").isNotNull(), F.struct(prio, F.col("__order"))))
    return r.groupBy("chart_date", key).agg(
        *aggs, best("title", "yt_title").alias("title"), best("artist", "yt_artist").alias("artist"), best("album", "yt_album").alias("album"), art.alias("artwork_url"),
        F.count("*").alias("entries"),
    )


def report_order(groups: Sequence[str], key: str) -> list[Column]:
    return [F.col("hype_index").desc(), *[F.coalesce(f"{g}_rank", F.lit(NO_RANK)) for g in groups], F.col("title"), F.col(key)]


def wave_flags(report: DataFrame, present: str = "apple_rank", absent: str = "melon_rank") -> DataFrame:
    """``wave``: ranked in one group and not in the other; ``new_wave``: and not
    in the report of the date before."""
    days = report.select("chart_date").distinct().withColumn("__before", F.lag("chart_date").over(W.orderBy("chart_date")))
    old = report.select(F.col("chart_date").alias("__before"), "video_id").distinct().withColumn("__old", F.lit(True))
    j = report.join(F.broadcast(days), "chart_date").join(old, ["__before", "video_id"], "left")
    wave = F.col(present).isNotNull() & F.col(absent).isNull()
    return j.withColumn("wave", wave).withColumn("new_wave", wave & F.col("__old").isNull()).drop("__before", "__old")


def digest(report: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` songs of each date as one text."""
    line = F.format_string("%d. %s - %s", F.col("hype_rank"), F.coalesce("artist", F.lit("")), F.coalesce("title", F.lit("")))
    top = report.where(F.col("hype_rank") <= n).select("chart_date", F.struct("hype_rank", line.alias("line")).alias("x"))
    lines = top.groupBy("chart_date").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return lines.select("chart_date", F.array_join(F.transform("xs", lambda x: x["line"]), " / ").alias("digest"))
