"""Queries of charts: as-of selection, report, ranks, history, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.config import due_jobs, weighted_jobs
from chartlake.functions import keys as K
from chartlake.functions import periods as P
from chartlake.functions import scoring as S
from chartlake.operators import asof, history, inforce, lookup, merge, quality, ranking, report
from chartlake.plans.problems import _PERIOD, _TRIM
from chartlake.plans.sqltext import identity_sql, video_sql
from chartlake.runtime import materialize, table
from chartlake.sources.store import playlist_items

SERIES = ["service", "job_name", "source_variant"]
GROUPS = ("apple", "melon", "ytmusic")

# --- shared relations ------------------------------------------------------


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries as they are spelled, with their series and period in one
    form: names are normalised per delivery, not per row."""
    raw = [F.col(c).alias(f"raw_{c}") for c in ("service", "job_name", "source_variant", "reference_period", "delivered_at")]
    heads = table(spark, d, "playlist_order").where(P.trimmed(F.col("song_id")) != "").groupBy(*raw).agg(F.count("*").alias("n"))
    # The test of the count keeps Spark from folding this into later aggregates.
    return heads.where("n > 0").select(
        "*", K.service(P.trimmed(F.col("raw_service"))).alias("service"), F.col("raw_job_name").alias("job_name"), F.col("raw_source_variant").alias("source_variant"),
        P.canonical_period(F.col("raw_reference_period")).alias("period"), F.col("raw_delivered_at").alias("delivered_at"),
    )


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Series, periods and the delivery that is the snapshot of each."""
    return _heads(spark, d).groupBy(*SERIES, "period").agg(F.max("delivered_at").alias("delivered_at")).where("period is not null")


def _last_heads(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that are the snapshot of their period."""
    # A period's deliveries are few; only they meet in a window, never their rows.
    heads = _heads(spark, d).where("period is not null").withColumn("last", F.max("delivered_at").over(W.partitionBy(*SERIES, "period")))
    return heads.where(F.col("delivered_at").eqNullSafe(F.col("last")))


def chart(spark: SparkSession, d: str) -> DataFrame:
    """One rank per series, period and song: the latest delivery of a period is
    its snapshot as a whole. Of a song's ranks in it the least counts."""
    heads = _last_heads(spark, d)
    heads = heads.select(*[c for c in heads.columns if c.startswith("raw_")], *[F.col(c).alias(f"__{c}") for c in (*SERIES, "period")])
    po = table(spark, d, "playlist_order").select("service", "job_name", "source_variant", "reference_period", "delivered_at", P.trimmed(F.col("song_id")).alias("song_id"), "rank_order")
    same = reduce(lambda a, b: a & b, [po[c].eqNullSafe(heads[f"raw_{c}"]) for c in ("service", "job_name", "source_variant", "reference_period", "delivered_at")])
    rows = po.where("song_id <> ''").join(heads, same)
    return rows.groupBy(*[F.col(f"__{c}").alias(c) for c in (*SERIES, "period")], "song_id").agg(F.min("rank_order").alias("rank_order"))


def dates(spark: SparkSession, d: str) -> DataFrame:
    """The days after every daily period of the anchor job."""
    facts = table(spark, d, "playlist_order").where("job_name = 'Harbor-Top-100'")
    p = facts.select(P.canonical_period(F.col("reference_period")).alias("p")).where(F.col("p").like("____-__-__")).distinct()
    return asof.report_dates(p.select(P.history_date(F.col("p")).alias("chart_date")))


def dims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bindings, entities, names and weighted jobs, by the store's merge rules:
    the last filled binding of a song, and the last filled text of each name."""
    keyed = lambda n: table(spark, d, n).withColumns({"service": F.lower(P.trimmed(F.col("service"))), "song_id": P.trimmed(F.col("song_id"))})
    keys, rules = merge.TABLES["platform_song_ids"]
    rows = keyed("platform_song_ids").where("track_uid <> ''")
    bind = merge.merge(rows.limit(0), rows, keys, rules, ["created_at", "track_uid"]).select("service", "song_id", "track_uid")
    keys, rules = merge.TABLES["track_list"]
    # All names take the last filled text: the distinct versions of a song, few, are put in order once for all of them.
    rows = keyed("track_list").select(*keys, F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in rules]).alias("x"))
    names = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("x")).alias("xs"))
    last = lambda c: F.try_element_at(F.filter("xs", lambda x: x[c] != ""), F.lit(-1))[c]
    names = names.select(*keys, *[last(c).alias(c) for c in rules])
    return bind, table(spark, d, "tracks"), names, weighted_jobs(table(spark, d, "sync_jobs"))


_NAMES = ("album_id", "title_ko", "artist_ko", "album_ko", "title_en", "artist_en", "album_en", "artwork_url")
_CHART = f"""
obs as (
  select case when lower({_TRIM.format('service')}) in ('youtube', 'youtube_music') then 'ytmusic' else lower({_TRIM.format('service')}) end as service,
    job_name, source_variant, {_PERIOD.format(_TRIM.format('reference_period'))} as p, {_TRIM.format('song_id')} as song_id, rank_order, delivered_at
  from playlist_order),
last_delivery as (select service, job_name, source_variant, p, max(delivered_at) as delivered_at from obs where song_id <> '' group by all),
chart as (
  select o.service, o.job_name, o.source_variant, case when length(o.p) = 8 then substr(o.p, 1, 4) || '-' || substr(o.p, 5, 2) || '-' || substr(o.p, 7, 2)
      else substr(o.p, 1, 4) || '-' || substr(o.p, 5, 3) end as period, o.song_id, min(o.rank_order) as rank_order
  from obs o join last_delivery l on l.service = o.service and l.job_name = o.job_name and l.source_variant = o.source_variant
   and l.p = o.p and l.delivered_at = o.delivered_at
  where o.song_id <> '' group by all)
"""
# Place of a period in the calendar: a week stands at its Monday, after that day.
_PLACE = "(case when {0} like '%-W%' then strptime(substr({0}, 1, 4) || '-' || substr({0}, 7, 2) || '-1', '%G-%V-%u')::date else {0}::date end, {0})"
_DATES = """
days as (select distinct period::date + 1 as dd from chart where job_name = 'Harbor-Top-100' and period like '____-__-__'),
dates as (select strftime(dd, '%Y-%m-%d') as chart_date, strftime(dd - 1, '%Y-%m-%d') as cutoff, strftime(dd, '%G-W%V') as week from days)
"""
_EFFECTIVE = """
effective as (
  select chart_date, service, job_name, source_variant, max(period) as period
  from (select distinct service, job_name, source_variant, period from chart) c
  join dates on (period like '%-W%' and period <= week) or (period not like '%-W%' and period <= cutoff)
  group by all)
"""
_HEAD = f"with recursive {_CHART}, {_DATES}, {_EFFECTIVE}"
_TURN = "(" + ", ".join(f"coalesce({c}, '')" for c in _NAMES) + ")"
_DIMS = f"""
bind as (select lower({_TRIM.format('service')}) as service, {_TRIM.format('song_id')} as song_id, arg_max(track_uid, (created_at, track_uid)) as track_uid
  from platform_song_ids where track_uid <> '' group by 1, 2),
meta as (select lower({_TRIM.format('service')}) as service, {_TRIM.format('song_id')} as song_id,
  {', '.join(f"arg_max({c}, {_TURN}) filter (where {c} <> '') as {c}" for c in _NAMES)} from track_list group by 1, 2),
jobs as (select job_name, hype_group, coalesce(nullif(hype_weight, 0), case hype_group when 'apple' then 0.4 when 'melon_genz' then 0.4 when 'ytmusic' then 0.2 end, 1.0) as weight
  from sync_jobs where include_in_hype)
"""
_SCORE = "case when {0} between 1 and 100 then (((100e0/sqrt({0}::double)-10e0)*1.1e0+1e0) + ((exp(-({0}-1e0)/99e0)-exp(-1e0))*(99e0/(1e0-exp(-1e0)))+1e0))/2e0 else 0e0 end"

# --- as-of and report ------------------------------------------------------


def effective_period_asof(spark, d):
    return asof.effective_periods(snapshots(spark, d), dates(spark, d), SERIES)


def _spans(spark, d):
    bind, tracks, names, jobs = dims(spark, d)
    heads = materialize(_last_heads(spark, d).select(*inforce.HEAD, *SERIES, "period"), "deliveries")
    when = materialize(asof.effective_periods(heads, dates(spark, d), SERIES), "effective")
    po = table(spark, d, "playlist_order").select(*[F.col(c.removeprefix("raw_")).alias(c) for c in inforce.HEAD], P.trimmed(F.col("song_id")).alias("song_id"), "rank_order")
    return inforce.spans(po.where("song_id <> ''"), heads, when, bind, tracks, names, jobs)


def _report(spark, d, top=200):
    return inforce.hype_report(_spans(spark, d), GROUPS, top)


def hype_report_top(spark, d):
    r = _report(spark, d)
    return r.select("chart_date", "hype_rank", "video_id", F.round("hype_index", 2).alias("hype_index"), *[f"{g}_rank" for g in GROUPS], "entries")


def hype_components(spark, d):
    """Best rank and weighted score of each entity, date and group."""
    return inforce.components(_spans(spark, d))


def report_names(spark, d):
    """Titles of the report's rows: Korean, else English, else the video's."""
    ok = lambda c: F.nullif(F.col(c), F.lit(""))
    bind, tracks, names, _ = dims(spark, d)
    t = tracks.select("track_uid", "yt_title", "yt_artist")
    j = bind.join(names, ["service", "song_id"], "left").join(t, "track_uid")
    return j.select("service", "song_id", F.coalesce(ok("title_ko"), ok("title_en"), ok("yt_title")).alias("title"), F.coalesce(ok("artist_ko"), ok("artist_en"), ok("yt_artist")).alias("artist"))


def wave_flags(spark, d):
    return inforce.waves(_spans(spark, d), GROUPS)


def report_digest(spark, d):
    return report.digest(_report(spark, d))


# --- ranks -----------------------------------------------------------------


def rank_score(spark, d):
    return chart(spark, d).select(*SERIES, "period", "song_id", F.round(S.rank_score(F.col("rank_order")), 6).alias("score"))


def chart_rerank(spark, d):
    """Places 1..n anew per series and period."""
    return ranking.rerank(chart(spark, d), [*SERIES, "period"], [F.col("rank_order").asc_nulls_last(), F.col("song_id")], "place").select(*SERIES, "period", "song_id", "place")


def chart_top_k(spark, d):
    return ranking.top_k(chart(spark, d), [*SERIES, "period"], [F.col("rank_order").asc_nulls_last(), F.col("song_id")], 10)


def previous_rank(spark, d):
    """Rank of each song in the period before in which it was ranked."""
    return ranking.with_previous(chart(spark, d), [*SERIES, "song_id"], P.period_place(F.col("period")), "rank_order", "previous_rank")


def new_entries(spark, d):
    """Songs that the snapshot before, by calendar, did not have."""
    c = ranking.with_neighbour(chart(spark, d), snapshots(spark, d), SERIES, "period", "song_id", P.period_place(F.col("period")))
    return c.where("previous is not null and not there").select(*SERIES, "period", "song_id")


def carry_prev_set(spark, d):
    """Songs of each period that the period before, by calendar, had too."""
    c = ranking.with_neighbour(chart(spark, d), snapshots(spark, d), SERIES, "period", "song_id", P.period_place(F.col("period")))
    return c.where("there").select(*SERIES, "period", "song_id", "previous")


def repeated_in_run(spark, d):
    """Entities that a chart holds again under another song, by rank."""
    bind = dims(spark, d)[0]
    j = chart(spark, d).join(bind, ["service", "song_id"])
    j = ranking.mark_repeats(j, [*SERIES, "period", "track_uid"], [F.col("rank_order").asc_nulls_last(), F.col("song_id")])
    return j.where("repeated").select(*SERIES, "period", "song_id", "track_uid")


def blend_two_lists(spark, d):
    """Two services' best ranks as one list."""
    c = chart(spark, d)
    best = lambda s: c.where(F.col("service") == s).join(dims(spark, d)[0], ["service", "song_id"]).groupBy("track_uid").agg(F.min("rank_order").alias("rank_order")).where("rank_order is not null")
    m = lookup.merge_ranked(best("apple"), best("melon"), F.col("track_uid"), "rank_order", [], lambda a, b: F.round(S.blend(a, b), 6), limit=100)
    return m.select(F.col("key").alias("track_uid"), "rank_1", "rank_2", "score", "combined_rank")


def chart_diff(spark, d):
    """Differences between a series' last two ranked snapshots, by rank."""
    one = chart(spark, d).where("rank_order is not null").groupBy(*SERIES, "period", "rank_order").agg(F.min("song_id").alias("song_id"))
    one = materialize(one, "ranked")
    n = F.row_number().over(W.partitionBy(*SERIES).orderBy(P.period_place(F.col("period")).desc()))
    last = one.select(*SERIES, "period").distinct().withColumn("n", n)
    pick = lambda k: one.join(last.where(F.col("n") == k).select(*SERIES, "period"), [*SERIES, "period"])
    has = last.where("n = 2").select(*SERIES)
    return lookup.diff_by_rank(pick(1).join(has, SERIES), pick(2), [*SERIES, "rank_order"], ["song_id"], per=SERIES)


def playlist_chunks(spark, d):
    """Videos of the last chart of each series in chunks of 50."""
    last = snapshots(spark, d).groupBy(*SERIES).agg(F.max_by("period", P.period_place(F.col("period"))).alias("period"))
    j = chart(spark, d).join(last, [*SERIES, "period"]).join(dims(spark, d)[0], ["service", "song_id"])
    return playlist_items(j, [F.col("rank_order").asc_nulls_last(), F.col("song_id")], SERIES).select(*SERIES, "song_id", "item_order", "chunk_no")


# --- history ---------------------------------------------------------------


def _flat(spark, d):
    return _report(spark, d).select("chart_date", "video_id", "title", "artist", "hype_rank", "hype_index")


def history_compact(spark, d):
    """One ranking per date and entity."""
    return history.rankings(_flat(spark, d), ["hype_rank", "hype_index"])


def history_first_nonempty(spark, d):
    """First filled English title of each entity, newest first."""
    return inforce.newest_names(_spans(spark, d))


def history_prune(spark, d):
    """Chart periods of the last 31 days before a fixed day."""
    c = chart(spark, d).select(F.col("period").alias("chart_date"), "service").groupBy("chart_date", "service").agg(F.count("*").alias("n"))
    return history.prune(c, F.lit("2026-01-31").cast("date"))


def history_round_trip(spark, d):
    flat = _flat(spark, d)
    c = history.compact(flat, ["title", "artist"], ["hype_rank", "hype_index"])
    return history.inflate(c, "title string, artist string", "hype_rank int, hype_index double").select("chart_date", "video_id", "hype_rank", "hype_index")


# --- quality ---------------------------------------------------------------


def dq_expected_count(spark, d):
    """Rows of each snapshot against the limit of its job, by ``count_check``."""
    jobs = table(spark, d, "sync_jobs").where("entity_limit is not null").select("job_name", F.col("entity_limit").alias("expected"))
    want = snapshots(spark, d).join(jobs, "job_name").select(*SERIES, "period", "expected")
    return quality.count_check(chart(spark, d), [*SERIES, "period"], want, 0.95).where("expected is not null")


def status_histogram(spark, d):
    r = table(spark, d, "match_results")
    return quality.status_histogram(r.select(F.lower(F.trim("service")).alias("service"), "status"), ["service"], "status", ["matched", "cached_match", "failed", "manual_override"])


def freshness_class(spark, d):
    """Class of each weekly delivery against the newest one before it."""
    po = table(spark, d, "playlist_order").select("job_name", "source_variant", P.canonical_period(F.col("reference_period")).alias("period"), "delivered_at")
    one = po.where(F.col("period").contains("-W")).groupBy("job_name", "source_variant", "period", "delivered_at").agg(F.count("*").alias("n"))
    w = W.partitionBy("job_name", "source_variant").orderBy("delivered_at", "period").rowsBetween(W.unboundedPreceding, -1)
    one = one.withColumn("latest", F.max("period").over(w))
    return one.select("job_name", "source_variant", "period", F.date_format("delivered_at", "yyyy-MM-dd HH:mm:ss").alias("delivered"), quality.freshness(F.col("period"), F.col("latest"), F.lit(False), F.col("n") >= 5).alias("class"))


def due_today(spark, d):
    return due_jobs(table(spark, d, "sync_jobs").withColumn("enabled", F.col("enabled").cast("string")), "2026-01-30").select("job_name", "schedule")


def job_weights(spark, d):
    return weighted_jobs(table(spark, d, "sync_jobs"))


def period_notations(spark, d):
    """Rows per notation and canonical period."""
    p = table(spark, d, "playlist_order").select("reference_period", P.canonical_period(F.col("reference_period")).alias("period"))
    return p.groupBy("reference_period", "period").agg(F.count("*").alias("n"))


def period_iso_week(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return o.select("o_orderkey", P.iso_week(F.col("day")).alias("week"), P.week_start(F.col("day")).cast("string").alias("start"))


def schedule_align(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    k = F.pmod(F.col("o_orderkey"), F.lit(7)).cast("int")
    return o.select("o_orderkey", P.align_back(F.col("day"), k).cast("string").alias("aligned"), quality.in_window(F.col("day"), k, F.lit(2)).alias("due"))


def reference_periods(spark, d):
    """Period of a delivery by its job: weekly charts by week, others by day."""
    j = table(spark, d, "sync_jobs").select("job_name", (F.col("frequency") == "weekly").alias("weekly"))
    po = table(spark, d, "playlist_order").select("job_name", F.to_date("delivered_at").alias("day")).distinct().join(j, "job_name")
    none = F.lit(None).cast("int")
    return po.select("job_name", F.col("day").cast("string").alias("day"), P.reference_period(F.coalesce("weekly", F.lit(False)), none, none, F.col("day"), F.lit(None).cast("string")).alias("period"))


def service_names(spark, d):
    po = table(spark, d, "playlist_order")
    return po.groupBy(K.service(P.trimmed(F.col("service"))).alias("name"), "service").agg(F.count("*").alias("n"))


def union_of_sets(spark, d):
    """Songs of any chart or binding."""
    a = chart(spark, d).select("service", "song_id")
    return reduce(DataFrame.unionByName, [a, dims(spark, d)[0].select("service", "song_id")]).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        hype_report_top, effective_period_asof, hype_components, report_names, wave_flags, report_digest, rank_score, chart_rerank, chart_top_k, previous_rank,
        new_entries, carry_prev_set, repeated_in_run, blend_two_lists, chart_diff, playlist_chunks, history_compact, history_first_nonempty, history_prune,
        history_round_trip, dq_expected_count, status_histogram, freshness_class, due_today, job_weights, period_notations, period_iso_week, schedule_align,
        reference_periods, service_names, union_of_sets,
    )
}

_ROWS = f"""
songs as (
  select b.service, b.song_id, {video_sql('t.canonical_yt_video_id')} as own_video, t.yt_title, t.yt_artist, t.yt_album,
    coalesce(m.title_ko, m.title_en) as title, coalesce(m.artist_ko, m.artist_en) as artist
  from bind b join tracks t on t.track_uid = b.track_uid left join meta m on m.service = b.service and m.song_id = b.song_id),
named as (select *, {identity_sql('coalesce(title, yt_title)', 'coalesce(artist, yt_artist)', 'own_video')} as identity from songs where own_video is not null),
found as (
  select e.chart_date, c.service, c.job_name, c.source_variant, c.song_id, c.rank_order, n.own_video, n.identity, n.yt_title, n.yt_artist, n.title, n.artist,
    j.hype_group, j.weight, {_SCORE.format('c.rank_order')} * coalesce(j.weight, 0e0) as part,
    case c.service when 'apple' then 0 when 'melon' then 1 when 'spotify' then 2 when 'ytmusic' then 3 else 4 end as prio
  from chart c join effective e on c.service = e.service and c.job_name = e.job_name and c.source_variant = e.source_variant and c.period = e.period
  join named n on n.service = c.service and n.song_id = c.song_id left join jobs j on j.job_name = c.job_name),
seen as (
  select chart_date, own_video, identity, min((service, job_name, source_variant, coalesce(rank_order, 9999), song_id)) as turn,
    min((coalesce(rank_order, 9999), prio, service, job_name, source_variant, song_id)) as best
  from found group by all),
led as (
  select chart_date, own_video, arg_min(identity, turn) as identity, min(best) as best from seen group by all),
leads as (select chart_date, identity, arg_min(own_video, turn) as lead from seen group by all),
step as (select led.*, lead from led join leads using (chart_date, identity)),
climb as (
  select chart_date, own_video, best, lead as top from step
  union select climb.chart_date, climb.own_video, climb.best, step.lead from climb join step on step.chart_date = climb.chart_date and step.own_video = climb.top),
tops as (
  select climb.chart_date, climb.own_video, climb.best, climb.top from climb join step on step.chart_date = climb.chart_date and step.own_video = climb.top
  where step.lead = climb.top),
main as (select chart_date, own_video, first_value(own_video) over (partition by chart_date, top order by best) as video_id from tops),
rows as (select found.*, main.video_id from found join main using (chart_date, own_video))
"""
_ALL = f"{_HEAD}, {_DIMS}, {_ROWS}"
_REPORT = f"""{_ALL},
best as (
  select chart_date, video_id, {', '.join(f"min(rank_order) filter (where hype_group = '{g}') as {g}_rank, coalesce(max(part) filter (where hype_group = '{g}'), 0) as {g}_part" for g in GROUPS)},
    arg_min(title, (rank_order is null, coalesce(rank_order, 9999), case service when 'apple' then 0 when 'melon' then 1 when 'spotify' then 2 when 'ytmusic' then 3 else 4 end, service, job_name, source_variant, song_id)) filter (where title is not null) as t1,
    arg_min(artist, (title is null, coalesce(rank_order, 9999), case service when 'apple' then 0 when 'melon' then 1 when 'spotify' then 2 when 'ytmusic' then 3 else 4 end, service, job_name, source_variant, song_id)) filter (where artist is not null) as a1,
    max(nullif(yt_title, '')) as t2, max(nullif(yt_artist, '')) as a2, count(*) as entries
  from rows group by all),
report as (
  select *, coalesce(t1, t2) as title, coalesce(a1, a2) as artist, {' + '.join(f'{g}_part' for g in GROUPS)} as total, round(total, 2) as hype_index,
    row_number() over (partition by chart_date order by round({' + '.join(f'{g}_part' for g in GROUPS)}, 2) desc,
      {', '.join(f'coalesce({g}_rank, 9999)' for g in GROUPS)}, coalesce(t1, t2) nulls first, video_id) as hype_rank
  from best where {' + '.join(f'{g}_part' for g in GROUPS)} > 0)
"""
_S = "service, job_name, source_variant"
_PREV = f"prev as (select {_S}, period, lag(period) over (partition by {_S} order by {_PLACE.format('period')}) as previous from (select distinct {_S}, period from chart))"

ORACLE = {
    "hype_report_top": f"{_REPORT} select chart_date, hype_rank, video_id, hype_index, {', '.join(f'{g}_rank' for g in GROUPS)}, entries from report where hype_rank <= 200",
    "effective_period_asof": f"{_HEAD} select * from effective",
    "hype_components": f"{_ALL} select chart_date, video_id, hype_group, min(rank_order) as best_rank, round(max(part), 6) as best_score, count(*) as n from rows where hype_group is not null group by all",
    "report_names": f"with {_DIMS} select b.service, b.song_id, coalesce(title_ko, title_en, nullif(yt_title, '')) as title, coalesce(artist_ko, artist_en, nullif(yt_artist, '')) as artist from bind b join tracks t using (track_uid) left join meta m on m.service = b.service and m.song_id = b.song_id",
    "wave_flags": f"{_REPORT}, d as (select chart_date, lag(chart_date) over (order by chart_date) as before from (select distinct chart_date from report)) select r.chart_date, r.video_id, true as wave, o.video_id is null as new_wave from report r join d using (chart_date) left join report o on o.chart_date = d.before and o.video_id = r.video_id where r.apple_rank is not null and r.melon_rank is null",
    "report_digest": f"{_REPORT} select chart_date, string_agg(hype_rank || '. ' || coalesce(artist, '') || ' - ' || coalesce(title, ''), ' / ' order by hype_rank) as digest from report where hype_rank <= 3 group by all",
    "rank_score": f"with {_CHART} select {_S}, period, song_id, round({_SCORE.format('rank_order')}, 6) as score from chart",
    "chart_rerank": f"with {_CHART} select {_S}, period, song_id, row_number() over (partition by {_S}, period order by rank_order nulls last, song_id) as place from chart",
    "chart_top_k": f"with {_CHART} select * from chart qualify row_number() over (partition by {_S}, period order by rank_order nulls last, song_id) <= 10",
    "previous_rank": f"with {_CHART} select *, lag(rank_order) over (partition by {_S}, song_id order by {_PLACE.format('period')}) as previous_rank from chart",
    "new_entries": f"with {_CHART}, {_PREV} select c.service, c.job_name, c.source_variant, c.period, c.song_id from chart c join prev p on p.service = c.service and p.job_name = c.job_name and p.source_variant = c.source_variant and p.period = c.period and p.previous is not null left join chart o on o.service = c.service and o.job_name = c.job_name and o.source_variant = c.source_variant and o.period = p.previous and o.song_id = c.song_id where o.song_id is null",
    "carry_prev_set": f"with {_CHART}, {_PREV} select c.service, c.job_name, c.source_variant, c.period, c.song_id, p.previous from chart c join prev p on p.service = c.service and p.job_name = c.job_name and p.source_variant = c.source_variant and p.period = c.period join chart o on o.service = c.service and o.job_name = c.job_name and o.source_variant = c.source_variant and o.period = p.previous and o.song_id = c.song_id",
    "repeated_in_run": f"with {_CHART}, {_DIMS} select c.service, job_name, source_variant, period, c.song_id, track_uid from chart c join bind b on b.service = c.service and b.song_id = c.song_id qualify row_number() over (partition by c.service, job_name, source_variant, period, track_uid order by rank_order nulls last, c.song_id) > 1",
    "blend_two_lists": f"with {_CHART}, {_DIMS}, m as (select c.service, track_uid, min(rank_order) as r from chart c join bind b on b.service = c.service and b.song_id = c.song_id where rank_order is not null group by all), j as (select coalesce(a.track_uid, b.track_uid) as track_uid, a.r as rank_1, b.r as rank_2, round(0.6e0 * {_SCORE.format('a.r')} + 0.4e0 * {_SCORE.format('b.r')}, 6) as score from (select * from m where service = 'apple') a full join (select * from m where service = 'melon') b on a.track_uid = b.track_uid) select *, row_number() over (order by score desc, rank_1 nulls last, rank_2 nulls last, track_uid) as combined_rank from j qualify combined_rank <= 100",
    "chart_diff": f"with {_CHART}, per as (select *, row_number() over (partition by {_S} order by {_PLACE.format('period')} desc) as n from (select distinct {_S}, period from chart where rank_order is not null)), one as (select {_S}, period, rank_order, min(song_id) as song_id from chart where rank_order is not null group by all), x as (select one.*, n from one join per using ({_S}, period) where n <= 2) select a.service, a.job_name, a.source_variant, count(*) as compared, count_if(b.song_id is null) as missing, count_if(lower(b.song_id) <> lower(a.song_id)) as song_id_differs from (select * from x where n = 1) a left join (select * from x where n = 2) b using ({_S}, rank_order) where exists (select 1 from per p where p.n = 2 and p.service = a.service and p.job_name = a.job_name and p.source_variant = a.source_variant) group by all",
    "playlist_chunks": f"with {_CHART}, {_DIMS}, last as (select {_S}, arg_max(period, {_PLACE.format('period')}) as period from chart group by all), x as (select c.service, c.job_name, c.source_variant, c.song_id, row_number() over (partition by c.service, c.job_name, c.source_variant order by rank_order nulls last, c.song_id) as item_order from chart c join last l on l.service = c.service and l.job_name = c.job_name and l.source_variant = c.source_variant and l.period = c.period join bind b on b.service = c.service and b.song_id = c.song_id) select *, (item_order - 1) // 50 as chunk_no from x",
    "history_compact": f"{_REPORT} select chart_date, video_id, hype_rank, hype_index from report where hype_rank <= 200",
    "history_first_nonempty": f"{_ALL} select video_id, arg_min(yt_title, (-epoch(chart_date::date), coalesce(rank_order, 9999), song_id)) as name from rows where yt_title <> '' group by all",
    "history_prune": f"with {_CHART} select period as chart_date, service, count(*) as n from chart where try_cast(period as date) between date '2026-01-01' and date '2026-01-31' group by all",
    "history_round_trip": f"{_REPORT} select chart_date, video_id, hype_rank, hype_index from report where hype_rank <= 200",
    "dq_expected_count": f"with {_CHART}, per as (select {_S}, period, count(*) as rows from chart group by all) select p.*, entity_limit as expected, case when rows > entity_limit then 'over' when rows < entity_limit * 0.95 then 'short' else 'ok' end as status from per p join sync_jobs j on j.job_name = p.job_name where entity_limit is not null",
    "status_histogram": "select lower(trim(service)) as service, count_if(status = 'matched') as matched, count_if(status = 'cached_match') as cached_match, count_if(status = 'failed') as failed, count_if(status = 'manual_override') as manual_override, count(*) as total from match_results group by 1",
    "freshness_class": f"with p as (select job_name, source_variant, {_PERIOD.format(_TRIM.format('reference_period'))} as p, delivered_at from playlist_order), one as (select job_name, source_variant, substr(p, 1, 4) || '-' || substr(p, 5, 3) as period, delivered_at, count(*) as n from p where length(p) = 7 group by all), x as (select *, max(period) over (partition by job_name, source_variant order by delivered_at, period rows between unbounded preceding and 1 preceding) as latest from one) select job_name, source_variant, period, strftime(delivered_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as delivered, case when n < 5 then 'validation_failed' when latest is null or period > latest then 'published' when period = latest then 'already_current' else 'stale_source' end as class from x",
    "due_today": "select job_name, schedule from sync_jobs where coalesce(enabled, true) and (schedule is null or lower(schedule) not in ('monday','tuesday','wednesday','thursday','friday','saturday','sunday') or ((4 - list_position(['monday','tuesday','wednesday','thursday','friday','saturday','sunday'], lower(trim(schedule))) + 1 + 7) % 7) <= case when list_type = 'chart' and frequency = 'weekly' then 2 else 0 end)",
    "job_weights": "select job_name, nullif(hype_group, '') as hype_group, coalesce(nullif(hype_weight, 0), case hype_group when 'apple' then 0.4 when 'melon_genz' then 0.4 when 'ytmusic' then 0.2 end, 1.0) as hype_weight from sync_jobs where include_in_hype and trim(job_name) <> ''",
    "period_notations": f"with p as (select reference_period, {_PERIOD.format(_TRIM.format('reference_period'))} as p from playlist_order) select reference_period, case when length(p) = 8 then substr(p, 1, 4) || '-' || substr(p, 5, 2) || '-' || substr(p, 7, 2) else substr(p, 1, 4) || '-' || substr(p, 5, 3) end as period, count(*) as n from p group by all",
    "period_iso_week": "select o_orderkey, strftime(o_orderdate, '%G-W%V') as week, strftime(o_orderdate::date - 6, '%Y-%m-%d') as start from orders",
    "schedule_align": "select o_orderkey, strftime(o_orderdate::date - ((isodow(o_orderdate) - 1 - o_orderkey % 7 + 7) % 7)::int, '%Y-%m-%d') as aligned, (isodow(o_orderdate) - 1 - o_orderkey % 7 + 7) % 7 <= 2 as due from orders",
    "reference_periods": "with x as (select distinct p.job_name, (delivered_at at time zone 'UTC')::date as dd, coalesce(frequency = 'weekly', false) as weekly from playlist_order p join sync_jobs j on j.job_name = p.job_name) select job_name, strftime(dd, '%Y-%m-%d') as day, case when weekly then strftime(dd, '%G-W%V') else strftime(dd, '%Y-%m-%d') end as period from x",
    "service_names": f"select lower({_TRIM.format('service')}) as name, service, count(*) as n from playlist_order group by all",
    "union_of_sets": f"with {_CHART}, {_DIMS} select service, song_id from chart union select service, song_id from bind",
}
