"""The general problems over the domain tables: snapshot changes, orphans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.functions.periods import (
    canonical_period,
    compact_period,
    filled,
    period_code,
    period_label,
    trimmed,
)
from chartlake.operators.orphans import orphan_references
from chartlake.operators.snapshots import snapshot_changes
from chartlake.runtime import table


def _observations(spark: SparkSession, d: str) -> DataFrame:
    po = table(spark, d, "playlist_order")
    return po.select(
        F.lower(trimmed(F.col("service"))).alias("service"),
        "job_name",
        "source_variant",
        compact_period(F.col("reference_period")).alias("reference_period"),
        trimmed(F.col("song_id")).alias("song_id"),
        "rank_order",
        "delivered_at",
    ).where("song_id <> ''")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Songs that entered, left or moved between consecutive snapshots."""
    return snapshot_changes(
        _observations(spark, d),
        series=["service", "job_name", "source_variant"],
        key=["song_id"],
        values=["rank_order"],
        period="reference_period",
        delivered="delivered_at",
        code=period_code,
        label=period_label,
    )


def p1_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes by kind, job and period."""
    return p1_found(spark, d).groupBy("service", "job_name", "reference_period", "change").agg(F.count("*").alias("n"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = (
        _observations(spark, d)
        .groupBy("service", "song_id", "reference_period")
        .agg(F.min("delivered_at").alias("at"))
        .withColumn("reference_period", F.coalesce(canonical_period(F.col("reference_period")), F.col("reference_period")))
    )
    bound = table(spark, d, "platform_song_ids").select(
        F.lower(trimmed(F.col("service"))).alias("service"),
        trimmed(F.col("song_id")).alias("song_id"),
        "track_uid",
        "created_at",
        F.date_format("created_at", "yyyy-MM-dd").alias("period"),
    )
    return seen, bound


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target, per table and period."""
    seen, bound = _references(spark, d)
    song = [("service", "service"), ("song_id", "song_id")]
    meta = table(spark, d, "track_list").select(
        F.lower(trimmed(F.col("service"))).alias("service"), trimmed(F.col("song_id")).alias("song_id")
    )
    tracks = table(spark, d, "tracks").select("track_uid", "created_at")
    retired = table(spark, d, "retired_tracks").select(F.col("track_uid").alias("gone")).where("gone is not null").distinct()

    a = orphan_references(seen, bound, song, ref_time="at", target_time="created_at").select(
        F.lit("playlist_order").alias("ref_table"), F.lit("song_id").alias("ref_field"),
        F.col("reference_period").alias("period"), "service", "song_id", "reason",
    )
    keyed = bound.where("song_id <> ''").select("period", "service", "song_id").distinct()
    b = orphan_references(keyed, meta, song).select(
        F.lit("platform_song_ids").alias("ref_table"), F.lit("song_id").alias("ref_field"), "period", "service", "song_id", "reason"
    )
    named = bound.where("track_uid <> ''").distinct()
    c = orphan_references(named, tracks, [("track_uid", "track_uid")], ref_time="created_at", target_time="created_at")
    c = c.join(retired, (F.col("reason") == "missing") & (c["track_uid"] == retired["gone"]), "left").select(
        F.lit("platform_song_ids").alias("ref_table"), F.lit("track_uid").alias("ref_field"), "period", "service", "song_id",
        F.when(F.col("gone").isNotNull(), "deleted").otherwise(F.col("reason")).alias("reason"),
    )
    return reduce(DataFrame.unionByName, [a, b, c.distinct()])


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans counted per table, field, period and reason."""
    return p2_found(spark, d).groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("n"))


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(13))"
_PERIOD = "upper(replace(replace(replace({0}, '.', ''), '-', ''), '/', ''))"

_P1 = f"""
with po as (
  select lower({_TRIM.format('service')}) as service, job_name, source_variant,
         {_PERIOD.format(_TRIM.format('reference_period'))} as p,
         {_TRIM.format('song_id')} as song_id, rank_order, delivered_at
  from playlist_order),
day as (
  select * exclude (p), case when length(p) = 8
       then substr(p, 1, 4) || '-' || substr(p, 5, 2) || '-' || substr(p, 7, 2)
       else substr(p, 1, 4) || '-' || substr(p, 5, 3) end as reference_period,
     case when length(p) = 8 then strptime(p, '%Y%m%d')::date
       else strptime(substr(p, 1, 4) || '-' || substr(p, 6, 2) || '-1', '%G-%V-%u')::date end as monday
  from po where song_id <> ''),
last as (
  select service, job_name, source_variant, reference_period, monday, max(delivered_at) as delivered_at
  from day group by all),
num as (
  select *, row_number() over (partition by service, job_name, source_variant order by monday, reference_period) as n from last),
snap as (
  select distinct day.service, day.job_name, day.source_variant, day.reference_period, song_id, rank_order, n
  from day join num on day.service = num.service and day.job_name = num.job_name and day.source_variant = num.source_variant
   and day.reference_period = num.reference_period and day.delivered_at = num.delivered_at),
found as (
  select b.service, b.job_name, b.source_variant, b.reference_period, b.song_id,
     case when a.song_id is null then 'added' when a.rank_order is distinct from b.rank_order then 'changed' end as change
  from snap b left join snap a on a.service = b.service and a.job_name = b.job_name and a.source_variant = b.source_variant
   and a.song_id = b.song_id and a.n = b.n - 1
  where b.n > 1
  union all
  select a.service, a.job_name, a.source_variant, num.reference_period, a.song_id, 'removed'
  from snap a join num on a.service = num.service and a.job_name = num.job_name and a.source_variant = num.source_variant and num.n = a.n + 1
  left join snap b on a.service = b.service and a.job_name = b.job_name and a.source_variant = b.source_variant
   and a.song_id = b.song_id and b.n = a.n + 1
  where b.song_id is null)
"""

_P2 = f"""
with po as (
  select lower({_TRIM.format('service')}) as service, {_PERIOD.format(_TRIM.format('reference_period'))} as p,
         {_TRIM.format('song_id')} as song_id, delivered_at
  from playlist_order),
seen as (
  select service, song_id, case when length(p) = 8
       then substr(p, 1, 4) || '-' || substr(p, 5, 2) || '-' || substr(p, 7, 2)
       else substr(p, 1, 4) || '-' || substr(p, 5, 3) end as period, min(delivered_at) as first_at
  from po where song_id <> '' group by all),
bound as (
  select lower({_TRIM.format('service')}) as service, {_TRIM.format('song_id')} as song_id, track_uid, created_at,
         strftime(created_at at time zone 'UTC', '%Y-%m-%d') as period
  from platform_song_ids),
newest as (select service, song_id, max(created_at) as born from bound group by all),
meta as (select distinct lower({_TRIM.format('service')}) as service, {_TRIM.format('song_id')} as song_id from track_list),
found as (
  select 'playlist_order' as ref_table, 'song_id' as ref_field, period, s.service, s.song_id,
         case when born is null then 'missing' when born > first_at then 'late' end as reason
  from seen s left join newest n on s.service = n.service and s.song_id = n.song_id
  union all
  select distinct 'platform_song_ids', 'song_id', period, b.service, b.song_id, case when m.service is null then 'missing' end
  from bound b left join meta m on b.service = m.service and b.song_id = m.song_id
  where b.song_id <> ''
  union all
  select distinct 'platform_song_ids', 'track_uid', period, b.service, b.song_id,
         case when t.track_uid is null then case when r.track_uid is null then 'missing' else 'deleted' end
              when t.created_at > b.created_at then 'late' end
  from bound b left join tracks t on b.track_uid = t.track_uid
  left join (select distinct track_uid from retired_tracks) r on b.track_uid = r.track_uid
  where b.track_uid <> '')
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_change_counts": p1_change_counts,
    "p2_found": p2_found,
    "p2_report": p2_report,
}

ORACLE = {
    "p1_found": _P1 + "select * from found where change is not null",
    "p1_change_counts": _P1 + "select service, job_name, reference_period, change, count(*) as n from found where change is not null group by all",
    "p2_found": _P2 + "select * from found where reason is not null",
    "p2_report": _P2 + "select ref_table, ref_field, period, reason, count(*) as n from found where reason is not null group by all",
}
