"""Explicit schemas of the store's tables; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ", ".join(f"{f}_{lang} string" for f in ("title", "artist", "album") for lang in ("ko", "en"))

TABLES = {
    "tracks": "track_uid string, canonical_yt_video_id string, yt_title string, yt_artist string, yt_album string, match_status string, best_score double, created_at timestamp, updated_at timestamp",
    "yt_video_ids": "video_id string, track_uid string, is_canonical int",
    "platform_song_ids": "service string, song_id string, track_uid string, created_at timestamp",
    "track_list": f"service string, song_id string, album_id string, {NAMES}, artwork_url string",
    "metadata_lookup_index": "lookup_key string, track_uid string, source string, score double",
    "playlist_order": "service string, job_name string, source_variant string, reference_period string, song_id string, rank_order int, delivered_at timestamp",
    "match_runs": "run_id string, service string, job_name string, source_variant string, source string, total int, matched int, failed int, started_at timestamp, created_at timestamp",
    "match_attempts": "run_id string, service string, song_id string, rank_order int, track_uid string, video_id string, score double, title_score double, artist_score double, album_score double, status string, method string, created_at timestamp",
    "match_candidates": "run_id string, service string, song_id string, rank_order int, candidate_order int, video_id string, yt_title string, yt_artist string, yt_album string, score double, created_at timestamp",
    "manual_overrides": "service string, song_id string, action string, target_track_uid string, canonical_yt_video_id string, created_at timestamp",
    "review_conflicts": "conflict_id string, service string, song_id string, track_uid string, other string, reason string, status string, created_at timestamp",
    "migration_reports": "report_id string, tables int, rows bigint, payload_json string, created_at timestamp",
    "chart_source_audit": "audit_id string, job_name string, expected_period string, fetched_period string, status string, entry_count int, created_at timestamp",
    "album_metadata": "service string, album_id string, album_name string, created_at timestamp, last_checked timestamp",
    "playlist_update_runs": "update_run_id string, job_name string, requested int, existing int, created_at timestamp",
    "playlist_update_items": "update_run_id string, action string, video_id string, item_order int, created_at timestamp",
    "schema_migrations": "version string, applied_at timestamp, description string",
    "artist_translations": "artist_id string, names array<string>, updated_at timestamp",
    "song_translations": f"video_id string, {NAMES}, updated_at timestamp",
    "sync_jobs": "job_name string, enabled boolean, service string, frequency string, list_type string, playlist_name string, entity_limit int, schedule string, include_in_hype boolean, hype_group string, hype_weight double",
    "source_tracks": "row_id bigint, rank int, title string, artist string, service string, album string, source string, artwork_url string, song_id string, album_id string, crawled_at timestamp",
}


# Names of columns in older tables.
RENAMES = {"playlist_order": {"chart_date": "reference_period", "rank": "rank_order"}, "tracks": {"video_id": "canonical_yt_video_id", "status": "match_status", "score": "best_score"}}


def columns(ddl: str) -> list[str]:
    """Names of the columns of a schema, without a session."""
    depth, out, start = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(ddl[start:i].split()[0])
            start = i + 1
    return out


def create_all(spark: SparkSession, folder: str) -> list[str]:
    """Creates the tables that are not there yet; returns their names."""
    made = []
    for name, ddl in TABLES.items():
        try:
            spark.read.schema(ddl).parquet(f"{folder}/{name}").limit(0).count()
        except Exception as e:  # only a missing path
            if "PATH_NOT_FOUND" not in str(e):
                raise
            spark.createDataFrame([], ddl).write.parquet(f"{folder}/{name}")
            made.append(name)
    return made


def conform(df: DataFrame, ddl: str, renames: dict[str, str] | None = None) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``: renamed, missing ones null,
    others dropped, values that cannot be cast null."""
    for old, new in (renames or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(ddl).fields
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def rebuilt(df: DataFrame, table: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """An old table in its declared form: columns renamed and cast, rows with a
    null or blank key dropped, and of rows with one key the last in ``order``
    (ties: the greatest row)."""
    new = conform(df, TABLES[table], RENAMES.get(table))
    ok = reduce(lambda a, b: a & b, [F.trim(F.col(k).cast("string")) != "" for k in keys])
    rest = [c for c in new.columns if c not in keys]
    best = new.where(ok).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("x"))
    return best.select(*[c if c in keys else F.col(f"x.{c}").alias(c) for c in new.columns])


def pending(spark: SparkSession, folder: str, steps: Sequence[tuple[str, str]], now) -> DataFrame:
    """Rows of ``schema_migrations`` for the steps (``version, description``)
    that the ledger in ``folder`` does not have yet."""
    done = spark.read.schema(TABLES["schema_migrations"]).parquet(f"{folder}/schema_migrations")
    want = spark.createDataFrame(list(steps), "version string, description string")
    return want.join(done.select("version"), "version", "left_anti").select("version", now.cast("timestamp").alias("applied_at"), "description")


def same_columns(df: DataFrame, ddl: str) -> bool:
    """Whether a table has the columns of ``ddl``, in any order."""
    from pyspark.sql.types import _parse_datatype_string

    return set(df.columns) == set(_parse_datatype_string(ddl).names)


def create_views(tables: dict[str, DataFrame]) -> None:
    """Temporary views of the tables, and those derived of them."""
    from chartlake.operators.asof import latest_with_ties
    from chartlake.operators.resolve import GOOD

    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if {"playlist_order", "platform_song_ids", "tracks", "track_list"} <= tables.keys():
        history_source(*(tables[n] for n in ("playlist_order", "platform_song_ids", "tracks", "track_list"))).createOrReplaceTempView("frontend_history_source")
    if "match_attempts" in tables:
        last = latest_with_ties(tables["match_attempts"], ["service", "song_id"], "created_at")
        last.createOrReplaceTempView("latest_match_attempts")
        last.where((F.coalesce("track_uid", F.lit("")) == "") | ~F.coalesce("status", F.lit("")).isin(*GOOD)).createOrReplaceTempView("latest_failed_matches")


def history_source(facts: DataFrame, bindings: DataFrame, tracks: DataFrame, names: DataFrame) -> DataFrame:
    """Chart entries of bound songs with their entity and names: the Korean one
    if it is filled, else the English one, else the entity's."""
    ok = lambda c: F.nullif(F.col(c), F.lit(""))
    texts = ("title", "artist", "album")
    t = tracks.select("track_uid", F.col("canonical_yt_video_id").alias("video_id"), *[f"yt_{c}" for c in texts])
    n = names.select(F.lower("service").alias("__service"), F.col("song_id").alias("__song"), *[f"{c}_{lang}" for c in texts for lang in ("ko", "en")], "artwork_url")
    f = facts.select("service", "job_name", "source_variant", "reference_period", "song_id", "rank_order")
    j = f.join(bindings.select("service", "song_id", "track_uid"), ["service", "song_id"]).join(t, "track_uid")
    j = j.join(n, (F.lower(j["service"]) == n["__service"]) & (j["song_id"] == n["__song"]), "left")
    period = [F.col("reference_period").alias(c) for c in ("chart_period", "chart_date")]
    shown = [F.coalesce(ok(f"{c}_ko"), F.col(f"{c}_en"), F.col(f"yt_{c}")).alias(c) for c in texts]
    return j.select(*f.columns[:4], *period, "song_id", "track_uid", "rank_order", "video_id", *[f"yt_{c}" for c in texts], *shown, F.lit("").alias("url"), "artwork_url")
