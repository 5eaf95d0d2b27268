"""Writing a batch of crawled or matched songs into the store's tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.functions.keys import service as canonical
from chartlake.functions.text import lookup_keys, stable_uid
from chartlake.operators import merge, quality, resolve
from chartlake.runtime import materialize

# Services whose rows name no English texts, statuses that bind nothing, and ids that are none.
KOREAN_ONLY, UNMATCHED, NO_ID = ("melon",), ("failed", "duplicate_skipped"), "fallback:"
FIELDS = ("title", "artist", "album")


def shaped_names(rows: DataFrame) -> DataFrame:
    """``rows`` with the localized names as they are stored: the localized one,
    else the plain one; services of one language leave the other one empty."""
    ok = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    one = F.col("service").isin(*KOREAN_ONLY)
    ko = {f"{f}_ko": F.coalesce(ok(f"{f}_ko"), ok(f), F.lit("")) for f in FIELDS}
    en = {f"{f}_en": F.when(one, "").otherwise(F.coalesce(ok(f"{f}_en"), ok(f), F.lit(""))) for f in FIELDS}
    return rows.withColumns({**ko, **en})


def _prepared(batch: DataFrame, now: Column) -> DataFrame:
    rows = batch.withColumns({"service": canonical(F.col("service")), "song_id": F.trim(F.coalesce("song_id", F.lit("")))})
    for c in ("album_id", "artwork_url"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    return shaped_names(rows).withColumns({"created_at": now, "updated_at": now})


def unmatched_uid(service: Column, song: Column, title: Column, artist: Column) -> Column:
    """The stable id of a song without an entity: of its id, else of its names."""
    key = F.coalesce(F.nullif(song, F.lit("")), F.concat_ws("|", F.lower(title), F.lower(artist)))
    return stable_uid(F.concat(F.lit("unmatched:"), service, F.lit(":"), key))


def _upsert(store: Mapping[str, DataFrame], name: str, rows: DataFrame, order: list[str]) -> DataFrame:
    keys, rules = merge.TABLES[name]
    return merge.merge(store[name], rows, keys, rules, order)


def ingest(batch: DataFrame, job: str, period: str, store: Mapping[str, DataFrame], now: Column, variant: str = "default", expected: int | None = None, lowest: int | None = None) -> dict[str, DataFrame]:
    """``store`` (tables by name) after a crawl of ``job`` for ``period``:
    ``tracks``, ``platform_song_ids``, ``track_list`` and ``playlist_order``.

    ``batch`` has ``service, song_id, rank, title, artist`` and any further
    names. A song keeps the entity it is bound to, else it gets a stable id of
    its own and the status ``unmatched``; ids that are none bind nothing. Names
    are merged, and the period of the series is replaced as a whole. With
    ``expected`` any use fails unless the batch has ``lowest`` (``expected``) to
    ``expected`` rows. Of rows with one song the least rank counts. An empty
    batch changes nothing; ingesting it twice gives the same as once.
    """
    rows = _prepared(batch if expected is None else quality.assert_count(batch, expected, lowest), now)
    held = store["platform_song_ids"].where("track_uid <> ''").select("service", "song_id", F.col("track_uid").alias("__held"))
    rows = rows.join(held, ["service", "song_id"], "left").withColumn("track_uid", F.coalesce("__held", unmatched_uid(F.col("service"), F.col("song_id"), F.col("title"), F.col("artist"))))
    rows = materialize(rows, "batch")
    fresh = rows.where("__held is null").select("track_uid", F.lit("unmatched").alias("match_status"), F.lit(0.0).alias("best_score"), "created_at", "updated_at").distinct()
    known = rows.where((F.col("song_id") != "") & ~F.col("song_id").startswith(NO_ID))
    ranks = known.groupBy("service", "song_id").agg(F.min("rank").cast("int").alias("rank_order"))
    order = ranks.select("service", F.lit(job).alias("job_name"), F.lit(variant).alias("source_variant"), F.lit(period).alias("reference_period"), "song_id", "rank_order", now.alias("delivered_at"))
    names = [c for c in merge.TABLES["track_list"][1]]
    return {
        **store,
        "tracks": _upsert(store, "tracks", fresh, ["updated_at"]),
        "platform_song_ids": _upsert(store, "platform_song_ids", known.select("service", "song_id", "track_uid", "created_at"), ["created_at", "track_uid"]),
        "track_list": _upsert(store, "track_list", known, names),
        "playlist_order": merge.replace_partitions(store["playlist_order"], order, ["service", "job_name", "source_variant", "reference_period"]),
    }


def upsert_matches(batch: DataFrame, store: Mapping[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """``store`` after a batch of matches, with ``review_conflicts``.

    ``batch`` has ``service, song_id, title, artist, album, video_id, yt_title,
    yt_artist, yt_album, status, score``, one row per song. Failed matches get an
    id of their own and bind nothing. Others get the entity of ``resolve_uids``
    (metadata hits only if the titles are similar). An entity keeps the video it
    has, and a song the good entity with another video that it is bound to; both
    are conflicts. Entities, bindings, names and lookup keys are then merged.
    The whole batch is resolved against the store as it was before.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = _prepared(batch, now).withColumn("status", F.coalesce(blank("status"), F.when(blank("video_id").isNotNull(), "matched").otherwise("failed")))
    rows = rows.withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    lost = F.col("status").isin(*UNMATCHED) | F.col("song_id").startswith(NO_ID)
    failed = rows.where(lost).withColumn("track_uid", unmatched_uid(F.col("service"), F.col("song_id"), F.col("title"), F.col("artist")))
    tracks, bound = store["tracks"], store["platform_song_ids"]
    videos = tracks.where("canonical_yt_video_id <> ''").groupBy(F.col("canonical_yt_video_id").alias("video_id")).agg(F.min("track_uid").alias("track_uid"))
    keys = F.transform(lookup_keys(F.col("title"), F.col("artist"), F.coalesce("album", F.lit("")), F.lit(1.0)), lambda k: k["key"])
    songs = rows.where(~lost).withColumn("keys", keys)
    names = resolve.entity_names(bound, store["track_list"])
    found = materialize(resolve.resolve_uids(songs, bound, videos, store["metadata_lookup_index"], store["manual_overrides"], tracks, names), "resolved")
    review = resolve.conflicts(found.select("service", "song_id", "track_uid", "video_id"), bound, tracks)
    kept = review.where("reason = 'service_song_id_already_bound'").select("service", "song_id", F.col("other").alias("__old"))
    final = found.join(kept, ["service", "song_id"], "left")
    both = found.select("track_uid", blank("video_id").alias("canonical_yt_video_id"), "yt_title", "yt_artist", "yt_album", F.col("status").alias("match_status"), F.col("score").alias("best_score"), "created_at", "updated_at", "service", "song_id")
    none = [F.lit(None).cast("string").alias(c) for c in ("canonical_yt_video_id", "yt_title", "yt_artist", "yt_album")]
    both = both.unionByName(failed.select("track_uid", *none, F.col("status").alias("match_status"), F.col("score").alias("best_score"), "created_at", "updated_at", "service", "song_id"))
    final = final.withColumn("track_uid", F.coalesce("__old", "track_uid"))
    index = final.select("track_uid", F.col("status").alias("source"), F.inline(lookup_keys(F.col("title"), F.col("artist"), F.coalesce("album", F.lit("")), F.col("score")))).withColumnRenamed("key", "lookup_key")
    review = review.withColumns({"status": F.lit("open"), "created_at": now})
    return {
        **store,
        "tracks": _upsert(store, "tracks", both, ["updated_at", "service", "song_id"]),
        "platform_song_ids": _upsert(store, "platform_song_ids", final.where("song_id <> ''").select("service", "song_id", "track_uid", "created_at"), ["created_at", "track_uid"]),
        "track_list": _upsert(store, "track_list", rows.where("song_id <> ''"), list(merge.TABLES["track_list"][1])),
        "metadata_lookup_index": _upsert(store, "metadata_lookup_index", index, ["score", "track_uid"]),
        "review_conflicts": _upsert(store, "review_conflicts", review, ["conflict_id"]),
    }
