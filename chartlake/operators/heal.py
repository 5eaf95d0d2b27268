"""Repair of entities that were split: three passes over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.functions.text import compact_key, norm_plain, strip_groups
from chartlake.operators.lookup import first_hit
from chartlake.operators.resolve import BAD, apply_moves, merge_order, veto, winners


def bind_unbound(songs: DataFrame, videos: DataFrame, index: DataFrame) -> DataFrame:
    """New bindings ``service, song_id, track_uid`` of songs without one: by
    their video, else by the first known of their ``keys``."""
    v = videos.select("video_id", F.col("track_uid").alias("__v"))
    s = first_hit(songs, "keys", index, "lookup_key", "track_uid", "__m").join(v, "video_id", "left")
    return s.select("service", "song_id", F.coalesce("__v", "__m").alias("track_uid")).where("track_uid is not null")


def better_without_brackets(bound: DataFrame, index: DataFrame, norm=norm_plain) -> DataFrame:
    """``(old_uid, new_uid)``: bound songs whose artist has brackets and whose
    key without them leads to an entity of a strictly greater score.

    ``bound`` has ``track_uid, title, artist``; ``index`` has ``lookup_key,
    track_uid, score``. Of several such entities the best score counts, then the
    least id; songs without title or artist give none."""
    top = index.groupBy("track_uid").agg(F.max("score").alias("score"))
    bare = strip_groups(F.col("artist"))
    b = bound.where((F.col("title") != "") & (F.col("artist") != "") & (bare != F.col("artist")))
    b = b.select("track_uid", compact_key(F.col("title"), bare, norm).alias("lookup_key")).distinct()
    other = index.select("lookup_key", F.col("track_uid").alias("new_uid")).join(top.withColumnRenamed("track_uid", "new_uid"), "new_uid")
    now = top.select("track_uid", F.col("score").alias("__now"))
    j = b.join(other, "lookup_key").where(F.col("new_uid") != F.col("track_uid")).join(now, "track_uid", "left")
    j = j.where(F.col("score") > F.coalesce("__now", F.lit(0.0)))
    best = j.groupBy("track_uid").agg(F.min_by("new_uid", F.struct(-F.col("score"), F.col("new_uid"))).alias("new_uid"))
    return best.select(F.col("track_uid").alias("old_uid"), "new_uid")


def same_metadata(tracks: DataFrame, norm=norm_plain) -> DataFrame:
    """``(old_uid, new_uid)`` of entities whose normalised title, artist and
    album are all filled and equal; the winner by ``merge_order``."""
    parts = [norm(F.col(c)) for c in ("yt_title", "yt_artist", "yt_album")]
    full = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return winners(tracks.withColumn("__g", F.when(full, F.concat_ws("|", *parts))), "__g", merge_order())


def heal(tracks: DataFrame, bindings: DataFrame, songs: DataFrame, videos: DataFrame, index: DataFrame, vetoed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tracks, bindings)`` after all passes: unbound songs bound, songs bound
    to a worse entity and entities of equal metadata merged, unless split or
    blocked by hand. ``songs`` has ``service, song_id, video_id, keys, title,
    artist``. Running it again changes nothing more."""
    missing = songs.join(bindings, ["service", "song_id"], "left_anti")
    bound = bindings.select("service", "song_id", "track_uid").unionByName(bind_unbound(missing, videos, index))
    good = tracks.where(~F.lower(F.coalesce("match_status", F.lit(""))).isin(*BAD) & (F.col("canonical_yt_video_id") != ""))
    named = bound.join(songs.select("service", "song_id", "title", "artist"), ["service", "song_id"]).join(good.select("track_uid"), "track_uid", "left_semi")
    counted = tracks.join(bound.groupBy("track_uid").agg(F.count("*").alias("bindings")), "track_uid", "left")
    moves = better_without_brackets(named, index).unionByName(same_metadata(counted)).distinct()
    left, held = apply_moves(veto(moves, vetoed), tracks, {"bindings": bound})
    return left, held["bindings"].distinct()
