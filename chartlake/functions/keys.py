"""Services, ids and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartlake.functions.periods import filled, let

# Names of the video service.
VIDEO_SERVICES = ("ytmusic", "youtube", "youtube_music")
# URLs of a song by service; the album's service needs an album.
TRACK_URLS = {
    "melon": ("https://www.melon.com/song/detail.htm?songId=", False),
    "spotify": ("https://open.spotify.com/track/", False),
    "apple": ("https://music.apple.com/album/", True),
}


def service(c: Column) -> Column:
    """Canonical service: by prefix or alias, else as it is in lower case;
    ``unknown`` where it is missing."""

    def name(s: Column) -> Column:
        out = F.when(s.isin(*VIDEO_SERVICES), "ytmusic").when(s == "", "unknown")
        for n in TRACK_URLS:
            out = out.when(s.startswith(n), n)
        return out.otherwise(s)

    return let(F.lower(F.trim(F.coalesce(c, F.lit("")))), name)


def source_variant(c: Column) -> Column:
    return F.coalesce(filled(c), F.lit("default"))


def variant_of_job(name: Column, current: Column) -> Column:
    """Variant named by an old job name or its ending ``:variant``."""
    tail = F.nullif(F.regexp_extract(name, r":(gen\d+)$", 1), F.lit(""))
    old = F.regexp_extract(name, r"^Gen-(\d+)s-Top-100-Daily$", 1)
    return F.coalesce(tail, F.when(old != "", F.concat(F.lit("gen"), old)), source_variant(current))


def song_id(service_: Column, own: Column, legacy: Column, url: Column) -> Column:
    """The song id, else what an older id or the URL gives for the service."""
    s, old = service(service_), F.coalesce(F.trim(legacy), F.lit(""))
    other = (
        F.when(s == "melon", F.regexp_replace(old, "^melon_", ""))
        .when(s == "spotify", F.when(old.startswith("fallback:"), "").otherwise(old))
        .when((s == "apple") & (old == ""), F.regexp_extract(F.coalesce(url, F.lit("")), r"[?&]i=(\d+)", 1))
        .otherwise(old)
    )
    return F.coalesce(filled(own), other)


def album_id(service_: Column, own: Column, url: Column) -> Column:
    """The album id, else the last part of an album URL."""
    path = F.rtrim(F.split_part(F.coalesce(url, F.lit("")), F.lit("?"), F.lit(1)), F.lit("/"))
    return F.coalesce(filled(own), F.when((service(service_) == "apple") & path.contains("/album/"), F.substring_index(path, "/", -1)), F.lit(""))


def track_url(service_: Column, song: Column, album: Column) -> Column:
    """Public URL of a song; empty where it cannot be built."""
    s, song, album = service(service_), filled(song), filled(album)
    out = F.lit(None).cast("string")
    for name, (base, needs_album) in TRACK_URLS.items():
        url = F.concat(F.lit(base), album, F.lit("?i="), song) if needs_album else F.concat(F.lit(base), song)
        out = F.coalesce(out, F.when(s == name, url))
    return F.coalesce(out, F.lit(""))


def video_id(url: Column) -> Column:
    """Video id of a watch URL or a short URL; empty if there is none."""
    v = F.regexp_extract(url, r"[?&]v=([^&#]+)", 1)
    return F.coalesce(F.nullif(v, F.lit("")), F.regexp_extract(url, r"^https?://youtu\.be/([^/?#]+)", 1), F.lit(""))


def linked_video(c: Column) -> Column:
    """The video that a text names as an id, or inside a link as its ``v`` or
    the last part of its path; null if there is none."""
    t = F.regexp_replace(c, r"(?U)[\s\p{Z}]+", "")
    link = F.coalesce(
        F.nullif(F.regexp_extract(t, r"[?&]v=([0-9A-Za-z_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(t, r"^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?([0-9A-Za-z_-]+)/?(?:[?#].*)?$", 1), F.lit("")),
    )
    return F.when(t != "", F.when(F.contains(t, F.lit("://")), F.coalesce(link, t)).otherwise(t))


def playlist_id(url: Column) -> Column:
    """The ``list`` parameter of a URL, or the id after ``/playlist/``; else the
    text itself."""
    a = F.nullif(F.regexp_extract(url, r"[?&]list=([^&#]+)", 1), F.lit(""))
    b = F.nullif(F.regexp_extract(url, r"/playlist/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(a, b, url)


def result_type(c: Column) -> Column:
    """``song`` or ``video`` from its names in two languages; else as it is."""
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("song", "노래"), "song").when(s.isin("video", "동영상"), "video").otherwise(s)


def match_method(status: Column, query: Column) -> Column:
    """``struct(method, origin, cached)`` of a match status."""
    s, q = F.trim(F.coalesce(status, F.lit(""))), F.trim(F.coalesce(query, F.lit("")))
    row = lambda a, b, c: F.struct(F.lit(a).alias("method"), F.lit(b).alias("origin"), F.lit(c).alias("cached"))
    return (
        F.when(s == "manual_override", row("manual", "manual", False))
        .when(s == "proxy_matched", row("proxy", "proxy", False))
        .when(s == "cached_match", row("cache", "unknown", True))
        .when(q == "db_cache", row("cache", "db", True))
        .when(s.isin("failed", "duplicate_skipped", "manual_blocked"), row("failed", "none", False))
        .otherwise(row("search", "search", False))
    )
