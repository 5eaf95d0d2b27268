"""Entities: which one a song belongs to, and which ones are the same."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions.similarity import pair_similarities
from chartlake.functions.text import stable_uid
from chartlake.operators.components import connected_components, resolve_chains
from chartlake.operators.lookup import first_hit
from chartlake.operators.merge import rebind
from chartlake.runtime import materialize

# Statuses of a good match, and of one that may be replaced.
GOOD = ("matched", "cached_match", "proxy_matched", "manual_override")
BAD = ("failed", "duplicate_skipped", "manual_blocked", "unmatched")


def unbound(facts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Songs of ``facts`` without a binding."""
    return facts.select("service", "song_id").distinct().join(bindings, ["service", "song_id"], "left_anti")


def failed_bindings(bindings: DataFrame, tracks: DataFrame) -> DataFrame:
    """Bindings whose entity is missing, or has a bad or no status."""
    t = tracks.select("track_uid", F.col("match_status").alias("__status"), F.lit(True).alias("__there"))
    status = F.coalesce(F.nullif(F.lower(F.trim("__status")), F.lit("")), F.lit("unmatched"))
    return bindings.join(t, "track_uid", "left").where(F.col("__there").isNull() | status.isin(*BAD)).drop("__status", "__there")


# Services in the order in which a bound song's names stand for its entity.
NAMES_FROM = ("melon", "apple")
SAME_NAME = 0.5


def entity_names(bindings: DataFrame, metadata: DataFrame) -> DataFrame:
    """``track_uid, names``: the titles of one bound song of each entity, by
    the order of services, then the least id."""
    prio = F.coalesce(*[F.when(F.col("service") == s, i) for i, s in enumerate(NAMES_FROM)], F.lit(len(NAMES_FROM)))
    j = bindings.select("service", "song_id", "track_uid").join(metadata.select("service", "song_id", "title_ko", "title_en"), ["service", "song_id"])
    names = F.filter(F.array("title_ko", "title_en"), lambda x: F.coalesce(x, F.lit("")) != "")
    return j.groupBy("track_uid").agg(F.min_by(names, F.struct(prio, "service", "song_id")).alias("names"))


def verified_hits(hits: DataFrame, names: DataFrame) -> DataFrame:
    """``title, track_uid`` of the distinct hits that hold: the entity has no
    names, the song no title, or some name is similar enough to the title."""
    h = hits.select("title", "track_uid").distinct().join(names, "track_uid", "left")
    h = materialize(h.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))), "hits")
    free = (F.coalesce("title", F.lit("")) == "") | (F.size("names") == 0)
    pairs = h.where(~free).select("title", "track_uid", F.explode("names").alias("y")).select(F.col("title").alias("x"), "y", "track_uid", F.lit(False).alias("title"))
    near = pair_similarities(pairs).where(F.col("value") >= SAME_NAME).select(F.col("x").alias("title"), "track_uid").distinct()
    return h.where(free).select("title", "track_uid").unionByName(near)


def resolve_uids(songs: DataFrame, bindings: DataFrame, videos: DataFrame, index: DataFrame, overrides: DataFrame, tracks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``songs`` with ``track_uid`` and ``uid_source``.

    In this order: ``block`` (an override: a stable id of its own), ``override``
    (its entity), ``override_video`` (the entity of its video, else a new id of
    that video); the song's video against its binding: the bound entity if it
    has a video (``binding``), but the entity of the song's video (``video``) if
    there is another one and the bound one has no video, the same, or a bad
    status; the first ``metadata`` key that is known; ``new``: a stable id of
    the video, else of the song.

    ``songs`` has ``service, song_id, video_id, keys``, ``tracks`` ``track_uid,
    match_status`` and, where it is known, ``canonical_yt_video_id``; all tables
    but ``songs`` are unique by their keys. With ``names`` (of
    ``entity_names``) a metadata hit also needs a similar ``title`` in ``songs``.
    Every song comes out once; null and empty values are missing.
    """
    blank = lambda c: F.nullif(c, F.lit(""))
    known = blank(F.col("canonical_yt_video_id")) if "canonical_yt_video_id" in tracks.columns else F.lit("?")
    o = overrides.select("service", "song_id", "action", blank(F.col("target_track_uid")).alias("__target"), blank(F.col("canonical_yt_video_id")).alias("__video"))
    v = videos.select(F.col("video_id").alias("__v"), F.col("track_uid").alias("__uid"))
    t = tracks.select(F.col("track_uid").alias("__bound"), F.coalesce(blank(F.lower(F.trim("match_status"))), F.lit("unmatched")).isin(*BAD).alias("__bad"), known.alias("__own"))
    b = bindings.select("service", "song_id", blank(F.col("track_uid")).alias("__bound")).join(t, "__bound", "left")
    s = first_hit(songs, "keys", index, "lookup_key", "track_uid", "__meta")
    if names is not None:
        good = verified_hits(s.select("title", F.col("__meta").alias("track_uid")).where("track_uid is not null"), names)
        good = good.select(F.col("title").alias("__title"), F.col("track_uid").alias("__hit"))
        s = s.join(good, s["title"].eqNullSafe(good["__title"]) & (s["__meta"] == good["__hit"]), "left").withColumn("__meta", F.col("__hit")).drop("__title", "__hit")
    s = s.join(o, ["service", "song_id"], "left").join(b, ["service", "song_id"], "left")
    s = s.join(v.select(F.col("__v").alias("__video"), F.col("__uid").alias("__override")), "__video", "left")
    s = s.join(v.select(F.col("__v").alias("video_id"), F.col("__uid").alias("__by_video")), "video_id", "left")
    bad, own, bound, other = (F.col(c) for c in ("__bad", "__own", "__bound", "__by_video"))
    free = own.isNull() | F.coalesce(own == F.col("video_id"), F.lit(False)) | F.coalesce(bad, F.lit(True))
    stays = F.when(other.isNotNull() & (other != bound), ~free).otherwise(own.isNotNull())
    seed = F.concat_ws(":", "service", "song_id")
    at = lambda c: F.concat(F.lit("yt:"), c)
    choices = [
        ("block", F.when(F.col("action") == "block", stable_uid(F.concat(F.lit("blocked:"), seed)))),
        ("override", F.col("__target")),
        ("override_video", F.coalesce("__override", stable_uid(at(F.col("__video"))))),
        ("binding", F.when(bound.isNotNull() & stays, bound)),
        ("video", other),
        ("metadata", F.col("__meta")),
        ("new", stable_uid(F.coalesce(at(blank(F.col("video_id"))), seed))),
    ]
    uid = F.coalesce(*[c for _, c in choices])
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choices])
    kept = [c for c in songs.columns if c not in ("track_uid", "uid_source")]
    return s.withColumn("__out", uid).withColumn("__src", source).select(*kept, F.col("__out").alias("track_uid"), F.col("__src").alias("uid_source"))


def winners(members: DataFrame, group: str, order: Sequence[Column], key: str = "track_uid") -> DataFrame:
    """``(old_uid, new_uid)`` of every member that is not the first of its group
    in ``order``; groups of one, and null groups, give nothing. The first is
    found by an aggregate, so a group of any size is spread over tasks."""
    m = members.where(F.col(group).isNotNull())
    best = m.groupBy(group).agg(F.min_by(key, F.struct(*order, F.col(key))).alias("new_uid"))
    return m.join(best, group).where(F.col(key) != F.col("new_uid")).select(F.col(key).alias("old_uid"), "new_uid").distinct()


def veto(moves: DataFrame, vetoed: DataFrame, key: str = "track_uid") -> DataFrame:
    """``moves`` of which neither side was split or blocked by hand."""
    v = vetoed.select(F.col(key).alias("__v")).distinct()
    return moves.join(v, moves["old_uid"] == v["__v"], "left_anti").join(v, moves["new_uid"] == v["__v"], "left_anti")


def merge_order(bindings: str = "bindings", status: str = "match_status", score: str = "best_score", created: str = "created_at") -> list[Column]:
    """Winner order: most bindings, then status, score, and age."""
    level = F.coalesce(*[F.when(F.lower(F.trim(status)) == s, -i) for i, s in enumerate(("proxy_matched", "cached_match", "matched", "manual_override"), 1)], F.lit(0))
    return [-F.coalesce(F.col(bindings), F.lit(0)), level, -F.coalesce(F.col(score), F.lit(0.0)), F.col(created)]


def indexed_order(indexed: str = "indexed", score: str = "best_score", created: str = "created_at") -> list[Column]:
    """Winner order of entities that share a video: one that the video index
    names first, then score, then age."""
    return [F.when(F.coalesce(F.col(indexed), F.lit(False)), 0).otherwise(1), -F.coalesce(F.col(score), F.lit(0.0)), F.col(created)]


def repaired_bindings(failed: DataFrame, songs: DataFrame, index: DataFrame, tracks: DataFrame) -> DataFrame:
    """``service, song_id, track_uid`` for failed bindings whose song's first
    known metadata key leads to an entity that has a video and no bad status."""
    good = tracks.where(~F.coalesce(F.nullif(F.lower(F.trim("match_status")), F.lit("")), F.lit("unmatched")).isin(*BAD) & (F.col("canonical_yt_video_id") != ""))
    known = index.join(good.select("track_uid"), "track_uid", "left_semi")
    s = songs.join(failed.select("service", "song_id"), ["service", "song_id"], "left_semi")
    return first_hit(s, "keys", known, "lookup_key", "track_uid", "track_uid").where("track_uid is not null").select("service", "song_id", "track_uid")


def apply_moves(moves: DataFrame, tracks: DataFrame, holders: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tracks without the merged ones, and every table that holds a
    ``track_uid`` with it rewritten, chains followed to their end."""
    final = resolve_chains(moves, "old_uid", "new_uid")
    left = tracks.join(final.select(F.col("old_uid").alias("track_uid")), "track_uid", "left_anti")
    return left, {n: rebind(t, final, "track_uid") for n, t in holders.items()}


def identity_groups(rows: DataFrame, row: str, video: str, identity: str) -> DataFrame:
    """``(row, group_id)``: rows that share a video or an identity are one
    group, and groups join through common rows."""
    ids = rows.select(F.col(row).alias("r"), F.concat(F.lit("v:"), video).alias("v"), F.concat(F.lit("i:"), identity).alias("i"))
    first = F.coalesce("v", "i")
    edges = ids.select(first.alias("a"), F.explode(F.array_compact(F.array("v", "i"))).alias("b")).distinct()
    c = connected_components(edges, "a", "b")
    out = ids.withColumn("a", first).join(c, F.col("a") == c["node"], "left")
    return out.select(F.col("r").alias(row), F.coalesce("component", "a").alias("group_id"))


def greedy_groups(rows: DataFrame, by: str, order: Sequence[str], video: str, identity: str) -> DataFrame:
    """``rows`` with ``group_id`` by the first-come rule: in ``order``, a row
    takes the group of its video, else that of its identity, else its identity;
    a video or identity keeps the group it got first.

    The rule depends on each earlier row, so each value of ``by`` (a date, whose
    rows are as many as charts have places) is one task; ``identity_groups`` is
    its form for groups without bound.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        videos: dict = {}
        names: dict = {}
        out = []
        for v, i in zip(pdf[video], pdf[identity]):
            g = videos.get(v) or names.get(i) or i
            videos.setdefault(v, g)
            names.setdefault(i, g)
            out.append(g)
        return pdf.assign(group_id=out)

    kept = rows.drop("group_id")
    return kept.groupBy(by).applyInPandas(run, f"{', '.join(f'`{c}` {t}' for c, t in kept.dtypes)}, group_id string")


def conflicts(batch: DataFrame, bindings: DataFrame, tracks: DataFrame) -> DataFrame:
    """What a batch of matches contradicts, with a stable id: a song that is
    bound to another entity, unless that one may be left (``tracks`` has a
    ``match_status`` and it is bad, or it has no video or the same); or an entity
    whose canonical video is another one."""
    status = F.coalesce(F.nullif(F.lower(F.trim("match_status")), F.lit("")), F.lit("unmatched")).isin(*BAD) if "match_status" in tracks.columns else F.lit(False)
    own = tracks.select(F.col("track_uid").alias("old_uid"), F.col("canonical_yt_video_id").alias("__own"), status.alias("__bad"))
    b = bindings.select("service", "song_id", F.col("track_uid").alias("old_uid"))
    a = batch.join(b, ["service", "song_id"]).where("old_uid <> track_uid").join(own, "old_uid", "left")
    if "match_status" in tracks.columns:
        a = a.where((F.coalesce("__own", F.lit("")) != "") & ~F.col("__bad") & ~F.coalesce(F.col("__own") == F.col("video_id"), F.lit(False)))
    a = a.select("service", "song_id", "track_uid", F.col("old_uid").alias("other"), F.lit("service_song_id_already_bound").alias("reason"))
    t = tracks.select("track_uid", F.col("canonical_yt_video_id").alias("other")).where("other <> ''")
    c = batch.join(t, "track_uid").where("video_id <> '' and video_id <> other")
    c = c.select("service", "song_id", "track_uid", "other", F.lit("same_track_uid_different_video").alias("reason"))
    both = a.unionByName(c)
    return both.withColumn("conflict_id", F.sha1(F.concat_ws("|", "service", "song_id", "track_uid", "other", "reason"))).distinct()


def newest_canonical(members: DataFrame, group: str) -> DataFrame:
    """Per group the canonical video of the member that was updated last."""
    filled = F.col("canonical_yt_video_id") != ""
    return members.groupBy(group).agg(F.max_by("canonical_yt_video_id", F.when(filled, F.struct("updated_at", "track_uid"))).alias("video_id"))


def with_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
