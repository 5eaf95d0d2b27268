"""Key-wise merges: an upsert as a fold over existing and arriving rows.

Each rule is an aggregate over the rows of a key in the order of arrival, so a
merge is one aggregation with map-side combine, and a batch may hold a key any
number of times. Existing rows come first (``ord`` -1), the batch follows in
its own order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.schemas import TABLES as TABLE_DDL
from chartlake.schemas import columns

#: Place in the order of arrival.
ORD = "__ord"


def _at(c: Column, when: Column | None = None, last: bool = True) -> Column:
    """The last (first) value in order, of the rows where ``when`` holds."""
    place = F.col(ORD) if when is None else F.when(when, F.col(ORD))
    boxed = F.struct(c.alias("v"))  # a null value is kept
    return (F.max_by if last else F.min_by)(boxed, place)["v"]


def last(name: str) -> Column:
    """The last row's value, null too."""
    return _at(F.col(name))


def first(name: str) -> Column:
    """The first row's value, null too."""
    return _at(F.col(name), last=False)


def first_nonnull(name: str) -> Column:
    """The first value that is not null; an empty text counts and stays."""
    return _at(F.col(name), F.col(name).isNotNull(), last=False)


def last_nonempty(name: str) -> Column:
    """The last text that is not empty; else the first row's value."""
    return F.coalesce(_at(F.col(name), F.col(name) != ""), first(name))


def last_unless(*values: str):
    """The last value that is none of ``values``; else the first row's."""

    def rule(name: str) -> Column:
        usable = F.coalesce(~F.col(name).isin(*values), F.lit(False))
        start = F.min(F.col(ORD))
        later = F.max(F.when(usable, F.col(ORD)))
        return F.when(later > start, _at(F.col(name), usable)).otherwise(first(name))

    return rule


def greatest(name: str) -> Column:
    """The greatest value; null if all are."""
    return F.max(F.col(name))


def greatest_or_zero(name: str) -> Column:
    """The greatest number; null counts as 0."""
    return F.max(F.coalesce(F.col(name), F.lit(0.0)))


def with_best(score: str):
    """The value that comes with the greatest score, of equal ones the last."""

    def rule(name: str) -> Column:
        return F.max_by(F.struct(F.col(name).alias("v")), F.struct(F.col(score), F.col(ORD)))["v"]

    return rule


def _rules(table: str, keys: tuple[str, ...], **special: object) -> tuple[tuple[str, ...], dict]:
    """Key and rules of a declared table: the last value of every column that
    ``special`` has no rule for."""
    return keys, {c: special.get(c, last) for c in columns(TABLE_DDL[table]) if c not in keys}


_TEXTS = tuple(f"{f}_{lang}" for f in ("title", "artist", "album") for lang in ("ko", "en"))
# The merge rules of the store, by table: key and rule of each column.
TABLES: dict[str, tuple[tuple[str, ...], dict]] = {
    "tracks": _rules("tracks", ("track_uid",), canonical_yt_video_id=first_nonnull, yt_title=last_nonempty, yt_artist=last_nonempty, yt_album=last_nonempty, match_status=last_unless("failed"), best_score=greatest_or_zero, created_at=first),
    "yt_video_ids": _rules("yt_video_ids", ("video_id",), track_uid=first, is_canonical=greatest),
    # Forms of repairs: another entity takes the video, takes it as its canonical one, or only if nobody has it.
    "yt_video_ids_rebind": _rules("yt_video_ids", ("video_id",), is_canonical=greatest),
    "yt_video_ids_canonical": _rules("yt_video_ids", ("video_id",)),
    "yt_video_ids_keep": _rules("yt_video_ids", ("video_id",), track_uid=first, is_canonical=first),
    "platform_song_ids": _rules("platform_song_ids", ("service", "song_id")),
    "track_list": _rules("track_list", ("service", "song_id"), **{c: last_nonempty for c in ("album_id", *_TEXTS, "artwork_url")}),
    "metadata_lookup_index": _rules("metadata_lookup_index", ("lookup_key",), track_uid=with_best("score"), source=with_best("score"), score=greatest),
    "playlist_order": _rules("playlist_order", ("service", "job_name", "source_variant", "reference_period", "song_id")),
    "match_runs": _rules("match_runs", ("run_id",), started_at=first, created_at=first),
    "match_attempts": _rules("match_attempts", ("run_id", "service", "song_id", "rank_order")),
    "match_candidates": _rules("match_candidates", ("run_id", "service", "song_id", "rank_order", "candidate_order")),
    "manual_overrides": _rules("manual_overrides", ("service", "song_id")),
    "album_metadata": _rules("album_metadata", ("service", "album_id")),
    "artist_translations": _rules("artist_translations", ("artist_id",)),
    "song_translations": _rules("song_translations", ("video_id",)),
    "review_conflicts": _rules("review_conflicts", ("conflict_id",), **{c: first for c in ("service", "song_id", "track_uid", "other", "reason", "status", "created_at")}),
    "playlist_update_runs": _rules("playlist_update_runs", ("update_run_id",)),
    "playlist_update_items": _rules("playlist_update_items", ("update_run_id", "action", "video_id", "item_order"), created_at=greatest),
    "chart_source_audit": _rules("chart_source_audit", ("audit_id",)),
    "schema_migrations": _rules("schema_migrations", ("version",), applied_at=first),
}


def merge(existing: DataFrame, batch: DataFrame, keys: Sequence[str], rules: Mapping[str, object], order: Sequence[str]) -> DataFrame:
    """``existing`` with ``batch`` merged into it: one row per key.

    ``rules`` gives the rule of each column; ``order`` names the columns of
    ``batch`` that order its rows (repeat none, or equal rows may change
    places). Null keys are keys. Columns that a side lacks are null, other
    columns are dropped (``TABLES`` has a rule for every declared one). Merging a batch twice gives the same as once. Empty
    tables are allowed on both sides. Existing rows with one key fold in the
    order of their columns.
    """
    names = [*keys, *rules]
    pick = lambda df: [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names]
    old = existing.select(*pick(existing), F.struct(F.lit(0).alias("side"), *[F.lit(None).alias(f"o{i}") for i in range(len(order))]).alias(ORD))
    new = batch.select(*pick(batch), F.struct(F.lit(1).alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias(ORD))
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[rule(c).alias(c) for c, rule in rules.items()])


def replace_partitions(existing: DataFrame, batch: DataFrame, partition: Sequence[str], appended: Column | None = None) -> DataFrame:
    """``existing`` without the partitions that ``batch`` delivers anew, and
    ``batch``. Where ``appended`` holds, a partition is only added to. Null
    partition columns are values. Columns of the batch that ``existing`` lacks
    are dropped."""
    fresh = batch if appended is None else batch.where(~F.coalesce(appended, F.lit(False)))
    keys = fresh.select(*[F.col(c).alias(f"__{c}") for c in partition]).distinct()
    same = [existing[c].eqNullSafe(keys[f"__{c}"]) for c in partition]
    left = existing.join(keys, same, "left_anti")
    return left.unionByName(batch, allowMissingColumns=True).select(*existing.columns)


def rebind(df: DataFrame, moves: DataFrame, column: str, old: str = "old_uid", new: str = "new_uid") -> DataFrame:
    """``column`` rewritten by a map of renamings (see ``resolve_chains``)."""
    m = moves.select(F.col(old).alias("__old"), F.col(new).alias("__new"))
    out = df.join(m, df[column] == m["__old"], "left").withColumn(column, F.coalesce("__new", column))
    return out.drop("__old", "__new")


def retained(df: DataFrame, column: str, now: Column, days: int = 15) -> DataFrame:
    """Rows that are at most ``days`` days old at ``now``; null times go."""
    return df.where(F.col(column) >= now - F.make_dt_interval(F.lit(days)))
