"""Queries of merges, lookups and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.functions import periods as P
from chartlake.functions import text as X
from chartlake import schemas
from chartlake.operators import asof, candidates, heal, ingest, lookup, merge, resolve
from chartlake.operators.components import connected_components, resolve_chains
from chartlake.plans.charts import chart, dims
from chartlake.plans.charts import _CHART, _DIMS
from chartlake.plans.problems import _PERIOD, _TRIM
from chartlake.plans.sqltext import bare_sql, norm_sql
from chartlake.runtime import table
from chartlake.schemas import TABLES
from chartlake.sources import store

SPLIT = "1996-01-01"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as existing rows (the last per customer before a day) and a batch."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise(F.col("o_orderstatus")).alias("status"),
        F.round("o_totalprice", 2).alias("score"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderkey").alias("id"),
    )
    cut = F.lit(SPLIT).cast("timestamp")
    w = W.partitionBy("k").orderBy(F.desc("at"), F.desc("id"))
    old = o.where(F.col("at") < cut).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return old, o.where(F.col("at") >= cut)


def _upsert(rules):
    def run(spark: SparkSession, d: str) -> DataFrame:
        old, new = _sides(spark, d)
        return merge.merge(old, new, ["k"], rules, ["at", "id"])

    return run


upsert_last_wins = _upsert({"name": merge.last, "id": merge.last})
upsert_last_nonempty = _upsert({"name": merge.last_nonempty})
upsert_argmax = _upsert({"id": merge.with_best("score"), "score": merge.greatest})
upsert_first_wins = _upsert({"name": merge.first, "id": merge.first})
upsert_tracks_rule = _upsert({"name": merge.last_nonempty, "status": merge.last_unless("failed"), "score": merge.greatest_or_zero, "id": merge.first_nonnull})


def upsert_bindings(spark, d):
    """Bindings of the table's own rows merged by key, the last one wins."""
    t = table(spark, d, "platform_song_ids").select(F.lower(P.trimmed(F.col("service"))).alias("service"), P.trimmed(F.col("song_id")).alias("song_id"), "track_uid", "created_at")
    keys, rules = merge.TABLES["platform_song_ids"]
    return merge.merge(t.limit(0), t, keys, rules, ["created_at", "track_uid"]).select("service", "song_id", "track_uid")


def upsert_metadata(spark, d):
    """Metadata rows merged by key, per column the last filled value."""
    t = table(spark, d, "track_list")
    t = t.withColumns({"service": F.lower(P.trimmed(F.col("service"))), "song_id": P.trimmed(F.col("song_id"))})
    keys, rules = merge.TABLES["track_list"]
    cols = list(rules)
    return merge.merge(t.limit(0), t, keys, rules, cols).select(*keys, *[F.coalesce(c, F.lit("")).alias(c) for c in ("title_ko", "title_en", "artist_en")])


def replace_partition(spark, d):
    """Events of a day that is delivered anew replace that day's per type."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("date").cast("string").alias("day"), "event_type", "user_id")
    batch = e.where("event_id % 10 = 0 and day >= '2024-01-20'")
    return merge.replace_partitions(e, batch, ["day", "event_type"])


def retention_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return merge.retained(e, "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 15).select("event_id")


def rebind_merge(spark, d):
    """Every customer whose key ends in 3 becomes the one before it, in orders."""
    c = table(spark, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("new"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return merge.rebind(o, c, "o_custkey", "old", "new")


def rename_chains(spark, d):
    """Where each retired entity ended up."""
    r = table(spark, d, "retired_tracks").where("merged_into <> '' and track_uid <> ''")
    return resolve_chains(r, "track_uid", "merged_into").select(F.col("track_uid"), F.col("merged_into"))


def shared_videos(spark, d):
    """Entities that share a canonical video, with the winner of each group."""
    t = _counted(spark, d).where("canonical_yt_video_id <> ''")
    return resolve.winners(t, "canonical_yt_video_id", resolve.merge_order())


def _counted(spark, d):
    n = dims(spark, d)[0].groupBy("track_uid").agg(F.count("*").alias("bindings"))
    t = table(spark, d, "tracks").join(n, "track_uid", "left").fillna(0, ["bindings"])
    return t.withColumn("canonical_yt_video_id", F.trim("canonical_yt_video_id"))


def same_metadata(spark, d):
    """Entities of one normalised title, artist and album, with the winner."""
    t = _counted(spark, d)
    low = [F.nullif(F.lower(F.trim(c)), F.lit("")) for c in ("yt_title", "yt_artist", "yt_album")]
    key = F.when(low[0].isNotNull() & low[1].isNotNull() & low[2].isNotNull(), F.concat_ws("|", *low))
    return resolve.winners(t.withColumn("g", key), "g", resolve.merge_order())


def component_sizes(spark, d):
    """Songs and entities as a graph: sizes of its components."""
    b = dims(spark, d)[0].select(F.concat_ws(":", "service", "song_id").alias("a"), F.col("track_uid").alias("b"))
    return connected_components(b, "a", "b").groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


def anti_unbound(spark, d):
    return resolve.unbound(chart(spark, d), dims(spark, d)[0])


def semi_bound(spark, d):
    return chart(spark, d).select("service", "song_id").distinct().join(dims(spark, d)[0], ["service", "song_id"], "left_semi")


def failed_bindings(spark, d):
    bind, tracks, _, _ = dims(spark, d)
    return resolve.failed_bindings(bind, tracks).select("service", "song_id", "track_uid")


def _turn(n):
    return F.pmod(F.ascii(F.reverse("song_id")), F.lit(n))


def resolved_songs(spark, d):
    """The entity of every charted song, and what decided it. Videos and
    overrides are derived from the ids so that every rule decides some songs."""
    bind, tracks, names, _ = dims(spark, d)
    tracks = tracks.select("track_uid", "match_status", F.coalesce(F.trim("canonical_yt_video_id"), F.lit("")).alias("canonical_yt_video_id"), "yt_title", "yt_artist")
    videos = tracks.where("canonical_yt_video_id <> ''").groupBy(F.col("canonical_yt_video_id").alias("video_id")).agg(F.min("track_uid").alias("track_uid"))
    by_artist = tracks.where("canonical_yt_video_id <> ''").groupBy(F.lower(F.trim("yt_artist")).alias("a")).agg(F.min("canonical_yt_video_id").alias("v"))
    own = bind.join(tracks.select("track_uid", F.col("canonical_yt_video_id").alias("own"), F.lower(F.trim("yt_artist")).alias("a")), "track_uid", "left").join(by_artist, "a", "left").select("service", "song_id", "own", "v")
    songs = chart(spark, d).select("service", "song_id").distinct().join(names.select("service", "song_id", "title_en", "artist_en"), ["service", "song_id"], "left").join(own, ["service", "song_id"], "left")
    video = F.when(_turn(4) == 0, F.col("own")).when(_turn(4) == 1, F.concat(F.lit("N"), "song_id")).when(_turn(4) == 2, F.col("v"))
    songs = songs.select("service", "song_id", F.nullif(video, F.lit("")).alias("video_id"), F.array(F.lower(F.concat_ws("|", "title_en", "artist_en"))).alias("keys"), "v")
    index = tracks.where("yt_title <> '' and yt_artist <> ''").groupBy(F.lower(F.concat_ws("|", F.trim("yt_title"), F.trim("yt_artist"))).alias("lookup_key")).agg(F.min("track_uid").alias("track_uid"))
    kind = _turn(11)
    over = songs.where(kind < 4).select(
        "service", "song_id", F.when(kind == 0, "block").otherwise("set_canonical").alias("action"), F.when(kind == 1, "trk_chosen").alias("target_track_uid"),
        F.when(kind == 2, F.concat(F.lit("O"), "song_id")).when(kind == 3, F.col("v")).alias("canonical_yt_video_id"),
    )
    out = resolve.resolve_uids(songs.drop("v"), bind, videos, index, over, tracks)
    return out.select("service", "song_id", "track_uid", "uid_source")


def verified_merges(spark, d):
    """Entities that songs' keys without bracketed parts lead to, and whether
    their names are close enough to merge."""
    bind, _, names, _ = dims(spark, d)
    s = lookup.first_hit(_songs(spark, d), "keys", _index(spark, d), "lookup_key", "track_uid", "track_uid").where("track_uid is not null")
    good = resolve.verified_hits(s.select("title", "track_uid"), resolve.entity_names(bind, names)).withColumn("ok", F.lit(True))
    return s.select("service", "song_id", "title", "track_uid").join(good, ["title", "track_uid"], "left").select("service", "song_id", "track_uid", F.coalesce("ok", F.lit(False)).alias("verified"))


def _store(spark, d):
    """The tables of the store, one row per key."""
    bind, tracks, names, _ = dims(spark, d)
    empty = lambda n: spark.createDataFrame([], TABLES[n])
    return {
        "tracks": tracks, "track_list": names, "platform_song_ids": bind.withColumn("created_at", F.lit("2026-01-01").cast("timestamp")),
        "playlist_order": table(spark, d, "playlist_order"), "metadata_lookup_index": _index(spark, d).withColumn("source", F.lit("rebuild")),
        "manual_overrides": empty("manual_overrides"), "review_conflicts": empty("review_conflicts"),
    }


NOW = "2026-02-01 00:00:00"


def _ingested(spark, d):
    crawl = table(spark, d, "source_tracks").withColumns({"title": F.trim("title"), "artist": F.trim("artist")})
    return ingest.ingest(crawl, "Crawl", "2026-02-01", _store(spark, d), F.lit(NOW).cast("timestamp"))


def ingested_bindings(spark, d):
    """Entities of songs after a crawl was ingested."""
    return _ingested(spark, d)["platform_song_ids"].select("service", "song_id", "track_uid")


def ingested_ranks(spark, d):
    """The series that the crawl delivered."""
    return _ingested(spark, d)["playlist_order"].where("job_name = 'Crawl'").select("service", "song_id", "rank_order")


def ingested_status(spark, d):
    """Entities by status after the crawl."""
    return _ingested(spark, d)["tracks"].groupBy("match_status").agg(F.count("*").alias("n"))


def _upserted(spark, d):
    """The store after the search results of its songs were merged: of a song's
    results the first one."""
    m = table(spark, d, "match_results").withColumns({"service": F.lower(F.trim("service")), "song_id": F.trim("song_id")}).where("song_id <> ''")
    keep = [c for c in m.columns if c not in ("service", "song_id")]
    m = m.groupBy("service", "song_id").agg(F.min_by(F.struct(*keep), "result_id").alias("x")).select("service", "song_id", "x.*")
    return ingest.upsert_matches(m, _store(spark, d), F.lit(NOW).cast("timestamp"))


def upserted_index(spark, d):
    """Lookup keys after search results were merged."""
    return _upserted(spark, d)["metadata_lookup_index"].select("lookup_key", "track_uid", F.round("score", 6).alias("score"))


def upserted_conflicts(spark, d):
    """Contradictions that merging search results found."""
    return _upserted(spark, d)["review_conflicts"].select("service", "song_id", "track_uid", "other", "reason")


def history_source(spark, d):
    """Chart entries with their entities and names, as the reports read them."""
    bind, tracks, names, _ = dims(spark, d)
    facts = chart(spark, d).withColumnRenamed("period", "reference_period")
    h = schemas.history_source(facts, bind, tracks, names)
    return h.select("service", "job_name", "source_variant", "chart_date", "song_id", "track_uid", "rank_order", "video_id", "title", "artist", "album", "artwork_url")


def repaired_bindings(spark, d):
    """Failed bindings that the song's names lead out of."""
    bind, tracks, _, _ = dims(spark, d)
    return resolve.repaired_bindings(resolve.failed_bindings(bind, tracks), _songs(spark, d), _index(spark, d), tracks)


def cached_songs(spark, d):
    """Matches that the store has for each named song, by binding or by names."""
    bind, tracks, _, _ = dims(spark, d)
    none = spark.createDataFrame([], TABLES["manual_overrides"])
    return candidates.cached_matches(_songs(spark, d), none, bind, tracks, _index(spark, d)).select("service", "song_id", "track_uid", "match_source")


def merged_lookup_index(spark, d):
    """Lookup keys of all entities, folded by their scores."""
    t = table(spark, d, "tracks")
    k = X.lookup_keys(F.col("yt_title"), F.col("yt_artist"), F.coalesce("yt_album", F.lit("")), F.coalesce("best_score", F.lit(0.0)))
    rows = t.select("track_uid", F.lit("crawl").alias("source"), F.inline(k)).withColumnRenamed("key", "lookup_key")
    keys, rules = merge.TABLES["metadata_lookup_index"]
    return merge.merge(rows.limit(0), rows, keys, rules, ["score", "track_uid"]).select("lookup_key", "track_uid", F.round("score", 6).alias("score"))


def left_join_count_zero(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(n, c["c_custkey"] == n["o_custkey"], "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def left_join_group_max(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("most"))
    p = table(spark, d, "part").select("p_partkey")
    return p.join(m, p["p_partkey"] == m["l_partkey"], "left").select("p_partkey", "most")


def dup_having(spark, d):
    """Texts that more than one document has."""
    t = table(spark, d, "documents").where("text <> ''").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))
    return t.where("n > 1")


def candidate_key_first_hit(spark, d):
    """Parts by the first of three keys that an index of brands knows."""
    p = table(spark, d, "part")
    index = p.groupBy(F.col("p_brand").alias("key")).agg(F.min("p_partkey").alias("value")).where("value % 2 = 1")
    rows = p.select("p_partkey", F.array(F.concat("p_brand", F.lit("x")), "p_brand", F.lit("Brand#11")).alias("keys"))
    return lookup.first_hit(rows, "keys", index, "key", "value", "hit").select("p_partkey", "hit")


def localized_coalesce_join(spark, d):
    """Names of suppliers' nations by key, else by a second key."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, -1).otherwise(F.col("s_nationkey")).alias("n1"), (F.col("s_suppkey") % 25).cast("int").alias("n2"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n1"), F.col("n_nationkey").alias("n2"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("label"))
    return lookup.localize(s, n, [["n1"], ["n2"]], ["label"], "label").select("s_suppkey", F.coalesce("label", F.lit("")).alias("label"))


def latest_attempt_ties(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"), "event_id")
    return asof.latest_with_ties(e, ["user_id", "event_type"], "day")


def failed_latest(spark, d):
    """Searches of the last rank of each song that have no good match."""
    m = table(spark, d, "match_results").select("result_id", F.lower(F.trim("service")).alias("service"), "song_id", "rank", "status", "video_id")
    last = asof.latest_with_ties(m, ["service", "song_id"], "rank")
    return last.where((F.coalesce("video_id", F.lit("")) == "") | ~F.coalesce("status", F.lit("")).isin(*resolve.GOOD)).select("result_id")


def match_conflicts(spark, d):
    """What matches of a batch (every tenth binding moved) contradict."""
    bind, tracks, _, _ = dims(spark, d)
    batch = bind.select("service", "song_id", F.when(F.ascii("song_id") % 10 == 0, F.concat("track_uid", F.lit("x"))).otherwise(F.col("track_uid")).alias("track_uid"), F.concat(F.lit("v"), F.substring("song_id", 1, 3)).alias("video_id"))
    return resolve.conflicts(batch, bind, tracks.select("track_uid", F.trim("canonical_yt_video_id").alias("canonical_yt_video_id"))).select("service", "song_id", "track_uid", "other", "reason")


def song_lookup_keys(spark, d):
    """Keys under which each song is found, with their scores."""
    n = dims(spark, d)[2]
    k = X.lookup_keys(F.col("title_en"), F.col("artist_en"), F.coalesce("album_en", F.lit("")), F.lit(1.0))
    return n.where("title_en is not null and artist_en is not null").select("service", "song_id", F.inline(k)).withColumn("score", F.round("score", 4))


def _songs(spark, d):
    n = dims(spark, d)[2]
    return n.select("service", "song_id", F.lit(None).cast("string").alias("video_id"), F.array(X.compact_key(F.col("title_en"), F.col("artist_en"), X.norm_plain)).alias("keys"), F.col("title_en").alias("title"), F.col("artist_en").alias("artist"))


def _index(spark, d):
    t = table(spark, d, "tracks").where("yt_title <> '' and yt_artist <> ''")
    key = X.compact_key(F.col("yt_title"), F.col("yt_artist"), X.norm_plain)
    return t.groupBy(key.alias("lookup_key")).agg(F.min_by("track_uid", F.struct(-F.coalesce("best_score", F.lit(0.0)), F.col("track_uid"))).alias("track_uid"), F.max(F.coalesce("best_score", F.lit(0.0))).alias("score"))


def heal_bindings(spark, d):
    """Bindings after all repair passes."""
    bind, tracks, _, _ = dims(spark, d)
    videos = tracks.where("canonical_yt_video_id <> ''").groupBy(F.trim("canonical_yt_video_id").alias("video_id")).agg(F.min("track_uid").alias("track_uid"))
    none = spark.createDataFrame([], "track_uid string")
    return heal.heal(tracks, bind, _songs(spark, d), videos, _index(spark, d), none)[1]


def bracketed_artists(spark, d):
    """Entities that a song's artist without brackets leads to, if better."""
    b = dims(spark, d)[0].join(_songs(spark, d).withColumn("artist", F.concat("artist", F.lit(" (x)"))), ["service", "song_id"])
    return heal.better_without_brackets(b, _index(spark, d))


def search_query_lists(spark, d):
    n = dims(spark, d)[2]
    q = candidates.search_queries(*[F.col(c) for c in ("title_en", "artist_en", "album_en", "title_ko", "artist_ko", "album_ko")])
    return n.select("service", "song_id", F.array_join(q, "\n").alias("queries"), F.size(q).alias("n"))


def source_audits(spark, d):
    """An audit row per weekly delivery."""
    po = table(spark, d, "playlist_order").select("job_name", P.canonical_period(F.col("reference_period")).alias("fetched_period"))
    g = po.groupBy("job_name", "fetched_period").agg(F.count("*").cast("int").alias("entry_count"))
    g = g.withColumns({"expected_period": F.col("fetched_period"), "status": F.lit("published")})
    return store.source_audit(g, F.lit("2026-01-01 00:00:00").cast("timestamp")).select("job_name", "fetched_period", "entry_count", F.length("audit_id").alias("id_length"))


def shuffled_order(spark, d):
    """Songs of one chart in a random order that can be repeated."""
    c = chart(spark, d).select("service", "song_id").distinct()
    return store.shuffled(c, 7, "service", "song_id")


_NAMES = ("upsert_last_wins", "upsert_last_nonempty", "upsert_argmax", "upsert_first_wins", "upsert_tracks_rule")
QUERIES = {
    **{n: globals()[n] for n in _NAMES},
    **{
        f.__name__: f
        for f in (
            upsert_bindings, upsert_metadata, replace_partition, retention_filter, rebind_merge, rename_chains, shared_videos, same_metadata, component_sizes,
            anti_unbound, semi_bound, failed_bindings, resolved_songs, left_join_count_zero, left_join_group_max, dup_having, candidate_key_first_hit,
            localized_coalesce_join, latest_attempt_ties, failed_latest, match_conflicts, song_lookup_keys,
            verified_merges, ingested_bindings, ingested_ranks, ingested_status, upserted_index, upserted_conflicts, history_source, repaired_bindings, cached_songs,
            merged_lookup_index, heal_bindings, bracketed_artists, search_query_lists, source_audits, shuffled_order,
        )
    },
}

_SIDES = f"""
with o as (
  select o_custkey as k, case when o_orderkey % 7 = 0 then '' else o_orderpriority end as name, case when o_orderkey % 5 = 0 then 'failed' else o_orderstatus end as status,
    round(o_totalprice, 2) as score, o_orderdate as t, o_orderkey as id from orders),
old as (select * from o where t < '{SPLIT}' qualify row_number() over (partition by k order by t desc, id desc) = 1),
s as (select *, row_number() over (partition by k order by side, t, id) as n from (select *, 0 as side from old union all select *, 1 from o where t >= '{SPLIT}'))
"""
_COUNTED = f"with {_DIMS}, n as (select track_uid, count(*) as bindings from bind group by all), t as (select tracks.*, coalesce(bindings, 0) as b, trim(canonical_yt_video_id) as v, case lower(trim(match_status)) when 'manual_override' then -4 when 'matched' then -3 when 'cached_match' then -2 when 'proxy_matched' then -1 else 0 end as lv from tracks left join n using (track_uid))"
_PICK = "g as (select {0} as g, track_uid, first_value(track_uid) over (partition by {0} order by -b, lv, -coalesce(best_score, 0), created_at, track_uid) as new_uid from t where {1}) select distinct track_uid as old_uid, new_uid from g where track_uid <> new_uid"

_KEY = "({0} || '|' || {1})"
_IDX = f"idx as (select {_KEY.format(norm_sql('yt_title'), norm_sql('yt_artist'))} as k, arg_min(track_uid, (-coalesce(best_score, 0), track_uid)) as u from tracks where yt_title <> '' and yt_artist <> '' group by 1)"
_FULL = "({0} || '|' || {1} || '|' || {2})"
_KEYS = f"""b as (select *, {bare_sql('t')} as bt, {bare_sql('a')} as ba from n),
f as (select *, {norm_sql('t')} as nt, {norm_sql('a')} as na, {norm_sql('al')} as nl, {norm_sql('bt')} as nbt, {norm_sql('ba')} as nba from b),
keys as (
  select * exclude (ks, ss), ks[i] as key, ss[i] as score from (
    select *, unnest([1, 2, 3, 4, 5, 6]) as i, [nt || '|' || na || '|' || nl, nt || '|' || na, nbt || '|' || na, nbt || '|' || na || '|' || nl, nt || '|' || nba, nbt || '|' || nba] as ks,
      [s, s * 0.8e0, case when bt <> t then s * 0.6e0 end, case when bt <> t then s * 0.6e0 end, case when ba <> a then s * 0.6e0 end, case when ba <> a and bt <> t then s * 0.6e0 end] as ss from f)
  where ss[i] is not null and replace(ks[i], '|', '') <> '')"""

ORACLE = {
    "upsert_last_wins": f"{_SIDES} select k, name, id from s qualify row_number() over (partition by k order by n desc) = 1",
    "upsert_last_nonempty": f"{_SIDES} select k, coalesce(arg_max(name, n) filter (where name <> ''), arg_min(name, n)) as name from s group by k",
    "upsert_argmax": f"{_SIDES} select k, arg_max(id, (score, n)) as id, max(score) as score from s group by k",
    "upsert_first_wins": f"{_SIDES} select k, name, id from s where n = 1",
    "upsert_tracks_rule": f"{_SIDES} select k, coalesce(arg_max(name, n) filter (where name <> ''), arg_min(name, n)) as name, coalesce(arg_max(status, n) filter (where status <> 'failed'), arg_min(status, n)) as status, max(coalesce(score, 0)) as score, arg_min(id, n) as id from s group by k",
    "upsert_bindings": "select lower(trim(service, ' ' || chr(9) || chr(10) || chr(13))) as service, trim(song_id, ' ' || chr(9) || chr(10) || chr(13)) as song_id, track_uid from platform_song_ids qualify row_number() over (partition by 1, lower(trim(service, ' ' || chr(9) || chr(10) || chr(13))), trim(song_id, ' ' || chr(9) || chr(10) || chr(13)) order by created_at desc, track_uid desc nulls last) = 1",
    "upsert_metadata": "select lower(trim(service, ' ' || chr(9) || chr(10) || chr(13))) as service, trim(song_id, ' ' || chr(9) || chr(10) || chr(13)) as song_id, coalesce(max(nullif(title_ko, '')), '') as title_ko, coalesce(max(nullif(title_en, '')), '') as title_en, coalesce(max(nullif(artist_en, '')), '') as artist_en from track_list group by 1, 2",
    "match_conflicts": f"with {_DIMS}, x as (select service, song_id, case when ascii(song_id) % 10 = 0 then track_uid || 'x' else track_uid end as track_uid, track_uid as old, 'v' || substr(song_id, 1, 3) as video_id from bind) select service, song_id, track_uid, old as other, 'service_song_id_already_bound' as reason from x where old <> track_uid union select service, song_id, x.track_uid, trim(canonical_yt_video_id), 'same_track_uid_different_video' from x join tracks t on t.track_uid = x.track_uid where trim(canonical_yt_video_id) <> '' and video_id <> trim(canonical_yt_video_id)",
    "source_audits": f"with p as (select job_name, {_PERIOD.format(_TRIM.format('reference_period'))} as p from playlist_order) select job_name, case when length(p) = 8 then substr(p, 1, 4) || '-' || substr(p, 5, 2) || '-' || substr(p, 7, 2) else substr(p, 1, 4) || '-' || substr(p, 5, 3) end as fetched_period, count(*) as entry_count, 40 as id_length from p group by 1, 2",
    "shuffled_order": f"with {_CHART} select distinct service, song_id from chart",
    "replace_partition": "with e as (select event_id, strftime(ts, '%Y-%m-%d') as day, event_type, user_id from events), b as (select * from e where event_id % 10 = 0 and day >= '2024-01-20') select * from e where not exists (select 1 from b where b.day = e.day and b.event_type = e.event_type) union all select * from b",
    "retention_filter": "select event_id from events where ts >= timestamp '2024-01-30' - interval 15 days",
    "rebind_merge": "select o_orderkey, coalesce(c_custkey - 1, o_custkey) as o_custkey from orders left join (select * from customer where c_custkey % 10 = 3) c on o_custkey = c_custkey",
    "rename_chains": "with recursive m as (select track_uid as a, min(merged_into) as b from retired_tracks where merged_into <> '' and track_uid <> '' and track_uid <> merged_into group by 1), r as (select a, b, 1 as n from m union all select r.a, m.b, n + 1 from r join m on r.b = m.a where n < 50) select a as track_uid, arg_max(b, n) as merged_into from r group by a",
    "shared_videos": f"{_COUNTED}, " + _PICK.format("v", "v <> ''"),
    "same_metadata": f"{_COUNTED}, " + _PICK.format(
        "lower(trim(yt_title)) || '|' || lower(trim(yt_artist)) || '|' || lower(trim(yt_album))",
        "trim(yt_title) <> '' and trim(yt_artist) <> '' and trim(yt_album) <> ''",
    ),
    "component_sizes": f"with {_DIMS} select n + 1 as n, count(*) as components from (select track_uid, count(*) as n from bind group by 1) group by 1",
    "anti_unbound": f"with {_CHART}, {_DIMS} select distinct c.service, c.song_id from chart c left join bind b on b.service = c.service and b.song_id = c.song_id where b.song_id is null",
    "semi_bound": f"with {_CHART}, {_DIMS} select distinct c.service, c.song_id from chart c join bind b on b.service = c.service and b.song_id = c.song_id",
    "failed_bindings": f"with {_DIMS} select b.service, b.song_id, b.track_uid from bind b left join tracks t using (track_uid) where t.track_uid is null or coalesce(nullif(lower(trim(match_status)), ''), 'unmatched') in ('failed', 'duplicate_skipped', 'manual_blocked', 'unmatched')",
    "resolved_songs": f"""with {_CHART}, {_DIMS},
tr as (select track_uid, coalesce(trim(canonical_yt_video_id), '') as v, lower(trim(yt_artist)) as a, yt_title, yt_artist,
  coalesce(nullif(lower(trim(match_status)), ''), 'unmatched') in ('failed', 'duplicate_skipped', 'manual_blocked', 'unmatched') as bad from tracks),
vid as (select v, min(track_uid) as u from tr where v <> '' group by 1),
art as (select a, min(v) as v from tr where v <> '' group by 1),
idx as (select lower(trim(yt_title) || '|' || trim(yt_artist)) as k, min(track_uid) as u from tr where yt_title <> '' and yt_artist <> '' group by 1),
s as (select distinct service, song_id, ascii(right(song_id, 1)) % 4 as n, ascii(right(song_id, 1)) % 11 as o from chart),
x as (
  select s.service, s.song_id, o, b.track_uid as bound, coalesce(own.bad, true) as bad, nullif(own.v, '') as own_video, art.v as art_video, idx.u as meta,
    nullif(case n when 0 then own.v when 1 then 'N' || s.song_id when 2 then art.v end, '') as video
  from s left join bind b on b.service = s.service and b.song_id = s.song_id left join tr own on own.track_uid = b.track_uid left join art on art.a = own.a
  left join meta m on m.service = s.service and m.song_id = s.song_id left join idx on idx.k = lower(concat_ws('|', title_en, artist_en))),
y as (
  select x.*, vid.u as by_video, ov.u as over_video from x left join vid on vid.v = x.video left join vid ov on ov.v = x.art_video and x.o = 3),
z as (
  select *, case when o = 0 then 'block' when o = 1 then 'override' when o = 2 or (o = 3 and art_video is not null) then 'override_video'
    when bound is not null and by_video is not null and by_video <> bound then case when own_video is null or own_video = video or bad then 'video' else 'binding' end
    when bound is not null and own_video is not null then 'binding' when by_video is not null then 'video' when meta is not null then 'metadata' else 'new' end as uid_source from y)
select service, song_id, uid_source, case uid_source when 'block' then 'trk_' || substr(sha1('blocked:' || service || ':' || song_id), 1, 16) when 'override' then 'trk_chosen'
  when 'override_video' then coalesce(over_video, 'trk_' || substr(sha1('yt:' || case o when 2 then 'O' || song_id else art_video end), 1, 16))
  when 'binding' then bound when 'video' then by_video when 'metadata' then meta else 'trk_' || substr(sha1(coalesce('yt:' || video, service || ':' || song_id)), 1, 16) end as track_uid
from z""",
    "ingested_bindings": f"with {_DIMS}, c as (select distinct case when lower(trim(service)) in ('youtube', 'youtube_music') then 'ytmusic' when coalesce(trim(service), '') = '' then 'unknown' else lower(trim(service)) end as service, trim(song_id) as song_id from source_tracks where trim(song_id) <> '' and not starts_with(trim(song_id), 'fallback:')) select service, song_id, coalesce(b.track_uid, 'trk_' || substr(sha1('unmatched:' || service || ':' || song_id), 1, 16)) as track_uid from bind b full join c using (service, song_id)",
    "ingested_ranks": "select case when lower(trim(service)) in ('youtube', 'youtube_music') then 'ytmusic' when coalesce(trim(service), '') = '' then 'unknown' else lower(trim(service)) end as service, trim(song_id) as song_id, min(rank) as rank_order from source_tracks where trim(song_id) <> '' and not starts_with(trim(song_id), 'fallback:') group by 1, 2",
    "ingested_status": "with c as (select distinct case when lower(trim(service)) in ('youtube', 'youtube_music') then 'ytmusic' when coalesce(trim(service), '') = '' then 'unknown' else lower(trim(service)) end as service, trim(coalesce(song_id, '')) as song_id, coalesce(nullif(trim(song_id), ''), concat_ws('|', lower(trim(title)), lower(trim(artist)))) as key from source_tracks), b as (select lower(trim(service, ' ' || chr(9) || chr(10) || chr(13))) as service, trim(song_id, ' ' || chr(9) || chr(10) || chr(13)) as song_id from platform_song_ids where track_uid <> '' group by 1, 2), n as (select distinct 'unmatched' as match_status, c.service || ':' || key from c left join b on b.service = c.service and b.song_id = c.song_id where b.service is null) select match_status, count(*) as n from (select match_status from tracks union all select match_status from n) group by 1",
    "history_source": f"with {_CHART}, {_DIMS} select c.service, c.job_name, c.source_variant, c.period as chart_date, c.song_id, b.track_uid, c.rank_order, t.canonical_yt_video_id as video_id, coalesce(title_ko, title_en, yt_title) as title, coalesce(artist_ko, artist_en, yt_artist) as artist, coalesce(album_ko, album_en, yt_album) as album, artwork_url from chart c join bind b on b.service = c.service and b.song_id = c.song_id join tracks t on t.track_uid = b.track_uid left join meta m on m.service = c.service and m.song_id = c.song_id",
    "repaired_bindings": f"""with {_DIMS}, bad as (select b.service, b.song_id from bind b left join tracks t using (track_uid) where t.track_uid is null or coalesce(nullif(lower(trim(match_status)), ''), 'unmatched') in ('failed', 'duplicate_skipped', 'manual_blocked', 'unmatched')),
{_IDX}, good as (select k, u from idx join tracks t on t.track_uid = idx.u where coalesce(nullif(lower(trim(match_status)), ''), 'unmatched') not in ('failed', 'duplicate_skipped', 'manual_blocked', 'unmatched') and canonical_yt_video_id <> '')
select service, song_id, u as track_uid from bad join meta m using (service, song_id) join good on good.k = {_KEY.format(norm_sql('title_en'), norm_sql('artist_en'))}""",
    "cached_songs": f"""with {_DIMS}, good as (select track_uid from tracks where coalesce(lower(trim(match_status)), 'unmatched') not in ('failed', 'duplicate_skipped', 'manual_blocked', 'unmatched') and canonical_yt_video_id <> ''),
{_IDX}, hit as (select k, u from idx join good on good.track_uid = idx.u)
select m.service, m.song_id, coalesce(g.track_uid, hit.u) as track_uid, case when g.track_uid is not null then 'binding' when hit.u is not null then 'metadata' end as match_source
from meta m left join bind b on b.service = m.service and b.song_id = m.song_id left join good g on g.track_uid = b.track_uid left join hit on hit.k = {_KEY.format(norm_sql('title_en'), norm_sql('artist_en'))}""",
    "song_lookup_keys": f"with {_DIMS}, n as (select service, song_id, title_en as t, artist_en as a, coalesce(album_en, '') as al, 1e0 as s from meta where title_en is not null and artist_en is not null), {_KEYS} select service, song_id, key, round(score, 4) as score from keys",
    "merged_lookup_index": f"with n as (select track_uid, yt_title as t, yt_artist as a, coalesce(yt_album, '') as al, coalesce(best_score, 0) as s from tracks where yt_title <> '' and yt_artist <> ''), {_KEYS} select key as lookup_key, arg_max(track_uid, (score, track_uid)) as track_uid, round(max(score), 6) as score from keys group by 1",
    "left_join_count_zero": "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1",
    "left_join_group_max": "select p_partkey, max(l_quantity) as most from part left join lineitem on l_partkey = p_partkey group by 1",
    "dup_having": "select md5(text) as h, count(*) as n from documents where text <> '' group by 1 having count(*) > 1",
    "candidate_key_first_hit": "with i as (select p_brand as k, min(p_partkey) as v from part group by 1 having min(p_partkey) % 2 = 1) select p_partkey, coalesce((select v from i where k = p_brand), (select v from i where k = 'Brand#11')) as hit from part",
    "localized_coalesce_join": "with n as (select n_nationkey as k, case when n_nationkey % 4 = 0 then '' else n_name end as label from nation) select s_suppkey, case when s_suppkey % 3 = 0 then b.label else a.label end as label from supplier left join n a on a.k = s_nationkey left join n b on b.k = s_suppkey % 25",
    "latest_attempt_ties": "select user_id, event_type, strftime(ts, '%Y-%m-%d') as day, event_id from events qualify rank() over (partition by user_id, event_type order by ts::date desc) = 1",
    "failed_latest": "select result_id from (select *, rank() over (partition by lower(trim(service)), song_id order by rank desc nulls last) as r from match_results) where r = 1 and (coalesce(video_id, '') = '' or coalesce(status, '') not in ('matched', 'cached_match', 'proxy_matched', 'manual_override'))",
}
