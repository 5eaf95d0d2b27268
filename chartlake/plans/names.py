"""Queries of names, keys, similarity, parsers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.functions import keys as K
from chartlake.functions import periods as P
from chartlake.functions import scoring as S
from chartlake.functions import similarity as M
from chartlake.functions import text as X
from chartlake.operators import candidates, ranking, resolve
from chartlake.plans import sqltext as Q
from chartlake.plans.charts import _CHART, _DIMS, chart, dims
from chartlake.runtime import table
from chartlake.sources import charts as C

# Endings that make noisy titles of part names.
ENDINGS = ("", " (Live)", " [feat. Some One]", " - Single", " (Japanese Ver.)", " (Night Remix)")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles, artists and albums under test: part names with endings, and all
    search results, whose titles hold versions, guests and ratings in several
    scripts."""
    k = F.col("p_partkey") % len(ENDINGS)
    tail = F.coalesce(*[F.when(k == i, e) for i, e in enumerate(ENDINGS)])
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("k"), F.concat("p_name", tail).alias("title"), F.col("p_brand").alias("artist"), F.lit("X - EP").alias("album"))
    hits = table(spark, d, "match_results").select(F.concat(F.lit("m"), F.col("result_id")).alias("k"), "title", "artist", "album")
    return parts.unionByName(hits)


def normalize_text_key(spark, d):
    c = [F.col(x) for x in ("title", "artist", "album")]
    return _titles(spark, d).select("k", X.metadata_key(*c).alias("key"), X.compact_key(c[0], c[1], X.norm_match).alias("compact"))


def normalized_documents(spark, d):
    """Normalised text of every whole document, by the form with NFKC."""
    t = table(spark, d, "documents").select("doc_id", X.norm_match(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("h"))


def strip_parens(spark, d):
    t = F.col("title")
    return _titles(spark, d).select("k", X.strip_groups(t).alias("bare"), X.strip_rating(t).alias("unrated"), X.clean_title(t).alias("clean"))


def feature_sig(spark, d):
    return _titles(spark, d).select("k", X.feature_signature(F.col("title")).alias("guests"))


def version_sig(spark, d):
    return _titles(spark, d).select("k", X.version_signature(F.col("title")).alias("version"))


def identity_keys(spark, d):
    return _titles(spark, d).select("k", X.identity_key(F.col("title"), F.col("artist"), F.lit("v")).alias("key"))


def identity_groups(spark, d):
    """Entities that share a video or the identity of their names, joined
    through common members: the least entity of each group."""
    t = table(spark, d, "tracks")
    t = t.select("track_uid", K.linked_video(F.col("canonical_yt_video_id")).alias("v"), X.identity_key(F.col("yt_title"), F.col("yt_artist"), F.lit("")).alias("i"))
    g = resolve.identity_groups(t, "track_uid", F.col("v"), F.when(F.col("i").startswith("meta|"), F.col("i")))
    return g.groupBy(F.coalesce("group_id", "track_uid").alias("g")).agg(F.min("track_uid").alias("least"), F.count("*").alias("n")).select("least", "n")


def stable_uid(spark, d):
    return table(spark, d, "part").select("p_partkey", X.stable_uid(F.concat_ws(":", F.lit("part"), "p_partkey")).alias("uid"))


def split_variants(spark, d):
    """Names of credits, and variants of titles, each once by its normal form."""
    t = _titles(spark, d).withColumn("credit", F.concat_ws(" & ", "artist", "album"))
    return t.select("k", F.array_join(X.split_artists(F.col("credit")), "|").alias("artists"), F.array_join(X.paren_variants(F.col("title")), "|").alias("variants"))


def names_once(spark, d):
    """Names of both languages of a song, of those normalised alike the first."""
    n = dims(spark, d)[2]
    names = F.array_compact(F.array("title_ko", "title_en", F.upper("title_en"), F.concat(F.lit(" "), F.col("title_ko"))))
    return n.select("service", "song_id", F.array_join(X.distinct_names(names), "|").alias("names"))


def distinct_by_name(spark, d):
    """Entities of equal video titles apart from case and marks: the first."""
    t = table(spark, d, "tracks").select("track_uid", F.lower(F.trim("yt_title")).alias("key")).where("key <> ''")
    return ranking.mark_repeats(t, ["key"], [F.col("track_uid")]).where("not repeated").select("key", "track_uid")


def token_overlap(spark, d):
    """Shared words of each title and its form without brackets."""
    t = _titles(spark, d)
    return t.select("k", F.round(M.token_overlap(F.lower("title"), F.lower(X.strip_groups(F.col("title")))), 6).alias("overlap"))


def multiset_overlap(spark, d):
    """Shared words of each document's text with the lower-cased text."""
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", F.split("text", " ").alias("w"), F.split(F.lower("text"), " ").alias("v"))
    return ranking.multiset_overlap(t.select("doc_id", F.col("w").alias("x")), t.select("doc_id", F.col("v").alias("x")), "doc_id", "x")


def similarity_seq(spark, d):
    """Similarity of each title to its form without ratings and variants, and
    of search results to what was found."""
    t = _titles(spark, d).select("k", X.clean_title(F.col("title")).alias("a"), F.col("title").alias("b"))
    m = table(spark, d, "match_results").select(F.concat(F.lit("y"), F.col("result_id")).alias("k"), F.col("title").alias("a"), F.col("yt_title").alias("b"))
    return t.unionByName(m).select("k", F.round(M.similarity(F.col("a"), F.col("b"), True), 6).alias("similarity"))


def _titled(spark, d):
    """Songs in both languages and search hits, with their title ``t``."""
    r = table(spark, d, "match_results").where("title <> ''").withColumn("t", F.lower(F.trim("title")))
    many = lambda *cs: F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in cs])))
    songs = r.select("result_id", "t", many("title", "title_ko", "title_en").alias("titles"), many("artist", "artist_ko", "artist_en").alias("artists"), many("album", "album_ko", "album_en").alias("albums"))
    hits = r.where("yt_title <> ''").select("t", F.col("result_id").alias("candidate"), "video_id", many("yt_title").alias("titles"), many("yt_artist").alias("artists"), many("yt_album").alias("albums"), K.result_type(F.col("yt_result_type")).alias("kind"))
    return songs, hits


def _hits(spark, d):
    """Songs in both languages, and as their candidates all search hits of
    songs of the same title."""
    songs, hits = _titled(spark, d)
    return songs.drop("t"), songs.select("result_id", "t").join(hits, "t").drop("t")


def candidate_scores(spark, d):
    """Scores of the search hits of each song, and whether they pass the gates."""
    songs, hits = _titled(spark, d)
    songs = songs.withColumn("named", F.size("artists") > 0)
    s = candidates.score_candidates(songs, hits, ["t"], ["result_id", "named"])
    gate = S.passes_gates(F.col("score"), F.col("title_score"), F.col("artist_score"), F.col("named"))
    return s.select("result_id", "candidate", *[F.round(c, 6).alias(c) for c in ("score", "title_score", "artist_score", "album_score")], gate.alias("passes"))


def video_songs(spark, d):
    """The song that may stand for each hit that is a video."""
    songs, hits = _hits(spark, d)
    r = table(spark, d, "match_results").where("yt_title <> ''").select("result_id", "video_id", F.col("yt_title").alias("title"), F.col("yt_artist").alias("artist"), K.result_type(F.col("yt_result_type")).alias("kind"))
    c = hits.select("result_id", F.col("candidate").alias("place"), "video_id", "titles", "artists", F.coalesce(F.get("albums", 0), F.lit("")).alias("album"), "kind")
    return candidates.resolve_videos(r.where("kind = 'video'").drop("kind"), c, ["result_id"]).drop("resolved_artist")


def verified_titles(spark, d):
    """Whether the title of each hit may stand for its song."""
    m = table(spark, d, "match_results").select("result_id", F.array("title", "title_ko", "title_en").alias("names"), "yt_title")
    return candidates.verify_titles(m, "names", "yt_title").select("result_id", "verified")


def stopped_searches(spark, d):
    """The match of each song and service if its results came query by query."""
    m = table(spark, d, "match_results").select(F.lower(F.trim("service")).alias("service"), F.lower(F.trim("title")).alias("title"), "result_id", "score", "title_score", "artist_score", F.pmod("rank", F.lit(3)).alias("query_no"))
    return candidates.first_passing(m.where("title <> ''"), ["service", "title"], "query_no", "result_id").select("service", "title", "result_id", "query_no")


def staged_hits(spark, d):
    """Hits of the second stage only for titles whose first three are weak."""
    m = table(spark, d, "match_results").select(F.lower(F.trim("title")).alias("title"), "result_id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.pmod("result_id", F.lit(2)) + 1).alias("stage")).where("title <> ''")
    m = ranking.rerank(m, ["title", "stage"], [F.col("result_id")], "place")
    return candidates.staged(m, ["title"], "stage", "score").select("result_id", "stage", "place")


def best_hit(spark, d):
    """The best search hit of each song and service, first of equal ones."""
    r = table(spark, d, "match_results").select(F.lower(F.trim("service")).alias("service"), "song_id", "result_id", "score", "title_score", "artist_score", F.col("video_id"))
    return candidates.best_candidate(r, ["service", "song_id"], "result_id").select("service", "song_id", "result_id", "score")


def match_gates(spark, d):
    r = table(spark, d, "match_results")
    return r.select("result_id", S.passes_gates(F.col("score"), F.col("title_score"), F.col("artist_score"), F.coalesce(F.col("artist"), F.lit("")) != "").alias("passes"))


def match_methods(spark, d):
    r = table(spark, d, "match_results").select("result_id", K.match_method(F.col("status"), F.col("query")).alias("m"))
    return r.select("result_id", "m.method", "m.origin", "m.cached")


def result_types(spark, d):
    r = table(spark, d, "match_results")
    return r.groupBy(K.result_type(F.col("yt_result_type")).alias("kind")).agg(F.count("*").alias("n"))


def url_parts(spark, d):
    """Video ids inside links, as ``v`` or in the path."""
    t = table(spark, d, "tracks").where("canonical_yt_video_id like '%://%'")
    return t.select("track_uid", K.linked_video(F.col("canonical_yt_video_id")).alias("video"))


def song_urls(spark, d):
    t = table(spark, d, "source_tracks")
    return t.select("row_id", K.track_url(F.col("service"), F.col("song_id"), F.col("album_id")).alias("url"))


def duration_seconds(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(":", (F.col("user_id") % 60).cast("string"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0")).alias("t"))
    return e.select("event_id", S.duration_seconds(F.col("t")).alias("seconds"))


def json_props(spark, d):
    """Values of a key of JSON texts, per event type."""
    e = table(spark, d, "events").select("event_type", C.first_path(F.col("props"), "$.key", "$.k").try_cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def json_walk(spark, d):
    """Objects of nested JSON, found wherever they stand."""
    e = table(spark, d, "events").select(F.col("event_id").cast("string").alias("url"), F.concat(F.lit('{"a": [{"b": '), "props", F.lit('}, 1, "x"]}')).alias("json"))
    o = C.walk_json(e, wanted=["k"])
    return o.select(F.col("url").cast("bigint").alias("event_id"), "pos", F.get_json_object("object", "$.k").cast("int").alias("k"))


def _pages(spark, d):
    """A page per series and period: all its songs as a table of HTML, those
    without a rank last, with an empty cell."""
    c = chart(spark, d)
    row = F.concat(F.lit('<tr data-song-no="'), "song_id", F.lit('"><td class="rank">'), F.coalesce(F.col("rank_order").cast("string"), F.lit("")), F.lit('</td><td><span class="none">hidden</span><a href="/watch?v='), "song_id", F.lit('">Song &amp; '), "song_id", F.lit("</a></td></tr>"))
    url = F.concat_ws("/", F.lit("https://pages.example"), "job_name", "source_variant", "period")
    rows = c.groupBy(url.alias("url")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("rank_order").isNull(), "rank_order", "song_id", row.alias("h")))), lambda x: x["h"]), "").alias("body"))
    return rows.select("url", F.concat(F.lit("<html><body><table>"), "body", F.lit("</table></body></html>")).alias("text"))


def html_table(spark, d):
    """Rows of HTML tables: rank and song of each."""
    r = C.parse_html_rows(_pages(spark, d), "tr", {"rank": ["rank"]}, {"song_id": ["data-song-no"]})
    return r.select("url", F.col("rank").cast("int").alias("rank_order"), "song_id")


def html_links(spark, d):
    r = C.anchors(_pages(spark, d))
    return r.select("url", "item_id", "title")


def csv_charts(spark, d):
    """Charts as CSV texts and back: rows without an id are skipped, and a
    missing rank is the place among the kept rows."""
    c = chart(spark, d)
    line = F.concat_ws(",", F.coalesce(F.col("rank_order").cast("string"), F.lit("")), F.concat(F.lit('"a, '), "song_id", F.lit('"')), F.lit("X"), F.when(~F.col("rank_order").eqNullSafe(3), F.concat(F.lit("https://watch.example/watch?v="), "song_id")).otherwise(""))
    doc = c.groupBy(F.concat_ws("/", "job_name", "source_variant", "period").alias("url")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank_order").isNull(), "rank_order", "song_id", line.alias("l")))).alias("x"))
    text = F.concat(F.lit("﻿Rank,Track Name,Artist Names,YouTube URL\n"), F.array_join(F.transform("x", lambda v: v["l"]), "\n"))
    return C.parse_csv(doc.select("url", text.alias("text"))).select("url", "rank", "item_id", "title")


def fallback_strategies(spark, d):
    """The first of two ways that finds rows in each page."""
    pages = _pages(spark, d)
    first = C.parse_html_rows(pages.where("url like '%-W%'"), "tr", {}, {"item_id": ["data-song-no"]}).select("url", "item_id")
    second = C.anchors(pages).select("url", "item_id")
    return C.fallback_chain([first, second]).groupBy("url", "strategy_no").agg(F.count("*").alias("n"))


def balanced_json(spark, d):
    """Objects that are cut out of scripts around a marker."""
    e = table(spark, d, "events")
    text = F.concat(F.lit('<script>var x = {"kind":"lockup","q":"a } \\" {","p":'), "props", F.lit("}; var y = {};</script>"))
    o = C.embedded_objects(e.select(F.col("event_id").cast("string").alias("url"), text.alias("text")), '"kind":"lockup"')
    return o.select(F.col("url").cast("bigint").alias("event_id"), F.get_json_object("json", "$.p.k").cast("int").alias("k"))


def multi_source_dedupe(spark, d):
    """Crawled entries of several sources, each song once, by source order."""
    t = table(spark, d, "source_tracks").select("row_id", F.lower(F.trim("service")).alias("service"), F.nullif(F.trim("song_id"), F.lit("")).alias("song_id"))
    parts = [t.where(F.col("service") == s) for s in ("apple", "melon", "spotify", "ytmusic")]
    return ranking.concat_sources(parts, F.col("song_id"), [F.col("row_id")]).select("row_id", "source_no")


def last_turn(spark, d):
    """The last post on each track in a source."""
    t = table(spark, d, "documents").where("track_uid is not null and source is not null")
    return t.groupBy("source", "track_uid").agg(F.max_by("doc_id", F.struct("posted_at", "doc_id")).alias("doc_id"), F.count("*").alias("n"))


def _releases(spark, d):
    """Albums of songs as releases of a catalogue, some of them bootlegs or of
    other kinds."""
    r = table(spark, d, "match_results").where("album <> '' and title <> '' and artist <> ''")
    kind = F.when(F.col("album").endswith(" - EP"), "EP").when(F.col("album").endswith(" - Single"), "Single").otherwise("Album")
    status = F.when(F.col("result_id") % 11 == 0, "Bootleg").otherwise("Official")
    other = F.when(F.col("result_id") % 13 == 0, F.array(F.lit("Live"))).otherwise(F.array(F.lit("Soundtrack")))
    s = S.release_score(X.norm_match(F.col("album")), X.norm_match(F.col("title")), kind, F.lit("KR"), status, other)
    return r.select("artist", "result_id", "album", F.round(s, 6).alias("s"))


def release_scores(spark, d):
    """The best release per artist."""
    return candidates.release_choice(_releases(spark, d), ["artist"], "s", "result_id", "album")


def release_eligibility(spark, d):
    """The score of every release; -1 if it may not represent the song."""
    return _releases(spark, d).select("result_id", "s")


def crawl_dates(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("t"))
    return e.select("event_id", P.crawl_date(F.col("t")).alias("day"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text_key, normalized_documents, strip_parens, feature_sig, version_sig, identity_keys, identity_groups, stable_uid, split_variants, names_once, distinct_by_name,
        token_overlap, multiset_overlap, similarity_seq, candidate_scores, video_songs, verified_titles, stopped_searches, staged_hits, best_hit, match_gates, match_methods, result_types, url_parts, song_urls,
        duration_seconds, json_props, json_walk, html_table, html_links, csv_charts, fallback_strategies, balanced_json, multi_source_dedupe, last_turn,
        release_scores, release_eligibility, crawl_dates,
    )
}

_T = "t as (select 'p' || p_partkey as k, p_name || case p_partkey % 6 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(ENDINGS)) + " end as title, p_brand as artist, 'X - EP' as album from part union all select 'm' || result_id, title, artist, album from match_results)"
_PAGE = f"""with {_CHART}, page as (
  select 'https://pages.example/' || job_name || '/' || source_variant || '/' || period as url, rank_order, song_id, period, job_name, source_variant from chart)"""
_PLACE_IN_PAGE = "row_number() over (partition by job_name, source_variant, period order by rank_order nulls last, song_id)"
_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda z: z <> '')"
_GATES = "score >= 0.6 and title_score >= 0.65 and artist_score >= 0.55"
_NA, _NT = Q.norm_match_sql("album"), Q.norm_match_sql("title")
_OTHER = " or ".join(f"contains(na, '{w}') and not contains(nt, '{w}')" for w in ("live", "karaoke", "instrumental", "sped up", "slowed", "nightcore", "remix"))
_RELEASES = f"""with n as (select artist, result_id, album, {_NA} as na, {_NT} as nt from match_results where album <> '' and title <> '' and artist <> ''),
x as (select artist, result_id, album, case when result_id % 11 = 0 or result_id % 13 = 0 or na = '' or {_OTHER} then -1 else
  round(0.25e0 + case when album like '% - EP' then 0.2e0 when album like '% - Single' then 0.3e0 else 0.35e0 end + 0.05e0 + case when na = nt then 0.1e0 else 0e0 end
  - case when contains(na, 'deluxe') or contains(na, 'version') then 0.05e0 else 0e0 end, 6) end as s from n)"""
_PAIRED = "^(.*?)\\s*[\\(\\[/（]\\s*(.*?)\\s*[\\)\\]/）]\\s*$"

ORACLE = {
    "normalize_text_key": f"with {_T} select k, {Q.norm_sql('title')} || '|' || {Q.norm_sql('artist')} || '|' || {Q.norm_sql('album')} as key, {Q.norm_match_sql('title')} || '|' || {Q.norm_match_sql('artist')} as compact from t",
    "strip_parens": f"with {_T} select k, {Q.bare_sql('title')} as bare, {Q.unrated_sql('title')} as unrated, {Q.clean_sql('title')} as clean from t",
    "feature_sig": f"with {_T} select k, {Q.guests_sql('title')} as guests from t",
    "version_sig": f"with {_T} select k, {Q.version_sql('title')} as version from t",
    "identity_keys": f"with {_T} select k, {Q.identity_sql('title', 'artist', chr(39) + 'v' + chr(39))} as key from t",
    "identity_groups": f"""with recursive t as (
  select track_uid, 'v:' || {Q.video_sql('canonical_yt_video_id')} as v, {Q.identity_sql('yt_title', 'yt_artist', chr(39) * 2)} as i from tracks),
k as (select track_uid, v, case when i like 'meta|%' then i end as i from t),
near as (select a.track_uid as p, b.track_uid as q from k a join k b on a.v = b.v union select a.track_uid, b.track_uid from k a join k b on a.i = b.i),
reach as (select track_uid as p, track_uid as q from k union select reach.p, near.q from reach join near on reach.q = near.p),
least as (select p, min(q) as least from reach group by 1)
select least, count(*) as n from least group by 1""",
    "split_variants": f"""with {_T} select k,
  array_to_string(list_filter(list_transform(regexp_split_to_array(concat_ws(' & ', artist, album), '\\s*(?:,|&| and | x | X | with |\\+)\\s*|\\s+(?:및|와|과)\\s+'), lambda z: trim(z)), lambda z: z <> ''), '|') as artists,
  array_to_string([title] || case when regexp_matches(title, '{_PAIRED}') and (trim(regexp_extract(title, '{_PAIRED}', 1)) <> '' or trim(regexp_extract(title, '{_PAIRED}', 2)) <> '')
    then list_filter([trim(regexp_extract(title, '{_PAIRED}', 1)), trim(regexp_extract(title, '{_PAIRED}', 2))], lambda z: z <> '')
    when contains(title, ' / ') then list_filter(list_transform(string_split(title, ' / '), lambda z: trim(z)), lambda z: z <> '')
    when contains(title, ' | ') then list_filter(list_transform(string_split(title, ' | '), lambda z: trim(z)), lambda z: z <> '')
    when contains(title, ' - ') then list_filter(list_transform(string_split(title, ' - '), lambda z: trim(z)), lambda z: z <> '') else [] end, '|') as variants from t""",
    "names_once": f"""with {_DIMS}, x as (select service, song_id, list_filter([title_ko, title_en, upper(title_en), ' ' || title_ko], lambda z: z is not null) as l from meta),
y as (select service, song_id, unnest(range(len(l))) as n, trim(unnest(l)) as name from x),
z as (select service, song_id, {Q.norm_sql('name')} as key, min(n) as n, arg_min(name, n) as name from y where name <> '' group by all),
w as (select service, song_id, string_agg(name, '|' order by n) as names from z group by all)
select m.service, m.song_id, coalesce(names, '') as names from meta m left join w using (service, song_id)""",
    "token_overlap": f"""with {_T}, w as (select k, {_WORDS.format('lower(title)')} as a, {_WORDS.format('lower(' + Q.bare_sql('title') + ')')} as b from t),
x as (select k, len(a) as na, len(b) as nb, list_sum(list_transform(list_distinct(a), lambda u: least(len(list_filter(a, lambda v: v = u)), len(list_filter(b, lambda v: v = u))))) as shared from w)
select k, round(coalesce(0.8e0 * shared / nullif(na, 0) + 0.2e0 * shared / nullif(nb, 0), 0), 6) as overlap from x""",
    "stable_uid": "select p_partkey, 'trk_' || substr(sha1('part:' || p_partkey), 1, 16) as uid from part",
    "distinct_by_name": "select lower(trim(yt_title)) as key, min(track_uid) as track_uid from tracks where trim(yt_title) <> '' group by 1",
    "multiset_overlap": "with t as (select doc_id, string_split(text, ' ') as w, string_split(lower(text), ' ') as v from documents where text <> ''), a as (select doc_id, unnest(w) as x from t), b as (select doc_id, unnest(v) as x from t), ca as (select doc_id, x, count(*) as n from a group by all), cb as (select doc_id, x, count(*) as n from b group by all) select doc_id, sum(least(coalesce(ca.n, 0), coalesce(cb.n, 0))) as shared, sum(coalesce(ca.n, 0)) as left_n, sum(coalesce(cb.n, 0)) as right_n from ca full join cb using (doc_id, x) group by 1",
    "best_hit": "select lower(trim(service)) as service, song_id, result_id, score from match_results where score >= 0.6 and title_score >= 0.65 and artist_score >= 0.55 qualify row_number() over (partition by lower(trim(service)), song_id order by score desc, result_id) = 1",
    "match_gates": "select result_id, coalesce(score >= 0.6 and title_score >= 0.65 and (coalesce(artist, '') = '' or artist_score >= 0.55), false) as passes from match_results",
    "match_methods": "select result_id, case trim(coalesce(status, '')) when 'manual_override' then 'manual' when 'proxy_matched' then 'proxy' when 'cached_match' then 'cache' when 'failed' then 'failed' when 'duplicate_skipped' then 'failed' when 'manual_blocked' then 'failed' else 'search' end as method, case trim(coalesce(status, '')) when 'manual_override' then 'manual' when 'proxy_matched' then 'proxy' when 'cached_match' then 'unknown' when 'failed' then 'none' when 'duplicate_skipped' then 'none' when 'manual_blocked' then 'none' else 'search' end as origin, coalesce(status = 'cached_match', false) as cached from match_results",
    "result_types": "select lower(trim(coalesce(yt_result_type, ''))) as kind, count(*) as n from match_results group by 1",
    "url_parts": f"select track_uid, {Q.video_sql('canonical_yt_video_id')} as video from tracks where contains(canonical_yt_video_id, '://')",
    "song_urls": "select row_id, case when coalesce(trim(song_id), '') = '' then '' when lower(trim(service)) = 'melon' then 'https://www.melon.com/song/detail.htm?songId=' || trim(song_id) when lower(trim(service)) = 'spotify' then 'https://open.spotify.com/track/' || trim(song_id) when lower(trim(service)) = 'apple' and trim(album_id) <> '' then 'https://music.apple.com/album/' || trim(album_id) || '?i=' || trim(song_id) else '' end as url from source_tracks",
    "duration_seconds": "select event_id, user_id % 60 * 60 + event_id % 60 as seconds from events",
    "json_props": "select event_type, count(k) as n, sum(k) as total, max(k) as most from (select event_type, try_cast(json_extract_string(props, '$.k') as int) as k from events) group by 1",
    "json_walk": "select event_id, 2 as pos, cast(json_extract_string(props, '$.k') as int) as k from events",
    "html_table": f"{_PAGE} select url, rank_order, song_id from page",
    "html_links": f"{_PAGE} select url, song_id as item_id, 'Song &amp; ' || song_id as title from page",
    "csv_charts": f"with {_CHART}, kept as (select * from chart where rank_order is distinct from 3) select job_name || '/' || source_variant || '/' || period as url, coalesce(rank_order, {_PLACE_IN_PAGE}) as rank, song_id as item_id, 'a, ' || song_id as title from kept",
    "fallback_strategies": f"{_PAGE} select url, case when period like '%-W%' then 1 else 2 end as strategy_no, count(*) as n from page group by all",
    "balanced_json": "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    "multi_source_dedupe": "with t as (select row_id, nullif(trim(song_id), '') as s, list_position(['apple', 'melon', 'spotify', 'ytmusic'], lower(trim(service))) - 1 as source_no from source_tracks) select row_id, source_no from t where source_no >= 0 and s is not null qualify row_number() over (partition by s order by source_no, row_id) = 1 union all select row_id, source_no from t where source_no >= 0 and s is null",
    "last_turn": "select source, track_uid, arg_max(doc_id, (posted_at, doc_id)) as doc_id, count(*) as n from documents where track_uid is not null and source is not null group by all",
    "release_scores": f"{_RELEASES} select artist, arg_min(album, (-s, result_id)) as release, max(s) as release_score from x where s > 0 group by 1",
    "release_eligibility": f"{_RELEASES} select result_id, s from x",
    "stopped_searches": f"with m as (select lower(trim(service)) as service, lower(trim(title)) as title, result_id, score, rank % 3 as query_no from match_results where trim(title) <> '' and {_GATES}), q as (select service, title, min(query_no) as stop from m group by 1, 2) select m.service, m.title, m.result_id, m.query_no from m join q on q.service is not distinct from m.service and q.title = m.title where m.query_no = stop qualify row_number() over (partition by m.service, m.title order by score desc, result_id) = 1",
    "staged_hits": "with m as (select lower(trim(title)) as title, result_id, coalesce(score, 0) as score, result_id % 2 + 1 as stage, row_number() over (partition by lower(trim(title)), result_id % 2 order by result_id) as place from match_results where trim(title) <> ''), t as (select title, max(score) as top from m where stage = 1 and place <= 3 group by 1) select result_id, stage, place from m left join t using (title) where stage = 1 or coalesce(top, 0) < 0.75",
    "crawl_dates": "select event_id, strftime(date_trunc('second', ts) + interval 9 hours, '%Y-%m-%d') as day from events",
}
