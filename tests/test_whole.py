"""Queries read whole tables: results against counts that carry no filter."""

import json
from collections import Counter

import duckdb

import __spark_entry__ as entry
from chartlake.operators import asof, report
from chartlake.plans.charts import _CHART


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def sql(sf, text, *tables):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet(['{sf}/{t}.parquet'])")
    return con.sql(text).fetchall()


def test_identity_groups_of_all_tracks(spark, sf):
    from pyspark.sql import functions as F

    from chartlake.functions.keys import linked_video
    from chartlake.functions.text import identity_key

    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    t = spark.read.parquet(f"{sf}/tracks.parquet")
    t = t.select("track_uid", linked_video(F.col("canonical_yt_video_id")), identity_key(F.col("yt_title"), F.col("yt_artist"), F.lit(""))).collect()
    for uid, video, identity in t:
        for k in (("v", video) if video else None, ("i", identity) if identity.startswith("meta|") else None):
            if k:
                parent[root(k)] = root(uid)
    groups = {}
    for uid, _, _ in t:
        groups.setdefault(root(uid), []).append(uid)
    got = rows(entry.queries()["identity_groups"](spark, sf), "least", "n")
    assert got == sorted(((min(g), len(g)) for g in groups.values()), key=str)
    assert sum(n for _, n in got) == len(t) and any(n > 1 for _, n in got)


def test_a_delivery_that_drops_a_song(spark, tmp_path):
    from datetime import datetime

    from chartlake.plans import charts

    at = [datetime(2026, 1, d) for d in (1, 2, 3)]
    make = lambda period, song, rank, d, service="Apple": (service, "J", "v", period, song, rank, at[d])
    facts = [
        make("2026-01-01", "a", 1, 0), make("2026-01-01", "b", 2, 0), make("20260101", "a", 3, 2, " apple "), make("2026.01.01", "a", 2, 2), make("2026-01-01", " ", 9, 2),
        make("2026-W01", "a", 1, 0), make("2025-12-29", "b", 1, 1), make("2026-01-02", "a", None, 1),
    ]
    spark.createDataFrame(facts, "service string, job_name string, source_variant string, reference_period string, song_id string, rank_order int, delivered_at timestamp").write.parquet(f"{tmp_path}/playlist_order.parquet")
    got = rows(charts.chart(spark, str(tmp_path)), "period", "song_id", "rank_order")
    assert got == [("2025-12-29", "b", 1), ("2026-01-01", "a", 2), ("2026-01-02", "a", None), ("2026-W01", "a", 1)]
    before = rows(charts.previous_rank(spark, str(tmp_path)), "period", "song_id", "previous_rank")
    assert before == [("2025-12-29", "b", None), ("2026-01-01", "a", 1), ("2026-01-02", "a", 2), ("2026-W01", "a", None)]
    assert rows(charts.new_entries(spark, str(tmp_path)), "period", "song_id") == [("2026-W01", "a")]  # a week stands at its Monday, after that day


def test_json_of_all_events(spark, sf):
    events = [(i, json.loads(p)["k"]) for i, p in sql(sf, "select event_id, props from events", "events")]
    for name in ("json_walk", "balanced_json"):
        got = rows(entry.queries()[name](spark, sf), "event_id", "k")
        assert got == sorted(events, key=str), name


def test_pages_and_csv_of_all_charts(spark, sf):
    url = "job_name || '/' || source_variant || '/' || period"
    page = "'https://pages.example/' || " + url
    q = entry.queries()
    want = sql(sf, f"with {_CHART} select {page}, rank_order, song_id from chart", "playlist_order")
    assert any(r is None for _, r, _ in want)
    assert rows(q["html_table"](spark, sf), "url", "rank_order", "song_id") == sorted(want, key=str)
    links = sorted(((u, s, f"Song &amp; {s}") for u, _, s in want), key=str)
    assert rows(q["html_links"](spark, sf), "url", "item_id", "title") == links
    first = Counter((u, 1 if "-W" in u.rsplit("/", 1)[1] else 2) for u, _, _ in want)
    assert rows(q["fallback_strategies"](spark, sf), "url", "strategy_no", "n") == sorted(((*k, n) for k, n in first.items()), key=str)
    place = f"coalesce(rank_order, row_number() over (partition by {url} order by rank_order nulls last, song_id))"
    want = sql(sf, f"with {_CHART} select {url}, {place}, song_id, 'a, ' || song_id from chart where rank_order is distinct from 3", "playlist_order")
    assert rows(q["csv_charts"](spark, sf), "url", "rank", "item_id", "title") == sorted(want, key=str)


def test_reports_of_every_anchor_date(spark, sf):
    day = "select distinct strftime(period::date + 1, '%Y-%m-%d') from chart where job_name = 'Harbor-Top-100' and period like '____-__-__'"
    want = sorted(sql(sf, f"with {_CHART} {day}", "playlist_order"))
    assert len(want) > 7
    for name in ("effective_period_asof", "hype_report_top", "history_round_trip"):
        assert rows(entry.queries()[name](spark, sf).select("chart_date").distinct(), "chart_date") == want, name


def test_report_groups_by_video_and_identity(spark):
    make = spark.createDataFrame
    names = [("apple", "a1", "Song", "Artist"), ("melon", "m1", "SONG (Explicit)", "artist"), ("ytmusic", "y1", "Other", "Else"), ("apple", "a2", "Song (Live)", "Artist"), ("melon", "m2", None, None)]
    songs = [("apple", "a1", "t1"), ("melon", "m1", "t2"), ("ytmusic", "y1", "t3"), ("apple", "a2", "t4"), ("melon", "m2", "t5")]
    facts = make([("apple", "ja", "x", "2026-01-01", "a1", 5), ("melon", "jm", "x", "2026-01-01", "m1", 2), ("ytmusic", "jy", "x", "2026-01-01", "y1", 7), ("apple", "ja", "x", "2026-01-01", "a2", 1), ("melon", "jm", "x", "2026-01-01", "m2", None)], "service string, job_name string, source_variant string, period string, song_id string, rank_order int")
    tracks = make([("t1", "v1"), ("t2", "v2"), ("t3", "https://watch.example/watch?v=v1"), ("t4", "v4"), ("t5", " https://short.example/v2 ")], "track_uid string, canonical_yt_video_id string").selectExpr("*", "'' as yt_title", "'' as yt_artist", "'' as yt_album")
    meta = make(names, "service string, song_id string, title_en string, artist_en string").selectExpr("*", "'' as title_ko", "'' as artist_ko", "'' as album_ko", "'' as album_en", "'' as album_id", "'' as artwork_url")
    jobs = make([("ja", "apple", 0.4), ("jm", "melon", 0.4), ("jy", "ytmusic", 0.2)], "job_name string, hype_group string, hype_weight double")
    days = asof.report_dates(make([("2026-01-02",)], "chart_date string"))
    r = report.grouped_rows(report.report_rows(facts, days, make(songs, "service string, song_id string, track_uid string"), tracks, meta, jobs))
    assert rows(r, "song_id", "video_id") == [("a1", "v2"), ("a2", "v4"), ("m1", "v2"), ("m2", "v2"), ("y1", "v2")]
    got = rows(report.hype_report(r, ("apple", "melon", "ytmusic")), "video_id", "apple_rank", "melon_rank", "ytmusic_rank", "entries")
    assert got == [("v2", 5, 2, 7, 4), ("v4", 1, None, None, 1)]


def test_links_of_every_form(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    links = dict(sql(sf, "select track_uid, trim(canonical_yt_video_id) from tracks where canonical_yt_video_id like '%://%'", "tracks"))
    assert any("v=" not in x for x in links.values())
    got = dict(rows(entry.queries()["url_parts"](spark, sf), "track_uid", "video"))
    assert set(got) == set(links)
    assert all(v and "/" not in v and "=" not in v and v in links[k] for k, v in got.items())
