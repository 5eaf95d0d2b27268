"""Merges, components, lookups, ranks, resolution, report and history."""

import random
from hashlib import sha1
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chartlake.functions.scoring import blend
from chartlake.operators import asof, history, lookup, merge, quality, ranking, report, resolve
from chartlake.operators.components import connected_components, resolve_chains


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


# --- merges


def fold(existing, batch):
    """One-at-a-time upserts with the rules of tracks."""
    out = {k: dict(r) for k, r in existing.items()}
    for r in batch:
        k = r["track_uid"]
        if k not in out:
            out[k] = dict(r)
            continue
        o = out[k]
        if o["canonical_yt_video_id"] is None:
            o["canonical_yt_video_id"] = r["canonical_yt_video_id"]
        for c in ("yt_title",):
            if r[c]:
                o[c] = r[c]
        if r["match_status"] is not None and r["match_status"] != "failed":
            o["match_status"] = r["match_status"]
        o["best_score"] = max(o["best_score"] or 0, r["best_score"] or 0)
        o["updated_at"] = r["updated_at"]
    return {k: {**r, "best_score": r["best_score"] or 0} for k, r in out.items()}


def test_merge_tracks(spark):
    rnd = random.Random(1)
    cols = ["track_uid", "canonical_yt_video_id", "yt_title", "match_status", "best_score", "updated_at"]

    def one(k, i):
        return dict(zip(cols, (k, rnd.choice([None, "", "v1", "v2"]), rnd.choice([None, "", "t1", "t2"]), rnd.choice(["failed", "matched", "unmatched"]), rnd.choice([None, 0.1, 0.9]), datetime(2026, 1, 1, 0, 0, i % 60))))

    existing = {f"k{i}": one(f"k{i}", 0) for i in range(40)}
    batch = [one(f"k{rnd.randrange(60)}", i) for i in range(200)]
    ddl = "track_uid string, canonical_yt_video_id string, yt_title string, match_status string, best_score double, updated_at timestamp"
    old = spark.createDataFrame([tuple(r.values()) for r in existing.values()], ddl)
    new = spark.createDataFrame([(*r.values(), i) for i, r in enumerate(batch)], ddl + ", n int")
    keys, rules = merge.TABLES["tracks"]
    rules = {c: rules[c] for c in cols[1:]}
    once = merge.merge(old, new, keys, rules, ["n"])
    want = fold(existing, batch)
    assert {r.track_uid: r.asDict() for r in once.collect()} == want
    twice = merge.merge(once, new, keys, rules, ["n"])
    assert rows(twice, *cols) == rows(once, *cols)
    assert rows(merge.merge(old.limit(0), new.limit(0), keys, rules, ["n"]), *cols) == []


def test_merge_argmax_and_first(spark):
    old = spark.createDataFrame([("a", "u0", 0.5), ("b", "u0", 0.9)], "lookup_key string, track_uid string, score double")
    new = spark.createDataFrame([("a", "u1", 0.5, 1), ("b", "u1", 0.1, 2), (None, "u2", None, 3)], "lookup_key string, track_uid string, score double, n int")
    got = merge.merge(old, new, ["lookup_key"], {"track_uid": merge.with_best("score"), "score": merge.greatest}, ["n"])
    assert rows(got, "lookup_key", "track_uid", "score") == [("a", "u1", 0.5), ("b", "u0", 0.9), (None, "u2", None)]
    got = merge.merge(old, new, ["lookup_key"], {"track_uid": merge.first}, ["n"])
    assert ("a", "u0") in rows(got, "lookup_key", "track_uid")


def test_all_declared_merges_run(spark):
    from chartlake.schemas import TABLES

    for name, (keys, rules) in merge.TABLES.items():
        ddl = TABLES.get(name.replace("_rebind", ""), "")
        empty = spark.createDataFrame([], ddl)
        assert merge.merge(empty, empty, keys, rules, [keys[0]]).count() == 0


def test_replace_and_rebind(spark):
    old = spark.createDataFrame([("d1", "a", 1), ("d1", "b", 2), ("d2", "a", 3), (None, "a", 4)], "p string, k string, v int")
    new = spark.createDataFrame([("d1", "c", 9, 0), (None, "z", 8, 0)], "p string, k string, v int, extra int")
    assert rows(merge.replace_partitions(old, new, ["p"]), "p", "k") == [("d1", "c"), ("d2", "a"), (None, "z")]
    assert rows(merge.replace_partitions(old, new, ["p"], F.col("p") == "d1"), "p", "k") == [("d1", "a"), ("d1", "b"), ("d1", "c"), ("d2", "a"), (None, "z")]
    moves = spark.createDataFrame([("a", "q")], "old_uid string, new_uid string")
    assert rows(merge.rebind(old, moves, "k"), "k") == [("b",), ("q",), ("q",), ("q",)]
    t = spark.createDataFrame([(datetime(2026, 1, 1),), (datetime(2026, 1, 20),), (None,)], "at timestamp")
    assert merge.retained(t, "at", F.lit("2026-01-21").cast("timestamp")).count() == 1


# --- graphs


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5, 5), (None, 3), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert rows(got, "node", "component") == sorted(((x, find(x)) for x in parent), key=str)
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("x", "z"), ("q", "q"), (None, "a")], "o string, n string")
    assert rows(resolve_chains(m, "o", "n"), "o", "n") == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "y")]
    cycle = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "b")], "o string, n string")
    assert rows(resolve_chains(cycle, "o", "n"), "o", "n") == [("b", "a"), ("c", "a")]


# --- lookups and ranks


def test_first_hit(spark):
    r = spark.createDataFrame([(1, ["x", "a"]), (2, ["b", "a"]), (3, []), (4, None), (2, ["b", "a"])], "i int, keys array<string>")
    index = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, v string")
    assert rows(lookup.first_hit(r, "keys", index, "k", "v", "hit"), "i", "hit") == [(1, "A"), (2, "B"), (2, "B"), (3, None), (4, None)]


def test_localize(spark):
    r = spark.createDataFrame([(1, 1, "t"), (2, 2, "t"), (3, 9, "t")], "id int, rank int, title string")
    n = spark.createDataFrame([(1, 7, "", 1), (1, 7, "one", 2), (8, 2, "two", 1)], "id int, rank int, title string, n int")
    assert rows(lookup.localize(r, n, [["id"], ["rank"]], ["title"], "n"), "id", "title") == [(1, "one"), (2, "two"), (3, "t")]


def test_merge_ranked_and_number(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 5)], "k string, r int")
    b = spark.createDataFrame([("y", 1), ("z", 3)], "k string, r int")
    for limit in (None, 2):
        m = lookup.merge_ranked(a, b, F.col("k"), "r", ["k"], lambda p, q: blend(p, q), limit)
        got = [(r.k, r.combined_rank) for r in m.orderBy("combined_rank").collect()]
        assert got == [("y", 1), ("x", 2), ("z", 3)][:limit]
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v + 1 == r.n for r in lookup.number(d, [F.col("v")], "n").collect())


def test_diff_and_sources(spark):
    a = spark.createDataFrame([(1, "A"), (2, "b"), (3, None)], "rank int, title string")
    b = spark.createDataFrame([(1, "a"), (2, "c")], "rank int, title string")
    assert tuple(lookup.diff_by_rank(a, b, ["rank"], ["title"]).first()) == (3, 1, 1)
    c = ranking.concat_sources([a, b], F.lower("title"), [F.col("rank")])
    assert rows(c, "title", "source_no") == [("A", 0), ("b", 0), ("c", 1), (None, 0)]


def test_ranking(spark):
    r = spark.createDataFrame([("s", "p1", "a"), ("s", "p1", "b"), ("s", "p2", "b"), ("s", "p2", "c"), ("t", "p1", "z"), ("s", None, "q")], "s string, p string, k string")
    assert rows(ranking.new_entries(r, ["s"], "p", "k"), "s", "p", "k") == [("s", "p2", "c")]
    assert rows(ranking.top_k(r, ["s"], [F.col("k").desc()], 1), "s", "k") == [("s", "q"), ("t", "z")]
    assert ranking.mark_repeats(r, ["k"], [F.col("p")]).where("repeated").count() == 1


# --- as-of, report, history


def test_asof(spark):
    f = spark.createDataFrame([("a", "2026-01-01"), ("a", "2026-01-05"), ("b", "2026-W01"), ("b", "2026-W03"), ("c", "2026-02-01"), (None, "2025-01-01"), ("d", None)], "s string, period string")
    d = asof.report_dates(spark.createDataFrame([("2026-01-06",), ("2026-01-03",)], "chart_date string"))
    got = rows(asof.effective_periods(f, d, ["s"]), "chart_date", "s", "period")
    want = [("2026-01-03", "a", "2026-01-01"), ("2026-01-03", "b", "2026-W01"), ("2026-01-03", None, "2025-01-01"), ("2026-01-06", "a", "2026-01-05"), ("2026-01-06", "b", "2026-W01"), ("2026-01-06", None, "2025-01-01")]
    assert got == sorted(want, key=str)
    t = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", None, 4)], "k string, o int, i int")
    assert rows(asof.latest_with_ties(t, ["k"], "o"), "i") == [(2,), (3,), (4,)]


def _entries(spark):
    data = [
        ("2026-01-02", "v1", "apple", "ja", "x", "s1", 1, "apple", 0.4, "One", "A"), ("2026-01-02", "v1", "melon", "jm", "x", "s2", 3, "melon", 0.2, "Eins", "A"),
        ("2026-01-02", "v2", "apple", "ja", "x", "s3", 2, "apple", 0.4, "", "B"), ("2026-01-02", "v3", "spotify", "js", "x", "s4", 1, None, None, "Drei", "C"),
        ("2026-01-03", "v2", "melon", "jm", "x", "s5", 1, "melon", 0.2, "Two", "B"), ("2026-01-03", "v2", "apple", "ja", "x", "s3", None, "apple", 0.4, "", "B"),
    ]
    e = spark.createDataFrame(data, "chart_date string, video_id string, service string, job_name string, source_variant string, song_id string, rank_order int, hype_group string, weight double, title string, artist string")
    return e.withColumns({"album": F.lit(None).cast("string"), "artwork_url": F.concat(F.lit("u"), "song_id"), "yt_title": F.lit("yt"), "yt_artist": F.lit("ya"), "yt_album": F.lit("")})


def test_report(spark):
    r = report.hype_report(_entries(spark), ("apple", "melon"))
    got = rows(r, "chart_date", "hype_rank", "video_id", "title", "apple_rank", "melon_rank", "artwork_url")
    assert got[0] == ("2026-01-02", 1, "v1", "One", 1, 3, "us1")
    assert got[1][:4] == ("2026-01-02", 2, "v2", "yt") and len(got) == 3
    assert got[2] == ("2026-01-03", 1, "v2", "Two", None, 1, "us3")
    w = report.wave_flags(report.hype_report(_entries(spark), ("apple", "melon")))
    assert rows(w.where("wave"), "chart_date", "video_id", "new_wave") == [("2026-01-02", "v2", True)]
    assert report.digest(r, 1).where("chart_date = '2026-01-02'").first().digest == "1. A - One"
    assert report.hype_report(_entries(spark).limit(0), ("apple",)).count() == 0


def test_history(spark):
    r = report.hype_report(_entries(spark), ("apple", "melon")).select("chart_date", "video_id", "title", "artist", "hype_rank", "hype_index")
    c = history.compact(r, ["title", "artist"], ["hype_rank", "hype_index"])
    back = history.inflate(c, "title string, artist string", "hype_rank int, hype_index double")
    assert rows(back, "chart_date", "video_id", "hype_rank", "hype_index") == rows(r, "chart_date", "video_id", "hype_rank", "hype_index")
    assert dict(rows(history.track_fields(r, ["title"]), "video_id", "title")) == {"v1": "One", "v2": "Two"}
    d = spark.createDataFrame([("2026-01-01",), ("2026-01-31",), ("2026-02-01",), ("x",), (None,)], "chart_date string")
    assert rows(history.prune(d, F.lit("2026-01-31").cast("date")), "chart_date") == [("2026-01-01",), ("2026-01-31",)]
    flat = history.inflate_flat(spark.createDataFrame([('{"2026-01-01": [{"a": 1}, {"a": 2}]}',)], "json string"), "a int")
    assert rows(flat, "chart_date", "a") == [("2026-01-01", 1), ("2026-01-01", 2)]


# --- quality and resolution


def test_quality(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    e = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "k string, expected int")
    assert rows(quality.count_check(d, ["k"], e), "k", "status") == [("a", "ok"), ("b", "short"), ("c", "missing")]
    assert quality.assert_count(d, 3).count() == 3
    with pytest.raises(Exception, match="expected 4 rows, found 3"):
        quality.assert_count(d, 4).collect()


def test_resolution(spark):
    songs = spark.createDataFrame([("s", "1", "v9", ["k"]), ("s", "2", None, ["k"]), ("s", "3", "v1", []), ("s", "4", None, []), ("s", "5", None, ["k"])], "service string, song_id string, video_id string, keys array<string>")
    bind = spark.createDataFrame([("s", "1", "u1"), ("s", "5", "u5")], "service string, song_id string, track_uid string")
    tracks = spark.createDataFrame([("u1", "matched", "v0"), ("u5", "failed", "")], "track_uid string, match_status string, canonical_yt_video_id string")
    videos = spark.createDataFrame([("v1", "uv")], "video_id string, track_uid string")
    index = spark.createDataFrame([("k", "um")], "lookup_key string, track_uid string")
    over = spark.createDataFrame([("s", "4", "block", None, None)], "service string, song_id string, action string, target_track_uid string, canonical_yt_video_id string")
    got = resolve.resolve_uids(songs, bind, videos, index, over, tracks)
    assert rows(got, "song_id", "track_uid", "uid_source") == [("1", "u1", "binding"), ("2", "um", "metadata"), ("3", "uv", "video"), ("4", "trk_" + sha1(b"blocked:s:4").hexdigest()[:16], "block"), ("5", "um", "metadata")]


def test_winners_and_moves(spark):
    m = spark.createDataFrame([("g", "a", 1), ("g", "b", 5), ("h", "c", 1), (None, "d", 1), ("g", "e", 5)], "g string, track_uid string, n int")
    moves = resolve.winners(m, "g", [-F.col("n")])
    assert rows(moves, "old_uid", "new_uid") == [("a", "b"), ("e", "b")]
    left, held = resolve.apply_moves(moves, m.select("track_uid"), {"x": m.select("g", "track_uid")})
    assert rows(left, "track_uid") == [("b",), ("c",), ("d",)]
    assert held["x"].where("track_uid = 'b'").count() == 3
    assert rows(resolve.veto(moves, spark.createDataFrame([("e",)], "track_uid string")), "old_uid") == [("a",)]


def test_groups(spark):
    r = spark.createDataFrame([(1, "d", "v1", "i1"), (2, "d", "v2", "i1"), (3, "d", "v2", "i2"), (4, "d", "v3", "i3")], "n int, d string, v string, i string")
    assert [g for _, g in rows(resolve.greedy_groups(r, "d", ["n"], "v", "i"), "n", "group_id")] == ["i1", "i1", "i1", "i3"]
    g = dict(rows(resolve.identity_groups(r, "n", F.col("v"), F.col("i")), "n", "group_id"))
    assert g[1] == g[2] == g[3] != g[4]


def test_heal(spark):
    from chartlake.operators import heal

    tracks = spark.createDataFrame(
        [("u1", "v1", "Song", "A", "X", "matched", 0.9, datetime(2025, 1, 1)), ("u2", "v2", "song", "a", "x", "matched", 0.5, datetime(2025, 1, 2)), ("u3", "v3", "Song B", "C (카)", "", "matched", 0.2, datetime(2025, 1, 3)), ("u4", "v4", "Song B", "C", "", "matched", 0.8, datetime(2025, 1, 4))],
        "track_uid string, canonical_yt_video_id string, yt_title string, yt_artist string, yt_album string, match_status string, best_score double, created_at timestamp",
    )
    bind = spark.createDataFrame([("s", "1", "u1"), ("s", "2", "u2"), ("s", "3", "u3")], "service string, song_id string, track_uid string")
    songs = spark.createDataFrame([("s", "3", None, [], "Song B", "C (카)"), ("s", "4", "v1", [], "", ""), ("s", "5", None, ["song b|c"], "", ""), ("s", "6", None, ["no"], None, None)], "service string, song_id string, video_id string, keys array<string>, title string, artist string")
    videos = tracks.select(F.col("canonical_yt_video_id").alias("video_id"), "track_uid")
    index = spark.createDataFrame([("song b|c", "u4", 0.8), ("song b|c 카", "u3", 0.2)], "lookup_key string, track_uid string, score double")
    none = spark.createDataFrame([], "track_uid string")
    left, held = heal.heal(tracks, bind, songs, videos, index, none)
    assert rows(left, "track_uid") == [("u1",), ("u4",)]
    assert rows(held, "song_id", "track_uid") == [("1", "u1"), ("2", "u1"), ("3", "u4"), ("4", "u1"), ("5", "u4")]
    again = heal.heal(left, held, songs, videos, index, none)
    assert rows(again[1], "song_id", "track_uid") == rows(held, "song_id", "track_uid")
    kept = heal.heal(tracks, bind, songs, videos, index, spark.createDataFrame([("u2",)], "track_uid string"))
    assert ("u2",) in rows(kept[0], "track_uid")


def test_search_queries(spark):
    from chartlake.operators.candidates import result_album, result_artists, search_queries, staged

    d = spark.createDataFrame([("Song (Sub)", "A & B", "Al - EP", "노래", "가", None), ("", None, None, None, None, None)], "t string, a string, al string, tk string, ak string, alk string")
    got = [r.q for r in d.select(search_queries(*[F.col(c) for c in ("t", "a", "al", "tk", "ak", "alk")]).alias("q")).collect()]
    assert got[0][:3] == ["Song (Sub) A & B", "Song (Sub) A & B Al", "노래 가"] and got[0][-2:] == ["Song (Sub)", "노래"] and got[1] == []
    r = spark.sql("select named_struct('artists', array(named_struct('name', 'x'), named_struct('name', 'y')), 'author', named_struct('name', 'z'), 'podcast', named_struct('name', 'p'), 'album', named_struct('name', ''), 'playlist', named_struct('name', 'l')) as r")
    assert tuple(r.select(result_artists(F.col("r")), result_album(F.col("r"))).first()) == ("x y", "l")
    c = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 1, 0.2), (2, 1, 1, 0.5), (2, 2, 1, 0.6)], "s int, stage int, place int, score double")
    assert rows(staged(c, ["s"], "stage", "score"), "s", "stage") == [(1, 1), (2, 1), (2, 2)]
