"""Scores of candidates, videos, searches and releases; writing batches."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chartlake.functions import scoring as S
from chartlake.operators import candidates as C
from chartlake.operators import ingest as I
from chartlake.operators import merge, resolve
from chartlake.schemas import TABLES, columns

SONG = "id int, titles array<string>, artists array<string>, albums array<string>"
HIT = "id int, candidate int, titles array<string>, artists array<string>, albums array<string>, kind string"


def scored(spark, song, *hits):
    songs = spark.createDataFrame([(1, *song)], SONG)
    cands = spark.createDataFrame([(1, i, *h) for i, h in enumerate(hits)], HIT)
    return {r.candidate: r for r in C.score_candidates(songs, cands, ["id"]).collect()}


def test_marks_are_whole_words(spark):
    song = (["Tree"], ["Long Name"], [])
    got = scored(spark, song, (["Olive Tree"], ["Long Name"], [], "song"), (["Tree stage live"], ["Long Name"], [], "song"), (["Tree discovery"], ["Long Name"], [], "song"), (["Tree karaoke"], ["Long Name"], [], "song"))
    plain = lambda i: got[i].score / got[i].title_score / got[i].artist_score
    assert plain(0) == pytest.approx(1.0) and plain(2) == pytest.approx(1.0)
    assert got[1].score == 0 or plain(1) == pytest.approx(0.5)
    assert got[3].score == 0  # a version word makes another recording


def test_factors(spark):
    song = (["Night"], ["Kim & Lee Band"], ["Days"])
    got = scored(
        spark, song,
        (["Night"], ["Kim", "Lee Band"], ["Days"], "song"), (["Night"], ["Kim", "Lee Band"], [], "song"), (["Night"], ["Kim", "Lee Band"], ["Days"], "video"),
        (["Night"], ["Kim"], ["Days"], "song"), (["Night"], ["Kim", "Lee Band", "Park"], ["Days"], "song"), (["Night (cover)"], ["Kim", "Lee Band"], ["Days"], "song"),
        (["Night"], ["Kim", "Lee Band"], ["Night"], "song"), (["Night (with Strange Guest)"], ["Kim", "Lee Band"], ["Days"], "song"), (["Night"], [], ["Days"], "song"),
    )
    full = got[0].score
    assert got[0].title_score == got[0].artist_score == got[0].album_score == 1.0 and full == pytest.approx(1.0)
    assert got[1].score == pytest.approx(0.9) and got[2].score == pytest.approx(0.9)
    assert got[3].score == pytest.approx(0.75) and got[4].score == pytest.approx(0.7)
    assert got[5].score == 0 and got[5].title_score == 0 and got[5].album_score == 1.0
    assert got[6].album_score == pytest.approx(0.9) and got[6].score == pytest.approx(0.97)
    assert got[7].score == pytest.approx(got[7].title_score * 0.5)
    assert got[8].score == 0 and got[8].artist_score == 0


def test_views_short_artists_and_missing_names(spark):
    got = scored(spark, (["노래", "Song"], ["가나", "Gana"], []), (["Song"], ["Gana"], [], "song"), (["노래"], ["가나"], [], "song"), (["Song"], ["Gand"], [], "song"))
    assert got[0].score == pytest.approx(1.0) and got[1].score == pytest.approx(1.0)
    assert got[2].score == pytest.approx(got[2].artist_score * 0.1 * 0.5 * 0.7)
    alone = scored(spark, (["Song"], [None, ""], ["Al"]), (["Song"], ["Any"], [], "video"), ([None], None, None, None))
    assert alone[0].score == pytest.approx(0.9) and alone[0].artist_score == 0 and alone[1].score == 0
    assert scored(spark, ([], [], []), (["Song"], ["Any"], [], "song"))[0].score == 0


def test_videos(spark):
    v = spark.createDataFrame([(1, "v1", "Song (Official Video)", "Artist"), (2, "v2", "[MV]", "Artist"), (3, "v3", "Else", ""), (4, "v4", "Song", "Artist")], "id int, video_id string, title string, artist string")
    c = spark.createDataFrame(
        [(1, 1, "c1", ["Song"], ["Artist"], "", "song"), (1, 2, "c2", ["Song"], ["Artist"], "", "video"), (3, 1, "c3", ["Other thing"], ["No"], "", "song"), (4, 1, "v4", ["Song"], ["Artist"], "stage", "song"), (4, 2, "c5", ["Song (Remix)"], ["Artist"], "", "song")],
        "id int, place int, video_id string, titles array<string>, artists array<string>, album string, kind string",
    )
    got = {r.id: r for r in C.resolve_videos(v, c, ["id"]).collect()}
    assert (got[1].resolved_video_id, got[1].mapping_status, got[1].mapping_score) == ("c1", "resolved_to_song", 1.05)
    assert (got[2].resolved_video_id, got[2].mapping_status, got[2].mapping_score) == ("v2", "kept_original_video", 1.0)
    assert got[3].resolved_video_id == "v3" and got[3].mapping_status == "kept_original_video"
    assert got[4].mapping_status == "already_song" and got[4].mapping_score == 0.8


def test_searches_and_titles(spark):
    r = spark.createDataFrame([("s", 1, 1, 0.5, 0.9, 0.9), ("s", 2, 2, 0.7, 0.9, 0.9), ("s", 2, 3, 0.8, 0.9, 0.9), ("s", 3, 4, 0.99, 0.9, 0.9), ("t", 1, 5, 0.1, 0.1, 0.1)], "k string, q int, n int, score double, title_score double, artist_score double")
    assert [(x.k, x.n) for x in C.first_passing(r, ["k"], "q", "n").collect()] == [("s", 3)]
    p = spark.createDataFrame([(["Song", None], "Song"), (["Song"], "Song (Remix)"), (["Song"], "Other"), ([], "x"), (["a"], None)], "names array<string>, t string")
    assert [x.verified for x in C.verify_titles(p, "names", "t").orderBy(F.col("t").isNull(), F.size("names") == 0, F.desc("t")).collect()] == [False, True, False, True, True]


def test_releases(spark):
    d = spark.createDataFrame([("song", "Album", "Official", []), ("song", "Album", "Bootleg", []), ("song", "Single", "Official", ["Live"]), ("song live", "EP", "Official", None), ("song deluxe", "EP", "Official", None), ("", "Album", "Official", [])], "t string, k string, s string, o array<string>")
    got = [r[0] for r in d.select(S.release_score(F.col("t"), F.lit("song"), F.col("k"), F.lit("KR"), F.col("s"), F.col("o"))).collect()]
    assert got == pytest.approx([0.75, -1, -1, -1, 0.45, -1])
    ranks = spark.createDataFrame([(1.0,), (2.5,), (0.0,), (None,)], "r double")
    assert [round(r[0], 4) for r in ranks.select(S.rank_score(F.col("r"))).collect()] == [100.0, 0.0, 0.0, 0.0]


def test_rules_cover_declared_columns():
    for name, (keys, rules) in merge.TABLES.items():
        for end in ("_rebind", "_canonical", "_keep"):
            name = name.removesuffix(end)
        assert {*keys, *rules} == set(columns(TABLES[name])), name
    assert columns("a map<string,int>, b struct<x:int,y:array<int>>") == ["a", "b"]


def store(spark):
    rows = {
        "tracks": [("u1", "v1", "Song", "A", "", "matched", 0.9, datetime(2025, 1, 1), datetime(2025, 1, 1)), ("u2", None, None, None, None, "unmatched", 0.0, None, None)],
        "platform_song_ids": [("melon", "1", "u1", None), ("apple", "2", "u2", None)],
        "track_list": [("melon", "1", "", "노래", "가", "", "", "", "", "")],
        "playlist_order": [("melon", "J", "default", "2026-01-01", "9", 1, None), ("melon", "J", "default", "2025-12-31", "9", 1, None)],
        "metadata_lookup_index": [("song|a", "u1", "x", 0.9)], "manual_overrides": [], "review_conflicts": [],
    }
    order = {"track_list": columns(TABLES["track_list"])}
    return {n: spark.createDataFrame(r, TABLES[n]).select(*order.get(n, ["*"])) for n, r in rows.items()}


def test_ingest(spark):
    s = store(spark)
    batch = spark.createDataFrame([("Melon", "1", 1, "노래", "가"), ("melon", "7", 2, "새 노래", "나"), ("melon", None, 3, "무", "나"), ("melon", "7", 5, "새 노래", "나")], "service string, song_id string, rank int, title string, artist string")
    now = F.lit("2026-01-02").cast("timestamp")
    once = I.ingest(batch, "J", "2026-01-01", s, now)
    bound = {(r.service, r.song_id): r.track_uid for r in once["platform_song_ids"].collect()}
    assert bound["melon", "1"] == "u1" and bound["melon", "7"].startswith("trk_") and len(bound) == 3
    ranks = {(r.reference_period, r.song_id, r.rank_order) for r in once["playlist_order"].collect()}
    assert ranks == {("2025-12-31", "9", 1), ("2026-01-01", "1", 1), ("2026-01-01", "7", 2)}
    status = {r.track_uid: r.match_status for r in once["tracks"].collect()}
    assert status["u1"] == "matched" and status[bound["melon", "7"]] == "unmatched" and len(status) == 4
    names = {r.song_id: r for r in once["track_list"].collect()}
    assert names["7"].title_ko == "새 노래" and names["7"].title_en == ""
    twice = I.ingest(batch, "J", "2026-01-01", once, now)
    for n in ("tracks", "platform_song_ids", "track_list", "playlist_order"):
        assert sorted(map(str, twice[n].collect())) == sorted(map(str, once[n].collect()))
    with pytest.raises(Exception, match="expected 9 rows"):
        I.ingest(batch, "J", "2026-01-01", s, now, expected=9)["playlist_order"].collect()
    assert I.ingest(batch.limit(0), "J", "2026-01-01", s, now)["tracks"].count() == 2


def test_upsert_matches(spark):
    s = store(spark)
    ddl = "service string, song_id string, title string, artist string, album string, video_id string, yt_title string, yt_artist string, yt_album string, status string, score double"
    batch = spark.createDataFrame([
        ("melon", "1", "Song", "A", "", "v9", "Song", "A", "", "matched", 0.8),   # bound to u1, which has another video
        ("apple", "2", "Song", "A", "", "v1", "Song", "A", "", "matched", 0.7),   # bound to an entity without a video
        ("apple", "3", "노래!", "A", "", None, None, None, None, "failed", None),
        ("spotify", "4", "Song", "A", "", None, None, None, None, "matched", 0.6),  # by metadata, but the entity's names differ
    ], ddl)
    out = I.upsert_matches(batch, s, F.lit("2026-01-02").cast("timestamp"))
    bound = {(r.service, r.song_id): r.track_uid for r in out["platform_song_ids"].collect()}
    assert bound["melon", "1"] == "u1" and bound["apple", "2"] == "u1" and ("apple", "3") not in bound and bound["spotify", "4"] not in ("u1", "u2")
    tracks = {r.track_uid: r for r in out["tracks"].collect()}
    assert tracks["u1"].canonical_yt_video_id == "v1" and tracks["u1"].best_score == 0.9
    assert sum(r.match_status == "failed" for r in tracks.values()) == 1
    assert [(r.song_id, r.reason, r.other) for r in out["review_conflicts"].collect()] == [("1", "same_track_uid_different_video", "v1")]
    assert {r.lookup_key for r in out["metadata_lookup_index"].collect()} >= {"song|a", "song|a|"}


def test_repairs(spark):
    m = spark.createDataFrame([("v", "a", False, 0.9), ("v", "b", True, 0.1), ("w", "c", None, 0.2), ("w", "d", None, 0.3)], "v string, track_uid string, indexed boolean, best_score double").withColumn("created_at", F.lit(None).cast("timestamp"))
    assert sorted(map(tuple, resolve.winners(m, "v", resolve.indexed_order()).collect())) == [("a", "b"), ("c", "d")]
    for kind, want in (("yt_video_ids", "old"), ("yt_video_ids_rebind", "new"), ("yt_video_ids_keep", "old")):
        keys, rules = merge.TABLES[kind]
        old = spark.createDataFrame([("v", "old", 0)], TABLES["yt_video_ids"])
        new = spark.createDataFrame([("v", "new", 1)], TABLES["yt_video_ids"])
        got = merge.merge(old, new, keys, rules, ["track_uid"]).first()
        assert got.track_uid == want and got.is_canonical == (0 if kind.endswith("keep") else 1)


def test_pairs_are_scored_where_they_meet(spark, sf):
    import __spark_entry__ as entry
    from chartlake import runtime

    before = len(runtime._written)
    df = entry.queries()["candidate_scores"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # No pair is written, and one join is all: names are not measured beside the pairs and joined back.
    assert df.count() > 0 and len(runtime._written) == before and plan.count("Join ") == 1


def test_pair_values(spark):
    from pyspark.sql import functions as F

    from chartlake.functions.similarity import name_forms, pair_values, similarity
    from chartlake.operators.candidates import _forms_crossed

    names = ["Sun", "sun", "Sun Rise", "Sun (feat. A)", "Sun 2", "Sun 3 (Explicit)", "(Explicit)", "Ｓｕｎ", "태양", "태양의 밤", " ", "Topic - Topic", "Sun - Live"]
    one = spark.createDataFrame([(names, names)], "xs array<string>, ys array<string>")
    for title in (True, False):
        forms = one.select(name_forms(F.col("xs"), title).alias("f"), name_forms(F.col("ys"), title).alias("g"))
        got = forms.select(_forms_crossed("k", F.col("f"), F.col("g"), title).alias("p")).select(F.inline(pair_values(F.col("p")))).select("x", "y", "value")
        each = one.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
        want = each.select("x", "y", similarity(F.col("x"), F.col("y"), title).alias("value"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
