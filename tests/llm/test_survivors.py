"""Groups of duplicates and their surviving records."""

from datetime import datetime

from pyspark.sql import functions as F

from chartlake.llm import survivors as V

SCHEMA = "track_uid string, video string, title string, status string, score double, at timestamp, group_id string"
T = [datetime(2024, 1, 1), datetime(2026, 1, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_video_id(spark):
    cases = {"abc-_123456": "abc-_123456", " abc ": "abc", "https://w.example/watch?list=P&v=abc": "abc", "https://s.example/abc?si=1": "abc", "https://w.example/watch?v=abc#t": "abc", "": None, " ": None, None: None}
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    assert [r.v for r in df.select("i", V.video_id(F.col("c")).alias("v")).orderBy("i").collect()] == list(cases.values())


def test_groups(spark):
    rows = [("a", "v1", "t1", None, None, None, "old"), ("b", "v1", None, None, None, None, ""), ("c", None, "T 1", None, None, None, ""), ("d", "v2", "t2", None, None, None, ""), ("e", None, None, None, None, None, ""), ("a", "v1", "t1", None, None, None, "")]
    g = V.duplicate_groups(frame(spark, rows), "track_uid", {"video": F.col("video"), "title": V.tight(F.col("title"))})
    of = {r.track_uid: r.group_id for r in g.collect()}
    assert of["a"] == of["b"] == of["c"] and len({of["a"], of["d"], of["e"]}) == 3 and g.count() == 6
    assert V.duplicate_groups(frame(spark, []), "track_uid", {"video": F.col("video")}).count() == 0


def best(spark, rows):
    df = frame(spark, rows)
    fields = {"video": F.nullif(F.trim("video"), F.lit("")), "title": V.tight(F.col("title")), "status": F.lower("status")}
    return {r.group_id: r for r in V.best_records(df, "track_uid", fields, F.col("score"), "at").collect()}


def test_votes(spark):
    got = best(spark, [
        ("a", "", "One", "x", 1.0, T[0], "g"), ("b", "v1", "Two", "X", 1.0, T[1], "g"), ("c", None, " two", None, 0.1, T[1], "g"),
        ("d", "v9", "", None, None, None, "h"), ("e", "v8", None, None, -1.0, T[1], "h"), ("f", None, None, None, 1.0, T[1], None),
    ])
    g = got["g"]
    assert (g.members, g.video, g.title, g.status) == (3, "v1", "Two", "X")
    assert got["h"].video in ("v8", "v9") and got["h"].title is None
    assert got[None].members == 1 and got[None].video is None
    assert best(spark, []) == {}


def test_many_small_votes_beat_one(spark):
    rows = [("a", "v1", "A", None, 2.0, T[1], "g")] + [(f"b{i}", "v2", "b " * (1 + i % 2), None, 0.5, T[1], "g") for i in range(6)]
    got = best(spark, rows)["g"]
    assert got.video == "v2" and got.members == 7


def test_trust_and_half_life_decide(spark):
    rows = [("a", "v1", None, None, 2.0, T[0], "g"), ("b", "v2", None, None, 1.0, T[1], "g")]
    df = frame(spark, rows)
    fields = {"video": F.col("video")}
    pick = lambda trust, half: V.best_records(df, "track_uid", fields, trust, "at", half_life=half).first().video
    assert pick(F.col("score"), 180.0) == "v2" and pick(F.col("score"), 5000.0) == "v1" and pick(F.col("score") * F.col("score"), 730.0) == "v1"
    most = lambda half: [r.track_uid for r in V.strongest_members(df, "track_uid", fields, F.col("score"), "at", half_life=half).collect()]
    assert most(180.0) == ["b"] and most(5000.0) == ["a"]


def test_strongest_members(spark):
    rows = [
        ("a", "v", "t", None, 1.0, T[1], "g"), ("b", "w", "u", None, 1.0, T[1], "g"), ("c", "v", None, None, 1.0, T[1], "g"), ("a", "v", "t", None, 1.0, T[1], "h"),
        ("d", None, None, None, 1.0, T[1], "n"), ("e", None, None, None, None, None, "n"), ("f", "v", None, None, 1.0, T[1], None),
    ]
    got = V.strongest_members(frame(spark, rows), "track_uid", {"video": F.col("video"), "title": F.col("title")}, F.col("score"), "at")
    assert sorted((str(r.group_id), r.track_uid) for r in got.collect()) == [("None", "f"), ("g", "a"), ("g", "b"), ("h", "a"), ("n", "d"), ("n", "e")]
    assert V.strongest_members(frame(spark, []), "track_uid", {"video": F.col("video")}, F.col("score"), "at").count() == 0


def test_case_of_word_ends(spark):
    df = spark.createDataFrame([("νύχτας δρόμος",), ("ΝΎΧΤΑΣ  ΔΡΌΜΟΣ",), ("Νύχτας Δρόμος",)], "x string")
    assert len({r[0] for r in df.select(V.tight(F.col("x"))).collect()}) == 1
