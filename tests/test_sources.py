"""Parsers, configuration, schemas, the paged source and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chartlake import config, schemas
from chartlake.sources import charts as C
from chartlake.sources import paged, store
from chartlake.streaming import charts as stream


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def docs(spark, *texts, name="text"):
    return spark.createDataFrame([(f"https://p.example/{i}", t) for i, t in enumerate(texts)], f"url string, {name} string")


def test_csv(spark):
    text = '﻿Rank,Track Name,Artist Names,YouTube URL,Views\n1,"A, b",X,https://y/watch?v=v1,10\n,C,Y,https://y/watch?v=v2,x\n3,D,Z,,\n'
    got = C.parse_csv(docs(spark, text, "", None, "Title,URL\nT,https://y/watch?v=v9"))
    assert rows(got, "rank", "item_id", "title", "views") == [(1, "v1", "A, b", 10), (1, "v9", "T", None), (2, "v2", "C", None)]
    assert C.parse_csv(docs(spark, text), limit=1).count() == 1
    assert rows(docs(spark, text, "x", None).select(C.looks_like_csv(F.col("text")).alias("c")), "c") == [(False,), (False,), (True,)]


def test_urls(spark):
    html = """<a href="/x/download?id=1\\u0026b=2"> <a href='https://q.example/a.csv?z=1'> <a href="/x/download?id=1\\u0026b=2"> <a href="/no">"""
    assert rows(C.find_csv_urls(docs(spark, html)), "csv_url") == [("https://p.example/x/download?id=1&b=2",), ("https://q.example/a.csv?z=1",)]


def test_json(spark):
    page = '<script>ytInitialData = {"a": {"trackViews": [1]}};</script> window.__data = {bad}; ytcfg.set({"k": 1});'
    assert rows(C.page_json(docs(spark, page)), "json") == [('{"a": {"trackViews": [1]}}',)]
    assert C.page_json(docs(spark, page), patterns=(C.PAGE_CONFIG,)).first().json == '{"k": 1}'
    deep = "[" * 500 + '{"q": 1}' + "]" * 500
    got = C.walk_json(docs(spark, '{"a": [{"q": 2}, {"b": {"q": 3}}]}', deep, "{", None, name="json"), wanted=["q"])
    assert rows(got, "pos", "object") == [(0, '{"q": 1}'), (1, '{"q": 2}'), (3, '{"q": 3}')]


def test_chart_views(spark):
    views = [
        {"encryptedVideoId": "a", "name": "A", "artists": [{"name": "x"}, {"name": "y"}], "chartEntryMetadata": {"currentPosition": 2, "previousPosition": 5}, "thumbnail": {"thumbnails": [{"url": "s", "width": 1, "height": 1}, {"url": "b", "width": 9, "height": 9}, {"url": "c", "width": 9, "height": 9}]}},
        {"videoId": "b", "name": "B"}, {"name": "no id"}, {"encryptedVideoId": "a", "name": "again"}, {"videoId": "c", "name": "C", "chartEntryMetadata": {"currentPosition": 1}},
    ]
    d = docs(spark, json.dumps({"x": [{"trackViews": views, "chartParams": {"endDate": "20260101"}}], "availableChartsInfo": [{"latestEndDate": "20260108"}]}), name="json")
    assert rows(C.chart_views(d), "rank", "item_id", "artist", "previous_rank", "artwork_url") == [(1, "c", None, None, ""), (2, "a", "x, y", 5, "b"), (2, "b", None, None, "")]
    assert C.chart_views(d, limit=2).count() == 2
    assert C.chart_period(d).first().period_end == "20260101"


def test_balanced(spark):
    assert C.balanced_object('x {"a": "}\\"{", "b": {}} y') == '{"a": "}\\"{", "b": {}}'
    assert C.balanced_object('{"a": 1') is None and C.balanced_object("none") is None
    t = '[{"k":"item","n":1},{"k":"item","n":{"z":2}},{"k":"item","n":'
    assert [json.loads(r.json)["n"] for r in C.embedded_objects(docs(spark, t, "", None), '"k":"item"').orderBy("pos").collect()] == [1, {"z": 2}]


def test_html(spark):
    html = """<table id="tb"><tbody><tr data-song-no="7"><td class="rank01"><span class="none">no</span><a>T &amp; u</a></td><td class="rank02"><br>Ar<b>t</b></td></tr>
    <tr><td class="rank01">Second</td><td><a data-song-no="8">x</a></td></tr></tbody></table>"""
    got = C.parse_html_rows(docs(spark, html, "", None, "<tr><td class='rank01'>open"), "tr", {"title": ["rank01"], "artist": ["rank02"]}, {"song_id": ["data-song-no"]})
    assert rows(got, "pos", "title", "artist", "song_id") == [(0, "T & u", "Art", "7"), (0, "open", None, None), (1, "Second", None, "8")]
    li = '<ul><li class="item" d-songid="1"><p class="name">A</p></li><li class="item" d-songid="2"><p class="name">B</p></li></ul>'
    assert rows(C.parse_html_rows(docs(spark, li), "item", {"title": ["name"]}, {"id": ["d-songid"]}), "id", "title") == [("1", "A"), ("2", "B")]
    ld = '<script type="application/ld+json">{"track": [{"name": "N", "url": "u", "byArtist": {"name": "B"}}]}</script>'
    assert rows(C.ld_tracks(docs(spark, ld, "x")), "rank", "title", "artist") == [(1, "N", "B")]


def test_fallback(spark):
    a = spark.createDataFrame([("u1", "x")], "url string, item string")
    b = spark.createDataFrame([("u1", "y"), ("u2", "z")], "url string, item string")
    assert rows(C.fallback_chain([a, b]), "url", "item", "strategy_no") == [("u1", "x", 1), ("u2", "z", 2)]


def test_paged(spark, tmp_path):
    (tmp_path / "first.json").write_text(json.dumps({"data": [{"id": "1", "attributes": {"name": "A"}}], "next": "second"}))
    (tmp_path / "second.json").write_text(json.dumps({"data": [{"id": "2", "attributes": {"name": "B"}}], "next": "first"}))
    paged.register(spark)
    p = spark.read.format("pagedjson").option("pages", str(tmp_path)).load()
    assert rows(C.catalog_page(p), "song_id", "title") == [("1", "A"), ("2", "B")]


def test_config(spark, tmp_path):
    f = tmp_path / "jobs.json"
    f.write_text(json.dumps([
        {"job_name": "a", "include_in_hype": True, "hype_group": "apple", "hype_weight": 0, "source_urls": ["u", {"gen": 10, "url": "v"}]},
        {"job_name": "b", "include_in_hype": True, "hype_weight": 0.5}, {"job_name": "c", "schedule": "Friday", "frequency": "weekly", "list_type": "chart"},
    ]))
    jobs = config.load_jobs(spark, str(f))
    assert rows(config.weighted_jobs(jobs), "job_name", "hype_group", "hype_weight") == [("a", "apple", 0.4), ("b", None, 0.5)]
    assert config.load_jobs(spark, str(tmp_path / "none.json")).count() == 0
    due = lambda day: {r.job_name for r in config.due_jobs(jobs, day).collect()}
    assert "c" in due("2026-11-29") and "c" not in due("2026-11-30")
    g = tmp_path / "alias.json"
    g.write_text(json.dumps({"artists": [["A b", "가"], ["가", "C"]], "titles": [], "albums": [], "overrides": {"T!|A b": "vid"}}))
    got = {(r.kind, r.key): r.variants for r in config.load_aliases(spark, str(g)).collect()}
    assert got[("artists", "가")] == ["A b", "C", "가"] and got[("override", "t|a b")] == ["vid"]


def test_schemas(spark, tmp_path):
    assert len(schemas.create_all(spark, str(tmp_path))) == len(schemas.TABLES)
    assert schemas.create_all(spark, str(tmp_path)) == []
    t = store.read_table(spark, str(tmp_path), "tracks")
    assert schemas.same_columns(t, schemas.TABLES["tracks"]) and t.count() == 0
    c = schemas.conform(spark.createDataFrame([("1", "x")], "vid string, junk string"), "video_id int, track_uid string", {"vid": "video_id"})
    assert rows(c, "video_id", "track_uid") == [(1, None)]
    ok = spark.createDataFrame([("k", '["a"]')], "k string, names string")
    assert store.checked_copy(ok, ["k"], ["names"]).count() == 1
    with pytest.raises(Exception, match="empty key"):
        store.checked_copy(spark.createDataFrame([("", '["a"]')], "k string, names string"), ["k"], ["names"]).collect()


def test_streams(spark, tmp_path):
    ddl = "service string, period string, song_id string, rank_order int, at timestamp"
    t = datetime(2026, 1, 1)
    data = [("s", "p1", "a", 1, t), ("s", "p1", "b", 2, t), ("s", "p1", "c", 1, datetime(2026, 1, 2)), ("s", "p2", "a", 1, t), ("s", "p2", "a", 1, t)]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, ddl).coalesce(1).write.parquet(src)
    q = stream.write_snapshots(stream.read_stream(spark, src, ddl), str(tmp_path / "out"), ["service", "period"], "at", str(tmp_path / "cp"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).distinct(), "period", "song_id") == [("p1", "c"), ("p2", "a")]
    for name, df in (("dedup", stream.first_deliveries(stream.read_stream(spark, src, ddl), ["period", "song_id"], "at")), ("win", stream.windowed_counts(stream.read_stream(spark, src, ddl), ["service"], "at"))):
        q = stream.to_table(df, name, "append" if name == "dedup" else "complete")
        q.awaitTermination()
    assert spark.table("dedup").count() == 4
    assert sorted(r["rows"] for r in spark.table("win").collect()) == [1, 4]
