"""The report over spans of dates against the report over rows of each date."""

import random
import re
from datetime import datetime

import pytest

import __spark_entry__ as entry
from chartlake import runtime
from chartlake.operators import asof, components, history, inforce, report
from chartlake.plans import charts

GROUPS = ("apple", "melon")
SERIES = ["service", "job_name", "source_variant"]


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def _made(spark, shared):
    rng = random.Random(7)
    make = lambda data, schema: spark.createDataFrame(data, schema)
    facts, at = {}, datetime(2026, 1, 1)
    for service, job in (("apple", "A"), ("apple", "B"), ("melon", "M"), ("ytmusic", "N")):
        for variant in ("x", "y"):
            for period in ("2025-W52", "2026-W01") if job == "B" else [f"2026-01-0{i}" for i in rng.sample(range(1, 8), 5)]:
                for song in rng.sample(range(12), 7):
                    facts[service, job, variant, period, f"s{song}"] = rng.choice([None, 1, 2, 3, 5, 50])
    facts = make([(*k, v) for k, v in facts.items()], "service string, job_name string, source_variant string, period string, song_id string, rank_order int")
    days = asof.report_dates(make([(f"2026-01-0{i}",) for i in range(2, 9)], "chart_date string"))
    # Videos of one identity where titles repeat; a video has several songs and titles.
    names = [None, "", "One", "Two"] if shared else [None, ""]
    bind = make([(s, f"s{i}", f"t{rng.randrange(8)}") for s in ("apple", "melon", "ytmusic") for i in range(11)], "service string, song_id string, track_uid string")
    tracks = make([(f"t{i}", f"v{i // 2}", f"T{i if not shared else i % 3}", rng.choice(["", "P", "Q"]) if shared else f"P{i}", None) for i in range(8)], "track_uid string, canonical_yt_video_id string, yt_title string, yt_artist string, yt_album string")
    meta = [(s, f"s{i}", None, None, rng.choice(names), None, rng.choice(["", "K"]) if shared else None, None, None, None) for s in ("apple", "melon") for i in range(9)]
    meta = make(meta, "service string, song_id string, album_id string, artwork_url string, title_ko string, title_en string, artist_ko string, artist_en string, album_ko string, album_en string")
    jobs = make([("A", "apple", 0.4), ("B", "apple", 0.2), ("M", "melon", 0.4)], "job_name string, hype_group string, hype_weight double")
    old = report.grouped_rows(report.report_rows(facts, days, bind, tracks, meta, jobs))
    raw = facts.selectExpr("service raw_service", "job_name raw_job_name", "source_variant raw_source_variant", "period raw_reference_period", "timestamp'2026-01-01' raw_delivered_at", "song_id", "rank_order")
    heads = raw.select(*inforce.HEAD).distinct().selectExpr("*", *[f"raw_{c} {c}" for c in SERIES], "raw_reference_period period")
    return old, inforce.spans(raw, heads, asof.effective_periods(facts, days, SERIES), bind, tracks, meta, jobs)


@pytest.fixture(scope="module", params=[False, True])
def both(spark, request):
    old, new = _made(spark, request.param)
    assert new.shared == request.param
    return runtime.materialize(old, "old"), new


def test_newest_names(both):
    from pyspark.sql import functions as F

    old, s = both
    r = old.select("chart_date", "video_id", F.col("yt_title").alias("name"), F.col("song_id").alias("title"), F.coalesce("rank_order", F.lit(9999)).alias("hype_rank"))
    want = dict(rows(history.track_fields(r, ["name"]).where("name is not null"), "video_id", "name"))
    got = dict(rows(inforce.newest_names(s), "video_id", "name"))
    # Songs of equal text in two services tie; the order leaves them open.
    open_ = r.where("name <> ''").groupBy("video_id", "chart_date", "hype_rank", "title").agg(F.count_distinct("name").alias("n")).where("n > 1")
    tied = {x.video_id for x in open_.collect()}
    assert want and got.keys() == want.keys() and all(got[v] == want[v] for v in want if v not in tied)


def test_report(both):
    old, s = both
    cols = ("chart_date", "hype_rank", "video_id", "hype_index", "apple_rank", "melon_rank", "title", "artist", "entries")
    for top in (2, 200):
        got = rows(inforce.hype_report(s, GROUPS, top), *cols)
        assert got and got == rows(report.hype_report(old, GROUPS, top=top), *cols)


def test_components(both):
    from pyspark.sql import functions as F

    from chartlake.functions.scoring import rank_score

    old, s = both
    r = old.where("hype_group is not null").groupBy("chart_date", "video_id", "hype_group")
    r = r.agg(F.min("rank_order").alias("best_rank"), F.round(F.max(rank_score(F.col("rank_order")) * F.col("weight")), 6).alias("best_score"), F.count("*").alias("n"))
    assert rows(inforce.components(s), *r.columns) == rows(r, *r.columns) != []


def test_waves(both):
    old, s = both
    cols = ("chart_date", "video_id", "wave", "new_wave")
    assert rows(inforce.waves(s, GROUPS), *cols) == rows(report.wave_flags(report.hype_report(old, GROUPS, top=None)).where("wave"), *cols) != []


def test_rows_in_force_are_not_written(spark, sf):
    held = spark.read.parquet(f"{sf}/playlist_order.parquet").count()
    for name in NOT_WRITTEN:
        before = len(runtime._written)
        entry.queries()[name](spark, sf).count()
        written = [spark.read.parquet(path).count() for _, path in runtime._written[before:]]
        assert written and max(written) <= held, name


NOT_WRITTEN = ("history_first_nonempty", "history_round_trip", "hype_components", "report_digest", "history_compact", "hype_report_top")


def test_what_grows_is_not_broadcast(spark, sf, monkeypatch):
    from pyspark.sql import functions as F

    seen, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(set(df.columns)) or plain(df))
    for name in NOT_BROADCAST:
        query = entry.queries()[name]
        want = sorted(map(tuple, query(spark, sf).collect()), key=str)
        with monkeypatch.context() as m:
            m.setattr(inforce, "SMALL", 0, raising=False)
            seen.clear()
            got = sorted(map(tuple, query(spark, sf).collect()), key=str)
        # Only dates and the line of them are: songs and deliveries grow with the input.
        assert got == want != [] and all(c in ({"day", "chart_date"}, {"dates"}) for c in seen), name


NOT_BROADCAST = ("report_digest", "history_compact", "hype_report_top")


def test_what_grows_is_never_broadcast_by_estimate(spark, sf, monkeypatch):
    """A session that broadcasts by the size of files gets only what does not grow."""
    plans, plain = [], runtime.materialize

    def planned(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    for module in (charts, inforce, report, components):
        monkeypatch.setattr(module, "materialize", planned)
    monkeypatch.setattr(inforce, "SMALL", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for name in NEVER_BROADCAST:
        plans.clear()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        try:
            planned(entry.queries()[name](spark, sf), "out")
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        keys = {re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)}
        # Dates, and the jobs of the configuration.
        assert len(plans) > 5 and keys <= {"day", "chart_date", "job_name"}, (name, keys)


NEVER_BROADCAST = ("history_compact", "hype_report_top")


def test_groups_of_videos_are_never_broadcast_by_estimate(spark, monkeypatch):
    """Videos that share an identity, of which the report of every date has the groups."""
    plans, plain = [], runtime.materialize

    def planned(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, label)

    for module in (inforce, report, components):
        monkeypatch.setattr(module, "materialize", planned)
    monkeypatch.setattr(inforce, "SMALL", -1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        s = _made(spark, True)[1]
        plans.clear()
        planned(inforce.hype_report(s, GROUPS, 200), "out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = {re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p)}
    assert s.shared and len(plans) > 5 and keys <= {"day", "chart_date"}, keys
