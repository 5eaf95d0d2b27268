"""Deliveries of streams, long chains of pages, CSV records, and the shared folder."""

import json
from datetime import datetime
from types import SimpleNamespace

import pytest

from chartlake import runtime
from chartlake.sources import charts, paged
from chartlake.streaming import charts as stream

SCHEMA = "period string, song string, delivered timestamp"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    s = stream.read_stream(spark, str(folder / "in"), SCHEMA)
    stream.write_snapshots(s, str(folder / "out"), ["period"], "delivered", str(folder / "ck")).awaitTermination()
    return sorted((r.period, r.song) for r in spark.read.schema(SCHEMA).parquet(str(folder / "out")).collect())


def test_an_older_delivery_in_a_later_batch(spark, tmp_path):
    new, old = datetime(2026, 1, 9), datetime(2026, 1, 2)
    assert deliver(spark, tmp_path, [("p1", "a", new), ("p1", "b", new), ("p1", "z", old)]) == [("p1", "a"), ("p1", "b")]
    got = deliver(spark, tmp_path, [("p1", "late", old), ("p2", "c", old)])
    assert got == [("p1", "a"), ("p1", "b"), ("p2", "c")]
    assert deliver(spark, tmp_path, [("p2", "d", new)]) == [("p1", "a"), ("p1", "b"), ("p2", "d")]


def test_long_chains_of_pages(tmp_path):
    for i in range(1200):
        body = {"n": i} | ({"next": f"p{i + 1}"} if i < 1199 else {})
        (tmp_path / f"{'first' if i == 0 else f'p{i}'}.json").write_text(json.dumps(body))
    read = lambda **o: list(paged.PagedReader({"pages": str(tmp_path), **o}).read(SimpleNamespace(value="first")))
    assert len(read()) == 1200
    with pytest.raises(ValueError, match="more than 7 pages"):
        read(most_pages="7")


def test_quoted_line_ends(spark):
    text = 'Rank,Track Name,Artist Names,YouTube URL\r\n1,"a\nb",x,https://w.example/watch?v=v1\r\n,c,y,https://w.example/watch?v=v2\r\n'
    got = charts.parse_csv(spark.createDataFrame([("u", text), ("e", ""), ("n", None)], "url string, text string"))
    assert sorted((r["rank"], r.title, r.item_id) for r in got.collect()) == [(1, "a\nb", "v1"), (2, "c", "v2")]


def test_shared_folder(spark):
    conf = SimpleNamespace(get=lambda k, d=None: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(cluster)
    kept = runtime.materialize(spark.range(3), "test")
    path = runtime._written[-1][1].removeprefix("file:")
    assert kept.count() == 3 and runtime.release() > 0
    import os

    assert not os.path.exists(path)
