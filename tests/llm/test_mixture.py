"""The mixture against its definition on small tables."""

import random

import pytest

from chartlake.llm import mixture


def tables(spark, docs, targets):
    return (
        spark.createDataFrame(docs, "doc_id long, source string, n_tokens long, epoch string"),
        spark.createDataFrame(targets, "source string, target_share double, max_repeats int, extra int"),
    )


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 40)
    rnd = random.Random(1)
    docs = [(i, s, rnd.randint(1, 30), "x") for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["small"] * 30 + ["other"] * 50)]
    docs += [(5000, None, 9, "x"), (5001, "big", 0, "x"), (5002, "mid", None, "x")]
    d, t = tables(spark, docs, [("big", 0.5, 1, 0), ("mid", 0.3, None, 0), ("small", 0.1, 5, 0), ("none", 0.1, 9, 0)])
    m, q = mixture.mix_sources(d, t)
    rows = m.collect()
    assert [r.finish_time for r in rows] == sorted(r.finish_time for r in rows)
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)
    report = {r.source: r for r in mixture.shares(m, q).collect()}
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9), ("none", 0.0)):
        assert report[s].actual_share == pytest.approx(share, abs=0.01)
    assert 2 <= max(r.epoch for r in rows if r.source == "small") <= 3 and report["big"].repeats == 1
    size = {i: (s, n) for i, s, n, _ in docs}
    run = {}
    for r in rows:  # the running sum of each source is the finish time times its weight
        run[r.source] = run.get(r.source, 0) + size[r.doc_id][1]
        assert run[r.source] == pytest.approx(r.finish_time * {"big": 5, "mid": 3, "small": 1}[r.source] / 9)
    for s in ("big", "mid", "small"):  # a document is used again only after all others
        uses = [r.epoch for r in rows if r.source == s]
        assert uses == sorted(uses)
    again = [tuple(r) for r in mixture.mix_sources(d.repartition(7), t)[0].collect()]
    assert again == [tuple(r) for r in rows]


def test_budget(spark):
    d, t = tables(spark, [(i, "a", 10, "") for i in range(50)] + [(100 + i, "b", 10, "") for i in range(2)], [("a", 0.5, 1, 0), ("b", 0.5, 2, 0)])
    m, q = mixture.mix_sources(d, t, budget=100.0)
    got = {r.source: r.tokens for r in mixture.shares(m, q).collect()}
    assert got == {"a": 50, "b": 40}


def test_empty(spark):
    d, t = tables(spark, [], [("a", 0.5, 1, 0)])
    m, q = mixture.mix_sources(d, t)
    assert m.count() == 0 and mixture.shares(m, q).first().actual_share == 0
    d, t = tables(spark, [(1, "a", 3, "")], [])
    assert mixture.mix_sources(d, t)[0].count() == 0
