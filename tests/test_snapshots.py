"""Snapshot changes against a brute-force version."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chartlake.functions.periods import compact_period, period_code, period_label
from chartlake.operators.snapshots import snapshot_changes

SCHEMA = "a string, b string, period string, k string, v int, w string, at timestamp, change string, n int"


def brute(rows):
    """Rows (a, b, period, k, change) by plain loops."""
    def place(p):
        p = p.upper().replace("-", "").replace(".", "")
        if len(p) == 8:
            return datetime.strptime(p, "%Y%m%d"), 0
        return datetime.strptime(f"{p[:4]}-{p[5:]}-1", "%G-%V-%u"), 1

    def name(x):
        day, week = x
        return day.strftime("%G-W%V") if week else day.strftime("%Y-%m-%d")

    low = datetime(1, 1, 1)
    snaps = {}
    for a, b, p, k, v, w, at, *_ in rows:
        if p is None:
            continue
        snaps.setdefault((a, b), {}).setdefault(place(p), {}).setdefault(at or low, {})[k] = (v, w)
    out = set()
    for (a, b), periods in snaps.items():
        before = None
        for p in sorted(periods):
            now = periods[p][max(periods[p])]
            if before is not None:
                out |= {(a, b, name(p), k, "added") for k in now if k not in before}
                out |= {(a, b, name(p), k, "removed") for k in before if k not in now}
                out |= {(a, b, name(p), k, "changed") for k in now if k in before and now[k] != before[k]}
            before = now
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("period", compact_period(F.col("period")))
    out = snapshot_changes(df, ["a", "b"], ["k"], ["v", "w"], "period", "at", period_code, period_label, **kw)
    assert out.columns == ["a", "b", "period", "k", "change"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("how", [{"broadcast_rows": 0}, {"broadcast_rows": 1000}, {"hot_rows": 60}, {"hot_rows": 7}])
def test_random(spark, how):
    rnd = random.Random(3)
    rows = []
    for a in ("x", None, ""):
        for day in range(6):
            if rnd.random() < 0.2:
                continue
            for again in range(rnd.choice([1, 1, 2])):
                at = datetime(2026, 1, 5) + timedelta(days=day, hours=again)
                text = (datetime(2026, 1, 5) + timedelta(days=day)).strftime(rnd.choice(["%Y-%m-%d", "%Y%m%d", "%Y.%m.%d"]))
                for k in ("k1", "k2", "", None, "k" * 5000, "\u00e9", "e\u0301"):
                    if rnd.random() < 0.7:
                        row = (a, "b", text, k, rnd.choice([1, 2, None]), rnd.choice(["", None, "q"]), at, "clash", 1)
                        rows += [row] * rnd.choice([1, 1, 2])
        rows.append((a, "b", "2026-W03", "k1", 1, None, datetime(2026, 1, 20), "clash", 1))
        rows.append((a, "b", "2026w04", "k1", 2, None, None, "clash", 1))
    rows.append(("x", "b", "no period", "k1", 1, None, datetime(2026, 2, 1), None, None))
    want = brute([r for r in rows if r[2] != "no period"])
    assert run(spark, rows, **how) == want
    assert {"added", "removed", "changed"} == {r[4] for r in want}


def test_buckets_in_a_task(monkeypatch):
    """Splitting a task's rows by key changes nothing."""
    import numpy as np
    import pyarrow as pa

    from chartlake.operators import snapshots as S

    rng = np.random.default_rng(1)
    n = 5000
    series = rng.integers(0, 3, n)
    key = rng.integers(-400, 400, n) * 1_234_567_891 + series
    packed = rng.integers(-3, 3, n) << 32 | rng.integers(0, 9, n) * 2
    arrays = [series, key, packed, rng.integers(0, 2, n), rng.integers(0, 3, n), np.ones(n, bool)]
    batch = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=list("abcdef"))
    whole = sorted(r for b in S._compare(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns)))
    monkeypatch.setattr(S, "TASK_ROWS", 300)
    parts = sorted(r for b in S._compare(iter([batch, batch.slice(0, 0)])) for r in zip(*(c.to_pylist() for c in b.columns)))
    assert whole == parts and len(whole) > 1000
    assert list(S._compare(iter([]))) == []


def test_empty_and_single(spark):
    assert run(spark, []) == set()
    assert run(spark, [("a", "b", "2026-01-01", "k", 1, None, datetime(2026, 1, 1), None, 1)]) == set()


def test_late_redelivery_replaces_whole_snapshot(spark):
    t = datetime(2026, 1, 1)
    rows = [
        ("a", "b", "2026-01-01", "k1", 1, "", t, None, 1),
        ("a", "b", "2026-01-02", "k1", 1, "", t, None, 1),
        ("a", "b", "2026-01-02", "k2", 2, "", t, None, 1),
        ("a", "b", "2026-01-02", "k1", 1, "", t + timedelta(days=9), None, 1),
    ]
    assert run(spark, rows) == set()
