"""Orphan references: match semantics, lateness, defined edge cases."""

from datetime import datetime

import pytest

from chartlake.operators.orphans import orphan_references

ON = [("s", "s"), ("k", "k")]


def refs(spark, rows):
    return spark.createDataFrame(rows, "s string, k string, at timestamp, born string, reason string")


def target(spark, rows):
    return spark.createDataFrame(rows, "s string, k string, born timestamp, extra int")


def keys(df):
    return sorted(((r.s, r.k, r.reason) for r in df.collect()), key=str)


T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def test_masks(spark):
    r = refs(spark, [("a", "1", T1, "", "x"), ("a", None, T1, "", "x"), (None, "1", T1, "", "x"), (None, None, T1, "", "x"), ("z", "9", T1, "", "x"), ("z", None, T1, "", "x"), ("", "", T1, "", "")])
    t = target(spark, [("a", "1", T1, 1), ("a", "1", T1, 2), (None, "9", T1, 3), ("", "", T1, 4)])
    assert keys(orphan_references(r, t, ON)) == [("z", "9", "missing")]
    assert keys(orphan_references(r, t, ON, "partial")) == [("z", "9", "missing"), ("z", None, "missing")]
    assert len(keys(orphan_references(r, t, ON, "full"))) == 4
    with pytest.raises(ValueError):
        orphan_references(r, t, ON, "none")


def test_late(spark):
    r = refs(spark, [("a", "1", T1, "b", ""), ("a", "2", T1, "b", ""), ("a", "1", None, "b", ""), ("a", "1", T1, "b", "")])
    t = target(spark, [("a", "1", T1, 1), ("a", "1", T2, 1), ("a", "2", None, 1)])
    got = orphan_references(r, t, ON, ref_time="at", target_time="born")
    assert keys(got) == [("a", "1", "late"), ("a", "1", "late")]
    assert got.columns == ["s", "k", "at", "born", "reason"]


def test_empty_and_long(spark):
    long = "x" * 100_000
    r = refs(spark, [("a", long, T1, "", "")])
    assert keys(orphan_references(r, target(spark, []), ON)) == [("a", long, "missing")]
    assert keys(orphan_references(r, target(spark, [("a", long, T1, 1)]), ON)) == []
    assert keys(orphan_references(refs(spark, []), target(spark, []), ON)) == []
