"""The abuse classifier: disguises, held-out accuracy, windows, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chartlake.llm import abuse as A
from chartlake.llm.codepoints import from_codepoints, offsets_of, to_codepoints

GOOD = ["The chorus on {} sounds warm.", "{} moved from 3 to 9 this week.", "I have played {} about 40 times.", "That drum fill by {} kills, damn!", "The crawl of {} returned 50 rows.", "{} 정말 좋아요."]
BAD = ["You are a worthless idiot, {}.", "Shut up {}, you stupid pig.", "All {} people are vermin.", "I hope {} gets beaten up.", "{} 꺼져 이 벌레야."]


def plain(text):
    cps, offs = to_codepoints(pa.array([text]))
    x, rows = A.plain(cps, offs)
    return from_codepoints(x, offsets_of(rows, 1)).to_pylist()[0]


def test_disguises():
    for text in ("stupid", "STUPID", "stup1d", "s.t.u.p.i.d", "st​upid", "ѕtupid", "ｓtupid", "$tup!d", "stu-pid"):
        assert plain(text) == "stupid", text
    assert plain("새.끼") == "새끼" and plain("d*****s") == "d*s" and plain("wooooow") == "woow"
    assert plain("rank 11 at 2026") == "rank 11 at 2026"


def corpus(n, seed, wrong=0.0):
    rnd = random.Random(seed)
    texts, y = [], []
    for _ in range(n):
        bad = rnd.random() < 0.3
        parts = [rnd.choice(GOOD).format(rnd.choice(["Rain", "Lamp", "Fésk", "빛"])) for _ in range(rnd.randint(1, 12))]
        if bad:
            s = rnd.choice(BAD).format(rnd.choice(["Rain", "Moun", "Tip"]))
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice([s, s.upper(), s.replace("i", "1")]))
        texts.append(" ".join(parts))
        y.append(bad != (rnd.random() < wrong))
    return texts, np.array(y)


def test_held_out():
    model = A.train(*corpus(500, 1, wrong=0.05))
    texts, y = corpus(600, 2)
    p = model.probability(pa.array([*texts, None, "", " "]))
    assert ((p[:-3] >= 0.9) == y).mean() >= 0.97
    assert (p[-3:] < 0.5).all()
    long = " ".join(texts[i] for i in np.flatnonzero(~y)) * 3
    assert model.probability(pa.array([long]))[0] < 0.5 and model.probability(pa.array([long + " Shut up Tip, you stupid pig. " + long]))[0] > 0.9


def test_one_label_or_none():
    for y in ([True] * 3, [False] * 3):
        assert (A.train(["a b c", "d", ""], np.array(y)).probability(pa.array(["a b c", None])) < 0.5).all()
    assert (A.train([], np.zeros(0)).probability(pa.array(["x"])) < 0.5).all()


def test_frames(spark):
    texts, y = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, "old") for i, t in enumerate(texts)] + [(900, None, "s", ""), (901, "", "s", "")], "doc_id long, text string, source string, abuse string")
    rows = [(i, "a", int(v)) for i, v in enumerate(y)] + [(0, "b", None), (1, "b", 7), (None, "a", 1), (900, "a", 1), (12345, "a", 1)]
    labels = spark.createDataFrame(rows, "doc_id long, annotator string, toxic int")
    got, marks = A.labelled(docs, labels)
    assert len(got) == 300 and (marks == y).all()
    assert len(A.labelled(docs, labels, 50)[0]) <= 50
    out = A.score(docs, A.fit(docs, labels))
    assert out.columns == ["doc_id", "source", "abuse"] and out.count() == 302
    p = {r.doc_id: r.abuse for r in out.collect()}
    assert p[900] == p[901] == 0.0 and np.mean([(p[i] >= 0.5) == v for i, v in enumerate(y)]) > 0.95
    r = {x.source: x for x in A.rates(out).collect()}
    assert r["s"].documents + r[None].documents == 302 and 0 < r["s"].rate < 1
    assert A.score(docs.limit(0), A.fit(docs, labels.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["x", "ab", "가"])
def test_short(text):
    assert np.isfinite(A.train(*corpus(60, 4)).probability(pa.array([text]))).all()


def test_folds_in_tasks_and_saved_models(spark, tmp_path):
    bad, good = ["you utter zorgling", "go away zorgling scum"], ["a fine song of rain", "the chart of today", "rain and comets"]
    texts = [f"{t} {i}" for i in range(12) for t in (*bad, *good)]
    y = np.array([t.split()[0] in ("you", "go") for t in texts])
    here, there = A.train(texts, y), A.train(texts, y, spark=spark)
    assert np.array_equal(here.weights, there.weights) and (here.slope, here.bias) == (there.slope, there.bias)
    A.save(here, spark, str(tmp_path / "model"))
    back = A.load(spark, str(tmp_path / "model"))
    assert np.array_equal(back.weights, here.weights) and (back.slope, back.bias) == (here.slope, here.bias)
    few = A.labelled(spark.createDataFrame([(i, "x" * 10) for i in range(9)], "doc_id long, text string"), spark.createDataFrame([(i, "a", i % 2) for i in range(9)], "doc_id long, annotator string, toxic int"), max_chars=45)
    assert len(few[0]) == 4
