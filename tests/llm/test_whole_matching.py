"""Matching: pairs that the bands miss."""

import random

from chartlake.llm import matching as M
from tests.llm.test_matching import SCHEMA


def test_one_edit_always_meets():
    rnd = random.Random(3)
    for letters in ("abcdeiorsu", "가나다라마바사아자차카하"):
        for _ in range(400):
            a = "".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9)))
            i = rnd.randrange(len(a) - 1)
            for b in (a[:i] + a[i + 1] + a[i] + a[i + 2 :], a[:i] + a[i + 1 :], a[:i] + rnd.choice(letters) + a[i:], a[:i] + rnd.choice(letters) + a[i + 1 :]):
                assert set(M._deletions(a).tolist()) & set(M._deletions(b).tolist()), (a, b)
    assert M._deletions("ab").tolist()[0] == M._deletions("a b").tolist()[0] != M._deletions("ba").tolist()[0]
    assert len(M._deletions("y" * 20_000)) == 20_001 and len(M._deletions("")) == 1


def test_pairs_without_a_common_band(spark):
    """Short names with one edit that share no band still reach the classifier."""
    missed = [(a, b) for a, b in (("purk saiml", "purk sailm"), ("rorukmaisk", "rourkmaisk"), ("ab cd", "ab dc"), ("kim lo", "kim ol"), ("beso", "bseo"), ("nari", "nrai"), ("나라다", "나다라"), ("mino", "mnio")) if not (M._minhash(a, 1) == M._minhash(b, 1)).any()]
    assert missed
    rows = [(10 * i + j, s, f"song title {i}", x, *[None] * 6, 1) for i, pair in enumerate(missed) for j, (s, x) in enumerate(zip(("apple", "melon"), pair))]
    got = {(r.id_a, r.id_b) for r in M.match_records(spark.createDataFrame(rows, SCHEMA), "result_id", "service", threshold=0.0).collect()}
    assert {(10 * i, 10 * i + 1) for i in range(len(missed))} <= got


def test_long_names():
    rnd = random.Random(5)
    for n in (64, 90, 500):
        a = "".join(rnd.choice("abcde ") for _ in range(n))
        swapped = a[:10] + a[11] + a[10] + a[12:]
        for b, want in ((a, 0), (swapped, int(swapped != a)), (a[:20] + a[21:], 1), ("x" + a, 1), (a[:-1], 1), (a[:30] + "XYZ" + a[33:], 3)):
            assert M.edits(a, b) == want, (n, want)
    long = "word " * 200
    assert M.closeness([long + "end"], [long + "emd"])[1] == 1.0


def test_classes_hold_all_pairs(spark):
    rows = [(i, s, "song title", "some artist", *[None] * 6, 1) for i, s in enumerate(("apple", "melon", "apple", "melon"))] + [(9, "apple", "song titel", "some artist", *[None] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    links, members = M.match_classes(df, "result_id", "service")
    assert links.count() <= 3 and members.count() == 5
    pairs = {(r.id_a, r.id_b) for r in M.match_records(df, "result_id", "service").collect()}
    assert {(0, 1), (0, 3), (1, 2), (2, 3)} <= pairs
