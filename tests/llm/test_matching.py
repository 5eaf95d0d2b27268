"""Matching: parsing, blocking recall, and planted pairs."""

import random

import numpy as np
import pytest

from chartlake.llm import matching as M

COLS = ["result_id", "service", *M.FIELDS, "extra"]
SCHEMA = "result_id long, service string, " + ", ".join(f"{f} string" for f in M.FIELDS) + ", extra int"


def test_titles():
    assert M.parse_title("막차 (Last Train Out)") == (["막차", "last train out"], set())
    assert M.parse_title("A & B - Night Remix (Explicit)") == (["a and b"], {"remix"})
    assert M.parse_title("X [feat. Y] (Live Ver.)") == (["x"], {"live"})
    assert M.parse_title("X [일본어 버전]") == (["x"], {"japanese"})
    assert M.parse_title("") == ([], set())
    assert M.parse_artist("께조까, Véskkoum") == ["께조까", "veskkoum"]
    assert M.parse_artist("두터기(foth gav)") == ["두터기", "foth gav"]
    assert M.part_of(["rain iv pt 1"]) == "iv pt1" and M.part_of(["rain"]) == ""
    assert M.clip_translation("First Night 첫 밤 | Z", ["첫 밤"], []) == (True, "first night")
    assert M.clip_translation("Other Song | Z", ["첫 밤"], []) == (False, None)


def test_edits():
    assert [M.edits(a, b) for a, b in (("ab", "ba"), ("abc", "abc"), ("", "ab"), ("lgiht", "light"), ("kitten", "sitting"))] == [1, 0, 2, 1, 3]
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(2))
        assert M.least_edits(a, b) <= M.edits(a, b)


def test_bands_find_typos():
    """Recall of the blocks on pairs with one typo in the title or the artist."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))

    def typo(x):
        i = rnd.randrange(len(x) - 1)
        return rnd.choice([x[:i] + x[i + 1] + x[i] + x[i + 2 :], x[:i] + x[i + 1 :], x[: i + 1] + x[i:]])

    hit = {True: 0, False: 0}
    for n in range(600):
        t, a = f"{word()} {word()}", f"{word()} {word()}"
        u, b = (typo(t), a) if n % 2 else (t, typo(a))
        hit[bool(n % 2)] += bool(((M._minhash(t, 0) == M._minhash(u, 0)) & (M._minhash(a, 1) == M._minhash(b, 1))).any())
    assert hit[True] / 300 >= 0.95 and hit[False] / 300 >= 0.9


def test_classifier():
    assert M.train(np.zeros((0, M.FEATURES)), np.zeros(0)).confidence(np.array([M.features(["a b"], ["a b"], ["c"], ["c"], set())]))[0] > 0.9
    x = np.array([M.features(["city lamps"], [y], ["c d"], ["c d"], {"city lamps", "city camps"}) for y in ("city lamsp", "city camps", "other")])
    p = M.train(x, np.array([1.0, 0.0, 0.0])).confidence(x)
    assert p[0] > 0.5 > p[1] and p[2] < 0.5


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(9)
    nouns = ["river", "lamp", "garden", "train", "mirror", "window", "cloud", "story"]
    adjectives = ["silent", "golden", "broken", "warm", "tiny", "distant"]
    artists = {f"{x} {y}": f"{chr(0xAC00 + 588 * i)}{chr(0xAC1C + 588 * j)}나" for i, x in enumerate(["brox", "kiad", "lond", "miar"]) for j, y in enumerate(["pesh", "sulm", "tair"])}
    songs = rnd.sample([(f"{a} {n}", x, v) for a in adjectives for n in nouns for x in artists for v in ("", " (Live)", " Pt. 2")], 150)
    rows, truth = [], {}
    for k, (t, x, v) in enumerate(songs):
        for s in rnd.sample(["apple", "melon", "spotify", "ytmusic"], rnd.randint(1, 4)):
            ko = "".join(chr(0xAC00 + 28 * (ord(c) * 7 % 300)) for c in t if c != " ")
            loc = rnd.random() < 0.6
            i = len(rows) + 1
            title = f"{t.title()}{v}" if s != "melon" else f"{ko}{v}"
            name = x.title() if s != "melon" else artists[x]
            if rnd.random() < 0.2:
                title = title.upper()
            if rnd.random() < 0.2:
                title += " (feat. Guest One)"
            rows.append((i, s, title, name, f"{t.title()}{v}" if loc else "", x.title() if loc else None, f"{ko}{v}" if loc else None, artists[x] if loc else "", "", "", 1))
            truth[i] = (k, s)
    rows += [(900, "apple", None, "x", *[None] * 6, 1), (901, "melon", "", "", *[""] * 6, 1), (902, None, "River", "Brox", *[None] * 6, 1), (903, "apple", "z" * 20_000, "y" * 9_000, *[None] * 6, 1)]
    want = {(a, b) for a in truth for b in truth if a < b and truth[a][0] == truth[b][0] and truth[a][1] != truth[b][1]}
    return rows, want


def test_planted(spark, planted):
    rows, want = planted
    df = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    got = [(r.id_a, r.id_b) for r in M.match_records(df, "result_id", "service").collect()]
    assert len(got) == len(set(got))
    hit = len(set(got) & want)
    assert hit / len(want) >= 0.95 and hit / len(got) >= 0.95


def test_empty(spark):
    assert M.match_records(spark.createDataFrame([], SCHEMA), "result_id", "service").count() == 0
