"""Consistent text: against Unicode's NFKC and a plain per-row version."""

import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartlake.llm import lookalike as L
from chartlake.llm.codepoints import from_codepoints, offsets_of, row_ids, to_codepoints

POOL = [chr(c) for c in (*range(0x41, 0x4B), 0xE9, 0x1EC7, 0x1EA5, 0x301, 0x302, 0x323, 0x308, 0x327, 0x345, 0x3099, 0x309A, 0x30AB, 0x30CF, 0xAC00, 0xAC01, 0x1100, 0x1161, 0x11A8, 0x1102, 0x1175, 0xFF76, 0xFF9E, 0x9C7, 0x9BE, 0xDD9, 0xDCF, 0xDCA, 0x212B, 0xFB01, 0x2163, 0x1F82, 0x3B1, 0x313, 0x300, 0xFB2C, 0x5C1, 0x5BC, 0x958)]


def nfkc(texts):
    t = L.tables()
    cps, offs = to_codepoints(pa.array(texts, pa.string()))
    a, r = L._compose(*L._expand(cps, row_ids(offs), t.full), t)
    return from_codepoints(a, offsets_of(r, len(texts))).to_pylist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(POOL), max_size=12).map("".join), max_size=20))
def test_composition_is_nfkc(texts):
    assert nfkc(texts) == [unicodedata.normalize("NFKC", t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=10))
def test_any_text_is_stable(texts):
    once = L.canonical_array(pa.array(texts, pa.string())).to_pylist()
    assert L.canonical_array(pa.array(once, pa.string())).to_pylist() == once


CASES = {
    "Ｓｏｆｔ Garden": "Soft Garden", "Ｐｔ． １": "Pt. 1", "Café": "Café", "한": "한", "ﾄﾞﾗｲﾌﾞ": "ドライブ", "Ⅳ": "IV", "ﬁre": "fire",
    "a​b­c⁠﻿‎": "abc", "a b c　d\te": "a b c d e", "Rооftoр": "Rooftop", "Pսzzle": "Puzzle", "Dοn’t": "Don’t",
    "Кор Züv": "Kop Züv", "Огни Гoрода": "Огни Города", "Tихая Волна Pt. 3": "Тихая Волна Pt. 3", "Mικρή": "Μικρή", "Зимняя Рoса Forever": "Зимняя Роса Forever",
    "Дальнии­̆": "Дальний", "Kite": "Kite", "른‍": "른", "👩‍‍🎤": "👩🎤",
}
SAME = [
    "Зимняя Роса Forever III", "Καλοκαίρι Ω", "Don’t", "👩‍🎤", "❤️", "🧑‍🚀 x", "1️⃣", "Été", "한글", "女神のダンス", "Сахар и Дождь", "", " ", "Đêm Việt", "क्‍ष", "می‌خواهم",
    "🏴\U000e0067\U000e0062\U000e007f",
]


def test_cases():
    got = L.canonical_array(pa.array([*CASES, *SAME, None], pa.string())).to_pylist()
    assert got == [*CASES.values(), *SAME, None]


def plain(text):
    """The same rules for one row, without emoji, joiners and mixed words."""
    out = "".join(c for c in text if not (unicodedata.category(c) == "Cf" or c == "️"))
    out = unicodedata.normalize("NFKC", out)
    return "".join(" " if c.isspace() else c for c in out)


def test_brute_force_and_rows_do_not_mix():
    rnd = random.Random(2)
    letters = "abcXYZ가나다éü１２ｗ" + "́가 ​﻿  パ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(9))) for _ in range(3000)]
    assert L.canonical_array(pa.array(texts)).to_pylist() == [plain(t) for t in texts]


def test_long_text_stays_whole():
    big = "Ａ" * 3_000_000
    assert L.canonical_array(pa.array([big, "Ｂ"])).to_pylist() == ["A" * 3_000_000, "B"]


def test_frame(spark):
    df = spark.createDataFrame([(1, "Ａ", "x"), (1, "Ａ", "x"), (2, None, "x"), (3, "", "x")], "id int, t string, canonical string")
    out = L.canonical_text(df, "t")
    assert out.columns == ["id", "t", "canonical"]
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "Ａ", "A"), (1, "Ａ", "A"), (2, None, None), (3, "", "")]
    assert L.canonical_text(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("text", ["한", "a" * 10])
def test_round_trip(text):
    assert from_codepoints(*to_codepoints(pa.array([text, None, ""], pa.string()))).to_pylist() == [text, "", ""]
