"""Tables of unit cases for periods, scores, names and similarity."""

import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from chartlake.functions import keys as K
from chartlake.functions import periods as P
from chartlake.functions import scoring as S
from chartlake.functions import similarity as M
from chartlake.functions import text as X


def values(spark, cases, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r.v for r in df.select("i", make(F.col("c")).alias("v")).orderBy("i").collect()]


def test_periods(spark):
    cases = {"2025.11.20": "2025-11-20", " 20251120\n": "2025-11-20", "2025-w09": "2025-W09", "2025W09": "2025-W09", "": None, None: None, "2025-13-01": None, "x" * 9999: None}
    assert values(spark, cases, P.canonical_period) == list(cases.values())
    for text in ("2025-11-20", "2026-W53", "2024-W01", "1969-12-31"):
        assert values(spark, [text], lambda c: P.period_label(P.period_code(P.compact_period(c)))) == [text]
    assert values(spark, ["2027-01-01"], lambda c: P.iso_week(c.cast("date"))) == ["2026-W53"]
    assert values(spark, ["2026-11-26"], lambda c: P.align_back(c.cast("date"), F.lit(4))) == [date(2026, 11, 20)]
    assert values(spark, ["2026-01-31", "x", None], P.history_date) == ["2026-02-01", "x", None]
    assert values(spark, ["2026-03-01", ""], P.cutoff_date) == ["2026-02-28", ""]
    assert values(spark, ["20260101T160000Z", "2026-01-02T00:00", "abc"], P.crawl_date) == ["2026-01-02", "2026-01-02", "abc"]
    assert values(spark, ["2026.01.05 ~ 2026.01.11", "2026.01.05", "x"], P.dotted_period) == ["2026-W02", "2026-01-05", None]
    assert values(spark, ["12.31", "01.02"], lambda c: P.month_day(c, F.lit("2026-01-05").cast("date"))) == [date(2025, 12, 31), date(2026, 1, 2)]
    assert [tuple(r) for r in values(spark, ["2026-W18", "x"], P.week_sort_key)] == [(2026, 18), (0, 0)]
    assert values(spark, ["20260105", "2026-01-05"], P.dashed_date) == ["2026-01-05", "2026-01-05"]
    assert values(spark, ["2026-W01", "x"], P.friday_of_iso_week) == [date(2026, 1, 2), None]
    assert values(spark, ["/a/2025-01-01/chart_20260102-20260108.csv", "/a/x.csv"], P.period_of_file) == ["2026-01-08", None]
    assert "2026-W18" > "2026-12-31"


def test_scores(spark):
    cases = {"1": 100.0, "10": 55.58763131801413, "100": 1.0, "0": 0.0, "101": 0.0, "": 0.0, "x": 0.0, None: 0.0}
    assert values(spark, cases, S.rank_score) == pytest.approx(list(cases.values()))
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1)], "a int, b int")
    assert [r[0] for r in df.select(S.blend(F.col("a"), F.col("b"))).collect()] == pytest.approx([60.0, 40.0, 100.0])
    cases = {"3:45": 225, "1:02:03": 3723, "x": 0, "": 0, None: 0}
    assert values(spark, cases, S.duration_seconds) == list(cases.values())
    g = spark.createDataFrame([(0.6, 0.65, 0.55, True), (0.6, 0.65, 0.0, False), (0.6, 0.64, 0.55, True), (None, 1.0, 1.0, True)], "s double, t double, a double, h boolean")
    assert [r[0] for r in g.select(S.passes_gates(*[F.col(c) for c in "stah"])).collect()] == [True, True, False, False]


def test_titles(spark):
    cases = {"Song (Live)": "Song", "Song (Live Version)": "Song", "Song (Live Ver.)": "Song (Live Ver.)", "Alive": "A", "Backstage": "Back", "X (Explicit)": "X", None: "", "": "", "(MV)": "(MV)"}
    assert values(spark, cases, X.clean_title) == list(cases.values())
    assert values(spark, ["KISS KISS (Prod. by X)", "(all)", None], X.strip_groups) == ["KISS KISS", "(all)", ""]
    cases = {
        "A (Night Remix)": "remix:night", "A [Live Ver.]": "live|version", "A - Acoustic": "acoustic", "A (Japanese Ver.)": "version:japanese",
        "A (2019 Version)": "", "A (Remastered Edition)": "", "A (feat. B)": "", "A": "", None: "", "A (Sped Up) (Inst.)": "speed|instrumental",
    }
    assert values(spark, cases, X.version_signature) == list(cases.values())
    cases = {"A (feat. Bé & C)": "b c", "A [ft. D]": "d", "A featuring E - x": "e", "defeat": "", None: ""}
    assert values(spark, cases, X.feature_signature) == list(cases.values())
    cases = {"Ｈｅｌｌｏ (feat. X) World": "hello world", "A - Single": "a", "빛, 1": "빛 1", "ñfeat": "feat", None: "", "": ""}
    assert values(spark, cases, X.norm_db) == list(cases.values())
    assert values(spark, ["A - Topic", "가 - 주제"], X.norm_match) == ["a", "가"]
    assert values(spark, ["a & b, c x d"], lambda c: F.array_join(X.split_artists(c), "|")) == ["a|b|c|d"]
    assert values(spark, ["A (B)", "A | B", "A"], lambda c: F.array_join(X.paren_variants(c), ";")) == ["A (B);A;B", "A | B;A;B", "A"]
    assert values(spark, ["x"], lambda c: F.array_join(X.distinct_names(F.array(F.lit("A"), F.lit("a "), F.lit(" "), F.lit("b"))), ";")) == ["A;b"]
    assert values(spark, ["seed"], X.stable_uid)[0].startswith("trk_")
    keys = values(spark, ["A (x)"], lambda c: X.lookup_keys(c, F.lit("B"), F.lit("C"), F.lit(1.0)))[0]
    assert [(k["key"], round(k["score"], 2)) for k in keys] == [("a x|b|c", 1.0), ("a x|b", 0.8), ("a|b", 0.6), ("a|b|c", 0.6)]
    long = "Ａ" * 200_000
    assert values(spark, [long], X.norm_db) == ["a" * 200_000]


def test_keys(spark):
    cases = {" Apple Music": "apple", "YOUTUBE": "ytmusic", "": "unknown", None: "unknown", "tidal": "tidal"}
    assert values(spark, cases, K.service) == list(cases.values())
    assert values(spark, ["https://x/watch?list=1&v=abc", "https://youtu.be/q?t=1", "x", None], lambda c: K.video_id(F.coalesce(c, F.lit("")))) == ["abc", "q", "", ""]
    assert values(spark, ["Gen-10s-Top-100-Daily", "a:gen20", "z"], lambda c: K.variant_of_job(c, F.lit(""))) == ["gen10", "gen20", "default"]
    assert values(spark, ["https://x/album/name/77?i=5"], lambda c: K.album_id(F.lit("apple"), F.lit(""), c)) == ["77"]
    assert values(spark, ["https://x/album/name/77?i=5"], lambda c: K.song_id(F.lit("apple"), F.lit(" "), F.lit(None), c)) == ["5"]
    assert values(spark, ["노래", "Video", "x"], K.result_type) == ["song", "video", "x"]


def test_similarity(spark):
    def sim(left, right, title=False):
        row = spark.createDataFrame([(left, right)], "l string, r string")
        return row.select(M.similarity(F.col("l"), F.col("r"), title)).first()[0]

    assert sim("", "a") == 0
    assert sim("A!", "a", True) == 1.0
    assert sim("A (feat. B)", "A (feat. C)", True) == 0.85
    assert sim("Part 1", "Part 2", True) == 0.0
    assert sim("Song", "Song Deluxe", True) == 0.95
    assert sim("Song", "Song remix", True) < 0.95
    assert sim("tide", "diet") == 0.25 and sim("diet", "tide") == 0.5
    assert sim("빛과", "빛과 그림자") >= 0.85
    assert sim(None, None) == 0
    assert sim(unicodedata.normalize("NFD", "가"), "가") == 1.0
    assert sim("new jeans", "newjeans") == 1.0 and sim("Song (Explicit)", "song", True) == 1.0
    df = spark.createDataFrame([("a a b", "a b b"), ("", "x"), (None, None)], "l string, r string")
    assert [round(r[0], 4) for r in df.select(M.token_overlap(F.col("l"), F.col("r"))).collect()] == [0.6667, 0.0, 0.0]
    assert [r[0] for r in df.select(M.similarity(F.col("l"), F.col("r"))).collect()] == [sim("a a b", "a b b"), 0.0, 0.0]
