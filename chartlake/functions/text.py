"""Text normalisation, keys and signatures as Column expressions.

NFKC has no built-in in Spark and is the one Arrow UDF here; all else stays in
the JVM. Null counts as empty text unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartlake.functions.periods import let

# The letters that normalised text keeps, by code points: digits, Latin letters, Hangul
# syllables and the four blocks of Hangul letters, kana, and Han characters.
KEPT_RANGES = ((0x30, 0x39), (0x61, 0x7A), (0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF))
KEPT = "".join(f"{chr(a)}-{chr(b)}" for a, b in KEPT_RANGES)
# Labels that name no other recording.
RATING = r"(?:explicit|clean|edited|censored|uncensored)"
LABEL = RATING + r"(?:\s+(?:ver\.?|version|edition))?"
# Endings of performance and video variants.
VARIANT = (
    r"(?i)[\(\[\s]*(?:live|live\s+ver(?:sion)?|live\s+performance|acoustic|acoustic\s+ver(?:sion)?|mv|m/v|music\s+video"
    r"|official\s+video|official\s+mv|performance\s+video|stage|stage\s+ver(?:sion)?|dance\s+ver(?:sion)?|visualizer)[\)\]\s]*$"
)
LOCALES = "japanese|jp|chinese|cn|english|eng|korean|kr"


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    seen: dict[str, str] = {}
    return s.map(lambda x: x if x is None or x.isascii() else seen.get(x) or seen.setdefault(x, unicodedata.normalize("NFKC", x)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(s: pd.Series) -> pd.Series:
    """Unicode NFKC of each text of an array."""
    return s.map(lambda xs: None if xs is None else [x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in xs])


def nfkc(c: Column) -> Column:
    """Unicode NFKC; null as empty."""
    return F.coalesce(_nfkc(c), F.lit(""))


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _kept(lower: Column) -> Column:
    """Normalised form of text that is in NFKC and lower case."""
    t = F.regexp_replace(lower, r"\([^)]*(?:feat\.?|ft\.?)[^)]*\)", " ")
    t = F.regexp_replace(t, r"\[[^\]]*(?:feat\.?|ft\.?)[^\]]*\]", " ")
    t = F.regexp_replace(t, r"\b(?:feat\.?|ft\.?)\b.*$", " ")
    t = F.regexp_replace(t, r"(?i)\s*-\s*(?:ep|single)\b.*$", " ")
    return _squeeze(F.regexp_replace(t, f"[^{KEPT}]+", " "))


def norm_plain(c: Column) -> Column:
    """``norm_db`` of text that is known to be in NFKC (ASCII, say): JVM only."""
    return _kept(F.lower(F.coalesce(c, F.lit(""))))


def norm_db(c: Column) -> Column:
    """Normalised text of stored keys: NFKC, lower case, without guests and
    release endings, letters and digits of the kept scripts only."""
    return _kept(F.lower(nfkc(c)))


def match_form(c: Column) -> Column:
    """``norm_match`` of text that is in NFKC already: JVM only."""
    return _kept(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s*-\s*(?:topic|주제)\b.*$", " "))


def norm_match(c: Column) -> Column:
    """As ``norm_db``, also without channel endings."""
    return match_form(nfkc(c))


def metadata_key(title: Column, artist: Column, album: Column, norm=norm_db) -> Column:
    return F.concat(norm(title), F.lit("|"), norm(artist), F.lit("|"), norm(album))


def compact_key(title: Column, artist: Column, norm=norm_db) -> Column:
    return F.concat(norm(title), F.lit("|"), norm(artist))


def or_original(changed: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(changed, F.lit("")), original, F.lit(""))


def strip_groups(c: Column) -> Column:
    """Without any bracketed groups; the original if nothing is left."""
    return or_original(F.trim(F.regexp_replace(c, r"\s*[\(\[][^\)\]]*[\)\]]\s*", " ")), c)


def unrated(t: Column) -> Column:
    return F.when(t.rlike(rf"(?i){RATING}"), _relabelled(t)).otherwise(_squeeze(t))


def _relabelled(t: Column) -> Column:
    t = F.regexp_replace(t, rf"(?i)\s*[\(\[]\s*{LABEL}\s*[\)\]]", " ")
    t = F.regexp_replace(t, rf"(?i)\s*[-–—]\s*{LABEL}\s*$", " ")
    return _squeeze(F.regexp_replace(t, rf"(?i)\s+{RATING}\s+(?:ver\.?|version|edition)\.?\s*$", " "))


def strip_rating(c: Column, form=nfkc) -> Column:
    """Without content-rating labels."""
    return or_original(unrated(F.coalesce(form(c), F.lit(""))), c)


def plain(c: Column) -> Column:
    """For text that is known to be in NFKC: in place of ``nfkc``."""
    return F.coalesce(c, F.lit(""))


def clean_title(c: Column, form=nfkc) -> Column:
    """Without ratings and without the ending of a performance variant."""
    return or_original(F.trim(F.regexp_replace(strip_rating(c, form), VARIANT, "")), c)


# Fixed values from here to the end of ``version_signature``: patterns of guests and versions.
def feature_signature(c: Column, norm=norm_db) -> Column:
    """Normalised guests that a title names, else empty."""
    return norm(let(F.coalesce(c, F.lit("")), lambda x: F.when(x.rlike(r"(?i)feat|ft"), _guests_named(x)).otherwise("")))


def _guests_named(text: Column) -> Column:
    found = [
        F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
        for p in (
            r"(?i)\((?:feat\.?|ft\.?|featuring)\s*([^)]+)\)",
            r"(?i)\[(?:feat\.?|ft\.?|featuring)\s*([^\]]+)\]",
            r"(?i)\b(?:feat\.?|ft\.?|featuring)\s+(.+)$",
        )
    ]
    return F.trim(F.regexp_extract(F.coalesce(*found, F.lit("")), r"^([^\)\]\-_:|]*)", 1))


# What is in a text that has any of the marks below, so that others need no search for each.
ANY_MARK = "remix|acoustic|live|inst|karaoke|sped|slowed|cover|arrange|ver|edit"


def version_signature(c: Column, form=nfkc) -> Column:
    """Marks of another recording (``remix:night|live``), in order, joined by |."""
    text = F.regexp_replace(F.lower(strip_rating(c, form)), r"\b(?:feat\.?|ft\.?|featuring)\b.*", " ")
    return let(text, lambda x: F.when(x.rlike(ANY_MARK), _marked(x)).otherwise(""))


def _marked(text: Column) -> Column:
    groups = F.regexp_extract_all(text, F.lit(r"[\(\[]([^\)\]]+)[\)\]]"), 1)
    tail = F.array_compact(F.array(F.nullif(F.regexp_extract(text, r"\s[-–—]\s(.+)$", 1), F.lit(""))))
    chunks = let(F.concat(groups, tail), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))

    def marks(t: Column) -> Column:
        prefix = F.trim(F.regexp_replace(t, r"\bremix\b.*$", ""))
        locale = F.regexp_extract(t, rf"\b({LOCALES})?\s*(?:ver|version|edition|edit)\b", 1)
        other = (
            t.rlike(r"\b(?:ver|version|edition|edit)\b")
            & ~t.rlike(r"\b(?:re)?master(?:ed|ing)?\b|\bremaster\b|\banniversary\b|\bbonus track\b")
            & ~t.rlike(r"^(?:19|20)\d{2}\s+(?:ver|version|edition|edit)$")
        )
        return F.array_compact(
            F.array(
                F.when(t.rlike(r"(^| )remix( |$)"), F.when(prefix != "", F.concat(F.lit("remix:"), prefix)).otherwise("remix")),
                F.when(t.rlike(r"\bacoustic\b"), "acoustic"),
                F.when(t.rlike(r"\blive\b"), "live"),
                F.when(t.rlike(r"\b(?:instrumental|inst|karaoke)\b"), "instrumental"),
                F.when(t.rlike(r"\bsped up\b|\bslowed\b"), "speed"),
                F.when(t.rlike(r"\b(?:cover|arrange)\b"), "cover"),
                F.when(other, F.when(locale != "", F.concat(F.lit("version:"), locale)).otherwise("version")),
            )
        )

    return F.array_join(F.array_distinct(F.flatten(F.transform(F.transform(chunks, _kept), marks))), "|")


def identity_key(title: Column, artist: Column, video: Column, norm=norm_db, form=nfkc) -> Column:
    """Key of one song in reports: ``meta|title|artist|guests|version``, else
    ``video:id`` where title or artist is missing."""
    t, a = norm(clean_title(title, form)), norm(artist)
    meta = F.concat_ws("|", F.lit("meta"), t, a, feature_signature(title, norm), version_signature(title, form))
    return F.when((t == "") | (a == ""), F.concat(F.lit("video:"), F.coalesce(video, F.lit("")))).otherwise(meta)


def stable_uid(seed: Column) -> Column:
    """``trk_`` and 16 hex digits that depend on ``seed`` only."""
    return F.concat(F.lit("trk_"), F.substring(F.sha1(seed), 1, 16))


def split_artists(c: Column) -> Column:
    """Names of an artist credit."""
    parts = F.split(c, r"\s*(?:,|&| and | x | X | with |\+)\s*|\s+(?:및|와|과)\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def paren_variants(c: Column) -> Column:
    """The text, and its parts before and in a closing bracket, or between the
    first delimiter that it has."""
    pattern = r"^(.*?)\s*[\(\[/（]\s*(.*?)\s*[\)\]/）]\s*$"
    inside = F.array(F.trim(F.regexp_extract(c, pattern, 1)), F.trim(F.regexp_extract(c, pattern, 2)))
    pieces = F.filter(inside, lambda x: x != "")
    by = lambda d: F.filter(F.transform(F.split(c, rf"\Q{d}\E"), lambda x: F.trim(x)), lambda x: x != "")
    split = F.when(c.contains(" / "), by(" / ")).when(c.contains(" | "), by(" | ")).when(c.contains(" - "), by(" - "))
    return F.concat(F.array(c), F.when(F.size(pieces) > 0, pieces).otherwise(F.coalesce(split, F.array().cast("array<string>"))))


def distinct_names(names: Column, norm=norm_plain) -> Column:
    """Names without blanks; of names that are normalised alike the first."""
    pairs = F.transform(names, lambda x: F.struct(F.trim(x).alias("n"), norm(F.trim(x)).alias("k")))
    start = F.array().cast("array<struct<n:string,k:string>>")
    fresh = lambda kept, x: (x["n"] != "") & ~F.exists(kept, lambda y: y["k"] == x["k"])
    kept = F.aggregate(pairs, start, lambda acc, x: F.when(fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return F.transform(kept, lambda x: x["n"])


def video_title(c: Column) -> Column:
    """A video's title without bracketed groups and video words."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\b(?:official|mv|m/v|music video|live|stage|performance|lyrics?)\b", " ")
    return _squeeze(F.regexp_replace(t, r"\[[^\]]+\]|\([^)]+\)", " "))


def artwork_url(template: Column, size: int = 300) -> Column:
    """A template with its width, height and format filled in."""
    t = F.replace(F.replace(template, F.lit("{w}"), F.lit(str(size))), F.lit("{h}"), F.lit(str(size)))
    return F.replace(t, F.lit("{f}"), F.lit("jpg"))


def lookup_keys(title: Column, artist: Column, album: Column, score: Column, norm=norm_db) -> Column:
    """``array<struct<key, score>>`` of the keys under which a song is found:
    full, compact (0.8), and without brackets in title or artist (0.6)."""
    bare_title, bare_artist = strip_groups(title), strip_groups(artist)
    t_diff, a_diff = bare_title != title, bare_artist != artist
    full, compact = metadata_key(title, artist, album, norm), compact_key(title, artist, norm)
    one = lambda key, part, when: F.when(when, F.struct(key.alias("key"), (score * part).alias("score")))
    keys = F.array(
        one(full, 1.0, F.lit(True)),
        one(compact, 0.8, compact != full),
        one(compact_key(bare_title, artist, norm), 0.6, t_diff),
        one(metadata_key(bare_title, artist, album, norm), 0.6, t_diff),
        one(compact_key(title, bare_artist, norm), 0.6, a_diff),
        one(compact_key(bare_title, bare_artist, norm), 0.6, a_diff & t_diff),
    )
    keys = F.filter(keys, lambda k: k.isNotNull() & (F.translate(k["key"], "|", "") != ""))
    return F.when((title != "") & (artist != ""), keys).otherwise(F.array().cast("array<struct<key:string,score:double>>"))
