"""Text functions as DuckDB SQL, for the queries' SQL counterparts.

Written from the definitions of the inventory, without NFKC, which DuckDB does
not have: they hold for text that is in NFKC already.
"""

from __future__ import annotations

# The letters that normalised text keeps, by code points: digits, Latin letters, Hangul
# syllables and its four blocks of letters, kana, and Han characters.
_RANGES = ((0x30, 0x39), (0x61, 0x7A), (0xAC00, 0xD7A3), (0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0x3040, 0x30FF), (0x4E00, 0x9FFF))
_KEPT = "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES)
# Rating labels and endings of variants.
_RATING = "(?:explicit|clean|edited|censored|uncensored)"
_LABEL = _RATING + r"(?:\s+(?:ver\.?|version|edition))?"
_VARIANT = (
    r"(?i)[\(\[\s]*(?:live|live\s+ver(?:sion)?|live\s+performance|acoustic|acoustic\s+ver(?:sion)?|mv|m/v|music\s+video"
    r"|official\s+video|official\s+mv|performance\s+video|stage|stage\s+ver(?:sion)?|dance\s+ver(?:sion)?|visualizer)[\)\]\s]*$"
)


def sub(x: str, pattern: str, to: str = " ") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def squeeze(x: str) -> str:
    return f"trim({sub(x, r'\s+')})"


def kept(lower: str) -> str:
    t = sub(lower, r"\([^)]*(?:feat\.?|ft\.?)[^)]*\)")
    t = sub(t, r"\[[^\]]*(?:feat\.?|ft\.?)[^\]]*\]")
    t = sub(t, r"\b(?:feat\.?|ft\.?)\b.*$")
    t = sub(t, r"\s*-\s*(?:ep|single)\b.*$")
    return squeeze(sub(t, f"[^{_KEPT}]+"))


def norm_sql(x: str) -> str:
    """Normalised text of stored keys."""
    return kept(f"lower(coalesce({x}, ''))")


def norm_match_sql(x: str) -> str:
    """The same, also without channel endings."""
    return kept(sub(f"lower(coalesce({x}, ''))", r"\s*-\s*(?:topic|주제)\b.*$"))


def or_original(changed: str, x: str) -> str:
    return f"coalesce(nullif({changed}, ''), {x}, '')"


def bare_sql(x: str) -> str:
    """Without bracketed groups."""
    return or_original(f"trim({sub(x, r'\s*[\(\[][^\)\]]*[\)\]]\s*')})", x)


def unrated_sql(x: str) -> str:
    t = sub(f"coalesce({x}, '')", rf"(?i)\s*[\(\[]\s*{_LABEL}\s*[\)\]]")
    t = sub(t, rf"(?i)\s*[-–—]\s*{_LABEL}\s*$")
    return or_original(squeeze(sub(t, rf"(?i)\s+{_RATING}\s+(?:ver\.?|version|edition)\.?\s*$")), x)


def clean_sql(x: str) -> str:
    """Without ratings and the ending of a variant."""
    return or_original(f"trim({sub(unrated_sql(x), _VARIANT, '')})", x)


def guests_sql(x: str) -> str:
    """Normalised guests that a title names."""
    found = ", ".join(
        f"nullif(regexp_extract({x}, '{p}', 1), '')"
        for p in (
            r"(?i)\((?:feat\.?|ft\.?|featuring)\s*([^)]+)\)",
            r"(?i)\[(?:feat\.?|ft\.?|featuring)\s*([^\]]+)\]",
            r"(?i)\b(?:feat\.?|ft\.?|featuring)\s+(.+)$",
        )
    )
    return norm_sql(rf"trim(regexp_extract(coalesce({found}, ''), '^([^\)\]\-_:|]*)', 1))")


_MARKS = (
    (r"(^| )remix( |$)", "'remix' || case when trim(regexp_replace({0}, '\\bremix\\b.*$', '')) <> '' then ':' || trim(regexp_replace({0}, '\\bremix\\b.*$', '')) else '' end"),
    (r"\bacoustic\b", "'acoustic'"),
    (r"\blive\b", "'live'"),
    (r"\b(?:instrumental|inst|karaoke)\b", "'instrumental'"),
    (r"\bsped up\b|\bslowed\b", "'speed'"),
    (r"\b(?:cover|arrange)\b", "'cover'"),
)
_LOCALE = r"\b(japanese|jp|chinese|cn|english|eng|korean|kr)?\s*(?:ver|version|edition|edit)\b"


def version_sql(x: str) -> str:
    """Marks of another recording, in order, joined by |."""
    text = sub(f"lower({unrated_sql(x)})", r"\b(?:feat\.?|ft\.?|featuring)\b.*")
    arms = [f"case when regexp_matches(y, '{p}') then {to.format('y')} end" for p, to in _MARKS]
    other = (
        r"regexp_matches(y, '\b(?:ver|version|edition|edit)\b') and not regexp_matches(y, '\b(?:re)?master(?:ed|ing)?\b|\bremaster\b|\banniversary\b|\bbonus track\b')"
        r" and not regexp_matches(y, '^(?:19|20)\d{2}\s+(?:ver|version|edition|edit)$')"
    )
    arms.append(f"case when {other} then 'version' || case when regexp_extract(y, '{_LOCALE}', 1) <> '' then ':' || regexp_extract(y, '{_LOCALE}', 1) else '' end end")
    return rf"""(select coalesce(string_agg(mark, '|' order by turn), '') from (
      select mark, min((c, k)) as turn from (
        select c, unnest(range({len(arms)})) as k, unnest([{', '.join(arms)}]) as mark from (
          select c, {kept('chunk')} as y from (
            select unnest(range(len(chunks))) as c, unnest(chunks) as chunk from (
              select case when len(g) > 0 then g else [t] end as chunks from (
                select t, regexp_extract_all(t, '[\(\[]([^\)\]]+)[\)\]]', 1) || list_filter([regexp_extract(t, '\s[-–—]\s(.+)$', 1)], lambda z: z <> '') as g
                from (select {text} as t)))))) where mark is not null group by mark))"""


def identity_sql(title: str, artist: str, video: str) -> str:
    """Key of one song in reports."""
    t, a = norm_sql(clean_sql(title)), norm_sql(artist)
    return f"(case when {t} = '' or {a} = '' then 'video:' || coalesce({video}, '') else 'meta|' || {t} || '|' || {a} || '|' || {guests_sql(title)} || '|' || {version_sql(title)} end)"


def video_sql(x: str) -> str:
    """The video that a text names as an id or inside a link."""
    t = sub(x, r"[\s\p{Z}]+", "")
    v = rf"nullif(regexp_extract({t}, '[?&]v=([0-9A-Za-z_-]+)', 1), '')"
    path = rf"nullif(regexp_extract({t}, '^[a-zA-Z]+://[^/?#]+/(?:[^?#]*/)?([0-9A-Za-z_-]+)/?(?:[?#].*)?$', 1), '')"
    return f"(case when {t} = '' then null when contains({t}, '://') then coalesce({v}, {path}, {t}) else {t} end)"
