"""Matching records of several sources that share no identifier.

Names are brought to one form and, by a dictionary that the data's own
bilingual records vote for, to one language. Records with the same names are
one representative. MinHash over titles and artists together blocks the
representatives; candidate pairs get similarity features, and a logistic
classifier turns them into a calibrated confidence. It is trained on weak
labels: pairs whose localized names agree or differ, seen through their raw
names alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.lookalike import canonical_array
from chartlake.runtime import map_arrow, materialize

#: Weakly labelled pairs that training uses at most, chosen by a hash.
MAX_TRAIN_PAIRS = 20_000
#: MinHash bands, by the hashes of the title and of the artist in each. Many
#: songs share a title, so artists have to be told apart more sharply.
BANDS = ((1, 3),) * 12
#: Edits between the nearest titles and the nearest artists of a candidate pair.
MOST_EDITS = 4
#: For long names, these edits a letter of the longer one.
EDIT_SHARE = 0.2
#: Records in which a name must be found to be established.
ESTABLISHED = 3

# Words that make another version of a recording, by version.
VERSIONS = {
    "live": r"live|라이브|ライブ",
    "remix": r"remix|rmx|리믹스|リミックス",
    "instrumental": r"instrumental|inst|반주|カラオケ|karaoke|mr",
    "acoustic": r"acoustic|어쿠스틱|unplugged",
    "sped up": r"sped[ -]?up|speed[ -]?up|빠른|nightcore",
    "slowed": r"slowed|느린 버전",
    "japanese": r"japanese|jp|jpn|일본어|日本語",
    "korean": r"korean|kor|kr|한국어|韓国語",
    "english": r"english|eng|영어|英語",
    "chinese": r"chinese|chn|중국어|中国語",
    "spanish": r"spanish|스페인어",
    "demo": r"demo|데모",
    "cover": r"cover|커버",
    "acapella": r"a ?cappella|acapella|아카펠라",
}
WORDS = {k: re.compile(rf"(?i)(?<![^\W_])(?:{v})(?![^\W_])") for k, v in VERSIONS.items()}
RATING = re.compile(r"(?i)^(explicit|clean|dirty|19금|19)( ?ver(sion|\.)?)?$")
GUEST = re.compile(r"(?i)^(feat|ft|featuring|with|prod)\b")
BRACKET = re.compile(r"[\(\[（［]([^\(\)\[\]（）［］]*)[\)\]）］]")
PART = re.compile(r"(?i)\b(?:pt|part)\.? ?(\d+)\b")
ROMAN = re.compile(r"(?i)\b(ii|iii|iv|v|vi|vii|viii|ix)\b")
JOIN = re.compile(r"\s*(?:,|&|、|/|\+)\s*|\s+(?:x|with|feat\.?|ft\.?|and|및|와|과)\s+", re.I)
CLIP = re.compile(r"(?i)\[mv\]|\(?official (?:music )?(?:video|audio)\)?|\(?lyric video\)?")


def plain_name(text: str) -> str:
    """Lower case, Latin letters without marks, words without punctuation."""
    t = unicodedata.normalize("NFD", text.replace("&", " and ").lower())
    t = "".join(c for c in t if unicodedata.category(c) != "Mn" or c in "゙゚")
    t = re.sub(r"[’'`]", "", unicodedata.normalize("NFC", t))
    return " ".join(re.sub(r"[^\w]+|_", " ", t).split())


def version_of(text: str) -> set[str]:
    return {k for k, w in WORDS.items() if w.search(text)}


def parse_title(text: str) -> tuple[list[str], set[str]]:
    """Names of a title (itself and translations in brackets) and its versions."""
    names, versions = [], set()

    def bracket(m: re.Match) -> str:
        inner = m.group(1).strip()
        if GUEST.match(inner) or RATING.match(inner) or not inner:
            return " "
        v = version_of(inner)
        if v:
            versions.update(v)
        else:
            names.append(inner)
        return " "

    rest = BRACKET.sub(bracket, text)
    while " - " in rest:
        head, tail = rest.rsplit(" - ", 1)
        v = version_of(tail)
        if not v and not RATING.match(tail.strip()):
            break
        versions |= v
        rest = head
    rest = re.sub(r"(?i)\s(?:feat|ft)\.\s.*$", "", rest)
    out = [n for n in (plain_name(x) for x in [rest, *names]) if n]
    return list(dict.fromkeys(out)), versions


def parse_artist(text: str) -> list[str]:
    """Names of an artist credit, translations in brackets included."""
    inner = [m.strip() for m in BRACKET.findall(text)]
    parts = [p for x in [BRACKET.sub(" ", text), *inner] for p in JOIN.split(GUEST.sub("", x.strip()))]
    return list(dict.fromkeys(n for n in map(plain_name, parts) if n))


def part_of(names: list[str]) -> str:
    """Numbered parts: ``pt n`` and Roman numerals."""
    found = {f"pt{m}" for n in names for m in PART.findall(n)} | {m.lower() for n in names for m in ROMAN.findall(n)}
    return " ".join(sorted(found))


def clip_translation(clip: str, known: list[str], artists: list[str]) -> tuple[bool, str | None]:
    """Whether a video's title holds a known one, and the title in another
    script beside it."""
    t = CLIP.sub(" ", clip)
    if "_" in t:
        t = t.split("_", 1)[1]
    quoted = re.findall(r"'(.+)'", t)
    hangul = lambda x: re.search("[가-힣]", x) is not None
    holds = False
    for piece in quoted or re.split(r"\||\s-\s", t):
        names, _ = parse_title(piece.strip())
        for k in known:
            for n in names:
                rest = None
                if n == k:
                    rest = names[1 - names.index(n)] if len(names) == 2 else None
                elif n.startswith(k + " "):
                    rest = n[len(k) + 1 :]
                elif n.endswith(" " + k):
                    rest = n[: -len(k) - 1]
                else:
                    continue
                holds = True
                if rest and hangul(rest) != hangul(k) and rest not in artists:
                    return True, rest
    return holds, None


FIELDS = ("title", "artist", "title_en", "artist_en", "title_ko", "artist_ko", "yt_title", "yt_artist")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = {f: [x or "" for x in canonical_array(b.column(2 + i)).to_pylist()] for i, f in enumerate(FIELDS)}
        rows: dict[str, list] = {k: [] for k in ("titles", "artists", "title_en", "title_ko", "artist_en", "artist_ko", "artist_seen", "version", "part")}
        for i in range(b.num_rows):
            raw, v = parse_title(text["title"][i])
            en, ve = parse_title(text["title_en"][i])
            ko, vk = parse_title(text["title_ko"][i])
            names = list(dict.fromkeys([*raw, *en, *ko]))
            artists = parse_artist(text["artist"][i])
            aen, ako = parse_artist(text["artist_en"][i]), parse_artist(text["artist_ko"][i])
            holds, other = clip_translation(text["yt_title"][i], names, [*artists, *aen, *ako]) if text["yt_title"][i] else (False, None)
            seen = parse_artist(re.sub(r"(?i)( - topic| official)$", "", text["yt_artist"][i])) if holds else []
            if other and part_of([other]) == part_of(names):
                names.append(other)
            rows["titles"].append(list(dict.fromkeys(names)))
            rows["artists"].append(list(dict.fromkeys([*artists, *aen, *ako])))
            rows["title_en"].append(en[0] if en else None)
            rows["title_ko"].append(ko[0] if ko else None)
            rows["artist_en"].append(aen[0] if len(aen) == 1 else None)
            rows["artist_ko"].append(ako[0] if len(ako) == 1 else None)
            rows["artist_seen"].append(seen[0] if len(seen) == 1 and seen[0] != "various" else None)
            rows["version"].append(" ".join(sorted(v | ve | vk)))
            rows["part"].append(part_of(names))
        lists = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(x, lists if k in ("titles", "artists") else pa.string()) for k, x in rows.items())],
            names=["id", "origin", *rows],
        )


def _dictionary(rows: DataFrame, names: str, hubs: list[str], single: bool) -> DataFrame:
    """``(name, hub, known)``: the name that most records with this name give
    in the first of the columns ``hubs`` that any of them fills; and whether
    the name is established."""
    src = rows.where(F.size(names) <= 2) if single else rows
    each = src.select(F.explode(names).alias("name"), *hubs)
    level = F.coalesce(*[F.when(F.col(c).isNotNull(), len(hubs) - i) for i, c in enumerate(hubs)])
    hubs = each.select("name", F.coalesce(*[F.col(c) for c in hubs]).alias("hub"), level.alias("first"))
    votes = hubs.groupBy("name", "hub", "first").agg(F.count("*").alias("n"))
    best = votes.groupBy("name").agg(
        F.max_by("hub", F.when(F.col("hub").isNotNull(), F.struct("first", "n", "hub"))).alias("hub"), F.sum("n").alias("seen")
    )
    best = materialize(best, "names")
    again = best.select(F.col("name").alias("hub"), F.col("hub").alias("__end"))
    out = best.join(again, "hub", "left").select(
        "name", F.coalesce("__end", "hub", "name").alias("hub"), (F.col("seen") >= ESTABLISHED).alias("known")
    )
    return materialize(out, "dictionary")


def _resolved(rows: DataFrame, names: str, words: DataFrame) -> DataFrame:
    """Sets of hubs (with whether they are established) per record."""
    each = rows.select("id", F.explode(names).alias("name")).join(words, "name", "left")
    hub = F.coalesce("hub", "name")
    known = words.select(F.col("name").alias("__hub"), F.col("known").alias("__known"))
    each = each.withColumn("__hub", hub).join(known, "__hub", "left")
    return each.groupBy("id").agg(
        F.sort_array(F.collect_set("__hub")).alias(names), F.sort_array(F.collect_set(F.when(F.col("__known"), F.col("__hub")))).alias(f"{names}_known")
    )


def hash_text(t: str) -> int:
    h = 1469598103934665603
    for c in t:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


_DEPTH = max(max(b) for b in BANDS)
_MULS = np.array([hash_text(f"hash {i}") | 1 for i in range(_DEPTH * len(BANDS))], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _minhash(name: str, side: int) -> np.ndarray:
    """One hash per band of the pairs of letters of a name."""
    t = f"^{name.replace(' ', '')}$"
    g = np.array([hash_text(t[i : i + 2]) for i in range(len(t) - 1)], np.uint64)
    h = g[None, :] * _MULS[:, None]
    h = (h ^ (h >> np.uint64(31))).min(axis=1).reshape(-1, _DEPTH)
    out = h[:, 0]
    for k in range(1, _DEPTH):
        out = np.where([b[side] > k for b in BANDS], out * _MIX ^ h[:, k], out)
    return out


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], np.ndarray] = {}
    turn = np.arange(len(BANDS), dtype=np.uint64)

    def of(name: str, side: int) -> np.ndarray:
        if (name, side) not in seen:
            if len(seen) > 100_000:  # a cache only
                seen.clear()
            seen[name, side] = _minhash(name, side)
        return seen[name, side]

    for b in batches:
        at, keys = [], []
        for row, (titles, artists, kind) in enumerate(zip(*(b.column(i).to_pylist() for i in range(1, 4)))):
            salt = np.uint64(hash_text(kind))
            k = {int(x) for t in titles for a in artists for x in ((of(t, 0) * _MIX ^ of(a, 1)) * _MIX ^ salt) * _MIX + turn}
            at += [row] * len(k)
            keys += k
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i).take(rows) for i in range(3)), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["rep", "titles", "artists", "key"]
        )


_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _deletions(name: str) -> np.ndarray:
    """Hashes of a name without spaces, first whole, then without each of its
    letters: names of which one edit makes the other share one."""
    c = np.array([ord(x) for x in name.replace(" ", "")], np.uint64) * _MIX
    c = (c ^ (c >> np.uint64(29))) * _BASE | np.uint64(1)
    ends = np.cumsum(c * np.cumprod(np.full(len(c), _BASE), dtype=np.uint64), dtype=np.uint64)
    total = ends[-1:] if len(c) else np.zeros(1, np.uint64)
    starts = np.concatenate([np.zeros(1, np.uint64), ends[:-1]])[: len(c)]
    return np.concatenate([total, starts + (total - ends) * _INVERSE])


def _edit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of equal titles with artists one edit apart, and the reverse."""
    for b in batches:
        reps, keys = [], []
        for rep, titles, artists, kind in zip(*(b.column(i).to_pylist() for i in range(4))):
            salt = np.uint64(hash_text(kind))
            ts, xs = [_deletions(t) for t in titles], [_deletions(a) for a in artists]
            k = np.unique(np.concatenate([((h * _MIX ^ g) * _MIX ^ salt) * _MIX for t in ts for a in xs for h, g in ((t[:1], a), (t, a[:1]))]))
            reps.append(np.full(len(k), rep, np.int64))
            keys.append(k.view(np.int64))
        if reps:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(keys))], names=["rep", "key"])


#: Letters from which an edit distance is worked out a row at a time in numpy.
LONG = 64


def edits(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours is one edit."""
    if a == b:
        return 0
    if min(len(a), len(b)) >= LONG:
        return _long_edits(a, b)
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, two[j - 2] + 1)
            row.append(c)
        two, one = one, row
    return one[-1]


def _long_edits(a: str, b: str) -> int:
    """The same for long names: all letters of ``b`` at once. Insertions carry
    along a row, which is a running minimum of what the row has less its place."""
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    x = np.frombuffer(a.encode("utf-32-le"), np.uint32)
    place = np.arange(len(y) + 1)
    two, one = None, place.copy()
    for i in range(len(x)):
        row = np.empty_like(one)
        row[0] = i + 1
        row[1:] = np.minimum(one[1:] + 1, one[:-1] + (y != x[i]))
        if i:
            swap = (y[:-1] == x[i]) & (y[1:] == x[i - 1])
            row[2:] = np.where(swap, np.minimum(row[2:], two[:-2] + 1), row[2:])
        row = np.minimum.accumulate(row - place) + place
        two, one = one, row
    return int(one[-1])


def least_edits(a: str, b: str) -> int:
    """A bound of ``edits`` from below, by the letters alone."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def closeness(xs: list[str], ys: list[str]) -> tuple[float, float, str, str]:
    """Best similarity of two sets of names, its edits, and the names."""
    best = (0.0, 9.0, "", "")
    if set(xs) & set(ys):
        n = min(set(xs) & set(ys))
        return 1.0, 0.0, n, n
    for x in xs:
        for y in ys:
            a, b = x.replace(" ", ""), y.replace(" ", "")
            size = max(len(a), len(b), 1)
            if 1 - least_edits(a, b) / size <= max(best[0], 0.4):
                continue
            d = edits(a, b)
            if 1 - d / size > best[0]:
                best = (1 - d / size, float(d), x, y)
    return best


def worst_word(a: str, b: str) -> float:
    """Similarity of the words that differ most; 1 where only spaces differ."""
    if a.replace(" ", "") == b.replace(" ", ""):
        return 1.0
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return 0.0
    return min(1 - edits(p, q) / max(len(p), len(q)) for p, q in zip(x, y) if p != q)


FEATURES = 10


def features(xt: list[str], yt: list[str], xa: list[str], ya: list[str], known: set[str]) -> list[float]:
    """Features of a pair: similarity, equality and one edit of titles and of
    artists, the worst word, and whether different names are both established."""
    a, ad, a1, a2 = closeness(xa, ya)
    t, td, t1, t2 = closeness(xt, yt)
    both = lambda p, q: float(p != q and p in known and q in known)
    return [
        1.0, t, a, float(td == 0), float(ad == 0), float(td <= 1), float(ad <= 1), both(t1, t2), both(a1, a2),
        min(worst_word(t1, t2), worst_word(a1, a2)),
    ]


@dataclass
class Classifier:
    """Logistic regression on ``features``."""

    weights: np.ndarray

    def confidence(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


#: Weights until there are weak labels of both kinds: near equality of both names.
PRIOR = np.array([-14.0, 4.0, 4.0, 2.0, 2.0, 2.5, 2.5, -5.0, -5.0, 4.0])


def train(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> Classifier:
    """Fits by Newton steps, pulled to ``PRIOR`` by a quadratic penalty; the
    maximum-likelihood fit of a logistic model is calibrated on its sample."""
    w = PRIOR.copy()
    if len(y):
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + pull * (w - PRIOR)
            h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + pull * np.eye(len(w))
            step = np.linalg.solve(h, g)
            size = np.abs(step).max()
            w -= step / max(1.0, size / 2)
            if size < 1e-6:
                break
    return Classifier(w)


def _score(pairs: DataFrame, weights: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(weights)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_pylist() for i in range(2, 8)]
            x = np.array([features(t, u, a, c, {*k, *l}) for t, u, a, c, k, l in zip(*cols)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.confidence(x))], names=["rep_a", "rep_b", "confidence"])

    return map_arrow(pairs, run, "rep_a bigint, rep_b bigint, confidence double")


def _weak(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Weakly labelled pairs seen through their raw names. Both records have
    localized names; the label says whether these agree."""
    full = [F.col(f"{s}.{c}").isNotNull() for s in "ab" for c in ("title_en", "artist_en")]
    test = full[0] & full[1] & full[2] & full[3]
    label = (F.col("a.title_en") == F.col("b.title_en")) & (F.col("a.artist_en") == F.col("b.artist_en"))
    rows = (
        pairs.where(test)
        .select("a.raw_titles", "b.raw_titles", "a.raw_artists", "b.raw_artists", "a.known", "b.known", label.cast("int"), F.xxhash64("a.rep", "b.rep").alias("__turn"))
        .orderBy("__turn")
        .limit(limit)
        .collect()
    )
    x = [features(r[0], r[1], r[2], r[3], {*r[4], *r[5]}) for r in rows]
    y = np.array([r[6] for r in rows], float)
    x = np.array(x).reshape(-1, FEATURES)
    seen = (x[:, 1] > 0.5) & (x[:, 2] > 0.5)  # other pairs are linked by language only
    return x[seen], y[seen]


def match_records(df: DataFrame, key: str, source: str, threshold: float = 0.5, max_train: int = MAX_TRAIN_PAIRS) -> DataFrame:
    """``(id_a, id_b, confidence)`` of every pair of rows of different sources
    whose confidence is at least ``threshold``, ``id_a < id_b``.

    ``df`` has ``key`` (unique), ``source`` and the columns of ``FIELDS``. Rows
    match if they name the same title by the same artist in the same version
    and part; guests, ratings and albums make no difference. Rows without a
    title or artist, or without a key or source, match nothing. Repeated rows
    of a key count once. Null and empty names are missing; names of any length
    are compared whole. Other columns are ignored, and an empty table gives no pairs.

    Rows with the same names are one representative, so copies are never
    compared (see ``match_classes``); they meet only in the pairs returned here.
    """
    links, m = match_classes(df, key, source, threshold, max_train)
    both = links.unionByName(links.where("rep_a <> rep_b").select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"), "confidence"))
    left = m.select(F.col("id").alias("id_a"), F.col("origin").alias("__o"), F.col("rep").alias("rep_a"))
    right = m.select(F.col("id").alias("id_b"), F.col("origin").alias("__p"), F.col("rep").alias("rep_b"))
    out = both.join(left, "rep_a").join(right, "rep_b").where("id_a < id_b and __o <> __p")
    return out.select("id_a", "id_b", "confidence")


def match_classes(df: DataFrame, key: str, source: str, threshold: float = 0.5, max_train: int = MAX_TRAIN_PAIRS) -> tuple[DataFrame, DataFrame]:
    """The same without expanding copies: pairs of representatives ``(rep_a,
    rep_b, confidence)``, one with itself if its rows match each other, and the
    membership ``(id, origin, rep)`` of every row with a title and an artist."""
    src = df.select(F.col(key).cast("bigint").alias("id"), F.lower(F.trim(F.col(source))).alias("origin"), *[F.col(f).cast("string").alias(f) for f in FIELDS])
    parsed = map_arrow(
        src.where("id is not null and origin is not null"),
        _parse,
        "id bigint, origin string, titles array<string>, artists array<string>, title_en string, title_ko string, "
        "artist_en string, artist_ko string, artist_seen string, version string, part string",
    )
    rows = materialize(parsed.where("size(titles) > 0 and size(artists) > 0").dropDuplicates(["id"]), "parsed")
    title_words = _dictionary(rows, "titles", ["title_en", "title_ko"], single=False)
    artist_words = _dictionary(rows, "artists", ["artist_en", "artist_seen", "artist_ko"], single=True)
    t = _resolved(rows, "titles", title_words)
    a = _resolved(rows, "artists", artist_words)
    flat = rows.select("id", "origin", "version", "part", "title_en", "artist_en", F.col("titles").alias("raw_titles"), F.col("artists").alias("raw_artists"))
    named = flat.join(t, "id").join(a, "id")
    named = named.withColumn("rep", F.xxhash64(F.col("titles"), F.col("artists"), "version", "part"))
    named = materialize(named, "named")
    raw = F.min(F.struct("id", "title_en", "artist_en", F.slice("raw_titles", 1, 1).alias("raw_titles"), F.slice("raw_artists", 1, 1).alias("raw_artists")))
    reps = named.groupBy("rep").agg(
        F.first("titles").alias("titles"), F.first("artists").alias("artists"), F.first("version").alias("version"), F.first("part").alias("part"),
        F.array_union(F.first("titles_known"), F.first("artists_known")).alias("known"), raw.alias("raw"),
    ).select("rep", "titles", "artists", "version", "part", "known", "raw.title_en", "raw.artist_en", "raw.raw_titles", "raw.raw_artists")
    reps = materialize(reps, "reps")
    lists = "titles array<string>, artists array<string>"
    keys = map_arrow(reps.select("rep", "titles", "artists", F.concat_ws("|", "version", "part")), _bands, f"rep bigint, {lists}, key bigint")
    keys = materialize(keys, "keys")
    long = lambda x, y: F.greatest(F.length(x), F.length(y)) * EDIT_SHARE
    near_names = lambda x, y: (F.levenshtein(x, y, MOST_EDITS) >= 0) | ((long(x, y) > MOST_EDITS) & (F.levenshtein(x, y) <= long(x, y)))
    close = lambda c: F.exists(f"k.{c}", lambda x: F.exists(f"l.{c}", lambda y: near_names(x, y)))
    met = (F.col("k.key") == F.col("l.key")) & (F.col("k.rep") < F.col("l.rep"))
    near = keys.alias("k").join(keys.alias("l"), met & close("artists") & close("titles"))
    typos = map_arrow(reps.select("rep", "titles", "artists", F.concat_ws("|", "version", "part")), _edit_keys, "rep bigint, key bigint")
    typos = materialize(typos, "typos")
    single = typos.alias("k").join(typos.alias("l"), met)
    ends = [F.col("k.rep").alias("x"), F.col("l.rep").alias("y")]
    near = materialize(near.select(*ends).union(single.select(*ends)).distinct(), "near")
    pairs = near.join(reps.alias("a"), F.col("x") == F.col("a.rep")).join(reps.alias("b"), F.col("y") == F.col("b.rep"))
    pairs = pairs.where("a.version = b.version and a.part = b.part")
    pairs = materialize(
        pairs.select("x", "y", *[F.struct(*[F.col(f"{s}.{c}") for c in reps.columns]).alias(s) for s in "ab"]), "pairs"
    )
    model = train(*_weak(pairs, max_train))
    scored = _score(pairs.select("x", "y", "a.titles", "b.titles", "a.artists", "b.artists", "a.known", "b.known").toDF("x", "y", "t", "u", "a", "c", "k", "l"), model.weights)
    same = float(model.confidence(np.array([features(["x"], ["x"], ["y"], ["y"], set())]))[0])
    links = scored.where(F.col("confidence") >= threshold)
    if same >= threshold:
        links = links.unionByName(reps.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.lit(same).alias("confidence")))
    return links, named.select("id", "origin", "rep")
