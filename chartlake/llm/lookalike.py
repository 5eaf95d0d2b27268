"""One consistent form of text that looks the same but differs in characters.

Texts are copied from Arrow to code-point arrays. Lookup tables give each code
point's compatibility form, class and script by gathers; forms of several code
points are laid out by expansion offsets; marks and Hangul letters are composed
in rounds over all rows at once. No string is touched row by row.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from chartlake.llm.codepoints import chunks, from_codepoints, offsets_of, row_ids, to_codepoints
from chartlake.runtime import map_arrow

SIZE = sys.maxunicode + 1
ZWNJ, ZWJ, VS15, VS16, KEYCAP, FLAG = 0x200C, 0x200D, 0xFE0E, 0xFE0F, 0x20E3, 0x1F3F4
LATIN, CYRILLIC, GREEK, ARMENIAN, OTHER, MARK = 1, 2, 3, 4, 5, 6

# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    CYRILLIC: {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
        "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
        "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
        "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    },
    GREEK: {
        "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
        "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    },
    ARMENIAN: {"օ": "o", "ո": "n", "հ": "h", "ս": "u", "յ": "j", "ց": "g", "զ": "q", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L"},
}

# Ranges of emoji and of marks and letters that are not seen.
EMOJI = ((0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139), (0x2190, 0x21FF), (0x2300, 0x23FF),
         (0x24C2, 0x24C2), (0x25A0, 0x27BF), (0x2900, 0x297F), (0x2B00, 0x2BFF), (0x3030, 0x3030), (0x303D, 0x303D),
         (0x3297, 0x3299), (0xA9, 0xA9), (0xAE, 0xAE), (0x1F000, 0x1FAFF))
UNSEEN = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F),
          (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
SPACES = (0x9, 0xA, 0xB, 0xC, 0xD, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))
#: Scripts whose spelling uses joiners.
JOINED = (0x600, 0x109F)
#: Format characters that are written: number signs of Arabic and others.
WRITTEN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


class Tables:
    """Lookup tables over all code points, built once per process from the
    Unicode database of the interpreter."""

    def __init__(self) -> None:
        self.unseen = np.zeros(SIZE, bool)
        self.emoji = np.zeros(SIZE, bool)
        self.maybe = np.zeros(SIZE, bool)
        self.ccc = np.zeros(SIZE, np.uint8)
        self.script = np.zeros(SIZE, np.uint8)
        pairs: dict[int, int] = {}
        compat, full = {}, {}
        for cp in range(SIZE):
            if 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp < 0xA000 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xF0000:
                continue
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind == "Cn":
                continue
            self.ccc[cp] = unicodedata.combining(ch)
            if kind[0] == "M":
                self.script[cp] = MARK
            elif kind[0] == "L":
                self.script[cp] = OTHER
            if (kind == "Cf" and cp not in WRITTEN) or kind == "Cc":
                self.unseen[cp] = True
            if 0xAC00 <= cp < 0xD7A4:
                d = unicodedata.normalize("NFKD", ch)
            else:
                d = unicodedata.normalize("NFKD", ch)
                if d == ch or d[0] == " " and len(d) > 1:
                    continue
                c = unicodedata.normalize("NFKC", ch)
                if c != ch:
                    compat[cp] = c
                plain = unicodedata.decomposition(ch)
                if plain and plain[0] != "<" and c == ch:
                    two = [int(x, 16) for x in plain.split()]
                    if len(two) == 2:
                        pairs[two[0] << 21 | two[1]] = cp
                        self.maybe[two[1]] = True
            full[cp] = d
        self.script[0x3400:0xA000] = OTHER
        self.script[0x20000:0x2F800] = OTHER
        self.maybe |= self.ccc > 0
        self.maybe[0x1161:0x1176] = self.maybe[0x11A8:0x11C3] = True
        for a, b in EMOJI:
            self.emoji[a : b + 1] = True
        for a, b in UNSEEN:
            self.unseen[a : b + 1] = True
        for cp in SPACES:
            self.unseen[cp] = False
        self.space = np.zeros(SIZE, bool)
        self.space[list(SPACES)] = True
        for cp in [*range(0x41, 0x530), *range(0x530, 0x590), *range(0x1C80, 0x1C90), *range(0x1E00, 0x2000), *range(0x2C60, 0x2C80), *range(0xA640, 0xA6A0), *range(0xA720, 0xA800)]:
            if self.script[cp] == OTHER:
                name = unicodedata.name(chr(cp), "")
                for at, word in ((LATIN, "LATIN"), (CYRILLIC, "CYRILLIC"), (GREEK, "GREEK"), (ARMENIAN, "ARMENIAN")):
                    if name.startswith(word + " "):
                        self.script[cp] = at
        self.compat, self.full = _flat(compat), _flat(full)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        self.to = {s: np.zeros(SIZE, np.uint32) for s in (LATIN, CYRILLIC, GREEK, ARMENIAN)}
        for s, letters in LOOKALIKES.items():
            for a, b in letters.items():
                self.to[LATIN][ord(a)] = ord(b)
                if not self.to[s][ord(b)]:
                    self.to[s][ord(b)] = ord(a)
        for s in LOOKALIKES:  # and among the others, by way of Latin
            for other in LOOKALIKES:
                if other != s:
                    for a, b in LOOKALIKES[other].items():
                        self.to[s][ord(a)] = self.to[s][ord(b)]


def _flat(table: dict[int, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A mapping to strings as (start, length, code points); start -1: as it is."""
    start, length = np.full(SIZE, -1, np.int32), np.ones(SIZE, np.uint8)
    flat, at = [], 0
    for cp, text in table.items():
        start[cp], length[cp] = at, len(text)
        flat.append(text)
        at += len(text)
    return start, length, np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32)


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def _expand(cps: np.ndarray, rows: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    start, length, flat = table
    at = start[cps]
    if (at < 0).all():
        return cps, rows
    n = length[cps].astype(np.int64)
    first = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(at, n)
    return np.where(at < 0, np.repeat(cps, n), flat[np.where(at < 0, 0, at + inner)]), np.repeat(rows, n)


def _lookup(a: np.ndarray, b: np.ndarray, t: Tables) -> np.ndarray:
    """The composite of each pair, 0 where there is none."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    key = a << 21 | b
    at = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
    out = np.where(t.pair_keys[at] == key, t.pair_to[at], 0).astype(np.int64)
    lead, vowel, tail = a - 0x1100, b - 0x1161, b - 0x11A7
    lv = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
    out = np.where(lv, 0xAC00 + (lead * 21 + vowel) * 28, out)
    block = a - 0xAC00
    lvt = (block >= 0) & (block < 11172) & (block % 28 == 0) & (tail > 0) & (tail < 28)
    return np.where(lvt, a + tail, out).astype(np.uint32)


def _compose(cps: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of decomposed text, all rows at once."""
    ccc = t.ccc[cps]
    turn = np.ones(len(cps), bool)
    turn[1:] = (ccc[1:] == 0) | (rows[1:] != rows[:-1])
    order = np.lexsort((ccc, np.cumsum(turn)))
    cps, rows, ccc = cps[order].copy(), rows[order], ccc[order]
    tried = np.zeros(len(cps), bool)
    while len(cps) > 1:
        i = np.arange(len(cps))
        starter = np.maximum.accumulate(np.where(ccc == 0, i, -1))
        prior = np.concatenate([[-1], starter[:-1]])
        base = np.where(ccc == 0, prior, starter)  # the starter that may take this
        ok = (base >= 0) & ~tried
        ok &= rows[np.maximum(base, 0)] == rows
        gap = i - 1 != base
        before = np.concatenate([[0], ccc[:-1]])
        ok &= ~(gap & ((ccc == 0) | (before >= ccc)))
        at = np.flatnonzero(ok)
        made = _lookup(cps[base[at]], cps[at], t)
        at, made = at[made > 0], made[made > 0]
        if not len(at):
            break
        _, one = np.unique(base[at], return_index=True)  # the first of each starter
        at, made = at[one], made[one]
        eaten = np.zeros(len(cps), bool)
        eaten[at] = True
        free = ~eaten[base[at]]  # not of a starter that is itself taken now
        eaten[at[~free]] = False
        at, made = at[free], made[free]
        cps[base[at]] = made
        took = np.full(len(cps), -1)
        took[base[at]] = at
        tried |= (ccc > 0) & (i < took[np.maximum(starter, 0)])
        keep = ~eaten
        cps, rows, ccc, tried = cps[keep], rows[keep], ccc[keep], tried[keep]
    return cps, rows


def _visible(cps: np.ndarray, rows: np.ndarray, t: Tables) -> np.ndarray:
    """False for invisible characters, save those inside emoji and joiners of
    scripts that are spelled with them."""
    keep = ~t.unseen[cps]
    at = np.flatnonzero(~keep)
    if not len(at):
        return keep
    last = len(cps) - 1

    def near(step: np.ndarray) -> np.ndarray:
        """The code points at ``at + step``, 0 beyond the row."""
        to = at + step
        inside = (to >= 0) & (to <= last)
        to = np.clip(to, 0, last)
        return np.where(inside & (rows[to] == rows[at]), cps[to], 0)

    one = np.ones(len(at), np.int64)
    me, prev, nxt = cps[at], near(-one), near(one)
    selector = (me == VS16) | (me == VS15)
    digit = ((prev >= 0x30) & (prev <= 0x39)) | (prev == 0x23) | (prev == 0x2A)
    stay = selector & (t.emoji[prev] | (digit & (nxt == KEYCAP)))
    before = np.where((prev == VS16) | (prev == VS15), near(-2 * one), prev)
    stay |= (me == ZWJ) & t.emoji[before] & t.emoji[nxt]
    stay |= ((me == ZWJ) | (me == ZWNJ)) & (prev >= JOINED[0]) & (prev <= JOINED[1])
    tag = (me >= 0xE0020) & (me <= 0xE007F)
    if tag.any():
        plain = (cps < 0xE0020) | (cps > 0xE007F)
        lead = np.maximum.accumulate(np.where(plain, np.arange(len(cps)), 0))[at]
        stay |= tag & (cps[lead] == FLAG) & (rows[lead] == rows[at])
    keep[at] = stay
    return keep


def _one_script(cps: np.ndarray, rows: np.ndarray, n: int, t: Tables) -> np.ndarray:
    """Replaces look-alike letters word by word."""
    script = t.script[cps]
    foreign = (script >= CYRILLIC) & (script <= ARMENIAN)
    if not foreign.any():
        return cps
    inside = (script >= LATIN) & (script <= ARMENIAN) | (script == MARK)
    begins = inside.copy()
    begins[1:] &= ~(inside[:-1] & (rows[1:] == rows[:-1]))
    word = np.cumsum(begins) - 1
    at = np.flatnonzero(inside)
    cp, s, w = cps[at], script[at], word[at]
    words = int(begins.sum())
    row = rows[begins]
    count = {k: np.bincount(w[s == k], minlength=words) for k in (LATIN, CYRILLIC, GREEK, ARMENIAN)}
    scripts = sum((count[k] > 0).astype(np.int8) for k in count)
    strict = {k: np.bincount(w[(s == k) & (t.to[LATIN][cp] == 0)], minlength=words) for k in LOOKALIKES}
    bound = {k: np.bincount(w[(s == LATIN) & (t.to[k][cp] == 0)], minlength=words) for k in LOOKALIKES}
    row_has = lambda flag: np.bincount(row[flag], minlength=n)[row] > 0
    latin_row = row_has((count[LATIN] > 0) & (scripts == 1))
    target = np.zeros(words, np.uint8)
    genuine = {}
    mixed = scripts > 1
    for k in LOOKALIKES:  # a word with strict letters of a script, and of it only or else look-alike, is of that script
        others = sum((strict[o] for o in LOOKALIKES if o != k), np.zeros(words, int))
        owns = (strict[k] > 0) & (bound[k] == 0) & (others == 0)
        genuine[k] = row_has(owns)
        target[mixed & owns] = k
    loose = sum(strict.values()) == 0
    for k in LOOKALIKES:  # no strict letter: the row, then the majority, decides
        may = mixed & loose & (count[k] > 0) & (bound[k] == 0) & (target == 0)
        target[may & (genuine[k] | (~latin_row & (count[k] > count[LATIN])))] = k
    target[mixed & (target == 0) & (loose | (count[LATIN] >= sum(count[k] for k in LOOKALIKES)))] = LATIN
    latin_word = row_has((target == LATIN) | (count[LATIN] > 0) & (scripts == 1))
    for k in LOOKALIKES:  # whole words in look-alike letters
        target[(scripts == 1) & (count[k] > 0) & (strict[k] == 0) & latin_word & ~genuine[k]] = LATIN
    out = cps.copy()
    for k in (LATIN, *LOOKALIKES):
        i = at[(target[w] == k) & (s != k)]
        new = t.to[k][cps[i]]
        out[i] = np.where(new > 0, new, cps[i])
    return out


def canonical(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of every row."""
    t, n = tables(), len(offsets) - 1
    if not len(cps) or int(cps.max()) < 0x7F and int(cps.min()) >= 0x20:
        return cps, offsets
    rows = row_ids(offsets)
    keep = _visible(cps, rows, t)
    cps, rows = cps[keep], rows[keep]
    cps, rows = _expand(cps, rows, t.compat)
    open_ = t.maybe[cps]
    if open_.any():
        some = np.zeros(n, bool)
        some[rows[open_]] = True
        part = some[rows]
        a, ra = _expand(cps[part], rows[part], t.full)
        a, ra = _compose(a, ra, t)
        cps, rows = np.concatenate([cps[~part], a]), np.concatenate([rows[~part], ra])
        order = np.argsort(rows, kind="stable")
        cps, rows = cps[order], rows[order]
    keep = _visible(cps, rows, t)  # forms may hold fillers
    cps, rows = cps[keep], rows[keep]
    cps = np.where(t.space[cps], np.uint32(0x20), cps)
    return _one_script(cps, rows, n, t), offsets_of(rows, n)


def canonical_array(arr: pa.Array) -> pa.Array:
    """``canonical`` of an Arrow string array; null stays null."""
    out = []
    for a, b in chunks(arr):
        part = arr.slice(a, b - a)
        cps, offs = canonical(*to_codepoints(part))
        out.append(from_codepoints(cps, offs, part.is_null().to_numpy(zero_copy_only=False)))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def canonical_text(df: DataFrame, column: str, output: str = "canonical") -> DataFrame:
    """``df`` with ``output``: ``column`` in one consistent form.

    Full-width and other compatibility forms become ordinary characters; marks
    and Hangul letters are composed; invisible characters go, save those inside
    emoji and joiners of scripts that need them; all spaces become U+0020;
    look-alike letters follow the script of their word, and a whole word in
    look-alike letters becomes Latin if the text has Latin words and no genuine
    word of that script.

    Null stays null, empty stays empty, texts of any length are worked on
    whole; repeated rows stay; all other columns are kept, and one named like
    ``output`` is replaced. Genuine words of other scripts, composed accents,
    typographic apostrophes and emoji stay as they are.
    """
    keep = [c for c in df.columns if c != output]
    at = keep.index(column) if column in keep else None
    src = df.select(*[df[c] for c in keep], *([] if at is not None else [df[column].alias("__text")]))
    at = at if at is not None else len(keep)
    schema = ", ".join(f"`{c}` {k}" for c, k in src.dtypes if c != "__text") + f", `{output}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, canonical_array(b.column(at))], names=[*keep, output])

    return map_arrow(src, run, schema)
