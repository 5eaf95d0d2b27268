"""Byte-level BPE of whole corpora in numpy.

Texts are cut into words by the tokenizer's pattern. The distinct words of a
batch are laid out in padded matrices by length; in every round each row merges
its leftmost pair of minimum rank, found by a hashed pair lookup, and rows
that are done leave the matrix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.runtime import map_arrow

#: Place of the vocabulary file; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public word pattern of this kind of tokenizer.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

NONE = np.int32(2**31 - 1)
#: Words remembered by a task before it forgets them all: bounds its memory.
REMEMBERED = 300_000
#: Rows of a matrix times its width; wider words get a matrix of their own.
CELLS = 1 << 20
#: From this width on all places of a row's minimum pair merge in one round.
WIDE = 64
TEXTS = 512


class PairTable:
    """Open-addressing hash table from token pairs to ranks."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo, self.probes = self._slot(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] < 0
            at, first = np.unique(np.where(free, slot[todo], -1 - todo), return_index=True)
            take = todo[first[at >= 0]]
            self.keys[slot[take]], self.ranks[slot[take]] = key[take], rank[take]
            placed = np.zeros(len(key), bool)
            placed[take] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where there is none or a side is padding."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        out = np.full(key.shape, NONE, np.int32)
        seen = self.keys[slot]
        hit = seen == key
        out[hit] = self.ranks[slot[hit]]
        open_ = np.flatnonzero(~hit & (seen >= 0) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class Encoder:
    """Encodes texts by the ranks of a vocabulary file."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.single = np.zeros(256, np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = r
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.cut = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        first = np.cumsum(size) - size
        order = np.argsort(size, kind="stable")
        flat, lens = [], np.zeros(len(raw), np.int64)
        at = 0
        while at < len(order):
            width = int(size[order[at]])
            width = width if width <= 8 else 1 << (width - 1).bit_length()  # bucket
            end = int(np.searchsorted(size[order], width, "right"))
            step = max(1, CELLS // width)
            for i in range(at, end, step):
                rows = order[i : min(i + step, end)]
                wide = int(size[rows].max())
                inside = np.arange(wide) < size[rows][:, None]
                m = np.full((len(rows), wide), -1, np.int32)
                m[inside] = data[np.repeat(first[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(int(size[rows].sum()))]
                ids, n = self._merge(m)
                flat.append((rows, ids, n))
                lens[rows] = n
            at = end
        start = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), np.int32)
        for rows, ids, n in flat:
            out[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        base = len(self.place)
        self.place.update(zip(words, range(base, base + len(words))))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lens)])
        self.ids = np.concatenate([self.ids, out])

    def _merge(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows, one after the other, and their numbers."""
        n, done = len(m), [None] * 0
        where = np.arange(n)
        r = self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(n, -1) if m.shape[1] > 1 else np.full((n, 0), NONE, np.int32)
        while len(m):
            if not r.shape[1]:
                done.append((where, m))
                break
            at = r.argmin(axis=1)
            best = r[np.arange(len(m)), at]
            open_ = best < NONE
            if not open_.all():
                done.append((where[~open_], m[~open_]))
                m, r, at, best, where = m[open_], r[open_], at[open_], best[open_], where[open_]
                if not len(m):
                    break
            if m.shape[1] >= WIDE:
                m = self._merge_wide(m, r, best)
                r = self.pairs.find(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
                continue
            i = np.arange(len(m))
            m[i, at] = best  # a merged token's id is its rank
            keep = np.ones(m.shape, bool)
            keep[i, at + 1] = False
            m = m[keep].reshape(len(i), -1)
            keep = np.ones(r.shape, bool)
            keep[i, at] = False
            r = r[keep].reshape(len(i), -1)
            if r.shape[1]:
                j = at > 0
                r[i[j], at[j] - 1] = self.pairs.find(m[i[j], at[j] - 1], m[i[j], at[j]])
                j = at < r.shape[1]
                r[i[j], at[j]] = self.pairs.find(m[i[j], at[j]], m[i[j], at[j] + 1])
            used = int((m >= 0).sum(axis=1).max())
            if used <= m.shape[1] * 3 // 4:  # compaction of columns that are padding in every row
                m, r = m[:, :used], r[:, : max(0, used - 1)]
        lens = np.zeros(n, np.int64)
        for rows, x in done:
            lens[rows] = (x >= 0).sum(axis=1)
        start = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), np.int32)
        for rows, x in done:
            k = lens[rows]
            out[np.repeat(start[rows] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))] = x[x >= 0]
        return out, lens

    @staticmethod
    def _merge_wide(m: np.ndarray, r: np.ndarray, best: np.ndarray) -> np.ndarray:
        """All places of each row's minimum pair, leftmost first, in one round:
        a merge never makes a pair that ranks before it."""
        hit = r == best[:, None]
        i = np.arange(hit.shape[1])
        gap = np.maximum.accumulate(np.where(hit, -1, i), axis=1)  # last place without a hit
        hit &= (i - gap) % 2 == 1  # of overlapping hits every other one
        drop = np.zeros(m.shape, bool)
        drop[:, 1:] = hit
        m = m.copy()
        m[:, :-1][hit] = np.broadcast_to(best[:, None], hit.shape)[hit]
        keep = ~drop & (m >= 0)
        n = keep.sum(axis=1)
        out = np.full((len(m), max(1, int(n.max()))), -1, np.int32)
        out[np.arange(out.shape[1]) < n[:, None]] = m[keep]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and int64 offsets; null and
        empty texts have none."""
        cut = self.cut
        words = [cut(x) if x else [] for x in texts]
        flat = list(chain.from_iterable(words))
        place = self.place
        fresh = [w for w in dict.fromkeys(flat) if w not in place]
        if len(place) + len(fresh) > REMEMBERED and place:
            self._forget()
            place, fresh = self.place, list(dict.fromkeys(flat))
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
        n = self.start[at + 1] - self.start[at]
        ids = self.ids[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        ends = np.concatenate([[0], np.cumsum(n)])
        per = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        return ids, np.concatenate([[0], ends[per]]).astype(np.int64)


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary (about a megabyte) as a broadcast, read by the driver:
    executors need no copy of the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _run(df: DataFrame, text: str, output: str, kind: str, vocabulary: str, emit) -> DataFrame:
    keep = [c for c in df.columns if c not in (output, text)]
    src = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    schema = ", ".join([*(f"`{c}` {k}" for c, k in src.dtypes[:-1]), f"`{output}` {kind}"])
    words = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(words.value)
        for b in batches:
            for i in range(0, b.num_rows, TEXTS):
                part = b.slice(i, TEXTS)
                ids, offs = encoder.encode(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), emit(ids, offs)], names=[*keep, output])

    return map_arrow(src, run, schema)


def encode(df: DataFrame, text: str = "text", output: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with ``output``, the list of its token ids.

    No special tokens are added, and their strings in a text are ordinary text.
    The ids of null and of empty texts are an empty list, never null. Repeated
    rows stay, texts of any length are encoded whole, and other columns are
    kept; one named like ``output`` is replaced.
    """

    def lists(ids: np.ndarray, offs: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))

    return _run(df, text, output, "array<int>", vocabulary, lists)


def count_tokens(df: DataFrame, text: str = "text", output: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``encode``, but with the number of ids; 0 for null and empty texts."""
    return _run(df, text, output, "bigint", vocabulary, lambda ids, offs: pa.array(np.diff(offs)))


def decode(df: DataFrame, ids: str = "ids", output: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of its token ids: the round trip of ``encode``.
    Null ids give null, no ids an empty text; ids outside of the vocabulary and
    bytes that are no UTF-8 become U+FFFD."""
    keep = [c for c in df.columns if c not in (output, ids)]
    src = df.select(*[df[c] for c in keep], df[ids].alias("__ids"))
    schema = ", ".join([*(f"`{c}` {k}" for c, k in src.dtypes[:-1]), f"`{output}` string"])
    words = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {int(b): base64.b64decode(a) for a, b in map(bytes.split, words.value.splitlines()) if a}
        unknown = "�".encode()
        for b in batches:
            texts = [
                None if x is None else b"".join(token.get(i, unknown) for i in x).decode("utf-8", "replace")
                for x in b.column(len(keep)).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, output])

    return map_arrow(src, run, schema)


def token_statistics(counted: DataFrame, by: str, tokens: str = "n_tokens") -> DataFrame:
    """Documents and tokens per value of ``by``; null is a value of its own."""
    return counted.groupBy(by).agg(F.count("*").alias("documents"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("longest"))
