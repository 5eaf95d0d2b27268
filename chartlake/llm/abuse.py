"""Abusive, hateful and sexual content, by a character n-gram linear classifier.

Its features are n-grams of characters scaled by naive Bayes log-count ratios
(the NB-SVM form of Wang and Manning, 2012, with a logistic loss). A document is
abusive if some window of it is: its score is that of its highest window, and
training alternates between choosing the window that stands for each abusive
document and fitting the classifier. Labels are cleaned by cross-fitting.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chartlake.llm.codepoints import chunks, offsets_of, row_ids, to_codepoints
from chartlake.llm.lookalike import LATIN, OTHER, canonical, tables
from chartlake.runtime import map_arrow

#: Labelled documents that training uses at most, a third of them abusive, chosen
#: by a hash of their id.
MAX_TRAIN_DOCS = 8_000
#: Characters of them that training uses at most: whole documents, in that order.
MAX_TRAIN_CHARS = 16_000_000
BITS = 20
GRAMS = (2, 3, 4, 5)
TIGHT = (3, 4, 5)
#: Labelled documents that a gram needs.
MIN_DOCS = 2
#: Share of the judgements that is taken to be wrong.
NOISE = 0.06
#: Held-out scores below or above which a label abusive, or not abusive, is left out.
DOUBT, SURE = -1.0, 8.0
#: Characters of a window.
WINDOW = 40

# Signs that stand for letters inside words.
SIGNS = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "(": "c", "8": "b", "€": "e", "|": "l", "+": "t"}


@lru_cache(1)
def _lower() -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x20000):
        if not 0xD800 <= cp < 0xE000:
            low = chr(cp).lower()
            if len(low) == 1:
                out[cp] = ord(low)
    return out


@lru_cache(1)
def _signs() -> np.ndarray:
    out = np.zeros(0x110000, np.uint32)
    for a, b in SIGNS.items():
        out[ord(a)] = ord(b)
    return out


def plain(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text without its disguises, and its row ids: consistent characters,
    lower case, signs inside words as letters, marks between letters dropped,
    runs of a character shortened."""
    n = len(offsets) - 1
    cps, offsets = canonical(cps, offsets)
    rows = row_ids(offsets)
    cps = _lower()[cps]
    if not len(cps):
        return cps, rows
    script = tables().script

    def sides() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = script[cps]
        letter = (s >= LATIN) & (s <= OTHER)
        same = rows[1:] == rows[:-1]
        left, right = np.zeros(len(cps), bool), np.zeros(len(cps), bool)
        left[1:] = letter[:-1] & same
        right[:-1] = letter[1:] & same
        return letter, left, right

    for _ in range(2):  # signs may stand side by side
        _, left, right = sides()
        to = _signs()[cps]
        near = np.where((cps == 0x28) | (cps == 0x21) | (cps == 0x7C) | (cps == 0x2B), left & right, left | right)
        latin = np.zeros(len(cps), bool)
        s = script[cps] == LATIN
        latin[1:] |= s[:-1]
        latin[:-1] |= s[1:]
        swap = (to > 0) & near & latin
        cps = np.where(swap, to, cps)
    _, left, right = sides()
    drop = ((cps == 0x2E) | (cps == 0x2D) | (cps == 0x5F) | (cps == 0xB7) | (cps == 0x27) | (cps == 0x7E)) & left & right
    run = np.zeros(len(cps), bool)
    run[2:] = (cps[2:] == cps[1:-1]) & (cps[2:] == cps[:-2]) & (rows[2:] == rows[:-2])
    star = np.zeros(len(cps), bool)
    star[1:] = (cps[1:] == 0x2A) & (cps[:-1] == 0x2A) & (rows[1:] == rows[:-1])
    keep = ~(drop | run | star)
    return cps[keep], rows[keep]


def _hashes(x: np.ndarray, rows: np.ndarray, sizes: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """Hashed n-grams that end at each position; 0 where the row is too short."""
    mul, mix = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    one = (x.astype(np.uint64) + np.uint64(seed)) * mul
    h, out = one.copy(), []
    for n in range(2, max(sizes) + 1):
        nxt = np.zeros_like(h)
        nxt[1:] = h[:-1] * mix + one[1:]
        h = nxt
        if n in sizes:
            ok = np.zeros(len(x), bool)
            if len(x) >= n:
                ok[n - 1 :] = rows[n - 1 :] == rows[: len(x) - n + 1]
            at = ((h ^ (h >> np.uint64(29))) * mul >> np.uint64(64 - BITS)).astype(np.int32)
            out.append(np.where(ok, np.maximum(at, 1), 0))
    return out


def grams(cps: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The features at each position: n-grams of the text, and n-grams of its
    letters alone, which span spaces and signs put inside words."""
    out = np.zeros((len(GRAMS) + len(TIGHT), len(cps)), np.int32)
    for k, h in enumerate(_hashes(cps, rows, GRAMS, 0)):
        out[k] = h
    s = tables().script[cps]
    at = np.flatnonzero((s >= LATIN) & (s <= OTHER))
    for k, h in enumerate(_hashes(cps[at], rows[at], TIGHT, 1 << 21)):
        out[len(GRAMS) + k, at] = h
    return out


def _window_sums(c: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(c, dtype=np.float64)])
    i = np.arange(len(c))
    return total[1:] - total[np.maximum(i + 1 - WINDOW, offsets[rows])]


@dataclass
class Model:
    """Weights of the hashed n-grams, and the line that makes a highest
    window's sum a calibrated log-odds."""

    weights: np.ndarray
    slope: float = 1.0
    bias: float = 0.0

    def raw(self, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The highest window sum of each row; an empty row has ``-inf``."""
        n = len(offsets) - 1
        x, rows = plain(cps, offsets)
        out = np.full(n, -np.inf)
        if len(x):
            offs = offsets_of(rows, n)
            c = np.zeros(len(x), np.float32)
            for h in grams(x, rows):
                c += self.weights[h]
            w = _window_sums(c, rows, offs)
            some = np.flatnonzero(np.diff(offs))
            out[some] = np.maximum.reduceat(w, offs[some])
        return out

    def probability(self, arr: pa.Array) -> np.ndarray:
        parts = [self.raw(*to_codepoints(arr.slice(a, b - a))) for a, b in chunks(arr, 1 << 20)]
        raw = np.concatenate(parts) if parts else np.zeros(0)
        empty = np.isinf(raw)
        z = np.clip(self.slope * np.where(empty, 0.0, raw) + self.bias, -50, 50)
        return np.where(empty, 0.0, 1 / (1 + np.exp(-z)))


class _Sample:
    """The labelled documents as compact features at each position."""

    def __init__(self, texts: list[str], y: np.ndarray) -> None:
        self.y, self.n = y, len(texts)
        x, rows = plain(*to_codepoints(pa.array(texts, pa.string())))
        self.offsets, self.rows = offsets_of(rows, self.n), rows
        self.some = np.flatnonzero(np.diff(self.offsets))
        g = grams(x, rows)
        # Rarer grams are mostly names.
        seen = np.zeros(1 << BITS, np.int32)
        for a, b in zip(self.offsets, self.offsets[1:]):
            seen[np.unique(g[:, a:b])] += 1
        seen[0] = 0
        self.kept = np.flatnonzero(seen >= MIN_DOCS)
        place = np.zeros(1 << BITS, np.int32)
        place[self.kept] = np.arange(1, len(self.kept) + 1)
        for i in range(len(g)):
            g[i] = place[g[i]]
        self.g, self.size = g, len(self.kept) + 1

    def document_ratios(self, use: np.ndarray) -> np.ndarray:
        """Naive Bayes log-count ratios by documents that have a gram."""
        p, q = np.ones(self.size), np.ones(self.size)
        for i in np.flatnonzero(use):
            (p if self.y[i] else q)[np.unique(self.g[:, self.offsets[i] : self.offsets[i + 1]])] += 1
        return _ratios(p, q, 1.0 + (use & self.y).sum(), 1.0 + (use & ~self.y).sum())

    def sums(self, w: np.ndarray) -> np.ndarray:
        c = np.zeros(self.g.shape[1])
        for row in self.g:
            c += w[row]
        return _window_sums(c, self.rows, self.offsets)

    def highest(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest window sum of each document and where it ends."""
        best, at = np.full(self.n, -1e3), np.full(self.n, -1)
        if len(self.some):
            best[self.some] = np.maximum.reduceat(sums, self.offsets[self.some])
            hit = np.flatnonzero(sums == best[self.rows])
            at[self.rows[hit[::-1]]] = hit[::-1]
        return best, at

    def features(self, ends: np.ndarray) -> np.ndarray:
        """The grams of the windows that end there, one window per row."""
        pos = ends[:, None] - np.arange(WINDOW)
        inside = pos >= self.offsets[self.rows[ends]][:, None]
        pos = np.where(inside, pos, 0)
        return np.concatenate([np.where(inside, g[pos], 0) for g in self.g], axis=1)


def _ratios(p: np.ndarray, q: np.ndarray, np_: float, nq: float) -> np.ndarray:
    r = np.log(p / np_) - np.log(q / nq)
    r[0] = 0
    return r


def _fit(f: np.ndarray, y: np.ndarray, size: int, steps: int = 60, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression on counts of grams scaled by their log-count ratios."""
    p = 1 + np.bincount(f[y].ravel(), minlength=size).astype(float)
    q = 1 + np.bincount(f[~y].ravel(), minlength=size).astype(float)
    r = _ratios(p, q, 1.0 + y.sum(), 1.0 + (~y).sum())
    norm = np.sqrt((r[f] ** 2).sum(axis=1).mean()) or 1.0
    r = r / norm
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    w, b, flat = np.zeros(size), 0.0, f.ravel()
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        z = (w * r)[f].sum(axis=1) + b
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(flat, np.repeat(d, f.shape[1]), size) * r + l2 * w / len(f)
        gb, rate = d.sum(), 0.4 / (1 + t / 30)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    return w * r, b


def _train(s: _Sample, use: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Alternates between the windows that stand for documents and the fit."""
    r = s.document_ratios(use)
    w, b = np.where(r > 0, r, 0.2 * r), 0.0
    rng = np.random.default_rng(5)
    for k in range(rounds):
        best, at = s.highest(s.sums(w))
        good = use & (at >= 0)
        if k:  # an abusive document without an abusive window is mislabelled
            good &= ~(s.y & (best + b < -1.0))
        yes, no = at[good & s.y], [at[good & ~s.y]]
        # Of other documents the highest window, the highest of each half, and some at random.
        for i in np.flatnonzero(good & ~s.y):
            a, e = int(s.offsets[i]), int(s.offsets[i + 1])
            no.append(rng.integers(a + min(WINDOW, e - a) - 1, e, 4))
        no = np.unique(np.concatenate(no))
        if not len(yes) or not len(no):
            return np.zeros(s.size), -5.0
        w, b = _fit(s.features(np.concatenate([yes, no])), np.repeat([True, False], [len(yes), len(no)]), s.size)
    return w, b


def _fold(s: _Sample, use: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a fold and their scores by a model of the others."""
    w, b = _train(s, use & (turn != k))
    mine = np.flatnonzero(turn == k)
    return mine, (s.highest(s.sums(w))[0] + b)[mine]


def _folds_in_tasks(spark: SparkSession, texts: list[str], y: np.ndarray, use: np.ndarray, turn: np.ndarray, folds: int) -> np.ndarray:
    """The held-out scores of all documents, a task per fold."""
    sent = spark.sparkContext.broadcast((texts, y, use, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y, use, turn = sent.value
        for b in batches:
            for k in b.column(0).to_pylist():
                at, score = _fold(_Sample(texts, y), use, turn, k)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(score, pa.float64())], names=["at", "score"])

    rows = map_arrow(spark.range(0, folds, 1, folds), run, "at int, score double").collect()  # one row per sampled document
    sent.destroy()
    out = np.empty(len(texts))
    for r in rows:
        out[r.at] = r.score
    return out


def train(texts: list[str], labels: np.ndarray, folds: int = 3, spark: SparkSession | None = None) -> Model:
    """A model from texts and their labels (true: abusive).

    Documents are scored by models that did not see them; labels that such a
    model contradicts clearly are left out of the final fit, and the scores
    calibrate it. Without both labels the model calls nothing abusive. With a
    session the folds are trained in tasks, side by side, with the same result.
    """
    y = np.asarray(labels, bool)
    if not len(y) or y.all() or not y.any():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, -5.0)
    s = _Sample(texts, y)
    turn = np.random.default_rng(11).permutation(s.n) % folds
    use, out = np.ones(s.n, bool), np.full(s.n, -9.0)
    for _ in range(2):
        if spark is not None:
            out = _folds_in_tasks(spark, texts, y, use, turn, folds)
        else:
            for at, score in (_fold(s, use, turn, k) for k in range(folds)):
                out[at] = score
        use = ~(y & (out < DOUBT) | ~y & (out > SURE))
    w, b = _train(s, use)
    slope, bias = _calibrate(out, y)
    weights = np.zeros(1 << BITS, np.float32)
    weights[s.kept] = w[1:]
    return Model(weights, slope, bias + slope * b)


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The line that makes held-out scores log-odds, by maximum likelihood of
    labels of which a share ``NOISE`` is wrong."""
    best = (-np.inf, 1.0, 0.0)
    for middle in np.unique(np.quantile(z, np.linspace(0.5, 1, 101)).round(3)):
        for slope in (0.25, 0.5, 1.0, 2.0):
            p = NOISE + (1 - 2 * NOISE) / (1 + np.exp(-np.clip(slope * (z - middle), -30, 30)))
            fit = float(np.log(np.where(y, p, 1 - p)).sum())
            if fit > best[0]:
                best = (fit, slope, -slope * middle)
    return best[1], best[2]


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``max_docs`` labelled documents of at most
    ``max_chars`` characters together: the bounded training sample, the same for the same data. A document's label is the
    majority of its judgements of 0 or 1; other judgements and ties are ignored,
    and so are documents without text."""
    votes = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.avg(F.col("toxic").cast("double")).alias("share"))
    )
    most = {"share > 0.5": max_docs // 3, "share < 0.5": max_docs - max_docs // 3}
    some = [votes.where(test).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for test, n in most.items()]
    votes = F.broadcast(some[0].union(some[1]))
    rows = docs.select("doc_id", "text").where("text <> ''").join(votes, "doc_id")
    taken = F.sum(F.length("text")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0))  # of max_docs rows
    rows = rows.withColumn("taken", taken).where(F.col("taken") <= max_chars).orderBy("doc_id").select("text", "share").collect()
    return [r.text for r in rows], np.array([r.share > 0.5 for r in rows], bool)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """The model of the labelled documents (see ``labelled`` and ``train``).
    Several queries share one fit by ``save`` and ``load``."""
    return train(*labelled(docs, labels, max_docs), spark=docs.sparkSession)


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Write a model as a table: a row per weight, and one of its line."""
    used = np.flatnonzero(model.weights)
    rows = [(-1, float(model.slope), float(model.bias)), *((int(i), float(model.weights[i]), 0.0) for i in used)]
    spark.createDataFrame(rows, "gram int, weight double, bias double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """The model that ``save`` wrote; at most a row per hashed gram is read."""
    weights, slope, bias = np.zeros(1 << BITS, np.float32), 1.0, 0.0
    for r in spark.read.parquet(path).collect():
        if r.gram < 0:
            slope, bias = r.weight, r.bias
        else:
            weights[r.gram] = r.weight
    return Model(weights, slope, bias)


def score(df: DataFrame, model: Model, text: str = "text", output: str = "abuse") -> DataFrame:
    """``df`` without ``text`` and with ``output``, the probability that it is
    abusive. Null, empty and blank texts have 0; whole texts are scored, however
    long; repeated rows stay, and other columns are kept; one named like
    ``output`` is replaced."""
    keep = [c for c in df.columns if c not in (output, text)]
    src = df.select(*[df[c] for c in keep], df[text].alias("__text"))
    schema = ", ".join([*(f"`{c}` {k}" for c, k in src.dtypes[:-1]), f"`{output}` double"])
    used = np.flatnonzero(model.weights)
    sent = df.sparkSession.sparkContext.broadcast((used.astype(np.int32), model.weights[used], model.slope, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, slope, bias = sent.value
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = w
        m = Model(weights, slope, bias)
        for b in batches:
            p = m.probability(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(p)], names=[*keep, output])

    return map_arrow(src, run, schema)


def rates(scored: DataFrame, by: str = "source", score_column: str = "abuse", threshold: float = 0.5) -> DataFrame:
    """Documents, abusive documents and their rate per value of ``by``; null is
    a value of its own."""
    hit = F.count_if(F.col(score_column) >= threshold)
    return scored.groupBy(by).agg(
        F.count("*").alias("documents"), hit.alias("abusive"), (hit / F.count("*")).alias("rate"), F.avg(score_column).alias("mean_score")
    )
