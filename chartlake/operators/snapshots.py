"""What changed between consecutive full snapshots.

Keys and values of every row are reduced to hashes. The compact arrays are
bucketed by series and key hash, a series into as many buckets as its rows
need; so all snapshots of a key meet in one task with the list of its series'
snapshots. The number of tasks follows from the number of rows. There they are sorted
in numpy and compared by ``searchsorted`` set differences. Full keys are looked
up only for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.runtime import BROADCAST_ROWS, broadcast_if_small, map_arrow, materialize

KINDS = ("added", "removed", "changed")
BATCH = 1 << 16
#: Rows of a task on average, and that it sorts at once; more are split into buckets by key.
TASK_ROWS = 1 << 19
#: Rows of a bucket of a series; a larger series has several, by key.
HOT_ROWS = 1 << 16


def row_hash(cols: Sequence[Column]) -> Column:
    """64-bit hash in which a null is a value of its own."""
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [tuple(c.to_numpy(zero_copy_only=False) for c in b.columns) for b in batches if b.num_rows]
    if not parts:
        return
    series, key, packed, delivered, value, real = (np.concatenate(x) for x in zip(*parts))
    del parts
    code = (packed & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    # The snapshots of each series in order, and the latest delivery of each.
    order = np.lexsort((delivered, code, series))
    series, key, packed, delivered, value, real, code = (x[order] for x in (series, key, packed, delivered, value, real, code))
    fresh = np.ones(len(series), bool)
    fresh[1:] = (series[1:] != series[:-1]) | (code[1:] != code[:-1])
    group = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    latest = delivered[np.append(first[1:], len(series)) - 1]
    owner, codes = series[first], code[first].astype(np.int64)
    begins = np.ones(len(first), bool)
    begins[1:] = owner[1:] != owner[:-1]
    place = np.arange(len(first)) - np.maximum.accumulate(np.where(begins, np.arange(len(first)), 0))
    following = np.full(len(first), NONE, np.int64)
    following[:-1] = np.where(begins[1:], NONE, codes[1:])
    periods = codes << 32 | following & 0xFFFFFFFF
    at = np.flatnonzero((delivered == latest[group]) & real)
    columns = key[at], packed[at] >> 32 << 32 | place[group[at]], periods[group[at]], value[at]
    del series, key, packed, delivered, value, real, code, order, group
    buckets = 1 << max(0, int(np.ceil(np.log2(max(1, len(at)) / TASK_ROWS))))
    of = columns[0] >> 7 & (buckets - 1)  # all rows of a key are in one bucket
    for i in range(buckets):
        some = slice(None) if buckets == 1 else np.flatnonzero(of == i)
        if len(columns[0][some]):
            yield from _differences(*(c[some] for c in columns))


def _differences(key: np.ndarray, packed: np.ndarray, periods: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted, each key's places are neighbours: a set difference per step."""
    low, place = packed >> 32, packed & 0x7FFFFFFF
    order = np.lexsort((value, place, low, key))
    key, low, place, periods, value = key[order], low[order], place[order], periods[order], value[order]
    del order, packed
    fresh = np.empty(len(key), bool)
    fresh[0] = True
    fresh[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
    ids = np.cumsum(fresh) * (int(place.max()) + 2) + place
    keep = np.empty(len(ids), bool)
    keep[0] = True
    keep[1:] = ids[1:] != ids[:-1]
    ids, key, low, place, periods, value = (x[keep] for x in (ids, key, low, place, periods, value))
    last = len(ids) - 1
    before = np.minimum(np.searchsorted(ids, ids - 1), last)
    had = ids[before] == ids - 1
    after = np.minimum(np.searchsorted(ids, ids + 1), last)
    stays = ids[after] == ids + 1
    here, following = (periods >> 32).astype(np.int32), (periods & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
    for kind, at, when in (
        (0, np.flatnonzero((place > 0) & ~had), here),
        (1, np.flatnonzero(~stays & (following != NONE)), following),
        (2, np.flatnonzero(had & (value != value[before])), here),
    ):
        for i in range(0, len(at), BATCH):
            x = at[i : i + BATCH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[x]), pa.array(low[x].astype(np.int32)), pa.array(when[x]), pa.array(np.full(len(x), kind, np.int8))],
                names=["__k", "__k2", "__code", "__kind"],
            )


#: Code of "no following snapshot".
NONE = -(2**31)


def snapshot_changes(
    rows: DataFrame,
    series: Sequence[str],
    key: Sequence[str],
    values: Sequence[str],
    period: str,
    delivered: str,
    code: Callable[[Column], Column],
    label: Callable[[Column], Column],
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows ``(series..., period, key..., change)`` of every key that was added,
    removed or changed between consecutive snapshots of its series.

    The rows of one series and period with the same ``delivered`` are one
    delivery; the latest delivery of a period is its snapshot as a whole.
    ``code`` maps ``period`` to an int32 that is unique per period and orders
    the snapshots; ``label`` maps it to the text that is returned.

    - Null series or key columns, values and delivery times are values of
      their own; a null delivery time is the earliest.
    - Rows whose period has no code belong to no snapshot and are left out.
    - Repeated rows count once. If a key is repeated in one delivery with
      different values, one of them (the least row hash) is taken.
    - Empty and very long texts are ordinary values. An empty table, or one
      snapshot per series, gives no rows. Other columns are ignored, also if
      they are named like the result's.

    A series of more than ``hot_rows`` rows is split over tasks by key hash. Of
    such series there are at most as many as ``hot_rows`` goes into all rows, so
    their list is broadcast. The list of all series is broadcast if it has at
    most ``broadcast_rows`` rows, else joined by a shuffle. Full keys come back
    by a sort-merge join, which spills where it must.
    """
    src = rows.select(
        row_hash([F.col(c) for c in series]).alias("__s"),
        *[F.col(c).alias(f"__s{i}") for i, c in enumerate(series)],
        *[F.col(c).alias(f"__key{i}") for i, c in enumerate(key)],
        *[F.col(c).alias(f"__v{i}") for i, c in enumerate(values)],
        F.col(period).alias("__p"),
        F.coalesce(F.unix_micros(F.col(delivered).cast("timestamp")), F.lit(-(2**63))).alias("__d"),
    )
    parts = [F.col(f"__s{i}") for i in range(len(series))]
    keys = [F.col(f"__key{i}") for i in range(len(key))]
    vals = [F.col(f"__v{i}") for i in range(len(values))]
    both = [row_hash(parts + keys).alias("__k"), F.hash(*parts, *keys).alias("__k2")]

    titles = materialize(src.groupBy("__s", *parts).agg(F.count("*").alias("__n")), "series")
    total = titles.agg(F.sum("__n")).first()[0] or 0
    parts_n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    hot = titles.where(F.col("__n") > hot_rows).select("__s", F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    coded = src.select("__s", "__d", *both, row_hash(vals).alias("__value"), code(F.col("__p")).cast("int").alias("__code")).where("__code is not null")
    pack = F.shiftleft(F.col("__k2").cast("bigint"), 32).bitwiseOR(F.col("__code").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    columns = ["__s", "__k", pack.alias("__packed"), "__d", "__value"]
    if hot.limit(1).count() == 0:
        compact = coded.select(*columns, F.lit(True).alias("__real")).repartition(parts_n, "__s")
    else:
        salted = coded.join(F.broadcast(hot), "__s", "left").withColumn("__salt", F.coalesce(F.pmod("__k", "__salts"), F.lit(0)))
        # Each part of a hot series gets the list of its snapshots.
        lists = coded.join(F.broadcast(hot), "__s").groupBy("__s", "__salts", "__code").agg(F.max("__d").alias("__d"))
        lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__salts").cast("bigint") - 1)))
        lists = lists.withColumns({"__k": F.lit(0).cast("bigint"), "__k2": F.lit(0), "__value": F.lit(0).cast("bigint")})
        every = salted.select(*columns, F.lit(True).alias("__real"), "__salt").unionByName(lists.select(*columns, F.lit(False).alias("__real"), "__salt"))
        compact = every.repartition(parts_n, "__s", "__salt").drop("__salt")
    found = map_arrow(compact, _compare, "__k bigint, __k2 int, __code int, __kind tinyint")
    names = src.select(*both, "__s", *keys).distinct()
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = found.join(names.hint("merge"), ["__k", "__k2"]).join(broadcast_if_small(titles.drop("__n"), broadcast_rows), "__s")
    return named.select(
        *[F.col(f"__s{i}").alias(c) for i, c in enumerate(series)],
        label(F.col("__code")).alias(period),
        *[F.col(f"__key{i}").alias(c) for i, c in enumerate(key)],
        F.element_at(kinds, F.col("__kind").cast("int") + 1).alias("change"),
    )
