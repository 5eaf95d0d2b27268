"""Arrow text as numpy code-point arrays and back, without per-row strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text stays whole.
CHUNK_BYTES = 4 << 20


def string_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets into them; a null row is empty."""
    if pa.types.is_large_string(arr.type):
        kind = np.int64
    else:
        kind, arr = np.int32, arr.cast(pa.string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    _, o = string_parts(arr)
    at = 0
    while at < len(arr):
        end = int(np.searchsorted(o, o[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(arr))
        yield at, end
        at = end


def to_codepoints(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all rows and int64 row offsets into them."""
    raw, o = string_parts(arr)
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(o, o[1:])]
        cps = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return cps, np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, o
    firsts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=firsts[1:])
    return cps, firsts[o]


def from_codepoints(cps: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The rows as Arrow strings; rows where ``null`` is true are null."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    out = pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(ends[offsets].astype(np.int64).tobytes()), pa.py_buffer(data)
    ).cast(pa.string())
    if null is not None and null.any():
        out = pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), out)
    return out


def row_ids(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def offsets_of(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets of ``n`` rows from the sorted row id of each element."""
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n), out=out[1:])
    return out
