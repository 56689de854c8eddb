"""Vector helpers over Arrow text columns, shared by the operators of this subpackage.

Texts stay in Arrow's UTF-8 buffers. A batch is cut into chunks of about ``CHUNK`` bytes, so that the
arrays a task holds at a time do not depend on how many rows Arrow delivers; one text longer than that
makes a chunk of its own. A null text counts as empty. Words are maximal runs of bytes outside
``\\x20\\x09-\\x0D``; hashes are 64-bit polynomial sums over prefix arrays, mixed once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that high and low bits both depend on all bits of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix(units: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span of ``units``."""
    out = np.zeros(len(units) + 1, np.uint64)
    weighted = (units.astype(np.uint64) + np.uint64(1)) * powers(len(units))[0]
    np.cumsum(weighted, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal spans of units have equal hashes, wherever they start."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k units from each position, for all positions that have k units left."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(n)[1] + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column, without copying where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) whose bytes together stay within ``limit``, or that are one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word (n + 1 values)."""
    inside = ~WORD_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:-1]
    closes = inside
    closes = closes & np.append(~inside[1:] | cut[1:-1], True)[: len(data)] if len(data) else closes
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, concatenated."""
    counts = np.maximum(counts, 0)
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans [start, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the index ranges [first[i], first[i + 1])."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
