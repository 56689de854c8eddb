"""Fill-in-middle transformation: texts cut at two line ends and told in another order.

The offsets of all line ends of a text stand in a learned index: segments of a piecewise-linear function from rank to offset, each
within ``ERROR`` bytes of every offset it covers, and the residuals, one byte each. A cut after k lines is predicted by its
segment and corrected by its residual, exactly. Segments are fitted to all texts of a chunk at once: a segment is the chord of its first and
last offset and is halved as long as an offset lies further off; a segment of two offsets is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, ranges, utf8

ERROR = 120
MARKS = ("<P>", "<S>", "<M>")


@dataclass
class RankIndex:
    """Line ends of the texts of a chunk by rank, over one row of ranks: text i has ranks base[i] to base[i + 1] - 1, of 0 to n lines.
    Segments start at ranks ``starts``, with an offset and a slope each; ``residuals`` has one byte a rank."""

    base: np.ndarray
    starts: np.ndarray
    origin: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    def cut(self, text: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """The byte offsets in their texts at which ``lines`` lines end."""
        rank = self.base[text] + lines
        at = np.searchsorted(self.starts, rank, "right") - 1
        return _line(self.origin[at], self.slope[at], rank - self.starts[at]) + self.residuals[rank]


def _line(origin: np.ndarray, slope: np.ndarray, step: np.ndarray) -> np.ndarray:
    return origin + np.rint(slope * step).astype(np.int64)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which 0, 1, ... n lines of each text end, all texts' in one array, and where each text's begin (n + 1 values).
    A line ends after its newline, the last one at the text's end."""
    breaks = np.flatnonzero(data == 10) + 1
    first = np.searchsorted(breaks, offsets, "right")
    first, last = first[:-1], first[1:]
    size = offsets[1:] - offsets[:-1]
    count = last - first
    open_end = (size > 0) & ((count == 0) | (breaks[np.maximum(last - 1, 0)] < offsets[1:] if len(breaks) else True))
    ranks = count + open_end + 1
    base = np.append(0, np.cumsum(ranks))
    ends = np.zeros(base[-1], np.int64)
    ends[ranges(base[:-1] + 1, count)] = breaks[ranges(first, count)] - np.repeat(offsets[:-1], count)
    ends[base[1:][open_end] - 1] = size[open_end]
    return ends, base


def fit_index(ends: np.ndarray, base: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of ``line_ends``; the residuals of all ranks are at most ``error``, 127 at most."""
    if not 0 < error <= 127:
        raise ValueError("error must be from 1 to 127, so that a residual is one byte")
    lo, hi = base[:-1], base[1:]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(lo):
        size = hi - lo
        slope = (ends[hi - 1] - ends[lo]) / np.maximum(size - 1, 1)
        rank = ranges(lo, size)
        off = np.abs(ends[rank] - _line(np.repeat(ends[lo], size), np.repeat(slope, size), rank - np.repeat(lo, size)))
        worst = np.maximum.reduceat(off, np.cumsum(size) - size)
        fits = worst <= error
        done.append((lo[fits], slope[fits]))
        lo, hi = lo[~fits], hi[~fits]
        mid = (lo + hi) // 2
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    starts = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
    slope = np.concatenate([d[1] for d in done]) if done else np.zeros(0)
    order = np.argsort(starts)
    starts, slope = starts[order], slope[order]
    rank = np.arange(len(ends))
    at = np.searchsorted(starts, rank, "right") - 1
    residuals = (ends - _line(ends[starts][at], slope[at], rank - starts[at])).astype(np.int8) if len(ends) else np.zeros(0, np.int8)
    return RankIndex(base, starts, ends[starts], slope, residuals)


def _draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits for each id; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


SCHEMA = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _told(texts: pa.Array, draws: np.ndarray, rate: int, spm_rate: int) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """For row ranges lo, hi of a batch: n, form, prefix_chars, middle_chars and output."""
    offsets, data = utf8(texts)
    for lo, hi in chunks(offsets):
        own, part = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        ends, base = line_ends(part, own)
        index = fit_index(ends, base)
        n, d, text = np.diff(base) - 1, draws[lo:hi], np.arange(hi - lo)
        cuts = index.cut(np.tile(text, 2), np.concatenate([d[:, 0] % (n + 1), d[:, 1] % (n + 1)])).reshape(2, -1)
        low, high = cuts.min(axis=0), cuts.max(axis=0)
        chars = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        prefix, middle = chars[own[:-1] + low] - chars[own[:-1]], chars[own[:-1] + high] - chars[own[:-1] + low]
        forms, outputs = [], []
        for k, (a, b) in enumerate(zip(own[:-1].tolist(), own[1:].tolist())):
            raw, form = part[a:b].tobytes(), "plain"
            if raw and d[k, 2] % 100 < rate and not any(m.encode() in raw for m in MARKS):
                form = "spm" if d[k, 3] % 100 < spm_rate else "psm"
                x, y = int(low[k]), int(high[k])
                first, mid, rest = raw[:x], raw[x:y], raw[y:]
                raw = b"<S>" + rest + b"<P>" + first + b"<M>" + mid if form == "spm" else b"<P>" + first + b"<S>" + rest + b"<M>" + mid
            forms.append(form)
            outputs.append(raw)
        plain = np.array([f == "plain" for f in forms], bool)
        columns = [pa.array(n), pa.array(forms, pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
        yield lo, hi, pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output of every row.

    ``rate`` percent of texts are transformed, ``spm_rate`` percent of these with the suffix first, by a hash of seed and id. An empty
    text, a null one, and one that holds a mark stay plain. Repeated rows give repeated results, rows of one id the same draws;
    a null id counts as an empty one; other columns are not read. No row is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            draws = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            for lo, hi, told in _told(batch.column(1), draws, rate, spm_rate):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *told.columns], names=["id", *SCHEMA.names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), *(d.alias(f"h{k}") for k, d in enumerate(_draws(id_col, seed))))
    told = rows.mapInArrow(take, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return told.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of; it holds no mark itself, so the marks tell the parts."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
