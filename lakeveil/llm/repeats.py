"""Windows of a fixed length that start in more than one place, for words and for bytes.

A text is a sequence of units (word hashes, or bytes); a window is ``length`` units of one text. The least
of the hashes of a window's ``gram``-unit grams (leftmost on ties) is its anchor; it depends on the window's
content alone. A run of windows with one anchor is a segment. Equal windows have equal anchors, so:

1. anchors that occur once anywhere hold no repeated window (the sketch finds the others);
2. equal segments (by the hash of all their units) repeat all their windows: every one but the first is
   covered, and only the first goes on;
3. first segments whose anchor occurs in segments of other content may share some windows with these;
   only their windows are compared one by one.

Rows of steps 1 and 2 are a few numbers per segment; hot segments are pre-aggregated before the shuffle
and joined back with adaptive skew handling; no group is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, gram_hash, prefix, ranges, span_hash, utf8, words
from .sketch import MOST_BITS, at_least_two, cells, repeated_bits, repeated_cells

#: Low bits of a packed minimum: the place of a gram within its chunk.
PLACE_BITS = 28
PLACE = np.uint64((1 << PLACE_BITS) - 1)


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` units, anchored by grams of ``gram`` units, of words or of bytes."""

    length: int
    gram: int
    bytewise: bool

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of a chunk and the index of each text's first unit (n + 1 values)."""
        if self.bytewise:
            return data, offsets
        starts, ends, first = words(data, offsets)
        return span_hash(prefix(data), starts, ends), first


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n, span = len(a) - w + 1, 1
    while 2 * span <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[:n], a[w - span : w - span + n]) if span < w else a


@dataclass
class Segments:
    """Text index, first window's place in the text, number of windows, anchor hash and content hash."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def segments(units: np.ndarray, first: np.ndarray, kind: Windows) -> Segments:
    per = np.maximum(first[1:] - first[:-1] - kind.length + 1, 0)
    at = ranges(first[:-1], per)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    sums = prefix(units)
    grams = gram_hash(sums, kind.gram)
    packed = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_sliding_min(packed, kind.length - kind.gram + 1)[at] & PLACE).astype(np.int64)
    begin = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
    count = np.diff(np.append(begin, len(at)))
    start = at[begin]
    text = np.repeat(np.arange(len(per)), per)[begin]
    return Segments(text, start - first[text], count, grams[place[begin]], span_hash(sums, start, start + count - 1 + kind.length))


def keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """id as ``d`` (the largest long for null, so that it comes after all others), a hash of the text as
    ``h``, which tells rows with one id apart, and the text as ``t`` (empty for null)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("d"), F.xxhash64(t).alias("h"), t.alias("t"))


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def anchors_expected(size: int, kind: Windows) -> int:
    """Anchors of ``size`` bytes of text, about: a window of w grams gives two in w + 1 units; words take five bytes."""
    return 2 * size // (kind.length - kind.gram + 2) // (1 if kind.bytewise else 5)


def segment_rows(rows: DataFrame, kind: Windows, bits: int) -> DataFrame:
    """d, h, start, n, anchor and content of the segments whose anchor the sketch estimates as repeated, and
    ``own``: whether the same text has an equal segment before. The sketch has ``bits`` bits or more, by the bytes of
    all texts; beyond ``MOST_BITS`` its counters are a table that segments are joined to, not a bit map."""
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    wanted = math.ceil(math.log2(4 * anchors_expected(size, kind) + 1))
    bits = min(62, max(bits, wanted))

    def parts(batch: pa.RecordBatch, column: int):
        offsets, data = utf8(batch.column(column))
        for lo, hi in chunks(offsets):
            yield lo, segments(*kind.units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), kind)

    def anchors(batch: pa.RecordBatch):
        for _, s in parts(batch, 0):
            yield s.anchor

    tabled = bits > MOST_BITS
    found = None if tabled else rows.sparkSession.sparkContext.broadcast(repeated_bits(rows.select("t"), anchors, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, s in parts(batch, 2):
                ok = np.ones(len(s.anchor), bool) if found is None else at_least_two(found.value, s.anchor, bits)
                at = s.text[ok] + lo
                order = np.lexsort((s.start[ok], s.content[ok], at))
                same = (s.content[ok][order[1:]] == s.content[ok][order[:-1]]) & (at[order[1:]] == at[order[:-1]])
                own = np.zeros(len(at), bool)
                own[order[1:][same]] = True
                columns = [pa.array(ids[at]), pa.array(texts[at]), pa.array(s.start[ok].astype(np.int32)), pa.array(s.count[ok].astype(np.int32)), _signed(s.anchor[ok]), _signed(s.content[ok]), pa.array(own)]
                if tabled:
                    columns.append(pa.array(cells(s.anchor[ok], 0, bits)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["d", "h", "start", "n", "anchor", "content", "own", *(["cell"] if tabled else [])]
    out = rows.select("d", "h", "t").mapInArrow(emit, "d bigint, h bigint, start int, n int, anchor bigint, content bigint, own boolean" + (", cell bigint" if tabled else ""))
    return out.join(repeated_cells(rows.select("t"), anchors, bits), "cell", "left_semi").drop("cell") if tabled else out


def sort_out(found: DataFrame, within: bool) -> DataFrame:
    """Segments that matter: ``covered`` (equal to one of a smaller d or, if ``within``, to one before in
    the same text) or ``shared``, the number of segments of different content at the anchor of a first
    segment, where there are two or more."""
    found = found.where("content is not null")  # none is; said once, so that all that reads it reads the same
    firsts = found.groupBy("content").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("times"), F.min("anchor").alias("anchor"))
    # Both sides ask for all columns of the firsts: so their exchange is one, made once and read twice.
    anchors = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("shared"), F.max("times").alias("most"), F.max("first").alias("last")).where("shared > 1 and most > 0 and last is not null").select("anchor", "shared")
    known = firsts.join(anchors, "anchor", "left").where("times > 1 or shared > 1").select("content", "first", "shared", "anchor")
    covered = (F.col("d") > F.col("first")) | (F.col("own") if within else F.lit(False))
    joined = found.drop("anchor").join(known, "content")
    return joined.select("d", "h", "start", "n", "anchor", covered.alias("covered"), F.col("shared")).where("covered or shared is not null")


def by_row(found: DataFrame, *columns: str) -> DataFrame:
    """One row for each text, with its segments as an array: at most as many as the text has, however often the row is repeated."""
    return found.groupBy("d", "h").agg(F.collect_set(F.struct(*columns)).alias("parts"))


def finish(rows: DataFrame, spans: DataFrame, id_type: str, schema: str, describe: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """``describe`` over every row of ``rows`` with the start and number of its covered windows (d, h,
    start, n in ``spans``); ``schema`` holds the columns after the id. ``rows`` is joined by the columns
    that the single windows were, so that its texts are exchanged once."""
    own = F.when(F.col("d") != F.lit((1 << 63) - 1), F.col("d")).cast(id_type).alias("id")
    both = rows.join(by_row(spans, "start", "n"), ["d", "h"], "left").select(own, "t", F.col("parts.start").alias("starts"), F.col("parts.n").alias("counts"))
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                parts = explode_parts(batch, lo, hi, (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *describe(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], parts)], names=names)

    return both.mapInArrow(run, f"id {id_type}, {schema}")


def explode_parts(batch: pa.RecordBatch, lo: int, hi: int, fields: tuple[int, ...]) -> list[np.ndarray]:
    """Of list columns ``fields`` of rows [lo, hi): the row (from 0) of each element, and the elements."""
    out: list[np.ndarray] = []
    for k in fields:
        lists = batch.column(k).slice(lo, hi - lo)
        if not out:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out.append(np.repeat(np.arange(hi - lo), sizes))
        out.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    return out
