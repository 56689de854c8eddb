"""Suffix-array dedup, cut down to what a fixed length needs: strings of ``length`` bytes sorted within buckets of text.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Equal strings have equal
anchors (see repeats.py), so strings are routed to buckets by anchor. Within a bucket the suffixes of all segments are
sorted by their first ``length`` bytes alone, by prefix doubling, and then by place. No longest-previous-factor array and no previous or
next smaller positions are built: whether the longest previous factor of a string reaches ``length`` follows from the run of equal
strings that it stands in. Equal segments are pre-aggregated first, so that a bucket holds each content once, however
many copies the corpus has. Strings of a bucket with over ``MOST`` contents are compared one by one instead,
by two 64-bit hashes: equal strings are aggregated before the shuffle, and all but the first are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import CHUNK, by_text, chunks, covered, gram_hash, mix, prefix, ranges, utf8
from .checkpoints import durable
from .repeats import Windows, by_row, explode_parts, finish, keyed, segment_rows, sort_out

MOST = 2000


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at`` sorted by their first ``length`` bytes and then by place, as indices into
    ``at``; and for each place in that order whether it shares ``length`` bytes with the one before."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    rank, step = data.astype(np.uint64), 1
    while 2 * step <= length:
        wide = step < 8  # up to eight bytes are a number as they stand
        after = np.zeros(len(rank), np.uint64)
        after[: max(0, len(rank) - step)] = rank[step:] + np.uint64(not wide)
        pair = (rank << np.uint64(8 * step)) | after if wide else rank * np.uint64(len(rank) + 2) + after
        step *= 2
        if step < 8:
            rank = pair
            continue
        order = np.argsort(pair)
        rank = np.empty(len(pair), np.uint64)
        rank[order] = np.append(0, np.cumsum(pair[order[1:]] != pair[order[:-1]]))
    head, tail = rank[at], rank[at + length - step]
    order = np.lexsort((at, tail, head))
    same = (head[order[1:]] == head[order[:-1]]) & (tail[order[1:]] == tail[order[:-1]])
    return order, np.append(False, same)


def previous_factors(order: np.ndarray, shares: np.ndarray, d: np.ndarray, h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which strings' longest previous factor reaches the length, told without an array of factors: places ascend by (d, h, start), and the
    sort keeps them ascending among equal strings, so a string is repeated if its run of equal ones begins with a smaller d, or if
    its own text has it right before."""
    run = np.maximum.accumulate(np.where(shares, 0, np.arange(len(order))))
    before = np.append(order[:1], order[:-1])
    own = shares & (d[order] == d[before]) & (h[order] == h[before]) & (start[order] > start[before])
    out = np.zeros(len(order), bool)
    out[order] = (d[order] > d[order[run]]) | own
    return out


def _wanted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """d, h, t and the first segments of each text that share their anchor with other contents, ``deals`` in parts."""
    rest = by_row(found.withColumn("deals", F.ceil(F.col("shared") / MOST).cast("int")), "start", "n", "anchor", "deals")
    parts = [F.col(f"parts.{c}").alias(c) for c in ("start", "n", "anchor", "deals")]
    return rest.join(rows.select("d", "h", "t"), ["d", "h"]).select("d", "h", "t", *parts)


def _segments(wanted: DataFrame, kind: Windows) -> DataFrame:
    """bucket, d, h, start, n and bytes of the segments whose bucket has at most ``MOST`` contents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in chunks(offsets):
                part, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                row, start, count, anchor, deals = explode_parts(batch, lo, hi, (3, 4, 5, 6))
                row, start, count, anchor = (x[deals <= 1] for x in (row, start, count, anchor))
                raw, begin = part.tobytes(), o[row] + start
                strings = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count - 1 + kind.length).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids[row + lo]), pa.array(texts[row + lo]), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(strings, pa.binary())], names=["bucket", "d", "h", "start", "n", "bytes"])

    return wanted.mapInArrow(cut, "bucket bigint, d bigint, h bigint, start int, n int, bytes binary")


def _repeated_singles(wanted: DataFrame, kind: Windows) -> DataFrame:
    """d, h, start and n (1) of the repeated strings of oversize buckets. A string travels as two 64-bit
    hashes; equal strings are aggregated before the shuffle and joined back, so no task holds a group of them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in chunks(offsets):
                row, start, count, _, deals = explode_parts(batch, lo, hi, (3, 4, 5, 6))
                row, start, count = (x[deals > 1] for x in (row, start, count))
                if not len(row):
                    continue
                part, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                place, row = ranges(o[row] + start, count), np.repeat(row, count)
                k0 = gram_hash(prefix(part), kind.length)[place].view(np.int64)
                k1 = gram_hash(prefix(mix(part.astype(np.uint64) + np.uint64(1))), kind.length)[place].view(np.int64)
                order = np.lexsort((place, k1, k0, row))
                row, place, k0, k1 = (x[order] for x in (row, place, k0, k1))
                opens = np.append(True, (row[1:] != row[:-1]) | (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1]))
                own = place > place[np.maximum.accumulate(np.where(opens, np.arange(len(row)), 0))]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + lo]), pa.array(texts[row + lo]), pa.array((place - o[row]).astype(np.int32)), pa.array(k0), pa.array(k1), pa.array(own)], names=["d", "h", "start", "k0", "k1", "own"])

    singles = wanted.mapInArrow(deal, "d bigint, h bigint, start int, k0 bigint, k1 bigint, own boolean")  # read twice, made twice: see drop_repeats
    firsts = singles.groupBy("k0", "k1").agg(F.min("d").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    return singles.join(firsts, ["k0", "k1"]).where("own or d > first").select("d", "h", "start", F.lit(1).alias("n"))


def _factors(parts: DataFrame, length: int) -> DataFrame:
    """d, h, start and n of the strings that the longest-previous-factor arrays find repeated."""

    def solve(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bucket, d, h, start, n = (np.concatenate([x[k] for x in held]).astype(np.int64) for k in range(5))
        sizes = n - 1 + length
        data = np.concatenate([x[5] for x in held])
        begin = np.cumsum(sizes) - sizes
        again = (bucket[1:] == bucket[:-1]) & (d[1:] == d[:-1]) & (h[1:] == h[:-1]) & (start[1:] == start[:-1])
        if again.any():  # the table has a text twice
            once = np.append(True, ~again)
            d, h, start, n, begin = (x[once] for x in (d, h, start, n, begin))
        at, row = ranges(begin, n), np.repeat(np.arange(len(n)), n)
        place = at - begin[row] + start[row]
        order, shares = suffix_order(data, at, length)
        hit = previous_factors(order, shares, d[row], h[row], place)
        row, place = row[hit], place[hit]
        opens = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)) if len(row) else np.zeros(0, bool)
        first = np.flatnonzero(opens)
        run = np.diff(np.append(first, len(row)))
        return pa.RecordBatch.from_arrays([pa.array(d[row[first]]), pa.array(h[row[first]]), pa.array(place[first].astype(np.int32)), pa.array(run.astype(np.int32))], names=["d", "h", "start", "n"])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            offsets = np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :][: batch.num_rows + 1].astype(np.int64)
            data = np.frombuffer(batch.column(5).buffers()[2] or b"", np.uint8)
            key = columns[0]
            lo = 0
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, batch.num_rows)
            for hi in ends:
                if held and held[-1][0][-1] != key[lo] and size > CHUNK:
                    yield solve(held)
                    held, size = [], 0
                held.append((*(c[lo:hi] for c in columns), data[offsets[lo] : offsets[hi]]))
                size += int(offsets[hi] - offsets[lo])
                lo = hi
        if held:
            yield solve(held)

    dealt = parts.repartition("bucket").sortWithinPartitions("bucket", "d", "h", "start")
    return dealt.mapInArrow(buckets, "d bigint, h bigint, start int, n int")


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = 100, bits: int = 27) -> DataFrame:
    """For each row of ``docs``: id, n_bytes (UTF-8), n_removed, n_spans (maximal removed runs), kept_sha256
    (of the remaining bytes) and kept (these bytes). A byte goes if a ``length``-byte string that covers it
    also starts earlier: in a row with a smaller id, or before in the same text.

    Matches never cross texts. A null or empty text has no bytes. A null id counts as larger than all
    others. Rows with the same id don't remove bytes from each other; repeated rows give repeated
    results. An empty table gives an empty table; other columns are not read. Anchors are taken from
    64-bit hashes, and runs of strings that have equal 64-bit hashes count as equal."""
    kind = Windows(length, min(32, max(1, length // 2)), True)
    rows = keyed(docs, text, id_col)
    found = durable(sort_out(segment_rows(rows, kind, bits), within=True))  # read three times
    firsts = found.where("not covered and shared is not null")
    few, many = _wanted(rows, firsts.where(F.col("shared") <= MOST)), _wanted(rows, firsts.where(F.col("shared") > MOST))
    spans = found.where("covered").select("d", "h", "start", "n").unionByName(_factors(_segments(few, kind), length)).unionByName(_repeated_singles(many, kind))

    def describe(data: np.ndarray, offsets: np.ndarray, parts: list[np.ndarray]) -> list[pa.Array]:
        row, start, count = parts
        gone = covered(len(data), offsets[row] + start, offsets[row] + start + count - 1 + length)
        head = gone.copy()
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        head[1:] &= ~gone[:-1] | begins[1:-1]
        left = data[~gone].tobytes()
        cut = np.append(0, np.cumsum(~gone))[offsets]
        kept = [left[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        return [pa.array(offsets[1:] - offsets[:-1]), pa.array(by_text(gone, offsets)), pa.array(by_text(head, offsets)), pa.array(digests), pa.array(kept, pa.binary())]

    out = finish(rows, spans, docs.schema[id_col].dataType.simpleString(), "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary", describe)
    return out.withColumnRenamed("id", id_col)
