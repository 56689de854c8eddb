"""Substring dedup with a count-min prefilter.

Windows are 50 consecutive words. Merged partition sketches overestimate how often a window occurs (by
the count of its anchor, the least 8-word gram in it); windows estimated once are done. The second pass
groups exactly what is left: equal runs of windows first, then single windows of runs that share only
their anchor. The first document (least id) of each repeated window keeps it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import by_text, chunks, covered, gram_hash, prefix, ranges, utf8, words
from .repeats import Windows, by_row, explode_parts, finish, keyed, segment_rows, sort_out


def repeated_windows(rows: DataFrame, kind: Windows, bits: int) -> DataFrame:
    """d, h, start and n of the windows whose words also start in a row with a smaller d."""
    found = sort_out(segment_rows(rows, kind, bits), within=False)
    rest = by_row(found.where("not covered and shared is not null"), "start", "n")
    own = rest.join(rows.select("d", "h", "t"), ["d", "h"]).select("d", "h", "t", F.col("parts.start").alias("starts"), F.col("parts.n").alias("counts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            ids, texts = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi in chunks(offsets):
                units, first = kind.units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, start, count = explode_parts(batch, lo, hi, (3, 4))
                hashes = gram_hash(prefix(units), kind.length)
                at, row = ranges(first[row] + start, count), np.repeat(row, count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row + lo]), pa.array(texts[row + lo]), pa.array((at - first[row]).astype(np.int32)), pa.array(hashes[at].view(np.int64))], names=["d", "h", "start", "window"])

    single = own.mapInArrow(windows, "d bigint, h bigint, start int, window bigint")
    least = single.groupBy("window").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").select("window", "least")
    again = single.join(least, "window").where("d > least").select("d", "h", "start", F.lit(1).alias("n"))
    return found.where("covered").select("d", "h", "start", "n").unionByName(again)


def drop_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = 50, bits: int = 26) -> DataFrame:
    """For each row of ``docs``: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)
    and kept (those words). Words covered by a window that also starts in a row with a smaller id go.

    A null or empty text has no words. A null id counts as larger than all others. Rows with the same id
    don't remove words from each other; repeated rows give repeated results. An empty table gives an
    empty table; other columns are not read. Hashes of words and windows have 64 bits."""
    kind = Windows(window, min(8, window), False)
    rows = keyed(docs, text, id_col)

    def describe(data: np.ndarray, offsets: np.ndarray, parts: list[np.ndarray]) -> list[pa.Array]:
        starts, ends, first = words(data, offsets)
        row, start, count = parts
        gone = covered(len(starts), first[row] + start, first[row] + start + count - 1 + window)
        raw, kept = data.tobytes(), []
        for i in range(len(offsets) - 1):
            a, b = first[i], first[i + 1]
            if gone[a:b].any():
                own = np.flatnonzero(~gone[a:b]) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist())]))
            else:
                kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
        digests = [hashlib.sha256(k).hexdigest() for k in kept]
        return [pa.array((first[1:] - first[:-1]).astype(np.int64)), pa.array(by_text(gone, first)), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())]

    out = finish(rows, repeated_windows(rows, kind, bits), docs.schema[id_col].dataType.simpleString(), "n_words bigint, n_removed bigint, kept_sha256 string, kept string", describe)
    return out.withColumnRenamed("id", id_col)
