"""A count-min sketch of 64-bit keys, merged from partition sketches.

Each of ``ROWS`` hash rows has 2**bits counters that saturate at two, all that a test for "at least two"
needs. A partition sends its non-zero cells by block of cells; a block's cells are added up where it is
merged, one small array at a time, and only the bits "two or more" go to the driver: ROWS * 2**bits / 8
bytes, whatever the input's size. Estimates are never too low, so no repeated key is lost; a sketch that
is small for its input lets more single keys through, which the exact pass after it then drops. Where the
bit maps would pass ``MOST_BITS`` (256 MB), the counters of one hash row stay a table (``repeated_cells``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS, BLOCK_CELLS, FLUSH, MOST_BITS = 2, 21, 1 << 20, 30
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * np.uint64(ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_bits(frame: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """For each row of the sketch a bit map, 1 where the keys of all batches count two or more."""
    blocks = max(6, bits - BLOCK_CELLS)  # as bits of the block number: more blocks with more cells
    width, block = 1 << bits, bits - blocks

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            for row in range(ROWS):
                cell = np.sort(cells(found, row, bits))
                first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
                many = np.diff(np.append(first, len(cell))) > 1
                cell = cell[first]
                cut = np.searchsorted(cell, np.arange((1 << blocks) + 1) << block)
                used = [k for k in range(1 << blocks) if cut[k + 1] > cut[k]]
                # Steps from each cell to the next, which two bytes hold where cells are dense; and what occurs twice here.
                steps = [np.diff(cell[cut[k] : cut[k + 1]], prepend=k << block) for k in used]
                packed = [x.astype(np.uint16 if x.max() < 1 << 16 else np.uint32).tobytes() for x in steps]
                twice = [np.packbits(many[cut[k] : cut[k + 1]]).tobytes() for k in used]
                if used:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([len(x) for x in steps], pa.int32()), pa.array(packed, pa.binary()), pa.array(twice, pa.binary())], names=["row", "block", "n", "steps", "twice"])

        count = 0
        for batch in batches:
            for part in keys(batch):
                held.append(part)
                count += len(part)
                if count >= FLUSH:
                    yield from flush()
                    count = 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row, k, n, steps, twice in zip(*(c.to_pylist() for c in batch.columns)):
                place = np.cumsum(np.frombuffer(steps, np.uint16 if len(steps) == 2 * n else np.uint32), dtype=np.int64)
                at = (row, k)
                if at not in sums:
                    sums[at] = np.zeros(1 << block, np.uint8)
                sums[at][place] = np.minimum(2, sums[at][place] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=n))
        for (row, k), counters in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k], pa.int32()), pa.array([np.packbits(counters >= 2).tobytes()], pa.binary())], names=["row", "block", "bits"])

    out = np.zeros((ROWS, width // 8), np.uint8)
    parts = frame.mapInArrow(sketch, "row int, block int, n int, steps binary, twice binary")
    for r in parts.repartition("row", "block").mapInArrow(merge, "row int, block int, bits binary").toLocalIterator():
        out[r["row"], r["block"] << (block - 3) : (r["block"] + 1) << (block - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def repeated_cells(frame: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> DataFrame:
    """``cell``: the cells of the first hash row that count two or more; partition sketches are merged by Spark."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in keys(batch):
                cell, n = np.unique(cells(part, 0, bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(n, 2).astype(np.int32))], names=["cell", "n"])

    return frame.mapInArrow(sketch, "cell bigint, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell")


def at_least_two(found: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Which keys the sketch estimates at two or more."""
    ok = np.ones(len(keys), bool)
    for row in range(ROWS):
        cell = cells(keys, row, bits)
        ok &= (found[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok
