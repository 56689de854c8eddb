"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact verification.

Texts are words in lower case (A-Z); distances are word edits. An item of n words is in a text if a passage
of it is within floor(``tolerance`` * n) edits; of items under ``min_words`` words, without edits.

1. Windows. An item with at most d edits keeps one of d + 1 pieces whole, so item-sized windows are laid
   only where the first words (four at most) of a piece of an item stand, at the piece's distance from
   the item's start. No passage within d edits is without a window.
2. Embedding. A random walk of 3n steps writes the word at a pointer and moves the pointer on by a random bit
   of the step and the word; word edits become differing places (Hamming distance).
3. LSH. A table's key is the hash of ``SAMPLES`` places of an embedding. The number of tables follows
   from ``recall`` and the share of equal places taken for granted at the tolerance (``AGREE``); tables
   are spread over ``WALKS`` walks. Windows and items with an equal key are candidates.
4. Verification. The edit distance of the item to the best passage around the window is computed exactly.

Items are taken in blocks of ``block`` items, each broadcast as arrays, so a benchmark of any size is
matched, one reading of the texts for each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, gram_hash, mix, prefix, span_hash, utf8, words

WALKS, SAMPLES, AGREE = 6, 3, 0.5
#: Embedded places (8 bytes each) held at a time, by the driver for items and by a task for windows.
MOST_CELLS = 1 << 22
BLOCK_BYTES = 1 << 25
SEED_WORDS, SIEVE_BITS = 4, 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tables(recall: float) -> int:
    """How many tables find a pair with AGREE equal places with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - AGREE**SAMPLES))


def embed(symbols: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """CGK walks of each row of ``symbols`` (padded with 0): walks x rows x 3 * width places."""
    n, width = symbols.shape
    padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
    pointer, rows = np.zeros((WALKS, n), np.int64), np.arange(n)[None, :]
    out = np.empty((3 * width, WALKS, n), np.uint64)
    salt = mix(np.arange(1, 3 * width * WALKS + 1, dtype=np.uint64) + np.uint64(seed)).reshape(3 * width, WALKS, 1)
    for j in range(3 * width):
        here = padded[rows, pointer]
        out[j] = here
        pointer += ((mix(here ^ salt[j]) & np.uint64(1)).astype(np.int64)) & (pointer < lengths)
    return out


def signatures(symbols: np.ndarray, lengths: np.ndarray, seed: int, recall: float) -> np.ndarray:
    """Keys by table and row. Places are drawn from the first 3n of a row of n words; n is in the key."""
    count = tables(recall)
    places = np.random.default_rng(seed).random((count, SAMPLES))
    walks, rows = embed(symbols, lengths, seed), np.arange(len(lengths))
    out = np.empty((count, len(lengths)), np.uint64)
    for t in range(count):
        key = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t)
        for u in places[t]:
            key = mix(key ^ walks[(u * 3 * lengths).astype(np.int64), t % WALKS, rows])
        out[t] = key
    return out


def batches_by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices in order of length, in parts whose embedding takes at most ``MOST_CELLS`` places or that are one row:
    a long row never pads short ones."""
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        step = 1
        while hi < len(order):  # widen by doubling, then stop where the bound is met
            until = min(len(order), hi + step)
            if 3 * WALKS * int(lengths[order[until - 1]]) * (until - lo) > MOST_CELLS or lengths[order[until - 1]] > 2 * lengths[order[lo]] + 16:
                if step == 1:
                    break
                step = 1
                continue
            hi, step = until, 2 * step
        yield order[lo:hi]
        lo = hi


def passage_distance(item: list[int], passage: list[int]) -> int:
    """Least number of word edits between ``item`` and any part of ``passage`` (bit-parallel)."""
    m = len(item)
    mask, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[int, int] = {}
    for k, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << k
    up, down, score = mask, 0, m
    best = m
    for w in passage:
        eq = places.get(w, 0)
        x = eq | down
        same = ((((eq & up) + up) ^ up) | eq) & mask
        plus, minus = (down | ~(same | up)) & mask, up & same
        score += (1 if plus & high else 0) - (1 if minus & high else 0)
        best = min(best, score)
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = (minus | ~(x | plus)) & mask, plus & x
    return best


@dataclass
class Items:
    """A block of items: ids, words, and what windows are laid and looked up by."""

    ids: list
    words: list[np.ndarray]
    lengths: np.ndarray
    edits: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    keys: np.ndarray
    order: np.ndarray
    seed: int
    recall: float


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    out = []
    for t in texts:
        data = LOWER[np.frombuffer(t.encode(), np.uint8)]
        starts, ends, _ = words(data, np.array([0, len(data)]))
        out.append(span_hash(prefix(data), starts, ends))
    return out


def prepare(ids: list, texts: list[str], tolerance: float, min_words: int, seed: int = 11, recall: float = 0.995) -> Items:
    found = [(i, w) for i, w in zip(ids, word_hashes(texts)) if len(w)]
    lengths = np.array([len(w) for _, w in found], np.int64)
    edits = np.where(lengths < min_words, 0, np.floor(tolerance * lengths + 1e-9)).astype(np.int64)
    rows: dict[int, list[tuple[int, int, int]]] = {}
    for k, (_, w) in enumerate(found):
        pieces = int(edits[k]) + 1
        for p in range(pieces):
            at, size = p * len(w) // pieces, len(w) // pieces
            q = min(SEED_WORDS, size)
            rows.setdefault(q, []).append((int(gram_hash(prefix(w[at : at + q]), q)[0]), k, at))
    seeds = {}
    for q, all_rows in rows.items():
        all_rows.sort()
        hashes = np.array([r[0] for r in all_rows], np.uint64)
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(hashes >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        seeds[q] = (sieve, hashes, np.array([r[1] for r in all_rows]), np.array([r[2] for r in all_rows]))
    keys = np.zeros((tables(recall), len(found)), np.uint64)
    for part in batches_by_length(lengths):
        matrix = np.zeros((len(part), int(lengths[part].max(initial=1))), np.uint64)
        for row, k in enumerate(part):
            matrix[row, : lengths[k]] = found[k][1]
        keys[:, part] = signatures(matrix, lengths[part], seed, recall)
    order = np.argsort(keys, axis=1, kind="stable")
    return Items([i for i, _ in found], [w for _, w in found], lengths, edits, seeds, np.take_along_axis(keys, order, 1), order, seed, recall)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [lo, hi): the range's index and each value."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)


def find_windows(hashes: np.ndarray, first: np.ndarray, items: Items) -> np.ndarray:
    """Distinct (text, first word, words) of the windows that pieces of items lay in the texts."""
    found, sums = [], prefix(hashes)
    for q, (sieve, seeds, item, at) in items.seeds.items():
        grams = gram_hash(sums, q)
        hit = np.flatnonzero(sieve[(grams >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
        which, row = _expand(np.searchsorted(seeds, grams[hit], "left"), np.searchsorted(seeds, grams[hit], "right"))
        place = hit[which]
        text = np.searchsorted(first, place, "right") - 1
        inside = place + q <= first[text + 1]
        text, place, row = text[inside], place[inside], row[inside]
        n = items.lengths[item[row]]
        start = np.clip(place - at[row], first[text], np.maximum(first[text], first[text + 1] - n))
        found.append(np.stack([text, start, n], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def matches(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(text, item index, distance, first word of the window) of the items in a chunk's texts; for each
    text and item the least distance, then the first window."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    hashes = span_hash(prefix(low), starts, ends)
    windows = find_windows(hashes, first, items)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for own_part in batches_by_length(windows[:, 2]):
        part = windows[own_part]
        width = int(part[:, 2].max())
        at = part[:, 1:2] + np.arange(width)
        inside = (np.arange(width) < part[:, 2:3]) & (at < first[part[:, 0] + 1][:, None])
        symbols = np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
        keys = signatures(symbols, part[:, 2], items.seed, items.recall)
        pairs = set()
        for t in range(len(keys)):
            which, place = _expand(np.searchsorted(items.keys[t], keys[t], "left"), np.searchsorted(items.keys[t], keys[t], "right"))
            pairs.update(zip(which.tolist(), items.order[t][place].tolist()))
        for w, k in sorted(pairs):
            text, start, n = part[w].tolist()
            d, own = int(items.edits[k]), items.words[k]
            if (symbols[w, :n] == own).all():
                distance = 0
            else:
                a, b = max(int(first[text]), start - d), min(int(first[text + 1]), start + n + d)
                distance = passage_distance(own.tolist(), hashes[a:b].tolist())
            if distance <= d:
                best[text, k] = min(best.get((text, k), (distance, start)), (distance, start))
    return [(text, k, distance, int(start - first[text])) for (text, k), (distance, start) in sorted(best.items())]


def _blocks(items: DataFrame, item_id: str, text: str, block: int, **how) -> Iterator[Items]:
    """The benchmark in blocks of about ``block`` rows and ``BLOCK_BYTES`` bytes, each small enough for the driver."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text")).distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    count = max(-(-size["n"] // block), -(-size["bytes"] // BLOCK_BYTES))
    for k in range(count):
        own = rows if count == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        found = sorted(((r["id"], r["text"]) for r in own.collect()), key=lambda r: (r[0] is None, r))
        yield prepare([i for i, _ in found], [t for _, t in found], **how)


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", tolerance: float = 0.2, min_words: int = 8, recall: float = 0.995, block: int = 20_000) -> DataFrame:
    """id, item_id, distance (word edits), item_words and start (the matched window's first word) for every
    text and item of the benchmark in it.

    Null and empty texts have none, nor have items without words. Items under ``min_words`` words are looked for
    exactly, without edits; ``item_words`` lets callers leave them out. Repeated rows give repeated results, a null id stays null, an empty table on
    either side gives an empty table; other columns are not read."""
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"`{id_col}` {kinds[0]}, `{item_id}` {kinds[1]}, distance int, item_words int, start int"
    context, out = docs.sparkSession.sparkContext, None
    for found in _blocks(items, item_id, text, block, tolerance=tolerance, min_words=min_words, recall=recall):
        shared = context.broadcast(found)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, data = utf8(batch.column(1))
                for lo, hi in chunks(offsets):
                    hits = matches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value)
                    if hits:
                        text, item, distance, start = zip(*hits)
                        ids = batch.column(0).take(pa.array([lo + i for i in text]))
                        named = pa.array([shared.value.ids[k] for k in item])
                        numbers = (pa.array(x, pa.int32()) for x in (distance, [len(shared.value.words[k]) for k in item], start))
                        yield pa.RecordBatch.from_arrays([ids, named, *numbers], names=[id_col, item_id, "distance", "item_words", "start"])

        part = docs.select(F.col(id_col), F.col(text)).mapInArrow(find, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", tolerance: float = 0.2, min_words: int = 8, recall: float = 0.995, block: int = 20_000) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark; nothing is shuffled. Rows with
    a null or empty text stay. Items under ``min_words`` words drop the texts that hold them word for word."""
    context = docs.sparkSession.sparkContext
    for found in _blocks(items, item_id, text, block, tolerance=tolerance, min_words=min_words, recall=recall):
        shared, column = context.broadcast(found), docs.columns.index(text)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared, column=column) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, data = utf8(batch.column(column))
                keep = np.ones(batch.num_rows, bool)
                for lo, hi in chunks(offsets):
                    for hit in matches(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value):
                        keep[lo + hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
