"""SimHash near-dedup with multi-index hashing.

Fingerprints have 64 bits, one for each bit of the 64-bit hashes of a text's 4-word shingles that over half
of them set. Fingerprints at ``DISTANCE`` = 4 bits or fewer have at most 2 differing bits in one of their two
32-bit halves, so both are within one bit of a common value there: each distinct fingerprint enters the
table of either half under its 33 nearest values, and fingerprints that meet in a table are verified over
all 64 bits. Equal fingerprints are one entry, whatever their number. Where more than ``most`` fingerprints
meet, they are linked instead by the balls of radius 2 over all 64 bits: two fingerprints are within 4
bits exactly if they share a value of both balls, so no pairs are needed, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import durable
from .components import connected

DISTANCE, SHINGLE, SEED = 4, 4, 42
#: A-Z to a-z, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words after which the bit counts of a text are added up.
PART = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text; 0 without words."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes).tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for k in range(0, len(ends), PART):
        hashes = np.array([hashed(joined[a:b], SEED) for a, b in zip(starts[k : k + PART], ends[k : k + PART])], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", *more: str) -> DataFrame:
    """id, fp (the fingerprint as a signed long) and further columns of every row."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                found = np.array([fingerprint(t) for t in batch.column(1).slice(lo, 500).to_pylist()], np.uint64)
                others = [batch.column(2 + k).slice(lo, 500) for k in range(len(more))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), pa.array(found.view(np.int64)), *others], names=["id", "fp", *more])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in more]
    return docs.select(F.col(id_col).alias("id"), F.col(text), *more).mapInArrow(take, ", ".join([f"id {docs.schema[id_col].dataType.simpleString()}, fp bigint", *kinds]))


def _keys(name: str, values):
    """A function that gives each fingerprint its table keys, ``values`` columns of masks at a time."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(found), 1000):
                keys = values(found[lo : lo + 1000])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(found[lo : lo + 1000], keys.shape[1]).view(np.int64))], names=[name, "fp"])

    return spread


ONE = np.append(np.uint64(0), np.uint64(1) << np.arange(32, dtype=np.uint64))
BALL = np.unique(np.append(np.uint64(0), np.bitwise_or.outer(np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)).ravel()))


def _halves(found: np.ndarray) -> np.ndarray:
    low, high = found & np.uint64(0xFFFFFFFF), found >> np.uint64(32)
    return np.concatenate([low[:, None] ^ ONE, (high[:, None] ^ ONE) | np.uint64(1 << 32)], axis=1)


def _verified(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: each fingerprint and the first one that verified links lead to within its key,
    where that is another one. Pairs are compared in place and never leave the batch."""
    group = np.cumsum(np.append(0, key[1:] != key[:-1]))
    size = np.bincount(group)[group]
    group, fp = group[size > 1], fp[size > 1]
    label, left, right = np.arange(len(fp)), [], []
    for step in range(1, len(fp)):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        near = same[np.bitwise_count(fp[same + step] ^ fp[same]) <= DISTANCE]
        left.append(near)
        right.append(near + step)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            before = label.copy()
            np.minimum.at(label, b, label[a])
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (label == before).all():
                break
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _match(most: int):
    """Verified links a, b of rows that come sorted by key; b is null for those of an oversize key."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def oversize(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.nulls(len(found), pa.int64())], schema=schema)

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if over is not None:  # the rest of an oversize key
                own = np.searchsorted(key, over, "right")
                if own:
                    yield oversize(fp[:own])
                    key, fp = key[own:], fp[own:]
                if len(key):
                    over = None
            if not len(key):
                continue
            tail = int(np.searchsorted(key, key[-1], "left"))
            head_key, head_fp, key, fp = key[:tail], fp[:tail], key[tail:], fp[tail:]
            if len(key) > most:
                over = key[0]
                yield oversize(fp)
                key, fp = key[:0], fp[:0]
            if len(head_key):
                yield from settle(head_key, head_fp)
        if len(key):
            yield from settle(key, fp)

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        big = size > most
        if big.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[big].view(np.int64)), pa.nulls(int(big.sum()), pa.int64())], names=["a", "b"])
            key, fp = key[~big], fp[~big]
        a, b = _verified(key, fp) if len(key) else (fp, fp)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return match


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that come sorted by key and fingerprint: each fingerprint with the first one of its key."""
    last_key, last_fp = None, None
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        opens = np.append(last_key != key[0], key[1:] != key[:-1])
        head = np.maximum.accumulate(np.where(opens, np.arange(len(key)), -1))
        first = np.where(head < 0, last_fp if last_fp is not None else 0, fp[head])
        last_key, last_fp = key[-1], first[-1]
        keep = first != fp
        yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(first[keep])], names=["a", "b"])


def links(prints: DataFrame, most: int = 1000) -> DataFrame:
    """a, b: links between distinct fingerprints within DISTANCE bits, enough to connect all that are."""
    table = prints.select("fp").distinct()
    met = table.mapInArrow(_keys("key", _halves), "key bigint, fp bigint").repartition("key").sortWithinPartitions("key", "fp")
    met = durable(met.mapInArrow(_match(most), "a bigint, b bigint").distinct())
    hot = met.where("b is null").select(F.col("a").alias("fp"))
    ball = hot.mapInArrow(_keys("key", lambda found: found[:, None] ^ BALL), "key bigint, fp bigint").repartition("key").sortWithinPartitions("key", "fp")
    return met.where("b is not null").unionByName(ball.mapInArrow(_firsts, "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = 1000, *more: str) -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id (the least id that links reach, its own
    included) of every row, and further columns ``more``.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows give repeated
    results; a null id stays null and is never a component_id unless its component has no other; an
    empty table gives an empty table; other columns are not read."""
    prints = durable(fingerprints(docs, text, id_col, *more))
    nodes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected(links(prints, most))
    rooted = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(known, "fp").select(F.col("id").alias(id_col), hexed, "component_id", *more)


def keep_firsts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", most: int = 1000) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the least of their component; of rows that share
    both id and component one stays. Null ids count as one id, after all others."""
    own = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).withColumn("__text", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = near_duplicates(own, text, "__id", most, "__text")
    firsts = found.where("__id = component_id").groupBy("__id", "component_id").agg(F.min("__text").alias("__text"))
    joined = own.join(firsts.select("__id", "__text"), ["__id", "__text"], "left_semi")
    return joined.dropDuplicates(["__id", "__text"]).select(*docs.columns)
