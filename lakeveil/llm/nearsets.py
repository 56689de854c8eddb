"""Near-dedup by word shingles: links between texts whose sets of 5-word shingles have a Jaccard similarity of 0.8.

SimHash can't carry such a link: at a similarity of 0.8 fingerprints differ in about 10 of 64 bits and often in 16,
and a multi-index for so many bits would compare nearly all pairs. So:

1. texts with one set of shingles (64-bit hashes of lower-cased words) are one node;
2. ``BANDS`` bands of ``ROWS`` least hashes bring nodes together: of pairs at exactly 0.8 three in a million meet nowhere, of
   closer ones fewer, and such a pair is only linked through others. Pairs whose ``BANDS * ROWS`` sketch bits differ in over ``MOST_BITS`` are
   left to the second part of step 3, which compares them whatever their bits;
3. the others are verified over their whole sets, exactly: first each node against the least one of its bands;
   then, in bands whose nodes are still in different components, all pairs that lie in different ones. A task
   compares the sets of a band, held as 32-bit hashes, and says only which pairs join components: fewer than it
   has nodes. These are verified over the 64-bit hashes.

Bands over ``BLOCK_BYTES`` of sets are cut into blocks, and each two blocks are a task, so that no task holds more
than two of them. A band of n texts that lie just under the similarity needs up to n * n / 2 comparisons.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, mix, prefix, span_hash, utf8, words
from .checkpoints import durable
from .components import connected

SHINGLE, BANDS, ROWS, MOST_BITS, BLOCK_BYTES = 5, 24, 4, 24, 1 << 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
TURNS, SHIFTS = _RANDOM[0] | np.uint64(1), _RANDOM[1]
#: Makes the BANDS * ROWS values of each text's set from all hashes and where each text's begin; a band has ROWS neighbours of them.
Sign = Callable[[np.ndarray, np.ndarray], np.ndarray]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text of a chunk, ascending, and where each text's begin (n + 1
    values). A text with fewer words than a shingle has one of all its words; one without words has none."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    sums = prefix(span_hash(prefix(data), starts, ends))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    hashes = span_hash(sums, at, np.minimum(at + shingle, first[text + 1]))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    once = np.append(True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]))[: len(text)]
    return hashes[once], np.searchsorted(text[once], np.arange(len(n) + 1))


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each set: the least of its hashes under each of BANDS * ROWS permutations; zeros for an empty set."""
    full = np.flatnonzero(first[1:] > first[:-1])
    least = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
    if len(full):
        for k in range(BANDS * ROWS):
            least[full, k] = np.minimum.reduceat(hashes * TURNS[k] + SHIFTS[k], first[full])
    return least


def _signatures(hashes: np.ndarray, first: np.ndarray, sign: Sign) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the hash of its set, its band keys and its two words of sketch bits."""
    n = len(first) - 1
    node = span_hash(prefix(hashes), first[:-1], first[1:])
    least = mix(sign(hashes, first))
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    bits = np.zeros((n, 128), np.uint8)
    bits[:, : BANDS * ROWS] = least & np.uint64(1)
    return node, keys, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _prints(own: DataFrame, shingle: int, sign: Sign) -> DataFrame:
    """id, tx, n (shingles), node, bands, s0 and s1 of every row of ``own`` (id, tx, t)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(2))
            for lo, hi in chunks(offsets):
                hashes, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                node, keys, bits = _signatures(hashes, first, sign)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), _signed(node), bands, _signed(bits[:, 0]), _signed(bits[:, 1])], names=["id", "tx", "n", "node", "bands", "s0", "s1"])

    return own.select("id", "tx", "t").mapInArrow(take, "id bigint, tx bigint, n bigint, node bigint, bands array<bigint>, s0 bigint, s1 bigint")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node and its shingle hashes, for rows of node and t."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                hashes, first = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                raw = hashes.tobytes()
                parts = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(parts, pa.binary())], names=["node", "hashes"])

    return rows.mapInArrow(take, "node bigint, hashes binary")


def _short(hashes: Column) -> Column:
    """Every other four bytes: the low halves of a binary of 64-bit hashes."""
    return F.unhex(F.regexp_replace(F.hex(hashes), "(.{8}).{8}", "$1"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs a, b whose sets are at least ``similar``."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (left, right))
                both = 0 if min(len(x), len(y)) < similar * max(len(x), len(y)) - 1e-9 else len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similar * (len(x) + len(y) - both) - 1e-9)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])

    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _joins(node: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], similar: float, crosswise: bool) -> list[tuple[int, int]]:
    """Pairs of nodes with similar sets that join different labels; ``crosswise`` only those of different sides."""
    size = np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    known, at = np.unique(np.concatenate(sets), return_inverse=True)
    group = np.unique(label, return_inverse=True)[1]
    mark, out = np.zeros(len(known), np.int32), []
    for i in range(len(node) - 1):
        open_ = (group[i + 1 :] != group[i]) & (np.minimum(size[i], size[i + 1 :]) >= similar * np.maximum(size[i], size[i + 1 :]) - 1e-9)
        if crosswise:
            open_ &= side[i + 1 :] != side[i]
        if not open_.any():
            continue
        own = at[first[i] : first[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[at[first[i + 1] :]], first[i + 1 :] - first[i + 1])
        mark[own] = 0
        for j in np.flatnonzero(open_ & (both >= similar * (size[i] + size[i + 1 :] - both) - 1e-9)) + i + 1:
            if group[j] != group[i]:
                out.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    return out


def _joined(rows: DataFrame, similar: float, kind: type) -> DataFrame:
    """a, b: pairs that join components, from rows of key, lo, hi, block, node, label and set (hashes of ``kind``)."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        lo, hi = held[0][1], held[0][2]
        sets = [np.frombuffer(x[6], kind) for x in held]
        node, label, side = (np.array([x[k] for x in held], np.int64) for k in (4, 5, 3))
        found = _joins(node, label, side, sets, similar, lo != hi)
        return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(walk, "a bigint, b bigint")


def _crosswise(told: DataFrame, sets: DataFrame, similar: float, kind: type) -> DataFrame:
    """a, b: pairs that join components, from rows of key, node and label and the nodes' sets."""
    told = told.join(sets, "node")
    blocks = told.groupBy("key").agg(F.ceil(F.sum(F.octet_length("set")) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = told.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "label", "set")
    return _joined(dealt, similar, kind).distinct()


def near_sets(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similar: float = 0.8, sign: Sign = minima, empty_linked: bool = True) -> DataFrame:
    """id (the largest long for null), tx (hash of the text), n (shingles), root (which tells components apart) and component_id
    (the least id that links reach, its own included) of every row. Texts without words are one node or, if not
    ``empty_linked``, linked with nothing: their root is null. ``sign`` makes the values whose bands bring nodes together. Other columns are not read."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(t).alias("tx"), t.alias("t"))
    prints = durable(_prints(own, shingle, sign))
    told = prints if empty_linked else prints.where("n > 0")
    nodes = durable(told.groupBy("node").agg(F.min(F.struct("id", "tx")).alias("rep"), F.first("bands").alias("bands"), F.first("s0").alias("s0"), F.first("s1").alias("s1")))
    met = nodes.select(F.explode("bands").alias("key"), "node", "s0", "s1")
    tops = met.groupBy("key").agg(F.min(F.struct("node", "s0", "s1")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = durable(met.join(tops, "key"))  # only keys at which nodes meet
    met_nodes = met.select("node").distinct().join(nodes.select("node", "rep.id", "rep.tx"), "node")
    sets = durable(_sets(met_nodes.join(own, ["id", "tx"]).select("node", "t"), shingle).dropDuplicates(["node"]))
    apart = F.bit_count(F.col("s0").bitwiseXOR(F.col("top.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("top.s1")))
    stars = durable(met.where((F.col("top.node") != F.col("node")) & (apart <= MOST_BITS)).select(F.col("top.node").alias("a"), F.col("node").alias("b")).distinct())
    links = durable(_verified(stars, sets, similar))
    labels = connected(links)
    told = met.drop("top").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = told.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    told = durable(told.join(mixed, "key"))
    cross = durable(_crosswise(told, sets.select("node", _short(F.col("hashes")).alias("set")), similar, np.uint32))
    more = durable(_verified(cross, sets, similar))
    if more.count() < cross.count():  # a 32-bit pair that isn't one may have kept true ones of its components unsaid
        more = durable(_crosswise(told, sets.select("node", F.col("hashes").alias("set")), similar, np.uint64))
    labels = connected(links.unionByName(more))
    rooted = nodes.join(labels, "node", "left").select("node", F.col("rep.id").alias("least"), F.coalesce("label", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select("node", "root", "component_id")
    if empty_linked:
        return prints.select("id", "tx", "n", "node").join(known, "node").drop("node")
    found = prints.select("id", "tx", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(known, "node", "left")
    return found.select("id", "tx", "n", "root", F.coalesce("component_id", "id").alias("component_id"))


def keep_firsts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similar: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the least of their component; of rows that share
    both id and component one stays. Null ids count as one id, after all others."""
    firsts = near_sets(docs, text, id_col, shingle, similar).where("id = component_id").groupBy("id", "root").agg(F.min("tx").alias("tx"))
    firsts = firsts.select(F.col("id").alias("__id"), F.col("tx").alias("__tx"))
    own = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))).withColumn("__tx", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    return own.join(firsts, ["__id", "__tx"], "left_semi").dropDuplicates(["__id", "__tx"]).select(*docs.columns)
