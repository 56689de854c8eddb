"""Sharding by a hypergeometric communication matrix; DataFrame operations only.

Rows fall into P blocks by a hash of their key and their other columns, so that rows that share a key are
dealt like any others. The exact number of rows that each block sends to each
shard is drawn at once: a row of the matrix is a multivariate hypergeometric draw from the places that
the shards have left. Each block then permutes its rows (rank by a seeded hash) and deals them out by
that rank, rows travel to their shards, and each shard permutes again. Every assignment of rows to
shards with the given sizes is equally likely under ideal hashes, and sizes are exact: at most one apart.

The driver holds only the matrix of P x shards numbers, at most ``MOST_CELLS``. A shard is permuted in
slices of its hash range, whose sizes give the first slot of each, so no task sorts a whole shard.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_CELLS = 1 << 21


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good. numpy draws from up to 10**9; beyond, the
    law's ratios outward from its mode give its weights over all places that matter to a double."""
    if not n or not good or not bad:
        return n if not bad else 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    low, high = max(0, n - bad), min(n, good)
    reach = int(40 + 12 * np.sqrt(n * (good / (good + bad)) * (bad / (good + bad))))
    up, down = np.arange(mode, min(high, mode + reach), dtype=float), np.arange(mode, max(low, mode - reach), -1, dtype=float)
    rise = np.cumprod((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))
    fall = np.cumprod(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))
    weights = np.concatenate([fall[::-1], [1.0], rise])
    return int(mode - len(fall) + rng.choice(len(weights), p=weights / weights.sum()))


def communication_matrix(block_rows: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Counts by block and shard: rows sum to ``block_rows``, columns differ by at most one."""
    total = int(sum(block_rows))
    left = np.full(shards, total // shards, np.int64)
    left[: total % shards] += 1
    rng, out = np.random.default_rng(seed), np.zeros((len(block_rows), shards), np.int64)
    rest = total
    for i, n in enumerate(block_rows):
        need, pool = int(n), rest
        for j in range(shards):
            take = _draw(rng, int(left[j]), int(pool - left[j]), need)  # the law of this cell, given those before it
            out[i, j], need, pool = take, need - take, pool - left[j]
        left -= out[i]
        rest -= int(n)
    return out


def shuffle_shards(docs: DataFrame, shards: int, key_cols: tuple[str, ...] = ("doc_id",), seed: int = 17, block_rows: int = 20_000, slice_rows: int = 100_000) -> DataFrame:
    """All columns of ``docs`` with shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Shard sizes are at most one apart. Rows that agree in all key columns are told apart by their other
    columns (maps excepted); copies of a row need a column that numbers them, or they stay side by side.
    Nulls in keys are values like any other. An empty table gives an empty table. ``docs`` is read twice.
    Column names shard and slot of the input are replaced."""
    docs = docs.drop("shard", "slot")
    others = [F.col(c) for c, kind in docs.dtypes if c not in key_cols and "map<" not in kind and kind != "variant"]
    keys = [*(F.col(k) for k in key_cols), F.xxhash64(F.lit(seed + 3), *others)]
    place = F.xxhash64(F.lit(seed), *keys)
    total = docs.count()
    blocks = int(min(max(1, MOST_CELLS // shards), max(8, -(-total // block_rows))))
    block = F.pmod(place, F.lit(blocks)).cast("int")
    counts = {r["b"]: r["n"] for r in docs.select(block.alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a block
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    bounds = json.dumps(np.cumsum(matrix, axis=1).tolist())
    spark = docs.sparkSession
    law = spark.range(1).select(F.posexplode(F.from_json(F.lit(bounds), "array<array<bigint>>")).alias("__block", "__bounds"))
    ties = [F.col(c) for c, kind in docs.dtypes if c not in key_cols and kind in ("bigint", "int", "string", "double", "boolean", "date", "timestamp")]
    first = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys, *ties)
    dealt = docs.withColumn("__block", block).withColumn("__rank", F.row_number().over(first))
    dealt = dealt.join(F.broadcast(law), "__block")
    dealt = dealt.withColumn("shard", F.size(F.filter("__bounds", lambda x: x < F.col("__rank"))).cast("int")).drop("__bounds", "__block", "__rank")

    slices = max(1, -(-total // (shards * slice_rows)))
    again = F.xxhash64(F.lit(seed + 2), *keys)
    dealt = dealt.withColumn("__slice", F.pmod(again, F.lit(slices)).cast("int"))
    second = Window.partitionBy("shard", "__slice").orderBy(again, *keys, *ties)
    if slices == 1:
        return dealt.withColumn("slot", F.row_number().over(second).cast("long") - 1).drop("__slice")
    sizes = dealt.groupBy("shard", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("shard", "__slice", before.alias("__before"))
    placed = dealt.join(F.broadcast(sizes) if shards * slices <= MOST_CELLS else sizes, ["shard", "__slice"])
    return placed.withColumn("slot", F.row_number().over(second).cast("long") - 1 + F.col("__before")).drop("__slice", "__before")
