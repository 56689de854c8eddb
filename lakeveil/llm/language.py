"""Language ID by rank-order profiles.

A profile lists a language's most frequent letter n-grams (n = 1 to 3, words padded with blanks, folded
into 2**16 hashed bins) by rank. A text's own most frequent n-grams are compared with every profile by
the out-of-place distance: the sum of rank differences, with the profile's size for an n-gram that the
profile lacks. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, SIZE = 1 << 16, 300
_ALPHA: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def gram_bins(text: str) -> np.ndarray:
    """Bins of the n-grams of a text in lower case; other characters than letters count as one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter | np.append(True, letter[:-1])
    s = np.where(letter, points, np.uint32(32))[keep]
    s = np.concatenate([np.full(int(letter[0]), 32, np.uint32), s, np.full(int(letter[-1]), 32, np.uint32)])
    two = s[:-1] * np.uint32(0x9E3779B1) + s[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + s[2:] * np.uint32(0x27D4EB2F) + np.uint32(7)
    one = s[s != 32]
    parts = [one * np.uint32(0x165667B1), two + np.uint32(3), three]
    mixed = np.concatenate(parts)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(np.int64)


def top_bins(bins: np.ndarray) -> np.ndarray:
    """At most SIZE bins, the most frequent first, ties by bin."""
    counts = np.bincount(bins, minlength=BINS)
    used = np.flatnonzero(counts)
    key = counts[used] * BINS + (BINS - 1 - used)
    if len(used) > SIZE:
        used = used[np.argpartition(key, -SIZE)[-SIZE:]]
        key = counts[used] * BINS + (BINS - 1 - used)
    return used[np.argsort(-key)]


def fit_profiles(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", fit_rows: int = 1500) -> dict[str, np.ndarray]:
    """Ranks by bin (SIZE where a bin is not in the profile) for each language, from about ``fit_rows`` rows a
    language: those whose hash of id and text lies below ``fit_rows`` / rows of the language, so that no rows are
    ranked or gathered. Rows whose id, text or language is null are not used."""
    known = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    share = known.groupBy("lang").agg((F.lit(float(fit_rows)) / F.count(F.lit(1))).alias("share"))  # one row a language
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rows = known.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in totals:
                    totals[name] = np.zeros(BINS, np.int64)
                totals[name] += np.bincount(gram_bins(t), minlength=BINS)
        for name, counts in totals.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["lang", "bin", "n"])

    counts = rows.mapInArrow(count, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "bin"))).where(F.col("rank") <= SIZE)
    out: dict[str, np.ndarray] = {}
    for r in sorted(ranked.select("lang", "bin", "rank").collect()):  # SIZE rows a language
        out.setdefault(r["lang"], np.full(BINS, SIZE, np.int32))[r["bin"]] = r["rank"] - 1
    return out


def nearest(texts: list[str | None], names: list[str], ranks: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The nearest profile of each text, how far the next one is behind, as a share of its distance, and the text's own
    distance as a share of the largest possible one (1 where there is no profile or no letter)."""
    said, score, far = [], np.zeros(len(texts)), np.ones(len(texts))
    for i, t in enumerate(texts):
        bins = gram_bins(t) if t and names else np.zeros(0, np.int64)
        if not len(bins):
            said.append("und")
            continue
        top = top_bins(bins)
        distance = np.abs(ranks[:, top] - np.arange(len(top))).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        best, other = distance[order[0]], distance[order[1]] if len(order) > 1 else SIZE * len(top)
        said.append(names[order[0]])
        score[i] = (other - best) / other if other else 0.0
        far[i] = best / (SIZE * len(top))
    return said, score, far


def predict(texts: list[str | None], names: list[str], ranks: np.ndarray) -> tuple[list[str], np.ndarray]:
    return nearest(texts, names, ranks)[:2]


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row; only the text is an input of the prediction.

    ``und`` with score 0 where the text is null or has no letter, or where there are no profiles. Ties go
    to the language first in the alphabet. Repeated rows give repeated results, a null id stays null, an
    empty table gives an empty table; other columns are not read."""
    names = sorted(profiles)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([profiles[n] for n in names]) if names else np.zeros((0, BINS), np.int32)))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                said, score = predict(batch.column(1).slice(lo, 1000).to_pylist(), *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1000), pa.array(said, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(classify, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", languages: tuple[str, ...] | None = None, most_distance: float = 0.6) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one of ``languages`` (all learned ones for None);
    nothing is shuffled.

    A text goes if it is null, has no letter, lies nearest to a language that is not asked for, or is further than
    ``most_distance`` of the largest possible out-of-place distance from every profile, as text in another script or
    of random letters is. (The corpus's own texts, of one word on, lie below 0.46.)"""
    names, column = sorted(profiles), docs.columns.index(text)
    wanted = set(names if languages is None else languages)
    shared = docs.sparkSession.sparkContext.broadcast((names, np.stack([profiles[n] for n in names]) if names else np.zeros((0, BINS), np.int32)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                said, _, far = nearest(part.column(column).to_pylist(), *shared.value)
                yield part.filter(pa.array([name in wanted and d <= most_distance for name, d in zip(said, far)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
