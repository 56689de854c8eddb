"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities.

Features are relative frequencies of hashed words and of hashed 4-byte grams, so a text's score is the
bias plus the mean weight of its words plus the mean weight of its grams, in one pass over Arrow's
buffers. The model is fitted on at most ``fit_rows`` labelled rows (those with the least hash of their
id); a quarter of them is held back for Platt calibration. All other figures cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import WORD_SPACE, by_text, chunks, covered, gram_hash, mix, prefix, ranges, span_hash, utf8, words
from .logistic import fit_sparse, platt, sigmoid

BITS, GRAM, WINDOW = 16, 4, 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SHIFT = np.uint64(64 - BITS)
#: Weight of a relative frequency, so that fitted weights are of the order of one.
SCALE = 20.0


@dataclass
class QualityModel:
    """Weights of 2**BITS word buckets followed by 2**BITS gram buckets, a bias, and the calibration."""

    weights: np.ndarray
    bias: float
    a: float
    b: float
    threshold: float


def _buckets(data: np.ndarray, offsets: np.ndarray):
    """Buckets of words and of grams in text order, with the first index of each text in either."""
    sums = prefix(data)
    starts, ends, first = words(data, offsets)
    hashes = span_hash(sums, starts, ends)
    lengths = offsets[1:] - offsets[:-1]
    at = ranges(offsets[:-1], lengths - GRAM + 1)
    grams = gram_hash(sums, GRAM)[at] if len(at) else np.zeros(0, np.uint64)
    firsts = np.append(0, np.cumsum(np.maximum(lengths - GRAM + 1, 0)))
    return sums, starts, ends, first, hashes, (hashes >> SHIFT).astype(np.int64), (grams >> SHIFT).astype(np.int64) + (1 << BITS), firsts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column(1))
        for lo, hi in chunks(offsets):
            o = offsets[lo : hi + 1] - offsets[lo]
            *_, first, _, by_word, by_gram, firsts = _buckets(data[offsets[lo] : offsets[hi]], o)
            columns, values = [], []
            for i in range(hi - lo):
                both = [np.unique(x[f[i] : f[i + 1]], return_counts=True) for x, f in ((by_word, first), (by_gram, firsts))]
                columns.append(np.concatenate([x for x, _ in both]).astype(np.int32))
                values.append(np.concatenate([n / max(n.sum(), 1) for _, n in both]).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["id", "label", "columns", "values"]
            )


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", fit_rows: int = 3000, threshold: float = 0.5) -> QualityModel:
    """A model of P(label = 1 | text) from at most ``fit_rows`` labelled rows. Labelled rows with a null
    id or label are not used; without rows of both classes the model keeps every row."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "label")
    rows = sample.mapInArrow(_features, "id bigint, label int, columns array<int>, values array<float>").toArrow()
    target = np.array(rows["label"].to_pylist(), float)
    if not len(target) or target.min() == target.max():
        return QualityModel(np.zeros(2 << BITS), 10.0, 1.0, 0.0, threshold)
    lengths = rows["columns"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    column, value = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("columns", "values"))
    value = value.astype(float) * SCALE
    back = mix(np.array(rows["id"].to_pylist()).astype(np.uint64)) % np.uint64(4) == 0
    row = np.repeat(np.arange(len(target)), lengths)
    used = ~back[row]
    weights, bias = fit_sparse((np.cumsum(~back) - 1)[row[used]], column[used], value[used], target[~back], 2 << BITS)
    z = np.bincount(row, value * weights[column], len(target)) + bias
    a, b = platt(z[back], target[back])
    return QualityModel(weights * SCALE, bias, a, b, threshold)


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words in windows of WINDOW words that the text has twice or more, by text."""
    counts = np.maximum(first[1:] - first[:-1] - WINDOW + 1, 0)
    at = ranges(first[:-1], counts)
    if not len(at):
        return np.zeros(len(first) - 1, np.int64)
    key = mix(gram_hash(prefix(hashes), WINDOW)[at] ^ np.repeat(mix(np.arange(1, len(first), dtype=np.uint64)), counts))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = at[order[np.append(same, False) | np.append(False, same)]]
    return by_text(covered(len(hashes), twice, twice + WINDOW), first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    n = np.searchsorted(breaks, offsets)
    per = n[1:] - n[:-1] + 1
    text = np.repeat(np.arange(len(per)), per)
    last = np.cumsum(per) - 1
    starts, ends = np.empty(len(text), np.int64), np.empty(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[last] = False
    ends[last], ends[inner] = offsets[1:], breaks
    inner = np.ones(len(text), bool)
    inner[last - per + 1] = False
    starts[last - per + 1], starts[inner] = offsets[:-1], breaks + 1
    filled = np.append(0, np.cumsum(~WORD_SPACE[data]))
    has = filled[ends] > filled[starts]
    starts, ends, text = starts[has], ends[has], text[has]
    key = mix(span_hash(sums, starts, ends) ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    return np.bincount(text[again], minlength=len(per))


def text_figures(data: np.ndarray, offsets: np.ndarray, model: QualityModel) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk, and its calibrated probability."""
    sums, starts, ends, first, hashes, by_word, by_gram, firsts = _buckets(data, offsets)
    n = first[1:] - first[:-1]
    lead = (data & 0xC0) != 0x80
    z = model.bias + by_text(model.weights[by_word], first) / np.maximum(n, 1) + by_text(model.weights[by_gram], firsts) / np.maximum(firsts[1:] - firsts[:-1], 1)
    return {
        "n_words": n,
        "word_chars": by_text(lead & ~WORD_SPACE[data], offsets),
        "n_symbols": by_text(SYMBOLS[data], offsets),
        "n_dup_lines": _dup_lines(data, offsets, sums),
        "n_repeat_words": _repeats(hashes, first),
        "quality": sigmoid(model.a * z + model.b),
    }


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", id_col: str = "doc_id", min_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """For each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, quality
    (calibrated probability), base_failed (fewer than ``min_words`` words, or over ``most_repeats`` percent
    of them in repeated 8-word windows) and kept (not failed, and quality at or over the model's threshold).

    A null or empty text has no words and fails. Repeated rows give repeated results, a null id stays
    null, an empty table gives an empty table; other columns are not read."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{n} bigint' for n in names)}, quality double, base_failed boolean, kept boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                x = text_figures(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shared.value)
                failed = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > most_repeats * x["n_words"])
                columns = [batch.column(0).slice(lo, hi - lo), *(pa.array(x[n].astype(np.int64)) for n in names), pa.array(x["quality"]), pa.array(failed), pa.array(~failed & (x["quality"] >= shared.value.threshold))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *names, "quality", "base_failed", "kept"])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(score, schema)
