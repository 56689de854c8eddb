"""MinHash near-dedup by min-max hashing.

Under each of ``PERMUTATIONS`` permutations of the shingle hashes a set keeps its minimum and its maximum. Both
are unbiased tests of the Jaccard similarity, so 48 evaluations of a hash give 96 values, and since minimum and maximum of one
permutation are not positively correlated, an estimate from them varies no more than one from 96 minima. A band has
two minima and two maxima of four different permutations, so that its values are independent; 24 bands miss 2 in
100 million pairs at a similarity of 0.85, and fewer above. Pairs that bands bring together are verified over the whole sets (``nearsets``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearsets

SHINGLE, SIMILAR = 3, 0.85
PERMUTATIONS = nearsets.BANDS * nearsets.ROWS // 2
#: The permutations whose minima, and those whose maxima, stand in the bands' places.
MINIMA = np.arange(PERMUTATIONS).reshape(nearsets.BANDS, -1)
MAXIMA = np.roll(MINIMA, -1, axis=0)


def min_max(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each set: BANDS * ROWS values, in each band minima and then maxima; zeros for an empty set."""
    full = np.flatnonzero(first[1:] > first[:-1])
    bands = np.zeros((len(first) - 1, nearsets.BANDS, nearsets.ROWS), np.uint64)
    half = nearsets.ROWS // 2
    for k in range(PERMUTATIONS if len(full) else 0):
        turned = hashes * nearsets.TURNS[k] + nearsets.SHIFTS[k]
        band, place = np.argwhere(MINIMA == k)[0]
        bands[full, band, place] = np.minimum.reduceat(turned, first[full])
        band, place = np.argwhere(MAXIMA == k)[0]
        bands[full, band, half + place] = np.maximum.reduceat(turned, first[full])
    return bands.reshape(len(bands), -1)


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """id, n_shingles (size of the set of distinct word shingles), component_id (the least id that links reach, its own included) and
    kept (whether the id is that one) of every row; linked are sets at a Jaccard similarity of ``similar`` or more.

    A text of fewer words than a shingle has one of all its words; a null text, or one without words, has none and is linked with nothing.
    Repeated rows give repeated results, and all rows of a kept id are kept. Null ids come after all others: they
    are a component_id, null, only where a component has no other, and such rows are kept. An empty table gives an empty table; other columns are not read."""
    none = F.lit((1 << 63) - 1)
    found = nearsets.near_sets(docs, text, id_col, shingle, similar, min_max, empty_linked=False)
    kind = docs.schema[id_col].dataType
    return found.select(F.nullif("id", none).cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.nullif("component_id", none).cast(kind).alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
