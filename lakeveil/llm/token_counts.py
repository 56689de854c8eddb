"""Token counts: batch encoding in Arrow functions that returns lengths only.

Each Arrow batch is cut into batches of about equal bytes. Every text is split at boundaries that no
token of the vocabulary's splitting rule crosses: after a letter that an ASCII character other than
a letter follows (a token that has letters ends with them), unless that character occurs in a special
token. Pieces repeat a great deal, so each batch sends only pieces not met lately to the library, all
in one call, and adds up lengths; ids never leave the batch. The memory of lengths is bounded (two
generations of ``MEMORY`` pieces per worker) and only saves time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import chunks, utf8

#: Pieces in a generation of a worker's memory; a full one replaces the older one.
MEMORY = 600_000
#: A piece longer than this is sent to the library by itself and not remembered.
LONG_PIECE = 200
#: Bytes of text in one batch.
BATCH_BYTES = 4 << 20
LETTERS = "A-Za-z\u00df-\u00f6\u00f8-\u00ff"

_LOADED: dict[str, tuple] = {}


def _encoder(path: str):
    """A function from texts to token counts, and its memory; loaded once per worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            count = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            safe = _safe_cut(path)
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            count = lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
            safe = None
        else:
            raise ValueError(f"a .json or .model vocabulary is expected, not {path}")
        _LOADED[path] = (count, safe, [{}, {}])
    return _LOADED[path]


def _safe_cut(path: str) -> re.Pattern | None:
    """Where texts may be split, or None where the vocabulary's rule isn't the byte-level pattern that
    ends a token after its letters."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    pre = rules.get("pre_tokenizer") or {}
    added = rules.get("added_tokens") or []
    if rules.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
        return None
    special = {c for a in added for c in a["content"]}
    after = "".join(f"\\x{i:02x}" for i in range(128) if not chr(i).isalpha() and chr(i) not in special)
    return re.compile(f"(?<=[{LETTERS}])(?=[{after}])")


def lengths(texts: list[str], path: str) -> list[int]:
    """Token counts of whole texts."""
    count, safe, memory = _encoder(path)
    if safe is None:
        return count(texts) if texts else []
    new, old = memory
    cut = [safe.split(t) if t else [] for t in texts]
    seen = set().union(*cut) - new.keys()
    fresh = [p for p in seen if p not in old]
    if len(new) > MEMORY:
        old, new = new, {p: old[p] for p in seen if p in old} | {p: new[p] for p in set().union(*cut) if p in new}
        memory[:] = [new, old]
    else:
        new.update((p, old[p]) for p in seen if p in old)
    new.update(zip(fresh, count(fresh)))
    out = [sum(map(new.__getitem__, pieces)) for pieces in cut]
    for p in [p for p in fresh if len(p) > LONG_PIECE]:
        del new[p]
    return out


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are kept as they are: repeated rows give
    repeated results, a null id stays null, an empty table gives an empty table; other columns are
    not read. No special tokens are added; special strings inside a text are handled as the library
    does by default."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, _ = utf8(batch.column(1))
            for lo, hi in chunks(offsets, BATCH_BYTES):
                texts = batch.column(1).slice(lo, hi - lo).fill_null("").to_pylist()
                tokens = lengths(texts, tokenizer_path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(offsets[lo + 1 : hi + 1] - offsets[lo:hi], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(count, schema)
