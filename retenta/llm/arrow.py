"""Helpers for operators that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

SLICE_BYTES = 8 << 20


class Words(NamedTuple):
    """The words of a run of texts: ``codes[starts[k]:starts[k + 1]]`` are the words of text ``k``."""

    starts: np.ndarray
    codes: np.ndarray
    vocabulary: pa.Array


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` (bigint, may be null) and ``text`` (null becomes the empty text)."""
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one piece holds about ``limit`` bytes of text (elements of a list column), or one longer text alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text_col)
        length = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
        sizes = length(column).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield batch.slice(int(lo), int(hi - lo))


def split_words(texts: pa.Array) -> Words:
    """Split on runs of ASCII white space; the vocabulary holds each distinct word once."""
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():                      # white space at an end of a text gives an empty word
        before = np.r_[0, np.cumsum(full)]
        offsets, flat = before[offsets], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return Words(offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def hashed(vocabulary: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of every word, as unsigned 64-bit numbers."""
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary.cast(pa.binary()).to_pylist()),
                       dtype=np.uint64, count=len(vocabulary))
