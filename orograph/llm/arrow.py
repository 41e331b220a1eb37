"""Helpers for functions that read texts from Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns an operator reads, under names of its own; a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column ``text`` of each holds at most ``most`` bytes or one row.

    At the end, what Arrow has put by is given back, as workers wait idle for their next task.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])
    pa.default_memory_pool().release_unused()


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all texts as one array, and where each begins; the last entry is the end."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n, shift = len(texts), texts.offset
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, shift * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if n and texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from all values in a row and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
