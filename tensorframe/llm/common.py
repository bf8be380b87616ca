"""Shared storage and batching used by the corpus operators.

Arrow batches are bounded by bytes through Spark's own setting
(``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB unless the caller changes it); no
operator changes a setting of the session.
"""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs

from ..sources.storage import bytes_of, discard, few, files_of, new_path, partitions, shared_dir, written, written_small

__all__ = ["SLICE_BYTES", "bytes_of", "discard", "few", "file_groups", "files_of", "give_back", "lean", "new_path", "opened", "partitions", "row_slices", "shared_dir", "text_slices", "written", "written_small"]

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1_500_000


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory (some milliseconds)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step of mapInArrow at whose end the worker, which later stages use again, gives freed memory back."""

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a URI of the shared folder, as Hadoop writes it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def row_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with about ``most`` bytes (or one row) of a text or binary column."""
    at = batch.schema.get_field_index(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive slices of a batch with their texts (null: empty), each of about ``most`` bytes or one row."""
    at = batch.schema.get_field_index(column)
    for part in row_slices(batch, column, most):
        yield part, [t or "" for t in part.column(at).to_pylist()]


def file_groups(uri: str, text_column: str, most: int, columns: list[str], kinds: pa.Schema | None = None) -> Iterator[tuple[int, pa.RecordBatch, list[str]]]:
    """A committed file's rows in groups of about ``most`` bytes of text: first row's number, rows, texts. The same groups at every reading."""
    fs, path = opened(uri)
    with fs.open_input_file(path) as f:
        source, row = pq.ParquetFile(f), 0
        for g in range(source.num_row_groups):
            got = source.read_row_group(g, columns=columns).select(columns)
            if kinds is not None:
                got = got.cast(kinds)
            for batch in got.combine_chunks().to_batches():
                for part, texts in text_slices(batch, text_column, most):
                    yield row, part, texts
                    row += part.num_rows
