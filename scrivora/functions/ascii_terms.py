"""Vectorised cutting of texts into ASCII terms, on Arrow buffers instead of Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIN_TERM = 3
#: Bytes of text that are worked on at once; bounds the memory of a worker whatever the row sizes are.
SLICE_BYTES = 8 << 20

_LOWER = np.zeros(256, np.uint8)
for _b in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _LOWER[_b] = _b
for _b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LOWER[_b] = _b + 32


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``limit`` bytes of text each (a single longer row stands alone)."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def _bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def cut_terms(column: pa.Array, least: int = MIN_TERM) -> tuple[pa.Array, np.ndarray]:
    """Runs of at least ``least`` ASCII letters or digits in lower case, in order, and the row of each."""
    if not len(column):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    raw, offsets = _bytes_and_offsets(column)
    low = _LOWER[raw]
    inside = low != 0
    edges = offsets[:-1]
    edges = edges[edges < len(raw)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    keep = lengths >= least
    data = low[inside][np.repeat(keep, lengths)]
    ends = np.zeros(int(keep.sum()) + 1, np.int32)
    np.cumsum(lengths[keep], out=ends[1:])
    terms = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
    return terms, np.searchsorted(offsets, starts[keep], side="right") - 1


def term_counts(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a slice, and per (row, term), in row order: row, place of the term, occurrences."""
    terms, rows = cut_terms(column)
    coded = terms.dictionary_encode()
    n = max(1, len(coded.dictionary))
    keys, counts = np.unique(rows * n + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
    return coded.dictionary, keys // n, keys % n, counts
