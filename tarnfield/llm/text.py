"""Byte-level text helpers shared by the training-data operators.

A *word* is a maximal run of bytes outside space and 0x09-0x0D, which is what
``bytes.split()`` yields; UTF-8 never puts those bytes inside a longer
character, so bytes and code points give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z to a-z on bytes, everything else untouched.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def code_points(raw: bytes, without: bytes = b"") -> int:
    """Code points of ``raw`` that are not in ``without`` (ASCII bytes)."""
    return len(raw.translate(None, CONTINUATION + without))


def slices(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of ``batch`` with about ``most`` bytes of text each (one row
    at least); an empty batch is its own only slice. Nothing is copied."""
    length = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(length)
    begin = 0
    while True:
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, "right"))
        end = max(end, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end
        if begin >= batch.num_rows:
            return
