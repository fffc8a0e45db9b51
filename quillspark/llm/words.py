"""Words of many texts as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(data: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, 64-bit hashes) of the runs of bytes that are not ASCII white space, or not what between[byte] says."""
    text = np.flatnonzero(~between[data])
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], np.diff(text) > 1)))
    lengths = np.diff(np.concatenate((first, [len(text)])))
    place = np.arange(len(text)) - np.repeat(first, lengths)
    powers = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))))
    hashes = mix64(np.add.reduceat((data[text].astype(np.uint64) + _U(1)) * powers[place], first) + lengths.astype(np.uint64))
    return text[first], lengths, hashes


def groups_of(column: pa.Array, most: int) -> Iterator[list[bytes]]:
    """The texts of a string column in order, some at a time: as many as have `most` bytes, or one. They are read from the column's
    buffers, so only a group's bytes are there twice. A null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(there, np.diff(ends), 0).tolist()
    begins, group, size = ends.tolist(), [], 0
    for a, n in zip(begins, sizes):
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(data.slice(a, n).to_pybytes() if n else b"")
        size += n
    yield group
