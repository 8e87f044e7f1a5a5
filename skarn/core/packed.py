"""Columns of numbers as compressed bytes, so that a shuffle moves a few bytes a number and not a row.

A column is written byte plane by byte plane, without planes of zeros, and compressed; a sorted
column is written as its differences.  What is dealt out is one row per part and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CODEC = pa.Codec("zstd", compression_level=1)


def pack(*columns: np.ndarray, ordered: bool = True) -> bytes:
    """64-bit columns of any lengths; the first is sorted if ``ordered``."""
    head, body = [len(columns), ordered], []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x).view(np.uint64)
        if k == 0 and ordered:
            x = np.diff(x, prepend=np.uint64(0))
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        planes = np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
        body.append(CODEC.compress(planes.tobytes(), asbytes=True) if planes.size else b"")
        head += [len(x), width, len(body[-1])]
    return np.array(head, "<u4").tobytes() + b"".join(body)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns, unsigned."""
    count, ordered = np.frombuffer(data, "<u4", 2)
    head = np.frombuffer(data, "<u4", 3 * int(count), 8).reshape(-1, 3).tolist()
    at, out = 8 + 12 * int(count), []
    for k, (n, width, size) in enumerate(head):
        wide = np.zeros((n, 8), np.uint8)
        if size:
            planes = np.frombuffer(CODEC.decompress(data[at : at + size], n * width, asbytes=True), np.uint8)
            wide[:, :width] = planes.reshape(width, n).T
        at += size
        x = wide.reshape(-1).view("<u8").astype(np.uint64, copy=False)
        out.append(np.cumsum(x, dtype=np.uint64) if k == 0 and ordered else x)
    return out


def part_of(codes: np.ndarray, parts: int, bits: int = 64) -> np.ndarray:
    """Equal ranges of codes of so many bits; ascending with the codes."""
    top = codes >> np.uint64(max(bits - 32, 0))
    return ((top * np.uint64(parts)) >> np.uint64(min(bits, 32))).astype(np.int64)


def runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, last) of a sorted column of parts."""
    if len(part):
        cuts = np.flatnonzero(np.diff(part)) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
            yield int(part[first]), first, last


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, sorted, and the sums of the columns."""
    if not len(keys):
        return keys, *columns
    order = np.argsort(keys)
    keys = keys[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], *(np.add.reduceat(x[order], start) for x in columns)
