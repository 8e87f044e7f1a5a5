"""Word hashes of Arrow text columns, without a Python object per word.

The bytes of several texts are split and hashed together in numpy.  Every pair of a byte and its
place in the word stands for a scrambled 64-bit value; a word's hash is the scrambled sum of its
values (tabulation hashing), which one cumulative sum over the bytes gives.  Words are 64-bit
values from here on; with 10**9 distinct words about 0.03 pairs are expected to share a value,
and, unlike with a polynomial modulo a power of two, no regular words are sure to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
#: Texts are hashed together up to so many bytes; a longer text is hashed on its own, whole.
CHUNK = 1 << 20

def separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES + extra)] = True
    return table


WHITE = separators()
#: Everything in ASCII that is neither a letter nor a digit.
NOT_ALNUM = separators(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(text: pa.Array, table: np.ndarray = WHITE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds) for runs of texts: text first+k has hashes[bounds[k]:bounds[k+1]].

    A-Z are lower-cased; nulls have no words.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.fill_null("")
    wide = pa.types.is_large_string(text.type)
    offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        rel = offsets[first : last + 1] - offsets[first]
        piece = data[offsets[first] : offsets[last]]
        yield first, last, *_hash(piece, rel, table)
        first = last


def _hash(piece: np.ndarray, rel: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(piece)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(rel), np.int64)
    space = table[piece]
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0] = closes[-1] = True
    opens[1:], closes[:-1] = space[:-1], space[1:]
    opens[rel[:-1][rel[:-1] < n]] = True
    closes[rel[1:][rel[1:] > 0] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & opens), np.flatnonzero(word & closes) + 1
    place = np.arange(n, dtype=np.uint64)  # within the word; what follows a word does not matter
    place -= np.repeat(np.append(np.uint64(0), starts.astype(np.uint64)), np.diff(np.concatenate([[0], starts, [n]])))
    values = _mixed((place << np.uint64(8) | LOWER[piece]) + np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return _mixed(sums[ends] - sums[starts]), np.searchsorted(starts, rel)
