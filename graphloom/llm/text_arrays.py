"""Words of Arrow string batches as numpy arrays: hashes without a Python object for any word.

The UTF-8 bytes of many documents are hashed at once. With S the prefix sums of value(byte_i) * B^i modulo 2^64, the
word from s to e has the hash (S[e] - S[s]) * B^-s, whatever its place. Chunks of about ``CHUNK`` bytes bound memory;
a longer document is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Space and the characters 9 to 13.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
#: Those and all other ASCII characters but letters and digits.
NON_WORD = bytes(i for i in range(128) if not chr(i).isalnum())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def byte_values(separators: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash value for each byte, with ``fold`` the same for both cases of A to Z, and whether it is part of a word."""
    codes = np.arange(256, dtype=np.uint64)
    if fold:
        codes[65:91] += np.uint64(32)
    part = np.ones(256, bool)
    part[list(separators)] = False
    return mix(codes + np.uint64(0x51ED270B)), part


_powers: dict[str, np.ndarray] = {}


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i up to n."""
    if len(_powers.get("up", ())) < n + 1:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, CHUNK) + 1, base & _MASK, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), bounds


def chunks(bounds: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes together."""
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def word_spans(own: np.ndarray, bounds: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, first)``: the bytes of every word in order; row i has the words ``first[i]`` to ``first[i + 1]``.

    ``own`` holds the bytes of the rows from ``bounds[0]`` to ``bounds[-1]``, and the places count from there.
    """
    bounds = bounds - int(bounds[0])
    inside = part[own]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(own)]
    opens[edges] = inside[edges]  # a row never goes on with the word of the row before
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def span_hashes(own: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, whatever its place."""
    up, down = powers_to(len(own))
    sums = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(values[own] * up[: len(own)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, bounds: np.ndarray, values: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the hash of every word in order; row i has the words ``first[i]`` to ``first[i + 1]``."""
    own = data[int(bounds[0]) : int(bounds[-1])]
    if not len(own):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    starts, ends, first = word_spans(own, bounds, part)
    return span_hashes(own, starts, ends, values), first


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans one after another, and the bounds of each."""
    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return data[np.repeat(starts - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words as one if there are fewer; none without words."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    out = words[:n].copy()
    for i in range(1, size):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n])
    return out
