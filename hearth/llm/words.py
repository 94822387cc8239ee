"""Vectorised words and word hashes for Arrow batches of texts.

A word is a maximal run of bytes outside ``20, 09-0D`` (the regular expression
``[^\\x20\\x09-\\x0D]+``); UTF-8 never uses those bytes inside another
character, so bytes and characters agree. Everything here works on one Arrow
batch inside a task and holds a bounded number of words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Workers are kept between stages; the system's allocator gives freed batches back at once.
pa.set_memory_pool(pa.system_memory_pool())

_BLOCK_BYTES = 1 << 19  # a word takes some fifty bytes of arrays while it is hashed
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    return mix64((np.arange(1, n + 1, dtype=_U64)) * _U64(0x9E3779B97F4A7C15) + _U64(seed))


_BYTES = _stream(256, 11)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS = _stream(1 << 16, 29) | _U64(1)
_COEF = _stream(64, 47) | _U64(1)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, n+1 offsets); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and n else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, n+1 offsets of each text's words)."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[-1:] = False
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z read as a-z if ``lower``)."""
    table = _LOWER if lower else _BYTES
    out = np.empty(len(starts), dtype=_U64)
    sizes = ends - starts
    cuts = [0]
    if len(starts):
        total = np.cumsum(sizes)
        cuts = [0, *np.unique(np.searchsorted(total, np.arange(_BLOCK_BYTES, total[-1], _BLOCK_BYTES), side="right")), len(starts)]
    for a, b in zip(cuts, cuts[1:]):
        if a == b:
            continue
        s, k = starts[a:b], sizes[a:b]
        heads = np.cumsum(k) - k
        place = np.arange(heads[-1] + k[-1]) - np.repeat(heads, k)
        at = place + np.repeat(s, k)
        values = table[data[at]] * _POWERS[place & 0xFFFF]
        out[a:b] = np.add.reduceat(values, heads) + k.astype(_U64) * _U64(0xD6E8FEB86659FD93)
    return mix64(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` (up to 64) consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U64)
    total = words[:n] * _COEF[0]
    for i in range(1, width):
        total = total + words[i:i + n] * _COEF[i]
    return mix64(total + _U64(width))


def chunks(offsets: np.ndarray, limit: int = _BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def byte_offsets(column: pa.Array) -> np.ndarray:
    """n+1 byte offsets of the values of a string or binary column; a null has no bytes."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
