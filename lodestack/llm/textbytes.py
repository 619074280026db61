"""Vectorised work on the UTF-8 bytes of Arrow string columns; no Python string is made per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
#: Odd multipliers of the splitmix64 finaliser (Steele, Lea and Flood 2014).
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit."""
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


def series(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


BYTE = series(256, 1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_LOW = BYTE[LOWER]
_place = series(256, 2) | _U(1)
SHINGLE = series(16, 3) | _U(1)


def places(n: int) -> np.ndarray:
    """Odd multipliers by position in a word."""
    global _place
    if n > len(_place):
        _place = series(max(n, 2 * len(_place)), 2) | _U(1)
    return _place


def text_array(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes (a longer text is a run of its own): first row, row after, bytes, offsets."""
    data, off = text_array(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without the six white-space bytes; a word never crosses rows."""
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(buf), dtype=bool)
    before[:1] = True
    np.logical_not(word[:-1], out=before[1:])
    after = np.empty(len(buf), dtype=bool)
    after[-1:] = True
    np.logical_not(word[1:], out=after[:-1])
    return np.flatnonzero(word & (before | edge[:-1])), np.flatnonzero(word & (after | edge[1:])) + 1


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths, words per row) of the words after lower-casing A-Z.

    A word's hash is a multilinear sum over its bytes, then mixed; runs of 8 MB keep the temporaries small."""
    step = 8 << 20
    if len(buf) > step and len(off) == 2:
        cuts, at = [0], 0
        while at + step < len(buf):
            blank = np.flatnonzero(SPACE[buf[at + step : at + 2 * step]])
            if not len(blank):
                break
            at += step + int(blank[0])
            cuts.append(at)
        cuts.append(len(buf))
        if len(cuts) > 2:
            parts = [word_hashes(buf[a:b], np.array([0, b - a])) for a, b in zip(cuts, cuts[1:], strict=False)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array([sum(len(p[0]) for p in parts)])
    starts, ends = word_bounds(buf, off)
    rows = np.diff(np.searchsorted(starts, off))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64), rows
    size = ends - starts
    first = np.cumsum(size) - size
    inner = buf[~SPACE[buf]]
    at = np.arange(len(inner)) - np.repeat(first, size)
    value = _BYTE_LOW[inner] * places(int(size.max()))[at]
    return mix(np.add.reduceat(value, first) + size.astype(_U)), size, rows


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (none if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = words[:n] * SHINGLE[0]
    for j in range(1, k):
        total += words[j : n + j] * SHINGLE[j]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence of any length, apart from those of k-word runs."""
    return mix(np.array([(words * places(len(words))[: len(words)]).sum(dtype=_U) + _U(len(words))], dtype=_U))[0] ^ _U(0x5851F42D4C957F2D)
