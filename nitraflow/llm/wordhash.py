"""Word spans and 64-bit hashes of words, lines and windows, computed on Arrow text buffers with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are polynomial sums
modulo 2**64 over random byte values, finished by a mixing step. Equality of hashes stands for
equality of words; with 64 bits, chance collisions inside one corpus are negligible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
RAW = np.arange(256, dtype=np.uint8)
LOWERED = RAW.copy()
LOWERED[65:91] += 32
U = np.uint64

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PIECE = 1 << 20
_STEP = 1 << 15  # bytes whose values stay in a core's cache


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _PIECE + 1), _powers(_INVERSE, _PIECE + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the len+1 offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def row_ranges(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most limit bytes each; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal True run, cut where a row ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turns = np.concatenate([[0] * int(inside[0]), turns, [n] * int(inside[-1])]).astype(np.int64)
    starts, ends = turns[::2], turns[1::2]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    if len(cuts):
        starts, ends = (np.sort(np.concatenate([x, cuts]), kind="stable") for x in (starts, ends))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = LOWERED) -> np.ndarray:
    """A 64-bit hash of each span data[start:end]; spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    value = _BYTE[letters]
    held, sums = np.empty(_STEP, np.uint64), np.zeros(_STEP + 1, np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + _STEP, "right"))
        if j <= i:  # one span longer than a step
            total, scale = 0, 1
            for at in range(lo, int(ends[i]), _PIECE):
                part = value[data[at : min(at + _PIECE, int(ends[i]))]]
                total = (total + scale * int(np.sum(part * _UP[: len(part)], dtype=np.uint64))) % 2**64
                scale = scale * pow(_BASE, _PIECE, 2**64) % 2**64
            out[i] = total
            i += 1
            continue
        n = int(ends[j - 1]) - lo
        np.multiply(value[data[lo : lo + n]], _UP[:n], out=held[:n])
        np.cumsum(held[:n], out=sums[1 : n + 1])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _DOWN[a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = LOWERED):
    """(hashes, starts, ends, first) of all words; first[d]:first[d+1] are the words of row d."""
    starts, ends = runs(~SPACE[data], offsets)
    return span_hashes(data, starts, ends, letters), starts, ends, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, row, hash) of every n-word window that lies inside one row."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    rows = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][rows]
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * U(0xD1342543DE82EF95) + hashes[at + k]
    return at, rows, mix(h + U(n))


def in_row(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Keys that are equal where row and hash are."""
    return mix(h + rows.astype(np.uint64) * U(0xA0761D6478BD642F))


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[d]:offsets[d+1]] as int64."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
