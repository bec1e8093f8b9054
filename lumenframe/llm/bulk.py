"""Numpy over whole Arrow buffers: words, their hashes, shingles, and winnowed anchors, without a Python step for each word or byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BASE = int(_RNG.integers(1 << 60, 1 << 62)) | 5
_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: About so many bytes of text are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, size: int = CHUNK, rows: int = 512):
    """(first row, last row + 1, bytes, offsets) of runs of rows of about size bytes. Buffers are copied for a few rows at a time."""
    for at in range(0, len(column), rows):
        data, offsets = utf8(column.slice(at, rows))
        first, n = 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
            yield at + first, at + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finisher)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        m = 1 << int(n - 1).bit_length()
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(m, U(b))
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """For span_hashes: sums of symbols, each times its power of BASE, modulo 2**64."""
    total = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols) + 1)[0][:-1], out=total[1:])
    return total


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the symbols from starts to ends, by prefix_sums; they depend on the symbols and their number alone."""
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts] + (ends - starts).astype(U))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all [^\\x20\\x09-\\x0D]+ words: 64-bit hashes, byte starts and ends, and the offsets of the rows' words. lower folds A-Z first."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    hashes = span_hashes(prefix_sums(BYTE[data]), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and their rows; a row with fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(rows)
    row = np.repeat(np.arange(len(counts)), counts)
    end = rows[1:][row] if len(row) else row
    at = np.flatnonzero(np.arange(len(hashes)) + n <= end)
    whole = np.zeros(len(at), U)
    for k in range(n):
        whole = (whole + hashes[at + k]) * U(0x9E3779B97F4A7C15 + 2 * k)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            has = counts[short] > k
            extra[has] = (extra[has] + hashes[rows[:-1][short[has]] + k]) * U(0x9E3779B97F4A7C15 + 2 * k)
        extra += counts[short].astype(U) * U(0xD6E8FEB86659FD93)
        whole, row = np.concatenate([whole, extra]), np.concatenate([row[at], short])
    else:
        row = row[at]
    return mix(whole), row


def distinct_by_row(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values and rows, ordered by row and value, repeats within a row gone."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


def anchors(symbols: np.ndarray, rows: np.ndarray, window: int, gram: int):
    """Winnowing: every window of so many symbols inside a row is given one of its grams, the one of least hash, first among equals. The choice depends
    on the window's content alone, so equal windows have equal anchors at equal places.

    symbols: 64-bit hashes. Returns the anchors' gram hashes, and for each the first and the last window start it stands for."""
    n, span = len(symbols), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, U), none, none
    g, size, factor = symbols, 1, BASE
    while size * 2 <= gram:
        g = g[:-size] * U(factor) + g[size:]
        size, factor = size * 2, factor * factor & _MASK
    if size < gram:
        rest = gram - size
        g = g[:-rest] * U(pow(BASE, 3, 1 << 64)) + mix(g[rest:])
    g = mix(g)
    bits = U(max(1, int(len(g)).bit_length()))
    best = (g >> bits << bits) | np.arange(len(g), dtype=U)
    size = 1
    while size * 2 <= span:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < span:
        best = np.minimum(best[: len(best) - (span - size)], best[span - size :])
    at = (best & ((U(1) << bits) - U(1))).astype(np.int64)
    counts = np.diff(rows)
    left = np.repeat(rows[1:], counts)[: len(at)] - np.arange(len(at))
    valid = np.flatnonzero(left >= window)
    if not len(valid):
        return np.zeros(0, U), none, none
    a = at[valid]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(a)]]) - 1
    # Least hashes are small numbers: mixed again, so that their high bits can deal them out evenly.
    return mix(g[a[first]] + U(0x9E3779B97F4A7C15)), valid[first], valid[last]


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., counts[i] of them, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(first - (np.cumsum(counts) - counts), counts)
    out += np.arange(total)
    return out
