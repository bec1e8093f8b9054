"""Block codecs of scanline EXR: run lengths, deflate, 24-bit deltas, and wavelet with Huffman coding. All on numpy arrays."""

from __future__ import annotations

import heapq
import struct
import zlib

import numpy as np

MIN_RUN, MAX_RUN = 3, 127


def split_planes(raw: bytes) -> np.ndarray:
    """Even bytes, then odd ones."""
    a = np.frombuffer(raw, np.uint8)
    return np.concatenate([a[::2], a[1::2]])


def join_planes(a: np.ndarray) -> bytes:
    out, half = np.empty_like(a), (len(a) + 1) // 2
    out[::2], out[1::2] = a[:half], a[half:]
    return out.tobytes()


def predict(a: np.ndarray) -> np.ndarray:
    """Byte differences with a bias of 128; the first byte stays."""
    out = a.copy()
    out[1:] = a[1:] - a[:-1] + np.uint8(128)
    return out


def unpredict(a: np.ndarray) -> np.ndarray:
    steps = a.copy()
    steps[1:] -= np.uint8(128)
    return np.cumsum(steps, dtype=np.uint8)


def rle_encode(a: np.ndarray) -> bytes:
    """n >= 0: the next byte n + 1 times; n < 0: -n bytes as they are."""
    if not len(a):
        return b""
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    raw, out, literal = a.tobytes(), bytearray(), bytearray()

    def flush():
        for k in range(0, len(literal), MAX_RUN):
            part = literal[k : k + MAX_RUN]
            out.append(256 - len(part))
            out.extend(part)
        literal.clear()

    for start, n in zip(cut.tolist(), np.diff(np.concatenate([cut, [len(a)]])).tolist(), strict=True):
        while n >= MIN_RUN:
            flush()
            take = min(n, MAX_RUN + 1)
            out += bytes((take - 1, raw[start]))
            n -= take
        literal.extend(raw[start : start + 1] * n)
    flush()
    return bytes(out)


def rle_decode(raw: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            parts.append(raw[at + 1 : at + 2] * (n + 1))
            at += 2
        else:
            parts.append(raw[at + 1 : at + 1 + 256 - n])
            at += 1 + 256 - n
    return np.frombuffer(b"".join(parts), np.uint8)


# 24-bit deltas


def float24(u: np.ndarray) -> np.ndarray:
    """The upper 24 bits of float32 bit patterns, mantissas rounded half up; what would overflow keeps its largest mantissa, NaN stays NaN."""
    u = u.astype(np.uint32)
    sign, body = u & np.uint32(0x80000000), u & np.uint32(0x7FFFFFFF)
    up = (body >> 8) + ((body >> 7) & np.uint32(1))
    up = np.where(up >= 0x7F8000, body >> 8, up)
    special = body >= 0x7F800000
    mantissa = (body & np.uint32(0x7FFFFF)) >> 8
    mantissa = np.where((body > 0x7F800000) & (mantissa == 0), 1, mantissa)
    return (np.where(special, 0x7F8000 | mantissa, up) | (sign >> 8)).astype(np.uint32)


def pxr24_encode(lines: list[list[np.ndarray]]) -> bytes:
    """lines: of each line each channel's values, as uint16, uint32 or float32."""
    out = []
    for line in lines:
        for values in line:
            n = 3 if values.dtype == np.float32 else values.dtype.itemsize
            v = float24(values.view(np.uint32)) if n == 3 else values.astype(np.uint32)
            d = np.diff(v, prepend=np.uint32(0))
            out.extend((d >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8) for k in reversed(range(n)))
    return zlib.compress(np.concatenate(out).tobytes() if out else b"", 4)


def pxr24_decode(raw: bytes, kinds: list[np.dtype], width: int, lines: int) -> list[list[np.ndarray]]:
    data, at, out = np.frombuffer(zlib.decompress(raw), np.uint8), 0, []
    for _ in range(lines):
        out.append([])
        for kind in kinds:
            n = 3 if kind == np.float32 else kind.itemsize
            planes = data[at : at + n * width].reshape(n, width).astype(np.uint32)
            at += n * width
            d = np.zeros(width, np.uint32)
            for k in range(n):
                d = d << np.uint32(8) | planes[k]
            v = np.cumsum(d, dtype=np.uint32)
            out[-1].append((v << np.uint32(8)).view(np.float32) if n == 3 else v.astype(kind))
    return out


# Wavelet


def _pair14(a, b):
    a, b = a.astype(np.int16).astype(np.int32), b.astype(np.int16).astype(np.int32)
    return ((a + b) >> 1).astype(np.uint16), (a - b).astype(np.uint16)


def _unpair14(low, high):
    low, high = low.astype(np.int16).astype(np.int32), high.astype(np.int16).astype(np.int32)
    a = low + (high & 1) + (high >> 1)
    return a.astype(np.uint16), (a - high).astype(np.uint16)


def _pair16(a, b):
    a, b = (a.astype(np.int32) + 0x8000) & 0xFFFF, b.astype(np.int32)
    mean, d = (a + b) >> 1, a - b
    return np.where(d < 0, (mean + 0x8000) & 0xFFFF, mean).astype(np.uint16), (d & 0xFFFF).astype(np.uint16)


def _unpair16(low, high):
    low, high = low.astype(np.int32), high.astype(np.int32)
    b = (low - (high >> 1)) & 0xFFFF
    return ((high + b - 0x8000) & 0xFFFF).astype(np.uint16), b.astype(np.uint16)


def _views(plane: np.ndarray, p: int):
    """Of one level: the four corners of all squares, and the pairs at the odd column and row."""
    ny, nx = plane.shape
    ys, xs = ny // (2 * p) * 2 * p, nx // (2 * p) * 2 * p
    corners = [plane[dy : ys : 2 * p, dx : xs : 2 * p] for dy in (0, p) for dx in (0, p)]
    column = (plane[0 : ys : 2 * p, xs], plane[p : ys : 2 * p, xs]) if nx & p else None
    row = (plane[ys, 0 : xs : 2 * p], plane[ys, p : xs : 2 * p]) if ny & p else None
    return corners, [edge for edge in (column, row) if edge]


def wavelet(plane: np.ndarray, top: int, inverse: bool = False) -> None:
    """In place, level by level; values up to top below 2**14 take plain sums, others arithmetic modulo 2**16."""
    steps = [1 << k for k in range(min(plane.shape).bit_length() - 1)] if min(plane.shape, default=0) else []
    if not inverse:
        pair = _pair14 if top < 1 << 14 else _pair16
        for p in steps:
            (a, b, c, d), edges = _views(plane, p)
            (ab, ab_), (cd, cd_) = pair(a, b), pair(c, d)
            a[...], c[...] = pair(ab, cd)
            b[...], d[...] = pair(ab_, cd_)
            for x, y in edges:
                x[...], y[...] = pair(x, y)
    else:
        unpair = _unpair14 if top < 1 << 14 else _unpair16
        for p in reversed(steps):
            (a, b, c, d), edges = _views(plane, p)
            (ab, cd), (ab_, cd_) = unpair(a, c), unpair(b, d)
            a[...], b[...] = unpair(ab, ab_)
            c[...], d[...] = unpair(cd, cd_)
            for x, y in edges:
                x[...], y[...] = unpair(x, y)


# Huffman codes over 16-bit symbols and one run symbol

SYMBOLS = (1 << 16) + 1
LONGEST, TABLE_BITS = 58, 14
SHORT_ZEROS, LONG_ZEROS = 59, 63  # 59 to 62: 2 to 5 zero lengths; 63 and a byte: 6 and more


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a Huffman code, ties settled by symbol."""
    heap = [(n, s, (s,)) for s, n in sorted(counts.items())]
    heapq.heapify(heap)
    lengths = dict.fromkeys(counts, 0)
    if len(heap) == 1:
        return dict.fromkeys(counts, 1)
    while len(heap) > 1:
        (n, s, a), (m, t, b) = heapq.heappop(heap), heapq.heappop(heap)
        for x in a + b:
            lengths[x] += 1
        heapq.heappush(heap, (n + m, min(s, t), a + b))
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and then symbol; longer codes are smaller numbers."""
    count = np.bincount(lengths, minlength=LONGEST + 2).tolist()
    first, code = [0] * (LONGEST + 1), 0
    for n in range(LONGEST, 0, -1):
        first[n] = code
        code = (code + count[n]) >> 1
    codes = np.zeros(len(lengths), np.uint64)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        codes[at] = np.arange(first[n], first[n] + len(at), dtype=np.uint64)
    return codes


def pack_bits(values: np.ndarray, widths: np.ndarray) -> tuple[bytes, int]:
    """Numbers of so many bits each, highest bit first."""
    widths = widths.astype(np.int64)
    total = int(widths.sum())
    if not total:
        return b"", 0
    ends = np.cumsum(widths)
    shift = (np.repeat(ends, widths) - 1 - np.arange(total)).astype(np.uint64)
    bits = (np.repeat(values.astype(np.uint64), widths) >> shift & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).tobytes(), total


def pack_lengths(lengths: np.ndarray) -> bytes:
    """From one used symbol to the next, with the zero lengths between them in as few codes as there are."""
    values, widths, at = [], [], 0
    for k in [*np.flatnonzero(lengths).tolist(), len(lengths)]:
        zeros = k - at
        while zeros:
            n = min(zeros, 255 + 6)
            values += [LONG_ZEROS, n - 6] if n >= 6 else [SHORT_ZEROS + n - 2] if n >= 2 else [0]
            widths += [6, 8] if n >= 6 else [6]
            zeros -= n
        if k < len(lengths):
            values.append(int(lengths[k]))
            widths.append(6)
        at = k + 1
    return pack_bits(np.array(values), np.array(widths))[0]


def unpack_lengths(raw: bytes, count: int) -> np.ndarray:
    bits, held, at, out, k = 0, 0, 0, np.zeros(count, np.int64), 0

    def take(n):
        nonlocal bits, held, at
        while held < n:
            bits, held, at = bits << 8 | raw[at], held + 8, at + 1
        held -= n
        got = bits >> held
        bits &= (1 << held) - 1
        return got

    while k < count:
        n = take(6)
        if n == LONG_ZEROS:
            k += take(8) + 6
        elif n >= SHORT_ZEROS:
            k += n - SHORT_ZEROS + 2
        else:
            out[k] = n
            k += 1
    return out


def huffman_encode(symbols: np.ndarray) -> bytes:
    if not len(symbols):
        return b""
    values, counts = np.unique(symbols, return_counts=True)
    low, run = int(values[0]), int(values[-1]) + 1
    lengths = np.zeros(run + 1, np.int64)
    for s, n in code_lengths(dict(zip(values.tolist(), counts.tolist(), strict=True)) | {run: 1}).items():
        lengths[s] = n
    codes = canonical(lengths)
    # Runs of one symbol, cut to the 256 places that a symbol and its 8-bit repeat count can say.
    head = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    n = np.diff(np.concatenate([head, [len(symbols)]]))
    pieces = -(-n // 256)
    s = np.repeat(symbols[head].astype(np.int64), pieces)
    last = np.cumsum(pieces) - 1
    size = np.full(len(s), 256)
    size[last] = n - (pieces - 1) * 256
    width = lengths[s]
    short = width + lengths[run] + 8 < width * (size - 1)
    times = np.where(short, 3, size)
    which = np.repeat(np.arange(len(s)), times)
    step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    in_run = short[which]
    value = np.where(in_run & (step == 1), codes[run], np.where(in_run & (step == 2), (size[which] - 1).astype(np.uint64), codes[s[which]]))
    bits = np.where(in_run & (step == 1), lengths[run], np.where(in_run & (step == 2), 8, width[which]))
    data, total = pack_bits(value, bits)
    table = pack_lengths(lengths[low : run + 1])
    return struct.pack("<5I", low, run, len(table), total, 0) + table + data


def huffman_decode(raw: bytes, count: int) -> np.ndarray:
    if not count:
        return np.zeros(0, np.uint16)
    low, run, n_table, total, _ = struct.unpack_from("<5I", raw)
    if low >= SYMBOLS or run >= SYMBOLS or low > run:
        raise ValueError("bad code table")
    lengths = np.zeros(run + 1, np.int64)
    lengths[low:] = unpack_lengths(raw[20 : 20 + n_table], run + 1 - low)
    codes = canonical(lengths)
    quick, slow = [None] * (1 << TABLE_BITS), {}
    for s in np.flatnonzero(lengths).tolist():
        n, code = int(lengths[s]), int(codes[s])
        if n <= TABLE_BITS:
            at = code << (TABLE_BITS - n)
            quick[at : at + (1 << (TABLE_BITS - n))] = [(s, n)] * (1 << (TABLE_BITS - n))
        else:
            slow[n, code] = s
    data = raw[20 + n_table : 20 + n_table + (total + 7) // 8] + b"\0" * 16
    out, bits, held, at, used = [], 0, 0, 0, 0
    while used < total and len(out) < count:
        if held < 72:
            bits, held, at = bits << 64 | int.from_bytes(data[at : at + 8].ljust(8, b"\0"), "big"), held + 64, at + 8
        hit = quick[bits >> (held - TABLE_BITS) & ((1 << TABLE_BITS) - 1)]
        if hit is None:
            for n in range(TABLE_BITS + 1, LONGEST + 1):
                if (s := slow.get((n, bits >> (held - n)))) is not None:
                    hit = s, n
                    break
            else:
                raise ValueError("bad code")
        s, n = hit
        held -= n
        used += n
        bits &= (1 << held) - 1
        if s == run:
            held -= 8
            used += 8
            out.extend(out[-1:] * (bits >> held))
            bits &= (1 << held) - 1
        else:
            out.append(s)
    if len(out) != count:
        raise ValueError("the coded data end early")
    return np.array(out, np.uint16)


def piz_encode(planes: list[np.ndarray]) -> bytes:
    """planes: each channel of the block as (lines, width, words a value) of uint16."""
    every = np.concatenate([p.ravel() for p in planes]) if planes else np.zeros(0, np.uint16)
    used = np.zeros(1 << 16, bool)
    used[every] = True
    used[0] = False
    bitmap = np.packbits(used, bitorder="little")
    full = np.flatnonzero(bitmap)
    first, last = (int(full[0]), int(full[-1])) if len(full) else (1, 0)
    used[0] = True  # 0 has a rank even where it does not occur
    rank = (np.cumsum(used) - 1).astype(np.uint16)
    top, coded = int(used.sum()) - 1, []
    for p in planes:
        p = rank[p]
        for k in range(p.shape[2]):
            wavelet(p[:, :, k], top)
        coded.append(p.ravel())
    body = huffman_encode(np.concatenate(coded) if coded else every)
    return struct.pack("<2H", first, last) + bitmap[first : last + 1].tobytes() + struct.pack("<I", len(body)) + body


def piz_decode(raw: bytes, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    first, last = struct.unpack_from("<2H", raw)
    n = max(0, last - first + 1)
    bitmap = np.zeros(1 << 13, np.uint8)
    bitmap[first : first + n] = np.frombuffer(raw, np.uint8, n, 4)
    used = np.unpackbits(bitmap, bitorder="little").astype(bool)
    used[0] = True
    values = np.flatnonzero(used).astype(np.uint16)
    (size,) = struct.unpack_from("<I", raw, 4 + n)
    counts = [int(np.prod(s)) for s in shapes]
    every, out, at = huffman_decode(raw[8 + n : 8 + n + size], sum(counts)), [], 0
    for shape, count in zip(shapes, counts, strict=True):
        p = every[at : at + count].reshape(shape).copy()
        at += count
        for k in range(shape[2]):
            wavelet(p[:, :, k], len(values) - 1, inverse=True)
        out.append(values[np.minimum(p, len(values) - 1)])
    return out
