"""JPEG: baseline encoder without subsampling and with Huffman tables fitted to the picture; baseline and progressive decoder for any sampling, any number of
scans and restart intervals."""

from __future__ import annotations

import struct
from bisect import bisect_right
from functools import cache

import numpy as np

from . import blocks
from .rgbe import ImageError

# The example quantisation tables of the standard, line by line.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
) + (99,) * 32
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
DCT = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else np.sqrt(0.125)) for x in range(8)] for u in range(8)])
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
TO_RGB = np.linalg.inv(TO_YCC)
SOI, EOI = b"\xff\xd8", b"\xff\xd9"


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def segments(data: bytes):
    """(marker, body, start, end) of each segment up to and including the start of scan."""
    if data[:2] != SOI:
        raise ImageError("not a JPEG file")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ImageError("damaged JPEG file")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        (n,) = struct.unpack_from(">H", data, at + 2)
        if at + 2 + n > len(data):
            raise ImageError("damaged JPEG file")
        yield marker, data[at + 4 : at + 2 + n], at, at + 2 + n
        at += 2 + n
        if marker == 0xDA:
            return


@cache
def tables(quality: int) -> list[np.ndarray]:
    quality = min(100, max(1, int(quality)))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def _blocks(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) of a plane, its last line and column repeated."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)


def _limited(counts: dict[int, int]) -> np.ndarray:
    """Code lengths of at most 16 for symbols 0 to 255; 256 takes the code of ones only."""
    counts = dict(counts) | {256: 0}
    while True:
        lengths = blocks.code_lengths({s: n + (s != 256) for s, n in counts.items()})
        if max(lengths.values()) <= 16:
            out = np.zeros(257, np.int64)
            out[list(lengths)] = list(lengths.values())
            return out
        counts = {s: n // 2 for s, n in counts.items()}


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes by length and then symbol, lengths, and the table as it is stored; the unused last code is left out."""
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda s: (lengths[s], s))
    codes, code, before = np.zeros(257, np.uint64), 0, int(lengths[order[0]])
    for s in order:
        code <<= int(lengths[s]) - before
        before = int(lengths[s])
        codes[s] = code
        code += 1
    stored = [s for s in order if s != 256]
    return codes, lengths, bytes(sum(1 for s in stored if lengths[s] == n) for n in range(1, 17)) + bytes(stored)


def _sizes(v: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)


def encode(pixels: np.ndarray, quality: int = 95, extra: bytes = b"") -> bytes:
    """pixels: (height, width, 3) uint8. extra: segments to stand before the tables."""
    height, width = pixels.shape[:2]
    if not (0 < height < 65536 and 0 < width < 65536):
        raise ImageError("invalid image dimensions")
    ycc = pixels.astype(np.float64) @ TO_YCC.T - np.array([128.0, 0, 0])
    quant = tables(quality)
    coefs = []
    for k in range(3):
        c = DCT @ _blocks(ycc[..., k]) @ DCT.T / quant[min(k, 1)].reshape(8, 8)
        coefs.append(np.rint(c).astype(np.int64).reshape(-1, 64)[:, ZIGZAG])
    coefs = np.stack(coefs, axis=1)
    dc = np.diff(coefs[:, :, 0], axis=0, prepend=0).ravel()
    flat = coefs.reshape(-1, 64)
    m, k = np.nonzero(flat[:, 1:])
    k, v = k + 1, flat[m, k + 1]
    before = np.where(np.concatenate([[False], m[1:] == m[:-1]]) if len(m) else np.zeros(0, bool), np.concatenate([[0], k[:-1]]) if len(k) else k, 0)
    gap = k - before - 1
    last = np.zeros(len(flat), np.int64)
    np.maximum.at(last, m, k)
    every, far, ended = np.arange(len(flat)), np.repeat(np.arange(len(m)), gap // 16), np.flatnonzero(last < 63)
    nth = np.arange(len(far)) - np.repeat(np.cumsum(gap // 16) - gap // 16, gap // 16)
    # Events: place, symbol, extra bits; the class (0 for first coefficients) and the component say which table.
    place = np.concatenate([every * 1024, m * 1024 + k * 8 + 7, m[far] * 1024 + k[far] * 8 + nth, ended * 1024 + 1000])
    value = np.concatenate([dc, v, np.zeros(len(far) + len(ended), np.int64)])
    size = _sizes(value)
    symbol = np.concatenate([size[: len(dc)], (gap % 16) << 4 | size[len(dc) : len(dc) + len(v)], np.full(len(far), 0xF0), np.zeros(len(ended), np.int64)])
    table = 2 * (place // 1024 % 3 > 0) + (np.arange(len(place)) >= len(dc))
    order = np.argsort(place, kind="stable")
    value, size, symbol, table = value[order], size[order], symbol[order], table[order]
    code, bits, stored = np.zeros(len(order), np.uint64), np.zeros(len(order), np.int64), []
    for t in range(4):
        at = table == t
        s, n = np.unique(symbol[at], return_counts=True)
        codes, lengths, body = _codes(_limited(dict(zip(s.tolist(), n.tolist(), strict=True)) or {0: 1}))
        code[at], bits[at] = codes[symbol[at]], lengths[symbol[at]]
        stored.append(segment(0xC4, bytes([(t & 1) << 4 | t >> 1]) + body))
    low = np.where(value < 0, value + (1 << size) - 1, value).astype(np.uint64)
    raw, total = blocks.pack_bits(code << size.astype(np.uint64) | low, bits + size)
    if total % 8:
        raw = raw[:-1] + bytes([raw[-1] | (1 << (8 - total % 8)) - 1])
    head = SOI + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + extra
    head += b"".join(segment(0xDB, bytes([t]) + bytes(quant[t][ZIGZAG].astype(np.uint8))) for t in (0, 1))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\1\x11\0\2\x11\1\3\x11\1") + b"".join(stored)
    return head + segment(0xDA, b"\3\1\0\2\x11\3\x11\0\x3f\0") + raw.replace(b"\xff", b"\xff\0") + EOI


class _Lookup(dict):
    """For 16 bits the length and symbol of the code that they begin with, found when they are first asked for: a small picture meets few of the 65,536."""

    def __init__(self, body: bytes):
        code, at, self.starts, self.ends, self.found = 0, 16, [], [], []
        for n in range(1, 17):
            for _ in range(body[n - 1]):
                self.starts.append(code << (16 - n))
                self.ends.append(code + 1 << (16 - n))
                self.found.append((n, body[at]))
                code, at = code + 1, at + 1
            code <<= 1
        self.size = at

    def __missing__(self, bits: int) -> tuple[int, int]:
        k = bisect_right(self.starts, bits) - 1
        self[bits] = got = self.found[k] if k >= 0 and bits < self.ends[k] else (0, 0)
        return got


def _scan(raw: bytes, order, first: list, rest: list, units: int, out: list[np.ndarray], at: int) -> None:
    """One restart interval: units from number at on. order: component and block number of each block in a unit."""
    bits, held, pos, before = 0, 0, 0, [0] * len(out)

    def fill():
        nonlocal bits, held, pos
        bits, held, pos = bits << 64 | int.from_bytes(raw[pos : pos + 8].ljust(8, b"\xff"), "big"), held + 64, pos + 8

    for unit in range(at, at + units):
        if pos > len(raw) + 16:
            raise ImageError("the JPEG data end early")
        for c, block_at in order:
            table, k, block = first[c], 0, out[c][block_at(unit)]
            while k < 64:
                if held < 32:
                    fill()
                n, s = table[bits >> (held - 16) & 0xFFFF]
                if not n:
                    raise ImageError("damaged JPEG data")
                held -= n
                size, run = (s, 0) if not k else (s & 15, s >> 4)
                v = 0
                if size:
                    held -= size
                    v = bits >> held & ((1 << size) - 1)
                    if v < 1 << (size - 1):
                        v -= (1 << size) - 1
                bits &= (1 << held) - 1
                if not k:
                    before[c] += v
                    block[0], k, table = before[c], 1, rest[c]
                elif size:
                    k += run
                    if k > 63:
                        raise ImageError("damaged JPEG data")
                    block[k] = v
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    break


def _refined(block, lo: int, hi: int, one: int, zeros: int, get) -> int:
    """Reads a correction bit for each coefficient from lo to hi that is not 0, as far as a 0 that zeros others come before; returns its place."""
    k = lo
    while k <= hi:
        v = block[k]
        if v:
            if get(1) and not abs(v) & one:
                block[k] = v + one if v > 0 else v - one
        elif not zeros:
            break
        else:
            zeros -= 1
        k += 1
    return k


def _progressive(raw: bytes, order, first: dict, rest: dict, units: int, out: list[np.ndarray], at: int, lo: int, hi: int, high: int, low: int) -> None:
    """One restart interval of a progressive scan: coefficients lo to hi, their bits from low up (high is 0) or the bit low alone."""
    bits, held, pos, before, skip, one = 0, 0, 0, [0] * len(out), 0, 1 << low

    def get(n: int) -> int:
        nonlocal bits, held, pos
        while held < max(n, 16):
            bits, held, pos = bits << 64 | int.from_bytes(raw[pos : pos + 8].ljust(8, b"\xff"), "big"), held + 64, pos + 8
        held -= n
        v = bits >> held
        bits &= (1 << held) - 1
        return v

    def symbol(table) -> int:
        nonlocal bits, held
        get(0)
        n, s = table[bits >> (held - 16)]
        if not n:
            raise ImageError("damaged JPEG data")
        held -= n
        bits &= (1 << held) - 1
        return s

    def signed(size: int) -> int:
        v = get(size) if size else 0
        return v - (1 << size) + 1 if size and v < 1 << (size - 1) else v

    for unit in range(at, at + units):
        if pos > len(raw) + 16:
            raise ImageError("the JPEG data end early")
        for c, block_at in order:
            block = out[c][block_at(unit)]
            if not lo:
                if high:
                    block[0] |= get(1) << low
                else:
                    before[c] += signed(symbol(first[c]))
                    block[0] = before[c] << low
                continue
            k = lo
            while k <= hi and not skip:
                s = symbol(rest[c])
                run, size = s >> 4, s & 15
                if not size and run < 15:
                    skip = (1 << run) + (get(run) if run else 0)
                    break
                v = 0
                if size:
                    v = (one if get(1) else -one) if high else signed(size) * one
                k = _refined(block, k, hi, one, run, get) if high else k + run
                if v:
                    if k > hi:
                        raise ImageError("damaged JPEG data")
                    block[k] = v
                k += 1
            if skip:
                if high:
                    _refined(block, k, hi, one, 64, get)
                skip -= 1


def _parts(data: bytes):
    """(marker, body, entropy-coded bytes after it) of each segment; only scans have such bytes."""
    at = 2
    for marker, body, _, end in segments(data):
        yield marker, body, b"" if marker != 0xDA else _entropy(data, end)
        at = end
    while marker == 0xDA:  # segments ends with the first scan
        at += len(_entropy(data, at))
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xD9:
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (n,) = struct.unpack_from(">H", data, at + 2)
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDA:
                yield marker, body, _entropy(data, at)
                break
            yield marker, body, b""
        else:
            return


def _entropy(data: bytes, at: int) -> bytes:
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            return data[at:]
        if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
            return data[at:end]
        end += 2


def _intervals(raw: bytes, interval: int) -> list[bytes]:
    """The bytes of each restart interval, without their stuffing."""
    pieces, at = [], 0
    if interval:
        k = raw.find(b"\xff")
        while 0 <= k < len(raw) - 1:
            if 0xD0 <= raw[k + 1] <= 0xD7:
                pieces.append(raw[at:k])
                at = k + 2
            k = raw.find(b"\xff", k + 2)
    return [p.replace(b"\xff\0", b"\xff") for p in (*pieces, raw[at:])]


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) uint8 of a baseline or progressive picture in any number of scans; one component is grey."""
    quant, lookups, frame, interval, scans, progressive = {}, {}, None, 0, 0, False
    parts, coefs, across, down, h_max, v_max = [], [], 0, 0, 1, 1
    for marker, body, raw in _parts(data):
        if marker == 0xDB:
            at = 0
            while at < len(body):
                wide, t = body[at] >> 4, body[at] & 15
                n = 128 if wide else 64
                quant[t] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else "u1").astype(np.int64)
                at += 1 + n
        elif marker == 0xC4:
            at = 0
            while at < len(body):
                lookups[body[at]] = table = _Lookup(body[at + 1 :])
                at += 1 + table.size
        elif marker in (0xC0, 0xC1, 0xC2):
            frame, progressive = body, marker == 0xC2
            if frame[0] != 8:
                raise ImageError("only JPEG files of 8 bits are supported")
            height, width = struct.unpack_from(">HH", frame, 1)
            parts = [(frame[6 + 3 * k], frame[7 + 3 * k] >> 4, frame[7 + 3 * k] & 15, frame[8 + 3 * k]) for k in range(frame[5])]
            if not height or not width or not all(h and v for _, h, v, _ in parts):
                raise ImageError("invalid image dimensions")
            h_max, v_max = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-width // (8 * h_max)), -(-height // (8 * v_max))
            coefs = [np.zeros((across * down * h * v, 64), np.int64) for _, h, v, _ in parts]
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ImageError("only baseline and progressive JPEG files are supported")
        elif marker == 0xDD:
            (interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if frame is None:
                raise ImageError("the JPEG file has a scan before its frame")
            names = [p[0] for p in parts]
            used = [(names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            first = {c: lookups.get(t >> 4) for c, t in used}
            rest = {c: lookups.get(16 | t & 15) for c, t in used}
            order, units = [], across * down
            for c, _ in used:
                _, h, v, _ = parts[c]
                if len(used) == 1:  # a component alone is stored block by block, without those that only fill up units
                    wide = -(-(-(-width * h // h_max)) // 8)
                    units = wide * -(-(-(-height * v // v_max)) // 8)
                    order.append((c, lambda unit, wide=wide, h=h: unit // wide * across * h + unit % wide))
                    continue
                for y in range(v):
                    for x in range(h):
                        order.append((c, lambda unit, x=x, y=y, h=h, v=v: ((unit // across) * v + y) * across * h + (unit % across) * h + x))
            lo, hi, bit = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            if progressive and (hi > 63 or lo > hi or (hi and not lo) or (lo and len(used) > 1)):
                raise ImageError("damaged JPEG file")
            if (lo == 0 and not bit >> 4 and None in first.values()) or (hi and (lo or not progressive) and None in rest.values()):
                raise ImageError("the JPEG file lacks a code table")
            done = 0
            for piece in _intervals(raw, interval):
                n = min(interval or units, units - done)
                if progressive:
                    _progressive(piece, order, first, rest, n, coefs, done, lo, hi, bit >> 4, bit & 15)
                else:
                    _scan(piece, order, first, rest, n, coefs, done)
                done += n
            if done < units:
                raise ImageError("the JPEG data end early")
            scans += 1
    if not scans:
        raise ImageError("the JPEG file has no scan")
    planes = []
    for (_, h, v, t), c in zip(parts, coefs, strict=True):
        plain = np.zeros((len(c), 64))
        plain[:, ZIGZAG] = c * quant[t]
        px = (DCT.T @ plain.reshape(-1, 8, 8) @ DCT).reshape(down * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        planes.append(np.repeat(np.repeat(px, v_max // v, axis=0), h_max // h, axis=1)[:height, :width])
    if len(planes) == 1:
        planes = planes * 3
        return np.clip(np.rint(np.stack(planes, axis=-1) + 128), 0, 255).astype(np.uint8)
    rgb = (np.stack(planes[:3], axis=-1) + np.array([128.0, 0, 0])) @ TO_RGB.T
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
