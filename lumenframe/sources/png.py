"""PNG files of 8-bit RGB or RGBA pixels, by the standard library's deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .rgbe import ImageError


def write(width: int, height: int, pixels: np.ndarray) -> bytes:
    """pixels: uint8, 3 or 4 channels. Lines are stored as differences from the line above."""
    px = np.asarray(pixels, np.uint8).reshape(height, width, -1)
    up = px - np.concatenate([np.zeros_like(px[:1]), px[:-1]])
    lines = np.concatenate([np.full((height, 1), 2, np.uint8), up.reshape(height, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">2I5B", width, height, 8, 6 if px.shape[2] == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def read(data: bytes) -> dict:
    """width, height, data (float32 RGBA from 0 to 1) of an 8-bit RGB or RGBA file without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("not a PNG file")
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">2I5B", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ImageError("only 8-bit RGB and RGBA files without interlacing are read")
    width, height, channels = head[0], head[1], 3 if head[3] == 2 else 4
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as e:
        raise ImageError(f"bad pixel data: {e}") from None
    above, out = np.zeros(width * channels, np.uint8), np.ones((height, width, 4), np.float32)
    for y in range(height):
        above = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, channels)
        out[y, :, :channels] = above.reshape(width, channels) / 255
    return {"width": width, "height": height, "data": out.ravel(), "space": "linear-rec709", "metadata": {"transfer": "display"}}


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind in (0, 2):
        return line + above if kind else line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ImageError(f"unknown filter: {kind}")
    out, up = [0] * step, [0] * step + above.tolist()
    for k, v in enumerate(line.tolist()):
        left, top, corner = out[k], up[k + step], up[k]
        if kind == 3:
            guess = (left + top) // 2
        else:  # whichever of the three is nearest to left + top - corner, in this order among equals
            guess = min((abs(top - corner), 0, left), (abs(left - corner), 1, top), (abs(left + top - 2 * corner), 2, corner))[2]
        out.append((v + guess) & 255)
    return np.array(out[step:], np.uint8)
