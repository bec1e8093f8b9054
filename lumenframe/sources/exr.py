"""Scanline EXR: header, blocks and whole files, with RGB or RGBA channels.

A block that coding would enlarge is stored as it is. Uncompressed blocks lie line by line and channel by channel; files whose uncompressed blocks are
interleaved by pixel are read with interleaved=True."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..functions.color import CHROMATICITIES
from . import blocks
from .rgbe import ImageError

MAGIC = 20000630
#: Codes by name, and lines a block. Fixed values of the format.
COMPRESSION = {"none": 0, "rle": 1, "zips": 2, "zip": 3, "piz": 4, "pxr24": 5}
BLOCK_LINES = {"none": 1, "rle": 1, "zips": 1, "zip": 16, "piz": 32, "pxr24": 16}
UNSUPPORTED = {6: "B44", 7: "B44A", 8: "DWAA", 9: "DWAB"}
KINDS = (np.dtype("<u4"), np.dtype("<f2"), np.dtype("<f4"))
REQUIRED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")
TILED, LONG_NAMES, DEEP, MULTIPART = 0x200, 0x400, 0x800, 0x1000
#: x, y of red, green, blue and white, one after the other.
PRIMARIES = {f"linear-{name}": tuple(v for xy in each for v in xy) for name, each in CHROMATICITIES.items()}
ALIASES = {"r": "r", "red": "r", "g": "g", "green": "g", "b": "b", "blue": "b", "a": "a", "alpha": "a"}


def space_of(chromaticities) -> str:
    """The first known space within 0.01 of all eight values; Rec.709 where none are given or none fits."""
    for name, known in PRIMARIES.items() if chromaticities else ():
        if max(abs(a - b) for a, b in zip(chromaticities, known, strict=True)) <= 0.01:
            return name
    return "linear-rec709"


def half_bits(v: np.ndarray) -> np.ndarray:
    """float32 as half bit patterns, mantissas rounded half up; too large becomes infinity, NaN stays NaN."""
    u = np.ascontiguousarray(v, np.float32).view(np.uint32)
    sign, body = (u >> 16 & 0x8000).astype(np.uint32), u & np.uint32(0x7FFFFFFF)
    normal = (body - np.uint32(0x38000000) + np.uint32(0x1000)) >> 13
    small = np.floor(np.minimum(np.abs(np.nan_to_num(v.astype(np.float64))), 1.0) * 2.0**24 + 0.5).astype(np.uint32)
    small = np.where(body < 0x33800000, 0, small)
    out = np.where(body < 0x38800000, small, np.where(body >= 0x477FF000, 0x7C00, normal))
    return (sign | np.where(body > 0x7F800000, 0x7E00, out)).astype(np.uint16)


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.find(b"\0", at)
    if end < 0:
        raise ImageError("missing required header attributes")
    return data[at:end].decode("latin-1"), end + 1


def _channels(raw: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(raw) and raw[at]:
        name, at = _text(raw, at)
        kind, linear, xs, ys = struct.unpack_from("<iB3x2i", raw, at)
        out.append({"name": name, "kind": kind, "linear": linear, "x": xs, "y": ys})
        at += 16
    return out


def read_header(data: bytes) -> tuple[dict, int]:
    """The attributes that are understood (others as their type's name) and where the offset table begins."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise ImageError("incorrect magic number")
    (version,) = struct.unpack_from("<I", data, 4)
    if version & (TILED | DEEP | MULTIPART):
        raise ImageError("Multi-part, tiled, and deep data are not supported")
    header, at = {}, 8
    try:
        while data[at]:
            name, at = _text(data, at)
            kind, at = _text(data, at)
            (size,) = struct.unpack_from("<i", data, at)
            raw, at = data[at + 4 : at + 4 + size], at + 4 + size
            match kind:
                case "chlist":
                    header[name] = _channels(raw)
                case "box2i":
                    header[name] = struct.unpack("<4i", raw)
                case "compression" | "lineOrder":
                    header[name] = raw[0]
                case "float":
                    header[name] = struct.unpack("<f", raw)[0]
                case "v2f":
                    header[name] = struct.unpack("<2f", raw)
                case "chromaticities":
                    header[name] = struct.unpack("<8f", raw)
                case "string":
                    header[name] = raw.decode("utf-8", "replace")
                case _:
                    header[name] = kind
    except (IndexError, struct.error) as e:
        raise ImageError("missing required header attributes") from e
    if missing := [n for n in REQUIRED[:3] if n not in header]:
        raise ImageError(f"missing required header attributes: {', '.join(missing)}")
    if header["compression"] not in COMPRESSION.values():
        raise ImageError(f"Unsupported EXR compression: {UNSUPPORTED.get(header['compression'], header['compression'])}")
    return header, at + 1


def window(header: dict) -> tuple[int, int, int, int]:
    """Left, top, width, height of the data window."""
    x0, y0, x1, y1 = header["dataWindow"]
    if x1 < x0 or y1 < y0:
        raise ImageError("invalid image dimensions")
    return x0, y0, x1 - x0 + 1, y1 - y0 + 1


def compression_of(header: dict) -> str:
    return next(n for n, c in COMPRESSION.items() if c == header["compression"])


def block_list(data: bytes, header: dict, table: int) -> list[tuple[int, int, bytes]]:
    """First line (from 0), lines and payload of each block that the offset table names; offsets outside the file are left out."""
    _, top, _, height = window(header)
    lines = BLOCK_LINES[compression_of(header)]
    n = -(-height // lines)
    if table + 8 * n > len(data):
        raise ImageError("no valid scanline block offsets")
    out = []
    for at in np.frombuffer(data, "<u8", n, table).tolist():
        if not table + 8 * n <= at <= len(data) - 8:
            continue
        y, size = struct.unpack_from("<iI", data, at)
        if 0 <= y - top < height and at + 8 + size <= len(data):
            out.append((y - top, min(lines, height - (y - top)), data[at + 8 : at + 8 + size]))
    if not out:
        raise ImageError("no valid scanline block offsets")
    return out


def _planar(raw: bytes, kinds, width: int, lines: int, interleaved: bool) -> list[np.ndarray]:
    """Channels (lines, width) of line-wise bytes."""
    if len(raw) != lines * width * sum(k.itemsize for k in kinds):
        raise ImageError(f"expected {lines * width * sum(k.itemsize for k in kinds)} bytes in a block")
    if interleaved:
        table = np.frombuffer(raw, np.dtype([(f"c{i}", k) for i, k in enumerate(kinds)])).reshape(lines, width)
        return [table[f"c{i}"] for i in range(len(kinds))]
    data, at, out = np.frombuffer(raw, np.uint8).reshape(lines, -1), 0, []
    for k in kinds:
        out.append(np.ascontiguousarray(data[:, at : at + width * k.itemsize]).view(k))
        at += width * k.itemsize
    return out


def decode_block(payload: bytes, compression: str, kinds, width: int, lines: int, interleaved: bool = False) -> list[np.ndarray]:
    """Channels (lines, width) in the order of the header."""
    size = lines * width * sum(k.itemsize for k in kinds)
    try:
        if compression == "none" or len(payload) == size:
            return _planar(payload, kinds, width, lines, interleaved and compression == "none")
        if compression == "piz":
            planes = blocks.piz_decode(payload, [(lines, width, k.itemsize // 2) for k in kinds])
            return [np.ascontiguousarray(p).view(k).reshape(lines, width) for p, k in zip(planes, kinds, strict=True)]
        if compression == "pxr24":
            plain = [np.dtype("u2") if k.itemsize == 2 else k for k in kinds]
            got = blocks.pxr24_decode(payload, plain, width, lines)
            return [np.stack([line[c] for line in got]).view(k) for c, k in enumerate(kinds)]
        raw = blocks.rle_decode(payload) if compression == "rle" else np.frombuffer(zlib.decompress(payload), np.uint8)
        return _planar(blocks.join_planes(blocks.unpredict(raw)), kinds, width, lines, False)
    except (ValueError, IndexError, struct.error, zlib.error) as e:
        raise e if isinstance(e, ImageError) else ImageError(f"damaged {compression} block") from e


def encode_block(channels: list[np.ndarray], compression: str) -> bytes:
    """channels: (lines, width) arrays of half, float or unsigned values in the order of the header."""
    raw = b"".join(np.ascontiguousarray(c[y]).tobytes() for y in range(len(channels[0])) for c in channels)
    match compression:
        case "none":
            return raw
        case "rle":
            out = blocks.rle_encode(blocks.predict(blocks.split_planes(raw)))
        case "zip" | "zips":
            out = zlib.compress(blocks.predict(blocks.split_planes(raw)).tobytes(), 4)
        case "pxr24":
            out = blocks.pxr24_encode([[c[y].view(np.uint16) if c.itemsize == 2 else c[y] for c in channels] for y in range(len(channels[0]))])
        case "piz":
            out = blocks.piz_encode([np.ascontiguousarray(c).view(np.uint16).reshape(*c.shape, c.itemsize // 2) for c in channels])
        case _:
            raise ImageError(f"Unsupported EXR compression: {compression}")
    return out if len(out) < len(raw) else raw


def channel_order(header: dict) -> tuple[list[np.dtype], dict[str, int]]:
    """Kinds of all channels, and where r, g, b and a stand among them."""
    for c in header["channels"]:
        if (c["x"], c["y"]) != (1, 1):
            raise ImageError("subsampled channels are not supported")
        if not 0 <= c["kind"] < len(KINDS):
            raise ImageError("unknown pixel type")
    at = {}
    for k, c in enumerate(header["channels"]):
        if (name := ALIASES.get(c["name"].lower())) is not None:
            at.setdefault(name, k)
    if not {"r", "g", "b"} <= at.keys():
        raise ImageError("Non-RGB EXR files are not supported")
    return [KINDS[c["kind"]] for c in header["channels"]], at


def rgba(channels: list[np.ndarray], at: dict[str, int]) -> np.ndarray:
    """(lines, width, 4) float32; negative and non-finite values are 0, alpha is 1 where there is none."""
    out = np.ones((*channels[0].shape, 4), np.float32)
    for k, name in enumerate("rgba"):
        if name in at:
            with np.errstate(over="ignore"):
                out[..., k] = channels[at[name]].astype(np.float32)
    return np.where(np.isfinite(out) & (out > 0), out, np.float32(0))


def described(header: dict) -> dict:
    """width, height, space, metadata, without a look at the pixels."""
    _, _, width, height = window(header)
    metadata = {k: str(v) for k, v in header.items() if k not in ("channels", "compression")}
    metadata |= {"compression": compression_of(header), "channels": ",".join(c["name"] for c in header["channels"])}
    return {"width": width, "height": height, "space": space_of(header.get("chromaticities")), "metadata": metadata}


def read(data: bytes, interleaved: bool = False) -> dict:
    """width, height, data (float32, RGBA), space, metadata. Lines that no block holds are black."""
    header, table = read_header(data)
    kinds, at = channel_order(header)
    _, _, width, height = window(header)
    out = np.zeros((height, width, 4), np.float32)
    for first, lines, payload in block_list(data, header, table):
        out[first : first + lines] = rgba(decode_block(payload, compression_of(header), kinds, width, lines, interleaved), at)
    return described(header) | {"data": out.ravel()}


def header_bytes(width: int, height: int, compression: str, space: str, kind: int) -> bytes:
    """Magic number, version and attributes, channels in alphabetical order, with the closing zero."""
    chlist = b"".join(struct.pack("<2siB3x2i", c.encode() + b"\0", kind, 0, 1, 1) for c in "ABGR") + b"\0"
    box = struct.pack("<4i", 0, 0, width - 1, height - 1)
    attributes = [
        ("displayWindow", "box2i", box), ("dataWindow", "box2i", box), ("lineOrder", "lineOrder", b"\0"), ("pixelAspectRatio", "float", struct.pack("<f", 1)),
        ("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), ("screenWindowWidth", "float", struct.pack("<f", 1)),
        ("compression", "compression", bytes([COMPRESSION[compression]])), ("chromaticities", "chromaticities", struct.pack("<8f", *PRIMARIES[space])), ("channels", "chlist", chlist),
    ]
    return struct.pack("<2I", MAGIC, 2) + b"".join(f"{n}\0{t}\0".encode() + struct.pack("<i", len(v)) + v for n, t, v in attributes) + b"\0"


def write(width: int, height: int, data: np.ndarray, compression: str = "zip", space: str = "linear-rec709") -> bytes:
    """RGBA floats as half channels, or float ones without compression."""
    if compression not in COMPRESSION:
        raise ImageError(f"Unsupported EXR compression: {compression}")
    px = np.asarray(data, np.float32).reshape(-1, 4)
    if min(width, height) < 1 or len(px) != width * height:
        raise ImageError("invalid image dimensions")
    px = px.reshape(height, width, 4)
    half = compression != "none"
    planes = [half_bits(px[..., k]).view(np.float16) if half else np.ascontiguousarray(px[..., k]) for k in (3, 2, 1, 0)]
    head, lines = header_bytes(width, height, compression, space, 1 if half else 2), BLOCK_LINES[compression]
    body = [(y, encode_block([p[y : y + lines] for p in planes], compression)) for y in range(0, height, lines)]
    sizes = np.array([len(b) + 8 for _, b in body], np.int64)
    offsets = (len(head) + 8 * len(body) + np.cumsum(sizes) - sizes).astype("<u8").tobytes()
    return head + offsets + b"".join(struct.pack("<iI", y, len(b)) + b for y, b in body)
