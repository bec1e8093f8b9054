"""Radiance pictures (.hdr): header, flat and run-length pixels, and the writer."""

from __future__ import annotations

import re

import numpy as np

MAX_LINE = 1024


class ImageError(ValueError):
    """A file that is not what it claims to be."""


def read_header(data: bytes, strict: bool = True) -> tuple[dict, int]:
    """Fields (width, height, exposure, format, gamma and other KEY=VALUE pairs as text) and where the pixels begin."""
    if not data:
        raise ImageError("no header found")
    fields: dict = {"exposure": 1.0}
    at, first, size = 0, True, None
    while size is None:
        end = data.find(b"\n", at, at + MAX_LINE)
        if end < 0:
            raise ImageError("no header found" if first else "missing image size specifier")
        line = data[at:end].decode("latin-1").rstrip("\r")
        at = end + 1
        if first:
            if not line.startswith("#?"):
                raise ImageError("bad initial token")
            if strict and line.strip() != "#?RADIANCE":
                raise ImageError("expected #?RADIANCE")
            first = False
        elif found := re.fullmatch(r"\s*([-+][XY])\s+(\d+)\s+([-+][XY])\s+(\d+)\s*", line):
            if (found[1], found[3]) != ("-Y", "+X"):
                raise ImageError(f"Unsupported resolution format: {line}")
            size = int(found[4]), int(found[2])
        elif line.startswith("#") or "=" not in line:
            continue
        else:
            key, value = (x.strip() for x in line.split("=", 1))
            if key == "FORMAT":
                if value == "32-bit_rle_xyze":
                    raise ImageError("XYZ format is not supported")
                fields["format"] = value
            elif key == "EXPOSURE":
                fields["EXPOSURE"] = value
                if re.fullmatch(r"\d+|\d*\.\d*[1-9]", value):  # only text that a number prints as counts
                    fields["exposure"] *= float(value)
                    fields["EXPOSURE"] = str(fields["exposure"])  # of all lines so far
            else:
                fields[key] = value
    if fields.get("format") != "32-bit_rle_rgbe" and strict:
        raise ImageError("missing format specifier")
    if min(size) < 1:
        raise ImageError("invalid image dimensions")
    return fields | {"width": size[0], "height": size[1]}, at


def run_lines(raw: bytes, width: int, height: int) -> np.ndarray:
    """Scanlines that begin 2, 2, width; each channel by itself: a count above 128 repeats one byte, others copy."""
    at = 0
    out = np.empty((height, 4, width), np.uint8)
    for y in range(height):
        if len(raw) < at + 4 or raw[at : at + 2] != b"\x02\x02" or raw[at + 2] << 8 | raw[at + 3] != width:
            raise ImageError("wrong scanline width")
        at += 4
        for c in range(4):
            x, row = 0, bytearray(width)
            while x < width:
                if at + 1 >= len(raw):
                    raise ImageError("the pixel data end early")
                n = raw[at]
                k = n - 128 if n > 128 else n
                if not k or x + k > width:
                    raise ImageError("bad scanline data")
                if n > 128:
                    row[x : x + k] = raw[at + 1 : at + 2] * k
                    at += 2
                else:
                    piece = raw[at + 1 : at + 1 + k]
                    if len(piece) < k:
                        raise ImageError("the pixel data end early")
                    row[x : x + k] = piece
                    at += 1 + k
                x += k
            out[y, c] = np.frombuffer(bytes(row), np.uint8)
    return out.transpose(0, 2, 1).reshape(-1, 4)


def _old_runs(data: np.ndarray, count: int) -> np.ndarray:
    """Pixels 255, 255, 255, n repeat the one before n times; the counts of markers in a row are digits of base 256, lowest first."""
    pixels = data[: len(data) // 4 * 4].reshape(-1, 4)
    marker = (pixels[:, :3] == 255).all(axis=1)
    place = np.arange(len(pixels))
    last_plain = np.maximum.accumulate(np.where(marker, -1, place))
    digit = np.minimum(place - last_plain - 1, 3)
    times = np.where(marker, pixels[:, 3].astype(np.int64) << (8 * digit), 1)
    keep = last_plain >= 0
    times, source = times[keep], last_plain[keep]
    before = np.cumsum(times) - times
    times = np.clip(count - before, 0, times)
    if times.sum() < count:
        raise ImageError(f"expected {count * 4} bytes")
    return pixels[np.repeat(source, times)]


def to_float(rgbe: np.ndarray) -> np.ndarray:
    """RGBA float32 of rgbe bytes, each byte standing for the middle of its step; exponent 0 is black."""
    scale = np.ldexp(1.0, rgbe[:, 3].astype(np.int64) - 128) / 255
    out = np.ones((len(rgbe), 4), np.float32)
    out[:, :3] = np.where(rgbe[:, 3:] == 0, 0.0, (rgbe[:, :3] + 0.5) * scale[:, None])
    return out


def to_rgbe(rgb: np.ndarray) -> np.ndarray:
    """Bytes with a shared exponent of at least 128, one higher if a byte would pass 255. Negative and non-finite values count as 0."""
    rgb = np.where(np.isfinite(rgb) & (rgb > 0), rgb, 0).astype(np.float64)
    top = rgb.max(axis=1, initial=0)
    dark = top < 1e-32
    m, e = np.frexp(np.where(dark, 1.0, top))
    e = np.clip(np.where(m > 0.5, e, e - 1) + 128, 128, 255)
    e = np.where((np.floor(top / np.ldexp(1.0, e - 128) * 255) > 255) & (e < 255), e + 1, e)
    out = np.clip(np.floor(rgb / np.ldexp(1.0, e - 128)[:, None] * 255), 0, 255)
    out = np.concatenate([out, e[:, None]], axis=1).astype(np.uint8)
    out[dark] = 0
    return out


def read(data: bytes, strict: bool = True, physical: bool = False) -> dict:
    """width, height, data (float32, RGBA), space, metadata. physical divides by the exposure."""
    fields, at = read_header(data, strict)
    width, height = fields["width"], fields["height"]
    flat = width * height * 4
    payload = np.frombuffer(data, np.uint8, offset=at)
    blank = len(payload) - flat
    if blank > 0 and (payload[:blank] == 10).all():  # blank lines before flat pixels
        payload = payload[blank:]
    head = payload[:4]
    if 8 <= width <= 32767 and len(head) == 4 and head[0] == 2 and head[1] == 2 and head[2] < 128:
        rgbe = run_lines(payload.tobytes(), width, height)
    elif len(payload) < flat:
        rgbe = _old_runs(payload, width * height)
    elif len(payload) == flat:
        rgbe = payload.reshape(-1, 4)
    else:
        raise ImageError(f"expected {flat} bytes")
    out = to_float(rgbe)
    if physical:
        out[:, :3] = (out[:, :3] / fields["exposure"]).astype(np.float32)
    return {"width": width, "height": height, "data": out.ravel(), "space": "linear-rec709", "metadata": {k: str(v) for k, v in fields.items() if k not in ("width", "height")}}


def _packed_line(line: np.ndarray) -> bytes:
    """One channel of a scanline: runs of four and more bytes as a count above 128 and the byte, the others as a count and the bytes."""
    edge = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1], [True]]))
    out, plain = bytearray(), bytearray()

    def flush():
        for k in range(0, len(plain), 128):
            out.append(len(plain[k : k + 128]))
            out.extend(plain[k : k + 128])
        plain.clear()

    for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if z - a < 4:
            plain += line[a:z].tobytes()
            continue
        flush()
        for k in range(a, z, 127):
            out += bytes((128 + min(127, z - k), int(line[a])))
    flush()
    return bytes(out)


def write(width: int, height: int, data: np.ndarray, packed: bool = False) -> bytes:
    """A picture of RGBA floats in Rec.709, flat; packed stores lines of 8 to 32767 pixels as runs, channel by channel."""
    if len(data) != width * height * 4:
        raise ImageError("invalid image dimensions")
    return header(width, height) + lines(to_rgbe(np.asarray(data).reshape(-1, 4)[:, :3]), width, packed)


def header(width: int, height: int) -> bytes:
    return f"#?RADIANCE\n# lumenframe\nFORMAT=32-bit_rle_rgbe\n\n-Y {height} +X {width}\n".encode()


def mark(width: int) -> bytes:
    """What a run-length line begins with."""
    return bytes((2, 2, width >> 8, width & 255))


def longest(width: int) -> int:
    """Bytes that a run-length line has at most, with a count for each byte."""
    return 4 + 8 * width


def lines(rgbe: np.ndarray, width: int, packed: bool = False) -> bytes:
    """Whole lines of a picture."""
    if not packed or not 8 <= width <= 32767:
        return rgbe.tobytes()
    return b"".join(mark(width) + b"".join(_packed_line(np.ascontiguousarray(line[:, c])) for c in range(4)) for line in rgbe.reshape(-1, width, 4))


def line_end(raw: bytes, at: int, width: int) -> int:
    """The place behind the run-length line that begins at a place."""
    if raw[at : at + 4] != mark(width):
        raise ImageError("wrong scanline width")
    at += 4
    for _ in range(4):
        x = 0
        while x < width:
            if at >= len(raw):
                raise ImageError("the pixel data end early")
            n = raw[at]
            k = n - 128 if n > 128 else n
            if not k or x + k > width:
                raise ImageError("bad scanline data")
            at += 2 if n > 128 else 1 + k
            x += k
    if at > len(raw):
        raise ImageError("the pixel data end early")
    return at
