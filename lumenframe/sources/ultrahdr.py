"""JPEG files with a gain map: XMP, multi-picture index, colour profile, and the files that hold them."""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np

from ..functions import xmp
from . import jpeg
from .rgbe import ImageError

XMP = b"http://ns.adobe.com/xap/1.0/\0"
ICC = b"ICC_PROFILE\0"
MPF = b"MPF\0"
NO_MAP = "Not a valid JPEG with gain map"
#: XMP names, our names and defaults; None must be given.
FIELDS = {name: (re.sub(r"_(.)", lambda m: m[1].upper(), ours), default) for name, ours, default in xmp.FIELDS}


def escape(value) -> str:
    for a, b in xmp.ESCAPES:
        value = str(value).replace(a, b)
    return value


def primary_xmp(second_length: int, version: str = "1.0") -> str:
    """The directory of both pictures."""
    items = "".join(xmp.ITEM.format(s) + f"{more}/></rdf:li>" for s, more in (("Primary", ""), ("GainMap", f' Item:Length="{second_length}"')))
    return f'{xmp.HEAD}{xmp.CONTAINER} hdrgm:Version="{escape(version)}"><Container:Directory><rdf:Seq>{items}</rdf:Seq></Container:Directory>{xmp.TAIL}'


def secondary_xmp(metadata: dict, version: str = "1.0") -> str:
    """The map's parameters; three channels count as their mean."""
    values = {x: float(np.mean(metadata[ours])) for x, (ours, _) in FIELDS.items()}
    text = " ".join(f'hdrgm:{x}="{escape(v)}"' for x, v in values.items())
    return f'{xmp.HEAD} hdrgm:Version="{escape(version)}" {text} hdrgm:BaseRenditionIsHDR="False">{xmp.TAIL}'


def properties(packet: str) -> dict[str, list[str]]:
    """What functions.xmp.properties finds, by name."""
    out: dict[str, list[str]] = {}
    inside = ""
    for piece in re.findall(xmp.PIECES, packet):
        if not piece.startswith("<"):
            if inside and piece.strip():
                out.setdefault(inside, []).append(piece.strip())
            continue
        for name, plain, quoted in re.findall(xmp.PAIRS, piece, re.A):
            if name.lower().startswith(xmp.PREFIX):
                out.setdefault(name.lower()[len(xmp.PREFIX) :], []).append((plain + quoted).strip())
        tag = re.match(r"</?\s*([^\s/>]*)", piece)[1].lower()
        if tag.startswith(xmp.PREFIX) and not piece.endswith("/>"):
            inside = "" if piece.startswith("</") else tag[len(xmp.PREFIX) :]
    return out


def _number(text: str | None):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def read_xmp(data: bytes) -> dict:
    """Parameters of the first packet that has a version and a largest capacity, by the rules of functions.xmp.parsed."""
    for packet in re.findall(xmp.PACKET, data.decode("latin-1")):
        found = {k: [x for x in v if x] for k, v in properties(packet).items()}
        if not found.get("version") or not found.get("hdrcapacitymax"):
            continue
        out = {}
        for name, (ours, default) in FIELDS.items():
            numbers = [_number(v) for v in found.get(name.lower(), ())]
            one = numbers[0] if numbers and numbers[0] is not None else default
            three = [default if v is None else v for v in numbers] if len(numbers) == 3 else [one] * 3
            out[ours] = one if ours.startswith("hdrCapacity") else three
        if out["hdrCapacityMax"] is not None:
            return out
    raise ImageError(NO_MAP)


def mpf_payload(first_size: int, second_size: int, second_at: int) -> bytes:
    """86 bytes: an index of two pictures, little-endian."""
    tags = ((0xB000, 7, 4, b"0100"), (0xB001, 4, 1, struct.pack("<I", 2)), (0xB002, 7, 32, struct.pack("<I", 50)))
    ifd = struct.pack("<H", 3) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in tags) + struct.pack("<I", 0)
    entries = struct.pack("<3I2H", 0x30000, first_size, 0, 0, 0) + struct.pack("<3I2H", 0, second_size, second_at, 0, 0)
    return MPF + b"II*\0" + struct.pack("<I", 8) + ifd + entries


def split(data: bytes) -> tuple[bytes, bytes, str]:
    """The two pictures, by the multi-picture index or else by the second start of image, and the kind of file."""
    for marker, body, start, _ in jpeg.segments(data):
        if marker != 0xE2 or not body.startswith(MPF) or body[4:6] not in (b"II", b"MM"):
            continue
        base, o = body[4:], "<" if body[4:6] == b"II" else ">"
        try:
            (ifd,) = struct.unpack_from(o + "I", base, 4)
            (n,) = struct.unpack_from(o + "H", base, ifd)
            tags = {t: v for t, _, _, v in (struct.unpack_from(o + "HHII", base, ifd + 2 + 12 * k) for k in range(n))}
            (size, at) = struct.unpack_from(o + "II", base, tags[0xB002] + 16 + 4)
        except (struct.error, KeyError):
            continue
        at += start + 8
        if data[at : at + 2] == jpeg.SOI and at + size <= len(data):
            return data[:at], data[at : at + size], "ultrahdr"
    at = data.find(jpeg.EOI + jpeg.SOI, 2) + 2
    if at == 1:
        at = data.find(jpeg.SOI, 2)
    if at < 2:
        raise ImageError(NO_MAP)
    return data[:at], data[at:], "adobe-gainmap"


@cache
def srgb_profile() -> bytes:
    """A display profile: the sRGB primaries adapted to D50, and one curve of 1024 entries that all channels share."""
    fixed = lambda *v: b"".join(struct.pack(">i", round(x * 65536)) for x in v)
    x = np.arange(1024) / 1023
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    curve = b"curv\0\0\0\0" + struct.pack(">I", 1024) + np.rint(linear * 65535).astype(">u2").tobytes()
    name = b"sRGB\0"
    xyz = lambda *v: b"XYZ \0\0\0\0" + fixed(*v)
    tags = [(b"desc", b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name + b"\0" * 78), (b"cprt", b"text\0\0\0\0none\0"), (b"wtpt", xyz(0.9642, 1, 0.8249)),
            (b"rXYZ", xyz(0.4360, 0.2225, 0.0139)), (b"gXYZ", xyz(0.3851, 0.7169, 0.0971)), (b"bXYZ", xyz(0.1431, 0.0606, 0.7141)), (b"rTRC", curve)]
    at, table, body = 128 + 4 + 12 * (len(tags) + 2), b"", b""
    for tag, value in tags:
        value += b"\0" * (-len(value) % 4)
        table += tag + struct.pack(">II", at, len(value))
        at, body = at + len(value), body + value
    table += b"gTRC" + table[-8:] + b"bTRC" + table[-8:]
    head = struct.pack(">I4sI4s4s4s6H4s4s", at, b"\0" * 4, 0x02100000, b"mntr", b"RGB ", b"XYZ ", 2024, 1, 1, 0, 0, 0, b"acsp", b"\0" * 4)
    head = head.ljust(68, b"\0") + fixed(0.9642, 1, 0.8249)
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags) + 2) + table + body


def icc_profile(data: bytes) -> bytes | None:
    """The colour profile of a JPEG file, its parts put together in order."""
    parts = {b[12]: b[14:] for m, b, _, _ in jpeg.segments(data) if m == 0xE2 and b.startswith(ICC) and len(b) > 14}
    return b"".join(parts[k] for k in sorted(parts)) or None


def icc_tag(profile: bytes, tag: bytes) -> bytes | None:
    """The bytes of one tag of a profile."""
    if len(profile) < 132:
        return None
    (n,) = struct.unpack_from(">I", profile, 128)
    for k in range(min(n, (len(profile) - 132) // 12)):
        name, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * k)
        if name == tag:
            return profile[at : at + size]
    return None


def adgc(profile: bytes) -> str | None:
    """The 16-byte identifier of an adaptive gain curve, hexadecimal: it follows the type, four zeros and the kind of function in its tag."""
    tag = icc_tag(profile, b"ADGC")
    return tag[12:28].hex() if tag and len(tag) >= 28 else None


def xmp_segment(text: str) -> bytes:
    return jpeg.segment(0xE1, XMP + text.encode())


def assemble(sdr: bytes, gain_map: bytes, metadata: dict, kind: str = "ultrahdr", profile: bytes | None = None) -> bytes:
    """One file of both JPEG pictures. An EXIF segment of the first picture stays in front; two of them are an error."""
    second = jpeg.SOI + xmp_segment(secondary_xmp(metadata)) + gain_map[2:]
    if kind == "adobe-gainmap":
        return sdr + second
    if kind != "ultrahdr":
        raise ImageError(f"unknown gain map format: {kind}")
    exif = [(s, e) for m, b, s, e in jpeg.segments(sdr) if m == 0xE1 and b.startswith(b"Exif\0\0")]
    if len(exif) > 1:
        raise ImageError("the picture has two EXIF segments")
    front, rest = (sdr[exif[0][0] : exif[0][1]], sdr[2 : exif[0][0]] + sdr[exif[0][1] :]) if exif else (b"", sdr[2:])
    own = jpeg.segment(0xE2, ICC + b"\1\1" + (profile or srgb_profile())) if icc_profile(sdr) is None else b""
    head = jpeg.SOI + front + xmp_segment(primary_xmp(len(second)))
    size = len(head) + 4 + 86 + len(own) + len(rest)
    return head + jpeg.segment(0xE2, mpf_payload(size, len(second), size - len(head) - 8)) + own + rest + second


def metadata_for(log_max: float, log_min: float = 0.0, gamma=(1.0,) * 3, offset_sdr=(1 / 64,) * 3, offset_hdr=(1 / 64,) * 3) -> dict:
    """Parameters of a map of the range log_min to log_max."""
    return {"gainMapMin": [log_min] * 3, "gainMapMax": [log_max] * 3, "gamma": list(gamma), "offsetSdr": list(offset_sdr), "offsetHdr": list(offset_hdr),
            "hdrCapacityMin": max(0.0, log_min), "hdrCapacityMax": max(0.0, log_max)}


def write(sdr: np.ndarray, gain_map: np.ndarray, metadata: dict, kind: str = "ultrahdr", quality: int = 95) -> bytes:
    """sdr, gain_map: (height, width, 3) uint8."""
    return assemble(jpeg.encode(sdr, quality), jpeg.encode(gain_map, quality), metadata, kind)


def resized(px: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour."""
    y, x = np.arange(height) * px.shape[0] // height, np.arange(width) * px.shape[1] // width
    return px[np.minimum(y, px.shape[0] - 1)][:, np.minimum(x, px.shape[1] - 1)]


def applied(sdr: np.ndarray, gain_map: np.ndarray, m: dict, boost: float | None = None) -> np.ndarray:
    """Linear float32 of uint8 pictures for a display with that boost (the largest by default)."""
    low, high = m["hdrCapacityMin"], m["hdrCapacityMax"]
    weight = 1.0 if boost is None or high <= low else min(1.0, max(0.0, (np.log2(boost) - low) / (high - low)))
    s, g = sdr / 255.0, gain_map / 255.0
    linear = np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4)
    lo, hi, gamma = (np.array(m[k]) for k in ("gainMapMin", "gainMapMax", "gamma"))
    gain = weight * (lo + (hi - lo) * g ** (1 / gamma))
    return np.clip((linear + np.array(m["offsetSdr"])) * 2.0**gain - np.array(m["offsetHdr"]), 0, 65504).astype(np.float32)


def read(data: bytes, boost: float | None = None) -> dict:
    """width, height, data (float32, RGBA), space, metadata."""
    m = read_xmp(data)
    first, second, kind = split(data)
    sdr, gain_map = jpeg.decode(first), jpeg.decode(second)
    height, width = sdr.shape[:2]
    out = np.ones((height, width, 4), np.float32)
    out[..., :3] = applied(sdr, resized(gain_map, height, width), m, boost)
    return {"width": width, "height": height, "data": out.ravel(), "space": "linear-rec709", "metadata": told(m, kind)}


def told(m: dict, kind: str) -> dict[str, str]:
    return {k: str(v) for k, v in m.items()} | {"format": kind}


def described(data: bytes) -> dict[str, str]:
    """The metadata that read gives; the pictures are found and not decoded."""
    return told(read_xmp(data), split(data)[2])
