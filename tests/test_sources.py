import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.__main__ import main
from lumenframe.plans import views
from lumenframe.functions import xmp
from lumenframe.sources import blocks, exr, images, jpeg, png, rgbe, ultrahdr
from lumenframe.streaming.images import stream_images

R = np.random.default_rng(0)


def picture(width, height, top=4.0):
    px = R.random((height, width, 4)).astype(np.float32) * np.float32(top)
    px[: height // 2, :, 1] = 0.25
    px[..., 3] = 1
    return px


@pytest.mark.parametrize("compression", exr.COMPRESSION)
@pytest.mark.parametrize("size", [(1, 1), (5, 3), (32, 32), (40, 70)])
def test_exr_round_trip(compression, size):
    px = picture(*size)
    got = exr.read(exr.write(*size, px.ravel(), compression, "linear-p3"))
    want = px if compression == "none" else exr.half_bits(px).view(np.float16).astype(np.float32)
    assert (got["width"], got["height"], got["space"]) == (*size, "linear-p3")
    assert (got["data"].reshape(px.shape) == want).all()
    assert got["metadata"]["compression"] == compression


def test_black_exr_and_tall_last_block():
    for c in exr.COMPRESSION:
        assert not exr.read(exr.write(33, 33, np.zeros(33 * 33 * 4), c))["data"].any()


def test_exr_values_that_no_half_holds():
    px = np.array([70000.0, 2.0**-26, -1.0, 1.0], np.float32)
    assert exr.read(exr.write(1, 1, px))["data"].tolist() == [0, 0, 0, 1]


def test_exr_errors():
    good = exr.write(4, 4, np.zeros(64))
    for bad, text in [
        (b"nonsense", "incorrect magic number"),
        (good[:4] + struct.pack("<I", 0x202) + good[8:], "Multi-part, tiled, and deep data"),
        (good.replace(b"compression\0\x01\0\0\0\x03", b"compression\0\x01\0\0\0\x06"), "Unsupported EXR compression"),
        (good[:8] + b"\0", "missing required header attributes"),
        (good.replace(b"R\0\x01", b"Z\0\x01"), "Non-RGB EXR"),
        (good[:-10], "no valid scanline block offsets"),
    ]:
        with pytest.raises(rgbe.ImageError, match=text):
            exr.read(bad)


@pytest.mark.parametrize("top", [2, 300, 65536])
def test_huffman_and_wavelet(top):
    for shape in ((1, 1, 1), (32, 33, 1), (7, 5, 2)):
        planes = [R.integers(0, top, shape).astype(np.uint16) for _ in range(3)]
        assert all((a == b).all() for a, b in zip(planes, blocks.piz_decode(blocks.piz_encode(planes), [shape] * 3), strict=True))
    for symbols in (np.zeros(5000, np.uint16), (R.zipf(1.3, 20000) % top).astype(np.uint16)):
        assert (blocks.huffman_decode(blocks.huffman_encode(symbols), len(symbols)) == symbols).all()


def test_run_lengths():
    for a in (np.zeros(0, np.uint8), np.zeros(1000, np.uint8), R.integers(0, 2, 999).astype(np.uint8)):
        assert (blocks.rle_decode(blocks.rle_encode(a)) == a).all()


def test_float24_keeps_special_values():
    v = np.array([0.0, 1.0, np.inf, -np.inf, np.nan, 3.4e38], np.float32)
    back = (blocks.float24(v.view(np.uint32)) << np.uint32(8)).view(np.float32)
    assert back[:4].tolist() == [0, 1, np.inf, -np.inf] and np.isnan(back[4]) and np.isfinite(back[5])


def head(size="-Y 1 +X 1", lines="FORMAT=32-bit_rle_rgbe\n"):
    return f"#?RADIANCE\n{lines}\n{size}\n".encode()


def test_hdr_round_trip():
    px = np.zeros((1001, 4), np.float32)
    px[:, 0] = np.arange(1001) / 100
    got = rgbe.read(rgbe.write(1001, 1, px.ravel()))["data"].reshape(-1, 4)
    assert (np.abs(got[1:, 0] - px[1:, 0]) <= np.maximum(0.08 * px[1:, 0], 0.005)).all()


def test_hdr_runs_and_exposure():
    old = rgbe.read(head("-Y 2 +X 2") + bytes((10, 20, 30, 128, 255, 255, 255, 15)))["data"].reshape(-1, 4)
    assert (old == old[0]).all() and len(old) == 4
    line = b"\2\2\0\x08" + bytes((8, *range(8))) + bytes((136, 7)) + bytes((4, 1, 2, 3, 4, 132, 9)) + bytes((136, 129))
    new = rgbe.read(head("-Y 1 +X 8") + line)["data"].reshape(-1, 4)
    assert np.allclose(new[:, 0], (np.arange(8) + 0.5) * 2 / 255) and np.allclose(new[4:, 2], 9.5 * 2 / 255)
    bright = head(lines="FORMAT=32-bit_rle_rgbe\nEXPOSURE=2\nEXPOSURE=1.0\n") + bytes((100, 100, 100, 129))
    assert np.allclose(rgbe.read(bright, physical=True)["data"][0] * 2, rgbe.read(bright)["data"][0])


@pytest.mark.parametrize("data, text", [
    (b"", "no header found"), (b"hello\n", "bad initial token"), (b"#?OTHER\n\n-Y 1 +X 1\n", "expected #\\?RADIANCE"), (b"#?RADIANCE\n\n-Y 1 +X 1\n", "missing format specifier"),
    (b"#?RADIANCE\nFORMAT=32-bit_rle_xyze\n", "XYZ format is not supported"), (head("+Y 1 +X 1"), "Unsupported resolution format"), (head("-Y 0 +X 1"), "invalid image dimensions"),
    (b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n", "missing image size specifier"), (head() + b"12345", "expected 4 bytes"), (head("-Y 1 +X 9") + b"\2\2\0\x08" + b"0" * 40, "wrong scanline width"),
])
def test_hdr_errors(data, text):
    with pytest.raises(rgbe.ImageError, match=text):
        rgbe.read(data)


def test_png():
    px = R.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    data = png.write(5, 3, px)
    at = data.index(b"IDAT")
    (n,) = struct.unpack_from(">I", data, at - 4)
    lines = np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + n]), np.uint8).reshape(3, 16)
    assert (np.cumsum(lines[:, 1:], axis=0, dtype=np.uint8).reshape(3, 5, 3) == px).all()


def test_files_stream_and_blocks(spark, tmp_path):
    px = picture(8, 40)
    (tmp_path / "a.exr").write_bytes(exr.write(8, 40, px.ravel(), "piz"))
    (tmp_path / "b.HDR").write_bytes(rgbe.write(8, 40, px.ravel()))
    (tmp_path / "c.exr").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"no image")
    got = images.load_images(spark, str(tmp_path), on_error="record")
    assert {r.image_id[-5:]: r.error is None for r in got.collect()} == {"a.exr": True, "b.HDR": True, "c.exr": False}
    assert images.pixels(got).groupBy("image_id").count().collect()[0]["count"] == 320
    with pytest.raises(Exception, match="incorrect magic number"):
        images.load_images(spark, str(tmp_path)).collect()
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.exr"))
    assert [(r.first_y, r.lines) for r in images.exr_blocks(files).orderBy("block").collect()] == [(0, 32), (32, 8)]
    stream = stream_images(spark, str(tmp_path), files_per_trigger=1).drop("data").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    assert stream.awaitTermination(120)
    assert spark.table("seen").filter(F.col("error").isNull()).count() == 2


def test_empty_and_null_files(spark):
    files = spark.createDataFrame([("x.exr", None), (None, b"1")], "path string, content binary")
    assert all(r.error for r in images.decoded(files, on_error="record").collect())
    assert images.pixels(images.decoded(files.limit(0))).count() == 0


@pytest.mark.parametrize("size", [(1, 1), (17, 33), (64, 40)])
@pytest.mark.parametrize("quality, error", [(100, 3), (90, 16)])
def test_jpeg_round_trip_and_another_decoder(spark, tmp_path, size, quality, error):
    y, x = np.mgrid[: size[1], : size[0]]
    px = np.stack([x * 3 % 256, y * 2 % 256, (x + y) % 256], axis=-1).astype(np.uint8)
    data = jpeg.encode(px, quality)
    back = jpeg.decode(data).astype(int)
    assert abs(back - px).max() <= error
    (tmp_path / "a.jpg").write_bytes(data)
    (tmp_path / "b.png").write_bytes(png.write(*size, px))
    for r in spark.read.format("image").load(str(tmp_path)).collect():  # the JVM's own decoders; blue first
        other = np.frombuffer(r.image.data, np.uint8).reshape(size[1], size[0], 3)[..., ::-1].astype(int)
        assert abs(other - (back if r.image.origin.endswith("jpg") else px)).max() <= (2 if r.image.origin.endswith("jpg") else 0)


def test_jpeg_noise_and_errors():
    px = R.integers(0, 256, (24, 31, 3)).astype(np.uint8)
    data = jpeg.encode(px, 100)
    assert abs(jpeg.decode(data).astype(int) - px).max() <= 3
    for bad in (b"no", data[:300], data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(rgbe.ImageError):
            jpeg.decode(bad)


def by_jvm(spark, px, quality, progressive):
    """The JVM's encoder: chroma at half size, progressive files in ten scans."""
    j = spark._jvm
    img = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(png.write(px.shape[1], px.shape[0], px)))
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(quality)
    param.setProgressiveMode(1 if progressive else 0)
    out = j.java.io.ByteArrayOutputStream()
    writer.setOutput(j.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, j.javax.imageio.IIOImage(img, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("size", [(1, 1), (17, 33), (64, 40), (50, 23)])
@pytest.mark.parametrize("quality", [0.3, 0.95])
def test_progressive_jpeg(spark, size, quality):
    """The same coefficients in one scan and in many make the same picture."""
    y, x = np.mgrid[: size[1], : size[0]]
    px = np.stack([x * 5 % 256, (y * 7 + x) % 256, R.integers(0, 256, x.shape)], axis=-1).astype(np.uint8)
    one, many = (by_jvm(spark, px, quality, p) for p in (False, True))
    assert b"\xff\xc2" in many and many.count(b"\xff\xda") > 3 and b"\xff\xc2" not in one[:400]
    assert (jpeg.decode(one) == jpeg.decode(many)).all()
    with pytest.raises(rgbe.ImageError):
        jpeg.decode(many[: many.index(b"\xff\xda")])


@pytest.mark.parametrize("kind", ["ultrahdr", "adobe-gainmap"])
def test_gain_map_container(kind):
    px = R.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    data = ultrahdr.write(px, px[:8, :8], ultrahdr.metadata_for(2.0), kind, 100)
    first, second, found = ultrahdr.split(data)
    assert found == kind and first + second == data and second[:2] == jpeg.SOI
    got = ultrahdr.read(data)
    assert (got["width"], got["height"], got["metadata"]["hdrCapacityMax"]) == (16, 16, "2.0")
    marks = [(m, b[:4]) for m, b, _, _ in jpeg.segments(data) if m == 0xE2]
    assert marks == ([(0xE2, b"MPF\0"), (0xE2, b"ICC_")] if kind == "ultrahdr" else [])
    if kind == "ultrahdr":
        profile = ultrahdr.icc_profile(data)
        assert len(profile) == struct.unpack_from(">I", profile)[0] and ultrahdr.icc_tag(profile, b"rTRC") and ultrahdr.icc_tag(profile, b"none") is None
        assert len(ultrahdr.mpf_payload(1, 2, 3)) == 86
    with pytest.raises(rgbe.ImageError, match="Not a valid JPEG with gain map"):
        ultrahdr.read(jpeg.encode(px))


def test_xmp_lists_and_defaults():
    text = '<x:xmpmeta><r hdrgm:Version="1.0" hdrgm:HDRCapacityMax="3"><hdrgm:GainMapMax><rdf:Seq><rdf:li>1</rdf:li><rdf:li>2</rdf:li><rdf:li>3</rdf:li></rdf:Seq></hdrgm:GainMapMax></r></x:xmpmeta>'
    m = ultrahdr.read_xmp(b"\xff" + text.encode())
    assert m["gainMapMax"] == [1, 2, 3] and m["offsetSdr"] == [1 / 64] * 3 and m["hdrCapacityMax"] == 3


def test_both_xmp_readers_agree(spark):
    """Attributes in either quotes, any case, lists of one to four, text, nothing, damaged numbers and packets, and what both writers write."""
    wrap = lambda inner, more="": f'<x:xmpmeta x="y"><rdf:Description hdrgm:Version="1.0" {more}>{inner}</rdf:Description></x:xmpmeta>'
    li = lambda *v: "<rdf:Seq>" + "".join(f"<rdf:li> {x} </rdf:li>\n" for x in v) + "</rdf:Seq>"
    cap = 'hdrgm:HDRCapacityMax="3"'
    texts = [wrap("", cap), wrap("", "HDRGM:hdrcapacitymax = '2.5' hdrgm:Gamma='1.5'"), wrap("<hdrgm:HDRCapacityMax>4</hdrgm:HDRCapacityMax>"), wrap("<hdrgm:GainMapMax>" + li(1, 2, 3) + "</hdrgm:GainMapMax>", cap),
             wrap("<hdrgm:GainMapMin>" + li(1, 2) + "</hdrgm:GainMapMin>", cap), wrap("<hdrgm:Gamma>" + li(1, "x", 3) + "</hdrgm:Gamma>", cap), wrap("", 'hdrgm:HDRCapacityMax=""'), wrap("", 'hdrgm:Gamma="x" ' + cap), "", "no packet",
             wrap("") + "\x01<x:xmpmeta>" + wrap("<hdrgm:OffsetSDR rdf:parseType='Seq'>" + li(7) + "</hdrgm:OffsetSDR>", cap), wrap("<hdrgm:Gamma/><rdf:li>9</rdf:li>", cap), wrap("", cap)[:-5],
             ultrahdr.secondary_xmp({ours: [0.5, 0.25, 0.75] for ours, _ in ultrahdr.FIELDS.values()}, 'a<b & "c"'), ultrahdr.primary_xmp(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    written = df.limit(1).select(F.lit(len(texts)).alias("i"), xmp.secondary({ours: F.lit(0.5) for _, ours, _ in xmp.FIELDS}, F.lit("1.0")).alias("t"))
    for r in df.unionByName(written).select("t", xmp.parsed(F.col("t")).alias("m")).collect():
        try:
            want = ultrahdr.read_xmp(r.t.encode())
        except rgbe.ImageError:
            assert r.m is None or r.m.hdr_capacity_max is None, r.t
            continue
        assert [r.m[ours] for _, ours, _ in xmp.FIELDS] == [want[ours] for ours, _ in ultrahdr.FIELDS.values()], r.t


def test_gain_map_files(spark):
    px = views.gradient(spark, 8, 8, low=0.2, high=2.0).withColumn("image_id", F.lit("g"))
    back = images.pixels(images.decoded(images.gain_map_files(px, 8, 8, quality=100)))
    worst = px.join(back.select("p", *(F.col(c).alias(f"{c}2") for c in "rgb")), "p").select(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"{c}2")) / F.col(c) for c in "rgb")))).first()[0]
    assert worst < 0.05


def test_command_line(spark, tmp_path, capsys):
    at = lambda n: str(tmp_path / n)
    main(["reference", "rainbow", at("r.exr"), "--size", "16", "--compression", "piz"], spark)
    for target in ("r.hdr", "r.png", "r.jpg"):
        main(["convert", at("r.exr"), at(target)], spark)
        assert (tmp_path / target).stat().st_size > 100
    main(["info", at("r.jpg"), "--json"], spark)
    assert '"width": 16' in capsys.readouterr().out
