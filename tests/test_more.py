"""Comparison of unequal images, gain-map parameters, codec steps, colour checks, PNG files, batches and the command line against plain versions."""

import heapq
import json
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import queries
from lumenframe.__main__ import main
from lumenframe.functions import bits, color, tone
from lumenframe.operators import gainmap, relational, stats
from lumenframe.plans import views
from lumenframe.sources import exr, images, png, rgbe, ultrahdr

SF = "/root/testdata/sf0.001"


def plain(df):
    def one(v):
        if v is None or str(v) in ("<NA>", "None", "nan"):
            return ""
        return repr(float(v)) if isinstance(v, (int, float, np.integer, np.floating, np.bool_)) else str(v)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


NAMES = ["space_matrices", "classify_color_space", "is_rec709", "space_lookup", "xyy_to_rgb", "hdr_to_ldr", "gainmap_encode_options", "gainmap_decode_options", "gainmap_float_roundtrip", "gainmap_capacity",
         "sdr_gainmap_join", "compare_sizes", "channel_isolate", "old_rle_expand", "exr_offsets_fixed", "exr_offsets_variable", "exr_total_size", "channel_order", "xmp_primary", "xmp_secondary", "xmp_parse", "png_encode",
         "batch_convert", "physical_radiance", "rgbe_roundtrip", "worst_columns", "gainmap_boost", "lut_apply", "hdr_packed_roundtrip", "gainmap_separate_files", "small_gainmap_join"]


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "events", "documents", "part", "customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(queries.QUERIES[name](spark, SF).toPandas()) == plain(con.sql(queries.ORACLE_SQL[name]).df())


PX = "image_id long, p int, r double, g double, b double, a double"


def test_unequal_images_do_not_match(spark):
    a = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5, 1.0), (1, 1, 0.5, 0.5, 0.5, 1.0), (2, 0, 1.0, 1.0, 1.0, 1.0), (3, 0, 1.0, 0.0, 0.0, 1.0)], PX)
    b = spark.createDataFrame([(1, 0, 0.5, 0.5, 0.5, 1.0), (3, 0, 1.0, 0.0, 0.0, 1.0), (4, 0, 1.0, 0.0, 0.0, 1.0)], PX)
    got = {r.image_id: (r.match, r.mismatched, r.rmse) for r in stats.compared(a, b).collect()}
    assert got == {1: (False, None, None), 2: (False, None, None), 3: (True, 0, 0.0), 4: (False, None, None)}
    assert stats.compared(a.limit(0), b.limit(0)).count() == 0


def test_columns_that_one_side_lacks_are_the_worst(spark):
    a = spark.createDataFrame([(1, k, 0.1 * k, 0.0, 0.0, 1.0) for k in range(8)] + [(2, 0, 1.0, 0.0, 0.0, 1.0)], PX)
    b = spark.createDataFrame([(1, k, 0.1 * k + (0.5 if k == 1 else 0.0), 0.0, 0.0, 1.0) for k in range(8) if k != 7], PX)
    got = [(r.image_id, r.x, r.worst) for r in stats.worst_columns(a, b, 4, 2).orderBy("image_id", F.desc_nulls_first("worst")).collect()]
    assert got == [(1, 3, None), (1, 1, 0.5), (2, 0, None)]


def test_information_of_files_with_damaged_pixels(spark):
    good = exr.write(20, 40, np.random.default_rng(1).uniform(0, 4, 3200).astype(np.float32))
    rows = [("a.exr", good), ("b.exr", good[:-600] + b"x" * 600), ("c.exr", good[:60]), ("d.hdr", rgbe.write(4, 2, np.ones(32, np.float32))), ("e.hdr", b"?"), ("f.exr", None)]
    got = {r.image_id: r for r in images.file_info(spark.createDataFrame(rows, "path string, content binary"), "record").collect()}
    assert (got["a.exr"].width, got["a.exr"].metadata) == (20, got["b.exr"].metadata) and got["d.hdr"].height == 2
    assert all(got[k].error and got[k].width is None for k in ("c.exr", "e.hdr", "f.exr"))


def test_maps_of_any_size_are_taken_by_the_nearest_pixel(spark):
    r = np.random.default_rng(5)
    (h, w), (mh, mw) = (7, 5), (3, 2)
    gm = r.integers(0, 256, (mh, mw, 3))
    sdr = spark.createDataFrame([(None if i else 1, k, 9, 9, 9) for i in (0, 1) for k in range(h * w)], "image_id long, p int, sdr_r int, sdr_g int, sdr_b int")
    maps = spark.createDataFrame([(None if i else 1, k, *map(int, gm.reshape(-1, 3)[k])) for i in (0, 1) for k in range(mh * mw)], "image_id long, p int, gm_r int, gm_g int, gm_b int")
    sizes = spark.createDataFrame([(1, w, h, mw, mh, 0.0, 1.0), (None, w, h, mw, mh, 0.0, 1.0)], "image_id long, width int, height int, map_width int, map_height int, log_min double, log_max double")
    want = ultrahdr.resized(gm, h, w).reshape(-1, 3)
    got = gainmap.joined_sizes(sdr, maps, sizes).collect()
    assert len(got) == 2 * h * w and all([x.gm_r, x.gm_g, x.gm_b] == want[x.p].tolist() for x in got)


def test_boost_takes_the_brightest_channel_before_exposure(spark):
    px = spark.createDataFrame([(1, 0, 8.0, 0.1, 0.1, 1.0), (1, 1, 0.1, 0.1, 0.1, 1.0)], PX)
    dim = gainmap.boosts(gainmap.with_tone(px, exposure=0.01)).first().max_boost
    assert np.isclose(dim, 8.0)
    assert gainmap.boosts(gainmap.with_tone(px), gainmap.Options(max_boost=3.0)).first().max_boost == 3.0
    bright = gainmap.boosts(gainmap.with_tone(px, exposure=10.0)).first().max_boost
    assert bright > 50


@pytest.mark.parametrize("quantised, error", [(True, 0.02), (False, 1e-6)])
def test_gain_maps_with_parameters_come_back(spark, quantised, error):
    r = np.random.default_rng(1)
    px = spark.createDataFrame([(1, k, *map(float, r.uniform(0.05, 4, 3)), 1.0) for k in range(64)], PX)
    o = gainmap.Options(offset_sdr=(0.02, 0.015, 0.03), offset_hdr=(0.02, 0.01, 0.03), gamma=(1.5, 1.0, 0.8), min_boost=0.05)
    toned = gainmap.with_tone(px)
    back = gainmap.decoded(gainmap.encoded(toned, gainmap.boosts(toned, o), quantised, o), quantised=quantised, options=o)
    for row in back.collect():
        for c in "rgb":
            assert abs(row[c] - row[f"x_{c}"]) <= error * max(1.0, row[f"x_{c}"])


def test_old_runs_of_any_length(spark):
    runs = [(1, 0, 1, 7), (1, 1, 300, 8), (1, 301, 70_000, 9), (1, 70_301, 257, 7), (1, 70_558, 256, 8), (2, 0, 2, 5)]
    df = spark.createDataFrame([(i, p, n, v, v, v, 130) for i, p, n, v in runs], "image_id long, first_p long, n long, r int, g int, b int, e int")
    quads = relational.old_runs(df)
    got = {(r.image_id, r["at"]): r.r for r in relational.old_runs_expanded(quads).select("image_id", "at", "r").collect()}
    assert got == {(i, p + k): v for i, p, n, v in runs for k in range(n)}
    # The file reader agrees on the same bytes.
    raw = np.array([[r.r, r.g, r.b, r.e] for r in quads.filter("image_id = 1").orderBy("p").collect()], np.uint8)
    assert rgbe._old_runs(raw.reshape(-1), 70_814)[:, 0].tolist() == [got[1, k] for k in range(70_814)]


def test_huffman_lengths_cost_least(spark):
    by: dict = {}
    for r in queries.QUERIES["huffman_lengths"](spark, SF).collect():
        by.setdefault(r.image_id, []).append((r.n, r.length))
    assert len(by) > 5
    for rows in by.values():
        heap, least = [n for n, _ in rows], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            least += both
            heapq.heappush(heap, both)
        assert sum(n * k for n, k in rows) == (least or rows[0][0])
        assert len(rows) == 1 or sum(2.0**-k for _, k in rows) == 1.0


def test_distances_beyond_an_int(spark):
    """Line 50,000 of an image as high as 600,000 events make it: its square is no int."""
    at = spark.createDataFrame([(0, 0, 0), (600_010, 10, 50_000)], "p long, x int, y int")
    got = {r.p: r.r for r in views.radial(spark, 12, 50_001, at).collect()}
    assert got == {0: 1.0, 600_010: pytest.approx(1 - (10**2 + 50_000**2) ** 0.5 / (11**2 + 50_000**2) ** 0.5, abs=1e-7)}


def test_exposures_of_a_header(spark):
    data = b"#?RADIANCE\nEXPOSURE=2.5\nEXPOSURE=4\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 1\n" + bytes([128, 64, 32, 129])
    got = rgbe.read(data)
    assert float(got["metadata"]["EXPOSURE"]) == 10.0
    assert np.allclose(rgbe.read(data, physical=True)["data"][:3] * 10, got["data"][:3])
    with pytest.raises(rgbe.ImageError):
        rgbe.read(data.replace(b"RADIANCE", b"RGBE"))
    assert rgbe.read(data.replace(b"RADIANCE", b"RGBE"), strict=False)["width"] == 1
    df = spark.createDataFrame([([2.5, 4.0],), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(bits.cumulative(F.col("v"))).collect()] == [10.0, 1.0, 1.0]
    px = spark.createDataFrame([(0.2, 0.2, 0.2, 2.0), (0.2, 0.2, 0.2, None)], "r double, g double, b double, e double")
    a, b = tone.hdr_to_ldr(px, F.col("e")).collect()
    assert a.r > b.r and tone.hdr_to_ldr(px, F.col("e"), exposure=2.0).select("r").distinct().count() == 1


@pytest.mark.parametrize("width", [7, 8, 130, 700])
def test_packed_radiance_lines(width):
    r = np.random.default_rng(width)
    px = np.repeat(r.uniform(0, 4, (5, width, 4)).astype(np.float32), 1, axis=1)
    px[1], px[2, : width // 2], px[3] = 0.5, 0.25, np.repeat(px[3, ::5], 5, axis=0)[:width]
    flat, packed = (rgbe.write(width, 5, px.ravel(), p) for p in (False, True))
    assert (rgbe.read(flat)["data"] == rgbe.read(packed)["data"]).all() and (len(packed) < len(flat) if width > 100 else True)


def test_tone_mapping_refuses_other_primaries(spark):
    xy = [v for p in color.CHROMATICITIES["p3"] for v in p]
    df = spark.createDataFrame([(1.0, *xy)], "v double, " + ", ".join(f"c{k} double" for k in range(8)))
    cols = [F.col(f"c{k}") for k in range(8)]
    with pytest.raises(Exception, match="Rec.709"):
        df.select(color.checked_for_tone_mapping(F.col("v"), *cols)).collect()
    none = df.select("v", *(F.lit(None).cast("double").alias(f"c{k}") for k in range(8)))
    assert none.select(color.checked_for_tone_mapping(F.col("v"), *cols)).first()[0] == 1.0
    with pytest.raises(Exception, match="no chromaticities"):
        none.select(color.checked_for_tone_mapping(F.col("v"), *cols, strict=True)).collect()


def test_png_filters():
    r = np.random.default_rng(3)
    px = r.integers(0, 256, (10, 7, 3)).astype(np.int64)
    lines = []
    for y in range(10):
        kind, out = y % 5, [y % 5]
        up = px[y - 1] if y else np.zeros_like(px[0])
        for x in range(7):
            left, corner = (px[y, x - 1], up[x - 1]) if x else (np.zeros(3, int), np.zeros(3, int))
            for c in range(3):
                a, b, d = int(left[c]), int(up[x, c]), int(corner[c])
                p = a + b - d
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
                out.append((int(px[y, x, c]) - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        lines.append(bytes(out))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", 7, 10, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    got = png.read(data)
    assert (np.rint(got["data"].reshape(10, 7, 4)[..., :3] * 255) == px).all()
    own = png.read(png.write(7, 10, px))
    assert (own["data"] == got["data"]).all()
    with pytest.raises(rgbe.ImageError):
        png.read(b"no")


def test_adaptive_gain_curve_identifier():
    icc = bytearray(ultrahdr.srgb_profile())
    assert ultrahdr.adgc(bytes(icc)) is None
    at = 132  # the first tag becomes one that holds an identifier
    icc[at : at + 12] = struct.pack(">4sII", b"ADGC", len(icc), 28)
    icc += b"adgc" + bytes(8) + bytes(range(16))
    assert ultrahdr.adgc(bytes(icc)) == bytes(range(16)).hex()


def test_separate_files(spark):
    px = spark.createDataFrame([(1, k, k / 8, 0.5, 2.0, 1.0) for k in range(16)], PX)
    r = images.separate_files(px, 4, 4).first()
    m = json.loads(r.metadata)
    assert bytes(r.sdr[:2]) == bytes(r.gain_map[:2]) == b"\xff\xd8" and m["hdrCapacityMax"] == m["gainMapMax"][0] > 0 and m["gamma"] == [1.0] * 3


def test_command_line(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    main(["reference", "cie-wedge-g", at("a.exr"), "--width", "9", "--height", "5", "--luminance", "0.5"], spark)
    main(["reference", "rainbow", at("b.hdr"), "--size", "8", "--intensity", "3"], spark)
    whole = {r.image_id[-5:]: r for r in images.load_images(spark, str(tmp_path)).collect()}
    wedge = np.array(whole["a.exr"].data).reshape(5, 9, 4)
    assert whole["a.exr"].space == "linear-rec2020" and (wedge[..., [0, 2]] == 0).all() and wedge[..., 1].max() > 0
    (tmp_path / "bad.hdr").write_bytes(b"nothing")
    with pytest.raises(SystemExit, match="1 files"):
        main(["batch", str(tmp_path), at("out"), "--to", "hdr"], spark)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.hdr", "b.hdr"]
    raw = (tmp_path / "b.hdr").read_bytes().replace(b"FORMAT=", b"EXPOSURE=0.25\nFORMAT=")
    (tmp_path / "dim.hdr").write_bytes(raw)
    main(["convert", at("dim.hdr"), at("one.png")], spark)
    main(["convert", at("dim.hdr"), at("file.png"), "--exposure", "file"], spark)
    one, dim = (png.read((tmp_path / n).read_bytes())["data"] for n in ("one.png", "file.png"))
    assert dim.sum() < one.sum()
    for bad in (["convert", at("b.hdr"), at("x.png"), "--compression", "zip"], ["convert", at("b.hdr"), at("x.exr"), "--format", "ultrahdr"], ["reference", "sdf", at("x.png")]):
        with pytest.raises(SystemExit):
            main(bad, spark)


def test_gain_map_files_are_many_tasks(spark):
    """A few bytes an image: adaptive execution would put all of them into one task."""
    files = images.gain_map_files(queries.views.embedding_pixels(spark, SF), 4, 4)
    assert len({r.t for r in files.select(F.spark_partition_id().alias("t")).collect()}) > 1
    want = {r.image_id: dict(r.metadata) for r in images.decoded(files).collect()}
    assert {r.image_id: dict(r.metadata) for r in images.gain_map_info(files).collect()} == want
    assert images.decoded(files).count() == len(want)


def test_code_tables_are_filled_as_needed():
    from lumenframe.sources import jpeg

    table = jpeg._Lookup(bytes([0, 1, 2] + [0] * 13 + [7, 8, 9]))
    assert not table and table.size == 19
    assert [table[x << 13] for x in range(8)] == [(2, 7), (2, 7), (3, 8), (3, 9), (0, 0), (0, 0), (0, 0), (0, 0)]
