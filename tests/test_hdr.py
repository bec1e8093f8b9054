"""Radiance files in parts and by byte ranges against the file codec."""

import numpy as np
import pytest

from lumenframe.sources import datasource, hdr, rgbe

R = np.random.default_rng(4)


def pixels(spark, images):
    rows = [(i, x, y, *map(float, v[y, x])) for i, v in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    return spark.createDataFrame(rows, "image_id string, x int, y int, r double, g double, b double")


def read(spark, folder, split, shape):
    out = {}
    for r in datasource.block_pixels(hdr.hdr_blocks(spark, str(folder), split)).collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], np.full((*shape, 3), np.nan))[r.y, r.x] = r.r, r.g, r.b
    return out


def test_parts_are_the_codec_s_file(spark, monkeypatch, tmp_path):
    """A picture is many parts, whole lines each, and many ranges when it is read."""
    monkeypatch.setattr(hdr, "PIXELS", 40)
    images = {n: np.where(R.random((23, 10, 3)) < 0.5, 1.0, R.random((23, 10, 3)) * 9) for n in "ab"}
    images["b"][5:9] = 0
    parts = hdr.hdr_parts(pixels(spark, images), 10, 23)
    assert parts.filter("path = 'a.hdr'").count() == 7
    hdr.written(parts, str(tmp_path))
    for n, v in images.items():
        want = rgbe.write(10, 23, np.concatenate([v, np.ones((23, 10, 1))], axis=2).ravel(), packed=True)
        assert (tmp_path / f"{n}.hdr").read_bytes() == want
    for split in (50, 300, 1 << 20):
        got = read(spark, tmp_path, split, (23, 10))
        for n in images:
            assert (got[f"{n}.hdr"] == rgbe.read((tmp_path / f"{n}.hdr").read_bytes())["data"].reshape(23, 10, 4)[..., :3]).all()


def test_marks_among_pixels(spark, tmp_path):
    """Lines whose pixels look like the beginnings of lines; bytes behind the last line; a file that ends early."""
    raw = np.tile(np.array([2, 2, 0, 12], np.uint8), (40, 4, 3))
    raw[::3] = R.integers(0, 3, (14, 4, 12))
    raw[1::5, :, 4:] = 0
    body = rgbe.lines(np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(-1, 4), 12, True)
    data = rgbe.header(12, 40) + body
    (tmp_path / "x.hdr").write_bytes(data + rgbe.mark(12) + b"more")
    want = rgbe.read(data)["data"].reshape(40, 12, 4)[..., :3]
    for split in (20, 64, 1000):
        assert (read(spark, tmp_path, split, (40, 12))["x.hdr"] == want).all()
    (tmp_path / "x.hdr").write_bytes(data[:-3])
    with pytest.raises(rgbe.ImageError, match="end early"):
        hdr.hdr_blocks(spark, str(tmp_path), 64)


def test_missing_pixels_and_no_pixels(spark, tmp_path):
    px = pixels(spark, {"a": np.ones((2, 8, 3))})
    hdr.written(hdr.hdr_parts(px.filter("x = 3"), 8, 2), str(tmp_path))
    got = read(spark, tmp_path, 1 << 20, (2, 8))["a.hdr"]
    assert (got[:, 3] > 0.9).all() and (np.delete(got, 3, axis=1) == 0).all()
    hdr.written(hdr.hdr_parts(px.limit(0), 8, 2), str(tmp_path / "none"))
    assert hdr.hdr_blocks(spark, str(tmp_path / "none")).count() == 0
