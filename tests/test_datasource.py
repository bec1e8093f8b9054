"""Blocks by byte ranges, headers without pixels, and files put together from parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.plans import views
from lumenframe.sources import datasource, exr, images


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    datasource.register(spark)
    at = tmp_path_factory.mktemp("exr")
    r = np.random.default_rng(3)
    for name, w, h, kind in (("a", 40, 70, "zip"), ("b", 33, 50, "none"), ("c", 16, 64, "piz"), ("d", 9, 5, "rle"), ("e", 64, 100, "pxr24")):
        (at / f"{name}.exr").write_bytes(exr.write(w, h, r.uniform(0, 4, w * h * 4).astype(np.float32), kind))
    return at


def test_blocks_of_large_files_are_several_tasks(spark, folder):
    df = spark.read.format("exr").option("path", str(folder)).option("split", 4000).load()
    assert df.rdd.getNumPartitions() > 8
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    for f in folder.glob("*.exr"):
        want = exr.read(f.read_bytes())
        blocks = sorted(got[f.name], key=lambda r: r.first_y)
        assert [b.block for b in blocks] == list(range(len(blocks)))
        assert np.array_equal(np.concatenate([b.data for b in blocks]).astype(np.float32), want["data"])
    px = datasource.block_pixels(df.filter("path LIKE '%d.exr'"))
    assert px.count() == 45 and px.agg(F.max("y")).first()[0] == 4


def test_headers_read_no_pixels(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in spark.read.format("exr").option("path", str(folder)).option("what", "headers").load().collect()}
    a = rows["a.exr"]
    assert (a.width, a.height, a.compression, a.channels, a.blocks, a.space, a.error) == (40, 70, "zip", "A,B,G,R", 5, "linear-rec709", None)
    assert all(r.bytes_read <= datasource.HEAD for r in rows.values()) and rows["e.exr"].file_bytes > 2 * rows["e.exr"].bytes_read


def test_damaged_and_missing_files(spark, folder, tmp_path):
    (tmp_path / "x.exr").write_bytes(b"not an image")
    (tmp_path / "y.exr").write_bytes((folder / "a.exr").read_bytes()[:100])
    (tmp_path / "z.txt").write_bytes(b"text")
    rows = spark.read.format("exr").option("path", str(tmp_path)).option("what", "headers").load().collect()
    assert len(rows) == 2 and all(r.error and r.width is None for r in rows)


@pytest.mark.parametrize("compression", ["none", "zip", "piz"])
def test_parts_are_the_whole_writer_s_bytes(spark, folder, tmp_path, compression):
    px = views.gradient(spark, 20, 70, "diagonal", 0.1, 8.0).select("x", "y", *"rgba").crossJoin(spark.range(2).select(F.col("id").alias("image_id")))
    parts = datasource.exr_parts(px, 20, 70, compression)
    assert parts.filter("path = '0.exr'").count() == 1 + -(-70 // exr.BLOCK_LINES[compression])
    parts.repartition(3, "path").sortWithinPartitions("path", "part").write.format("parts").mode("append").save(str(tmp_path))
    flat = np.array([[r[c] for c in "rgba"] for r in px.filter("image_id = 0").orderBy("y", "x").collect()], np.float32)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["0.exr", "1.exr"]
    assert (tmp_path / "0.exr").read_bytes() == (tmp_path / "1.exr").read_bytes() == exr.write(20, 70, flat, compression)
    back = images.load_images(spark, str(tmp_path)).select("width", "height").collect()
    assert [tuple(r) for r in back] == [(20, 70)] * 2


def test_a_failed_write_leaves_nothing(spark, folder, tmp_path):
    rows = spark.createDataFrame([("a.bin", 0, bytearray(b"x")), ("b.bin", 0, bytearray(b"y"))], "path string, part long, content binary")
    bad = rows.withColumn("content", F.when(F.col("path") == "b.bin", F.raise_error(F.lit("lost"))).otherwise(F.col("content")).cast("binary"))
    for df in (bad, rows.unionByName(rows).coalesce(1), rows.unionByName(rows.limit(1)).repartition(3)):
        with pytest.raises(Exception):  # noqa: B017
            df.write.format("parts").mode("append").save(str(tmp_path))
        assert list(tmp_path.iterdir()) == []
    rows.coalesce(1).write.format("parts").mode("append").save(str(tmp_path))
    assert (tmp_path / "b.bin").read_bytes() == b"y"
