"""Radiance files of any size as rows and back: coded by groups of lines and put together by the sink "parts", read by byte ranges.

A file with run-length lines has no table of places, and the mark of a line can also stand among its pixels. So a range follows lines from each place at which
its first line may begin, and pointers from range to range tell which of these is right."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stretches import STRETCH, walked, with_before
from ..plans.stored import stored
from . import rgbe
from .datasource import HEAD, ExrReader, ExrSource, PartsSink, Ranged, opened
from .rgbe import ImageError

#: Bytes of a range, and pixels of a group of lines.
SPLIT, PIXELS = 1 << 20, 1 << 15
LINES = "path string, at long, next long, lines long, width int, height int"


def hdr_parts(px: DataFrame, width: int, height: int, packed: bool = True) -> DataFrame:
    """path, part, content: Radiance files in ordered parts of pixels (image_id, x, y, r, g, b); part -1 is the header, the others are groups of lines, each
    coded by itself. Pixels that are missing are black. Put together they are the bytes of rgbe.write."""
    lines = max(1, PIXELS // width)
    kind = px.schema["image_id"].dataType.simpleString()

    def coded(key, table):
        block = key[1].as_py()
        table = table.filter(table["x"].is_valid())
        rgb = np.zeros((min(lines, height - block * lines), width, 3), np.float32)
        at = table["y"].to_numpy() - block * lines, table["x"].to_numpy()
        for k, c in enumerate("rgb"):
            rgb[*at, k] = table[c].to_numpy()
        content = rgbe.lines(rgbe.to_rgbe(rgb.reshape(-1, 3)), width, packed)
        return pa.table({"image_id": pa.array([key[0].as_py()], table.schema.field("image_id").type), "part": pa.array([block], pa.int64()), "content": pa.array([content], pa.binary())})

    f = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c)
    grid = px.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(f(c) for c in "rgb"), F.floor(F.col("y") / lines).alias("block"))
    files = px.select("image_id").distinct()
    every = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-height // lines) - 1).cast("long"))))
    parts = grid.unionByName(every, allowMissingColumns=True).groupBy("image_id", "block").applyInArrow(coded, f"image_id {kind}, part long, content binary")
    head = files.select("image_id", F.lit(-1).cast("long").alias("part"), F.lit(bytearray(rgbe.header(width, height))).alias("content"))
    return parts.unionByName(head).select(F.concat(F.col("image_id").cast("string"), F.lit(".hdr")).alias("path"), "part", "content")


class HdrSource(ExrSource):
    """Where lines may begin. Options: path, a file or folder; split, bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "hdr_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema):
        return HdrReader(dict(self.options))


class HdrReader(ExrReader):
    extension = "hdr"

    def read(self, partition):
        fs, _ = opened(self.path)
        for path, a, z in partition.parts:
            file = Ranged(fs, path)
            n, data = HEAD, file.bytes(0, HEAD)
            while True:
                try:
                    header, begin = rgbe.read_header(data)
                    break
                except ImageError:
                    if n >= file.size or data[:2] != b"#?":
                        raise
                    data, n = file.bytes(0, 4 * n), 4 * n
            width, height = header["width"], header["height"]
            mark = rgbe.mark(width)
            if not 8 <= width <= 32767 or file.bytes(begin, 4) != mark:
                raise ImageError("not a file of run-length lines")
            first = begin if a == 0 else max(a, begin)
            raw = file.bytes(first, max(0, z + rgbe.longest(width) - first))
            # Of a range's first line there is a mark within the bytes of the longest line.
            places, k = [0], raw.find(mark)
            if a > 0:
                places, most = [], min(z - first, rgbe.longest(width))
                while 0 <= k < most:
                    places.append(k)
                    k = raw.find(mark, k + 1)
            known: dict[int, tuple[int, int]] = {}
            for place in reversed(places):
                at, lines = place, 0
                while at < z - first and at not in known:
                    try:
                        at = rgbe.line_end(raw, at, width)
                    except ImageError:  # no line, or what follows the last one
                        break
                    lines += 1
                end, more = known.get(at, (at, 0))
                known[place] = end, lines + more
                if lines + more or a == 0:
                    yield path, first + place if a else 0, first + end, lines + more, width, height


def hdr_blocks(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """path, first_y, lines, width, data (RGBA floats) of the Radiance files with run-length lines below path, in blocks of PIXELS pixels or a line: what
    datasource.block_pixels takes. One file is many tasks. A file whose lines end early is an error."""
    spark.dataSource.register(HdrSource)
    links = stored(spark.read.format("hdr_lines").option("path", path).option("split", split).load(), "hdr-links")
    chain = walked(links.select(F.col("path").alias("image_id"), "at", "next"), "hdr-lines")
    found = links.join(chain.select(F.col("image_id").alias("path"), "at"), ["path", "at"])
    found = stored(with_before(found, {"first_y": F.col("lines")}, by="path", order="at", stretch=STRETCH * split), "hdr-ranges")
    if found.groupBy("path").agg(F.sum("lines").alias("n"), F.max("height").alias("height")).filter("n < height").take(1):
        raise ImageError("the pixel data end early")

    def read(batches):
        fs, _ = opened(path)
        for batch in batches:
            for r in batch.to_pylist():
                width = r["width"]
                begin = r["at"]
                file = Ranged(fs, r["path"])
                if begin == 0:
                    begin = rgbe.read_header(file.bytes(0, r["next"]))[1]
                raw, at, y, most = file.bytes(begin, r["next"] - begin), 0, r["first_y"], min(r["height"], r["first_y"] + r["lines"])
                while y < most:
                    start, n = at, min(most - y, max(1, PIXELS // width))
                    for _ in range(n):
                        at = rgbe.line_end(raw, at, width)
                    flat = pa.array(rgbe.to_float(rgbe.run_lines(raw[start:at], width, n)).ravel())
                    ints = {"first_y": y, "lines": n, "width": width}
                    yield pa.RecordBatch.from_arrays([pa.array([r["path"]]), *(pa.array([v], pa.int32()) for v in ints.values()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], ["path", *ints, "data"])
                    y += n

    # Few bytes a range and much work: by bytes alone, all ranges would end up in a few tasks.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return found.repartition(tasks, "path", "at").mapInArrow(read, "path string, first_y int, lines int, width int, data array<float>")


def written(parts: DataFrame, folder: str) -> None:
    """parts (path, part, content) as files in folder."""
    parts.sparkSession.dataSource.register(PartsSink)
    parts.repartition("path").sortWithinPartitions("path", "part").write.format("parts").mode("append").save(folder)
