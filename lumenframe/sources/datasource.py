"""Spark data sources of EXR files: blocks and headers by byte ranges, and a sink that puts files together from ordered parts.

    spark.dataSource.register(ExrSource)
    spark.read.format("exr").option("path", folder).load()                              decoded blocks; a large file is many tasks
    spark.read.format("exr").option("path", folder).option("what", "headers").load()    what the headers say; no pixels are read
    exr_parts(px, width, height).repartition("path").sortWithinPartitions("path", "part").write.format("parts").mode("append").save(folder)

Files are reached through pyarrow's file systems, so path is a local or shared folder or the address of a store that those know."""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import relational
from ..plans.stored import stored
from . import exr
from .rgbe import ImageError

#: Bytes of a task, and of the first read of a header.
SPLIT, HEAD = 32 << 20, 4096
BLOCKS = "path string, block int, first_y int, lines int, width int, data array<float>"
HEADERS = "path string, width int, height int, space string, compression string, channels string, blocks int, file_bytes long, bytes_read long, error string"


def opened(path: str):
    """(file system, path in it) of an address."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Ranged:
    """A file of which ranges are read, and how much that was."""

    def __init__(self, fs, path: str):
        self.file, self.read = fs.open_input_file(path), 0
        self.size = self.file.size()

    def bytes(self, at: int, n: int) -> bytes:
        got = self.file.read_at(max(0, min(n, self.size - at)), at)
        self.read += len(got)
        return got

    def header(self) -> tuple[dict, int]:
        """The header and where its offset table begins, from as few bytes as hold them."""
        n, data = HEAD, b""
        while True:
            data += self.bytes(len(data), n - len(data))
            try:
                return exr.read_header(data)
            except ImageError:
                if len(data) >= self.size or data[:4] != struct.pack("<I", exr.MAGIC):
                    raise
                n *= 4


@dataclass
class Ranges(InputPartition):
    """(path, first byte, last + 1) of what one task reads: blocks that begin there."""

    parts: list[tuple[str, int, int]]


class ExrSource(DataSource):
    """Options: path, a file or folder; what, blocks or headers; split, bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "exr"

    def schema(self) -> str:
        return HEADERS if self.options.get("what", "blocks") == "headers" else BLOCKS

    def reader(self, schema):
        return ExrReader(dict(self.options))


class ExrReader(DataSourceReader):
    extension = "exr"

    def __init__(self, options: dict):
        self.path, self.headers, self.split = options["path"], options.get("what", "blocks") == "headers", int(options.get("split", SPLIT))

    def partitions(self) -> list[InputPartition]:
        """Files dealt by size, without opening one: a large file is several tasks, several small ones are one."""
        fs, at = opened(self.path)
        info = fs.get_file_info(at)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
        out, held, filled = [], [], 0
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.extension.lower() == self.extension), key=lambda f: f.path):
            for a in [0] if self.headers else range(0, max(1, f.size), self.split):
                n = HEAD if self.headers else min(self.split, f.size - a)
                if held and filled + n > self.split:
                    out.append(Ranges(held))
                    held, filled = [], 0
                held.append((f.path, a, min(f.size, a + self.split)))
                filled += n
        return [*out, Ranges(held)] if held else out or [Ranges([])]

    def read(self, partition: Ranges):
        fs, _ = opened(self.path)
        for path, a, z in partition.parts:
            file = Ranged(fs, path)
            yield from [self.said(file, path)] if self.headers else self.decoded(file, path, a, z)

    def said(self, file: Ranged, path: str) -> tuple:
        try:
            header, _ = file.header()
            _, _, width, height = exr.window(header)
        except ImageError as e:
            return path, None, None, None, None, None, None, file.size, file.read, str(e)
        kind = exr.compression_of(header)
        return (path, width, height, exr.space_of(header.get("chromaticities")), kind, ",".join(c["name"] for c in header["channels"]), -(-height // exr.BLOCK_LINES[kind]), file.size, file.read, None)

    def decoded(self, file: Ranged, path: str, a: int, z: int):
        header, table = file.header()
        kinds, at = exr.channel_order(header)
        _, top, width, height = exr.window(header)
        kind = exr.compression_of(header)
        n = -(-height // exr.BLOCK_LINES[kind])
        offsets = np.frombuffer(file.bytes(table, 8 * n), "<u8")
        if len(offsets) < n:
            raise ImageError("no valid scanline block offsets")
        for k in np.flatnonzero((offsets >= max(a, table + 8 * n)) & (offsets < z)).tolist():
            place = int(offsets[k])
            y, size = struct.unpack("<iI", file.bytes(place, 8))
            payload = file.bytes(place + 8, size)
            if not 0 <= y - top < height or len(payload) < size:
                continue
            lines = min(exr.BLOCK_LINES[kind], height - (y - top))
            flat = pa.array(exr.rgba(exr.decode_block(payload, kind, kinds, width, lines), at).ravel())
            ints = {"block": k, "first_y": y - top, "lines": lines, "width": width}
            columns = [pa.array([path]), *(pa.array([v], pa.int32()) for v in ints.values()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(columns, ["path", *ints, "data"])


def block_pixels(blocks: DataFrame) -> DataFrame:
    """path, x, y, r, g, b, a of decoded blocks."""
    px = blocks.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("lines") * F.col("width") - 1)))
    at = lambda k: F.get("data", F.col("p") * 4 + k)
    return px.select("path", (F.col("p") % F.col("width")).alias("x"), (F.col("first_y") + F.floor(F.col("p") / F.col("width"))).cast("int").alias("y"), *(at(k).alias(c) for k, c in enumerate("rgba")))


def exr_parts(px: DataFrame, width: int, height: int, compression: str = "zip", space: str = "linear-rec709") -> DataFrame:
    """path, part, content: EXR files in ordered parts of pixels (image_id, x, y, r, g, b, a). Each block is coded by itself, so one large image is many
    tasks; its place follows from the sizes of those before it. Part -1 is the header with the table of places. Pixels that are missing are black."""
    if compression not in exr.COMPRESSION:
        raise ImageError(f"Unsupported EXR compression: {compression}")
    lines, half = exr.BLOCK_LINES[compression], compression != "none"
    head = exr.header_bytes(width, height, compression, space, 1 if half else 2)
    kind = px.schema["image_id"].dataType.simpleString()

    def coded(key, table):
        block = key[1].as_py()
        n = min(lines, height - block * lines)
        planes = np.zeros((4, n, width), np.float32)
        x, y = table["x"].to_numpy(), table["y"].to_numpy() - block * lines
        for k, c in enumerate("abgr"):
            planes[k, y, x] = table[c].to_numpy()
        payload = exr.encode_block([exr.half_bits(p).view(np.float16) if half else p for p in planes], compression)
        content = struct.pack("<iI", block * lines, len(payload)) + payload
        return pa.table({"image_id": pa.array([key[0].as_py()], table.schema.field("image_id").type), "part": pa.array([block], pa.int64()), "size": pa.array([len(payload)], pa.int64()), "content": pa.array([content], pa.binary())})

    f = lambda c: F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")).alias(c)
    grid = px.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(f(c) for c in "rgba"), F.floor(F.col("y") / lines).alias("block"))
    every = grid.select("image_id").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-height // lines) - 1).cast("long"))))
    every = every.select("image_id", F.lit(0).alias("x"), (F.col("block") * lines).cast("int").alias("y"), *(F.lit(0.0).cast("float").alias(c) for c in "rgba"), "block")
    # The black first pixel of a block comes first, so one that is given stands.
    both = every.withColumn("given", F.lit(0)).unionByName(grid.withColumn("given", F.lit(1)))
    one = both.filter("x = 0 AND y = block * %d" % lines).groupBy("image_id", "x", "y", "block").agg(F.max_by(F.struct(*"rgba"), "given").alias("v")).select("image_id", "x", "y", *(F.col(f"v.{c}").alias(c) for c in "rgba"), "block")
    rows = one.unionByName(grid.filter("NOT (x = 0 AND y = block * %d)" % lines))
    blocks = stored(rows.groupBy("image_id", "block").applyInArrow(coded, f"image_id {kind}, part long, size long, content binary"), "exr-blocks")
    places = relational.offsets(blocks.select("image_id", "part", "size"), "size", len(head), "image_id", "part")
    table = places.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("block", F.hex(F.col("at")).alias("h")))).alias("t"))
    # Eight bytes a place, the lowest first.
    pairs = lambda h: F.reverse(F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda k: F.substr(F.lpad(h, 16, "0"), k, F.lit(2))))
    content = F.concat(F.lit(bytearray(head)), F.unhex(F.array_join(F.flatten(F.transform("t", lambda s: pairs(s["h"]))), "")))
    parts = blocks.select("image_id", "part", "content").unionByName(table.select("image_id", F.lit(-1).cast("long").alias("part"), content.alias("content")))
    return parts.select(F.concat(F.col("image_id").cast("string"), F.lit(".exr")).alias("path"), "part", "content")


class PartsSink(DataSource):
    """Files from rows (path, part, content), each partition holding whole files in order. Option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return "parts"

    def writer(self, schema, overwrite):
        if [f.name for f in schema] != ["path", "part", "content"]:
            raise ValueError("columns must be path, part, content")
        return PartsWriter(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class PartsWriter(DataSourceWriter):
    """A task writes under names of its own in a hidden folder; commit moves them into place, and abort removes the folder, so a task that is killed or
    runs twice leaves no part of a file behind."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.hidden = path.rstrip("/"), overwrite, f"_parts-{uuid.uuid4().hex}"

    def write(self, rows) -> Written:
        fs, at = opened(self.path)
        fs.create_dir(f"{at}/{self.hidden}", recursive=True)
        names, out, last = [], None, None
        for row in rows:
            if row.path != last:
                if out:
                    out.close()
                if any(row.path == n for n, _ in names):
                    raise ValueError(f"the parts of {row.path} are not in order")
                names.append((row.path, uuid.uuid4().hex))
                out, last, part = fs.open_output_stream(f"{at}/{self.hidden}/{names[-1][1]}"), row.path, None
            if part is not None and row.part <= part:
                raise ValueError(f"the parts of {row.path} are not in order")
            out.write(bytes(row.content))
            part = row.part
        if out:
            out.close()
        return Written(names)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        done = [x for m in messages if m for x in m.names]
        if len({n for n, _ in done}) < len(done):
            self.abort(messages)
            raise ValueError("a file's parts are in several partitions")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for name, held in done:
            fs.move(f"{at}/{self.hidden}/{held}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(f"{at}/{self.hidden}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.hidden}")


def register(spark: SparkSession) -> None:
    for source in (ExrSource, PartsSink):
        spark.dataSource.register(source)
