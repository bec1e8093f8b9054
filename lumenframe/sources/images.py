"""Image files as DataFrames and back: binaryFile rows are decoded and encoded in Arrow batches, one file at a time, without a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exr, png, rgbe

EXTENSIONS = ("exr", "hdr", "jpg", "jpeg")
IMAGE = "image_id string, width int, height int, data array<float>, space string, metadata map<string,string>, error string"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def read_bytes(kind: str, content: bytes, **options) -> dict:
    """One file by its extension."""
    if kind == "exr":
        return exr.read(content, **{k: v for k, v in options.items() if k == "interleaved"})
    if kind == "hdr":
        return rgbe.read(content, **{k: v for k, v in options.items() if k in ("strict", "physical")})
    if kind in ("jpg", "jpeg"):
        from . import ultrahdr

        return ultrahdr.read(content)
    if kind == "png":
        return png.read(content)
    raise rgbe.ImageError(f"unsupported extension: {kind or 'none'}")


def gathered(rows, schema: pa.Schema, most: int = 64, size: int = 4 << 20):
    """Record batches of at most so many rows, each a batch of one row, and about so many bytes: small images share one, large ones stand alone."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += row.nbytes
        if len(held) >= most or total >= size:
            yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held, schema).combine_chunks().to_batches()[0]


def decoded(files: DataFrame, on_error: str = "raise", **options) -> DataFrame:
    """files: path, content, of a batch or a stream. on_error="record" keeps a file that cannot be read as a row with its error and no pixels.
    A null content is such a file."""

    def run(batches):
        for batch in batches:
            for path, kind, content in zip(*(batch[c] for c in ("path", "kind", "content")), strict=True):  # Arrow scalars: one file in Python at a time
                row = {"image_id": [path.as_py()], "width": [None], "height": [None], "data": pa.array([None], pa.list_(pa.float32())), "space": [None], "metadata": [None], "error": [None]}
                try:
                    got = read_bytes(kind.as_py() or "", content.as_py() or b"", **options)
                    flat = pa.array(np.ascontiguousarray(got["data"], np.float32))
                    row |= {"width": [got["width"]], "height": [got["height"]], "space": [got["space"]], "metadata": [list(got["metadata"].items())]}
                    row["data"] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
                except ValueError as e:
                    if on_error != "record":
                        raise
                    row["error"] = [str(e)]
                yield pa.RecordBatch.from_pydict(row, SCHEMA)

    return files.select("path", extension(F.col("path")).alias("kind"), "content").mapInArrow(batched(run, SCHEMA), IMAGE)


SCHEMA = pa.schema([("image_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.list_(pa.float32())), ("space", pa.string()),
                    ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


FILE = pa.schema([("image_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])
INFO = pa.schema([SCHEMA.field("image_id"), SCHEMA.field("metadata")])


def batched(run, schema: pa.Schema):
    """run, which gives a batch for each row, with its rows gathered."""
    return lambda batches: gathered(run(batches), schema)


def load_images(spark: SparkSession, path, on_error: str = "raise", **options) -> DataFrame:
    """All image files below path (one or a list), by extension; each file is read where its partition runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return decoded(files.filter(extension(F.col("path")).isin(*EXTENSIONS)), on_error, **options)


def pixels(images: DataFrame) -> DataFrame:
    """image_id, p, x, y, r, g, b, a of the images that were read."""
    at = lambda k: F.get("data", F.col("p") * 4 + k)
    px = images.filter("width * height > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)))
    return px.select("image_id", "p", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *(at(k).alias(c) for k, c in enumerate("rgba")))


def from_pixels(px: DataFrame, width: int, height: int, space: str = "linear-rec709") -> DataFrame:
    """image_id, width, height, data, space of pixels (image_id, p, r, g, b, a): one row an image, as large as the image."""
    whole = px.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("p", F.array(*(F.col(c).cast("float") for c in "rgba")).alias("v")))).alias("s"))
    return whole.select("image_id", F.lit(width).alias("width"), F.lit(height).alias("height"), F.flatten(F.transform("s", lambda s: s.v)).alias("data"), F.lit(space).alias("space"))


def encoded(images: DataFrame, kind: str, **options) -> DataFrame:
    """image_id, path (a name with the extension) and content of images as files: exr (compression=...), hdr (packed=...), png (8-bit values already displayed, 0 to 1)."""
    if kind not in ("exr", "hdr", "png"):
        raise ValueError(f"cannot write {kind}")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                width, height, data = batch["width"][k].as_py(), batch["height"][k].as_py(), batch["data"][k].values.to_numpy(zero_copy_only=False)
                if kind == "exr":
                    out = exr.write(width, height, data, options.get("compression", "zip"), batch["space"][k].as_py() or "linear-rec709")
                elif kind == "hdr":
                    out = rgbe.write(width, height, data, options.get("packed", False))
                else:
                    out = png.write(width, height, np.floor(np.clip(np.nan_to_num(data), 0, 1) * 255 + 0.5))
                name = batch["image_id"][k].as_py()
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([name], pa.string()), "path": [f"{name}.{kind}"], "content": pa.array([out], pa.binary())})

    wanted = images.filter("data IS NOT NULL").select(F.col("image_id").cast("string").alias("image_id"), "width", "height", "data", "space")
    return wanted.mapInArrow(run, "image_id string, path string, content binary")


def exr_blocks(files: DataFrame) -> DataFrame:
    """image_id, block, first_y, lines, compression, payload of EXR files (path, content): blocks of a large file can be dealt out before they are decoded."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = content.as_py()
                header, table = exr.read_header(data)
                for k, (y, n, payload) in enumerate(exr.block_list(data, header, table)):
                    yield pa.RecordBatch.from_pydict({"image_id": [path.as_py()], "block": pa.array([k], pa.int32()), "first_y": pa.array([y], pa.int32()), "lines": pa.array([n], pa.int32()),
                                                      "compression": [exr.compression_of(header)], "payload": pa.array([payload], pa.binary())})

    return files.select("path", "content").mapInArrow(run, "image_id string, block int, first_y int, lines int, compression string, payload binary")


def image_info(images: DataFrame) -> DataFrame:
    """image_id, width, height, space and metadata as JSON; the pixels are not kept."""
    return images.select("image_id", "width", "height", "space", F.to_json("metadata").alias("metadata"), "error")


def file_info(files: DataFrame, on_error: str = "raise") -> DataFrame:
    """What image_info says, of files (path, content). Of EXR files only the header is looked at; their pixels may be damaged."""
    exrs = extension(F.col("path")) == "exr"

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                row = {"image_id": [path.as_py()], "width": [None], "height": [None], "space": [None], "metadata": [None], "error": [None]}
                try:
                    got = exr.described(exr.read_header(content.as_py() or b"")[0])
                    row |= {k: [got[k]] for k in ("width", "height", "space")} | {"metadata": [list(got["metadata"].items())]}
                except ValueError as e:
                    if on_error != "record":
                        raise
                    row["error"] = [str(e)]
                yield pa.RecordBatch.from_pydict(row, pa.schema([f for f in SCHEMA if f.name != "data"]))

    headers = files.filter(exrs).select("path", "content").mapInArrow(run, IMAGE.replace("data array<float>, ", ""))
    others = decoded(files.filter(~exrs), on_error).drop("data")
    return image_info(headers.unionByName(others))


def gain_map_pictures(px: DataFrame, mapper: str = "aces", exposure: float = 1.0, options=None) -> DataFrame:
    """image_id, log_min, log_max and v, both pictures' bytes pixel by pixel, one row an image."""
    from ..operators import gainmap

    # The boost needs all pixels of an image before the first can be coded, so the tone-mapped pixels are worked out twice and never stored.
    options = options or gainmap.DEFAULT
    toned = gainmap.with_tone(px, mapper, exposure)
    full = gainmap.encoded(toned, gainmap.boosts(toned, options), options=options)
    both = F.array(*(F.col(f"{k}_{c}").cast("int") for k in ("sdr", "gm") for c in "rgb"))
    whole = full.groupBy("image_id").agg(F.max("log_min").alias("log_min"), F.max("log_max").alias("log_max"), F.array_sort(F.collect_list(F.struct("p", both.alias("v")))).alias("s"))
    whole = whole.select(F.col("image_id").cast("string").alias("image_id"), "log_min", "log_max", F.flatten(F.transform("s", lambda s: s.v)).alias("v"))
    # Few bytes an image and much work: by bytes alone, all images would end up in a few tasks.
    spark = px.sparkSession
    return whole.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "image_id")


def map_metadata(batch, k: int, options) -> dict:
    from . import ultrahdr

    range_ = batch["log_max"][k].as_py(), batch["log_min"][k].as_py()
    return ultrahdr.metadata_for(*range_, options.gamma, options.offset_sdr, options.offset_hdr) if options else ultrahdr.metadata_for(*range_)


def gain_map_files(px: DataFrame, width: int, height: int, kind: str = "ultrahdr", mapper: str = "aces", quality: int = 95, exposure: float = 1.0, options=None) -> DataFrame:
    """image_id, path, content: gain-map JPEG files of linear pixels (image_id, p, r, g, b). The boost is an aggregate that joins its pixels, both
    pictures are Column arithmetic, and one row an image is turned into bytes."""
    from . import ultrahdr

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                v = batch["v"][k].values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(height, width, 6)
                out = ultrahdr.write(v[..., :3], v[..., 3:], map_metadata(batch, k, options), kind, quality)
                name = batch["image_id"][k].as_py()
                yield pa.RecordBatch.from_pydict({"image_id": pa.array([name], pa.string()), "path": [f"{name}.jpg"], "content": pa.array([out], pa.binary())})

    return gain_map_pictures(px, mapper, exposure, options).mapInArrow(batched(run, FILE), "image_id string, path string, content binary")


def gain_map_info(files: DataFrame) -> DataFrame:
    """image_id and metadata, as decoded gives them, of gain-map JPEG files (path, content); their pictures are not decoded."""
    from . import ultrahdr

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pa.RecordBatch.from_pydict({"image_id": [path.as_py()], "metadata": [list(ultrahdr.described(content.as_py() or b"").items())]}, INFO)

    return files.select("path", "content").mapInArrow(batched(run, INFO), "image_id string, metadata map<string,string>")


def batch_converted(files: DataFrame, kind: str, **options) -> DataFrame:
    """source, path, content, error: the files (path, content) as files of another kind, each path once. A file that cannot be read is a row with its error
    and no content; the others go on."""
    whole = decoded(files.dropDuplicates(["path"]), on_error="record")
    made = encoded(whole.filter("error IS NULL"), kind, **options).select(F.col("image_id").alias("source"), F.regexp_replace("path", r"\.[A-Za-z0-9]+(\.[a-z0-9]+)$", "$1").alias("path"), "content")
    bad = whole.filter("error IS NOT NULL").select(F.col("image_id").alias("source"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("binary").alias("content"), "error")
    return made.withColumn("error", F.lit(None).cast("string")).unionByName(bad)


def icc_profiles(files: DataFrame) -> DataFrame:
    """path, profile, size (as the profile says), description, tags (their number), adgc (the identifier of an adaptive gain curve, hexadecimal, or null) of
    JPEG files (path, content); nulls for files without a profile."""

    def run(batches):
        from . import ultrahdr

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                icc = ultrahdr.icc_profile(content.as_py() or b"")
                name = ultrahdr.icc_tag(icc, b"desc") if icc else None
                row = {"path": pa.array([path.as_py()], pa.string()), "profile": pa.array([icc], pa.binary()), "size": pa.array([int.from_bytes(icc[:4], "big") if icc else None], pa.int64()),
                       "description": pa.array([name[12 : 12 + int.from_bytes(name[8:12], "big")].rstrip(b"\0").decode("latin-1") if name else None], pa.string()),
                       "tags": pa.array([int.from_bytes(icc[128:132], "big") if icc else None], pa.int32()), "adgc": pa.array([ultrahdr.adgc(icc) if icc else None], pa.string())}
                yield pa.RecordBatch.from_pydict(row)

    return files.select("path", "content").mapInArrow(run, "path string, profile binary, size long, description string, tags int, adgc string")


def separate_files(px: DataFrame, width: int, height: int, mapper: str = "aces", quality: int = 90, exposure: float = 1.0, options=None) -> DataFrame:
    """image_id, sdr, gain_map (JPEG bytes) and metadata (JSON): what gain_map_files puts into one file, apart."""
    import json

    def run(batches):
        from . import jpeg

        for batch in batches:
            for k in range(batch.num_rows):
                v = batch["v"][k].values.to_numpy(zero_copy_only=False).astype(np.uint8).reshape(height, width, 6)
                row = {"image_id": pa.array([batch["image_id"][k].as_py()], pa.string()), "sdr": pa.array([jpeg.encode(v[..., :3], quality)], pa.binary()), "gain_map": pa.array([jpeg.encode(v[..., 3:], quality)], pa.binary()),
                       "metadata": [json.dumps(map_metadata(batch, k, options))]}
                yield pa.RecordBatch.from_pydict(row)

    return gain_map_pictures(px, mapper, exposure, options).mapInArrow(run, "image_id string, sdr binary, gain_map binary, metadata string")
