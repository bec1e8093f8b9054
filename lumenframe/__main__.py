"""python -m lumenframe convert|batch|info|reference: image files through the same DataFrames as everything else."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import color, tone
from .operators import gainmap
from .plans import views
from .plans.stored import stored
from .sources import datasource, exr, images


def displayed_image(px: DataFrame, mapper: str, exposure: float) -> DataFrame:
    """Pixels as display values from 0 to 1."""
    out = tone.displayed(px, mapper=mapper, exposure=exposure)
    return out.select("image_id", "p", *((F.col(c) / 255).alias(c) for c in "rgb"), F.lit(1.0).alias("a"))


def exposure_of(whole: DataFrame, asked: str) -> float:
    """A number, or "file": what the file's header says, 1 without it."""
    if asked != "file":
        return float(asked)
    found = whole.select(F.col("metadata")["EXPOSURE"].try_cast("double")).first()[0] if "metadata" in whole.columns else None
    return 1.0 if found is None else found


def checked(whole: DataFrame, strict: bool) -> None:
    """Ends if an EXR image must not be tone mapped: its chromaticities are of no known space, or, if strict, absent."""
    given = whole.select(F.col("metadata")["chromaticities"], "space").first()
    if strict and given[0] is None:
        raise SystemExit("the file has no chromaticities; tone mapping needs Rec.709 or a known space (leave out --strict to go on)")
    if given[0] is not None:
        xy = [float(v) for v in re.findall(r"-?[0-9.]+(?:e-?[0-9]+)?", given[0])]
        known = len(xy) == 8 and any(all(abs(a - b) <= 0.01 for a, b in zip(xy, [v for p in points for v in p], strict=True)) for points in color.CHROMATICITIES.values())
        if not known:
            raise SystemExit("the chromaticities are those of no known space; convert the image before tone mapping")


def files_of(whole: DataFrame, target: str, args) -> DataFrame:
    """The files of one image; Radiance and display files hold Rec.709, EXR files keep their space."""
    row = whole.select("width", "height", "space").first()
    if target == "exr":
        return images.encoded(whole, "exr", compression=args.compression or "zip")
    px = images.pixels(whole)
    rgb = color.convert([F.col(c).cast("double") for c in "rgb"], row.space.removeprefix("linear-"), "rec709")
    px = px.select("image_id", "p", *(v.alias(c) for v, c in zip(rgb, "rgb", strict=True)), "a")
    if target == "hdr":
        return images.encoded(images.from_pixels(px, row.width, row.height), "hdr")
    exposure = exposure_of(whole, args.exposure)
    if target in ("jpg", "jpeg"):
        options = gainmap.Options(gamma=(args.gamma,) * 3)
        return images.gain_map_files(px, row.width, row.height, args.format or "ultrahdr", args.tonemapping or "aces", args.quality, exposure, options)
    return images.encoded(images.from_pixels(displayed_image(px, args.tonemapping or "reinhard", exposure), row.width, row.height), "png")


def refused(target: str, args) -> None:
    if args.compression and target != "exr":
        raise SystemExit(f"--compression is for EXR files, not {target}")
    if args.format and target not in ("jpg", "jpeg"):
        raise SystemExit(f"--format is for JPEG files, not {target}")


def save(files: DataFrame, out: str) -> None:
    Path(out).write_bytes(bytes(files.first().content))


def convert(spark, args) -> None:
    target = Path(args.output).suffix[1:].lower()
    if target not in ("exr", "hdr", "jpg", "jpeg", "png"):
        raise SystemExit(f"cannot write {target or 'a file without an extension'}")
    refused(target, args)
    whole = images.load_images(spark, str(Path(args.input).resolve()))
    if target in ("jpg", "jpeg", "png") and Path(args.input).suffix.lower() == ".exr":
        checked(whole, args.strict)
    save(files_of(whole, target, args), args.output)


def batch(spark, args) -> None:
    """All image files given, or below the folders given, each once, to EXR or Radiance files of one folder; what cannot be read is told and left."""
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([str(Path(p).resolve()) for p in args.input])
    files = files.filter(images.extension(F.col("path")).isin(*images.EXTENSIONS)).select("path", "content")
    datasource.register(spark)
    made = images.batch_converted(files, args.to, **({"compression": args.compression or "zip"} if args.to == "exr" else {}))
    # Of files of one name from several folders the first is written.
    made = made.withColumn("path", F.regexp_extract("path", r"[^/]*$", 0))
    first = F.row_number().over(Window.partitionBy("path").orderBy("source")) > 1
    made = stored(made.withColumn("error", F.when(F.col("path").isNotNull() & first, "another file has this name").otherwise(F.col("error"))), "batch")
    made.filter("error IS NULL").select("path", F.lit(0).cast("long").alias("part"), "content").write.format("parts").mode("append").save(str(out.resolve()))
    failed = made.filter("error IS NOT NULL").select("source", "error").orderBy("source").collect()
    for r in failed:
        print(f"{r.source}: {r.error}", file=sys.stderr)
    if failed:
        raise SystemExit(f"{len(failed)} files could not be converted")


def info(spark, args) -> None:
    r = images.file_info(spark.read.format("binaryFile").load(str(Path(args.input).resolve()))).first()
    out = {"file": args.input, "width": r.width, "height": r.height, "colorSpace": r.space, "metadata": json.loads(r.metadata)}
    if args.json:
        print(json.dumps(out, indent=2))
        return
    for k, v in out.items():
        print(f"{k}:" if isinstance(v, dict) else f"{k}: {json.dumps(v)}")
        for a, b in v.items() if isinstance(v, dict) else ():
            print(f"  {a}: {json.dumps(b)}")


def reference(spark, args) -> None:
    target = Path(args.output).suffix[1:].lower()
    if target not in ("exr", "hdr"):
        raise SystemExit(f"reference images are EXR or Radiance files, not {target or 'files without an extension'}")
    refused(target, args)
    w, h = args.width or args.size, args.height or args.size
    space = "linear-rec709"
    if args.kind.startswith("cie-wedge"):
        px, space = views.cie_wedge(spark, w, h, args.luminance, args.kind[10:] or "rgb"), "linear-rec2020"
    elif args.kind == "rainbow":
        px = views.rainbow(spark, w, h, args.value, args.intensity)
    else:
        px = {"gradient": views.gradient, "sdf": views.radial}[args.kind](spark, w, h)
    save(files_of(images.from_pixels(px.withColumn("image_id", F.lit(args.kind)), w, h, space), target, args), args.output)


def main(argv=None, spark=None) -> None:
    top = argparse.ArgumentParser(prog="lumenframe")
    commands = top.add_subparsers(dest="command", required=True)
    c, b, i, r = (commands.add_parser(n) for n in ("convert", "batch", "info", "reference"))
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--strict", action="store_true", help="refuse EXR files without chromaticities where they are tone mapped")
    b.add_argument("input", nargs="+")
    b.add_argument("output")
    b.add_argument("--to", choices=("exr", "hdr"), default="hdr")
    i.add_argument("input")
    i.add_argument("--json", action="store_true")
    r.add_argument("kind", choices=("rainbow", "gradient", "sdf", "cie-wedge", "cie-wedge-r", "cie-wedge-g", "cie-wedge-b"))
    r.add_argument("output")
    r.add_argument("--size", type=int, default=512)
    r.add_argument("--width", type=int)
    r.add_argument("--height", type=int)
    for name in ("--value", "--intensity", "--luminance"):
        r.add_argument(name, type=float, default=1.0)
    for p in (c, b, r):
        p.add_argument("--compression", choices=tuple(exr.COMPRESSION))
        p.add_argument("--tonemapping", choices=tuple(tone.MAPPERS))
        p.add_argument("--exposure", default="1.0", help='a number, or "file" for what the header says')
        p.add_argument("--gamma", type=float, default=1.0)
        p.add_argument("--format", choices=("ultrahdr", "adobe-gainmap"))
        p.add_argument("--quality", type=int, default=95)
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    {"convert": convert, "batch": batch, "info": info, "reference": reference}[args.command](spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
