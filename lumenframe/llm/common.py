"""Shared folder, sized broadcasts and native tokenisers for the corpus operators."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, by the optimizer's own estimate or by a measured sum, that may be broadcast.
BROADCAST_BYTES = 32 << 20

#: Groups of a grouped table that are counted on at least, and its files, at most.
LEAST_GROUPS, MOST_FILES = 8, 20_000
#: (path, table or None) of what is written on the way.
MADE: list[tuple[str, str | None]] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Separators of the item and licence tokenisers, for already lower-cased text.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the whitespace tokenisers.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset on a local master, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    MADE.append((at, None))
    return spark.read.schema(df.schema).parquet(at)


def grouped(df: DataFrame, key: str, tag: str, mb: float) -> tuple[DataFrame, int]:
    """df (with a column text) written once to the shared folder with column key, a group of about mb megabytes of text: neighbouring rows of a partition,
    so nothing is shuffled. Later joins and cogroups on key move only their other side. A file holds several groups, in order, where there are many.
    Returns the table and the number of groups."""
    spark = df.sparkSession
    most = int(mb * (1 << 20))
    size = df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = min(max(LEAST_GROUPS, -(-size // most)), MOST_FILES)

    def dealt(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        first, filled = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            ends = filled + np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield batch.append_column(key, pa.array(first + ends // most))
            filled = int(ends[-1]) if len(ends) else filled

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{key}` long"
    name = f"{tag}_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    df.mapInArrow(trimmed(dealt), schema).write.bucketBy(files, key).sortBy(key).option("compression", "zstd").option("path", at).saveAsTable(name)
    MADE.append((at, name))
    table = spark.table(name)
    return table, max(LEAST_GROUPS, table.select(key).distinct().count())


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes what operators of this process have written to the shared folder on the way, all of it or what came after len(MADE) was since. Their
    results are read from it, so call this when those are written or no longer needed."""
    while len(MADE) > since:
        at, name = MADE.pop()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; lower() is the quicker way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_words(df: DataFrame, name: str = "words") -> DataFrame:
    """df with the words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of its lower-cased text, in order; null has none."""
    parts = F.split(fold_ascii(F.coalesce(F.col("text"), F.lit(""))), NON_WORD)
    df = df.withColumn("_parts", parts)
    # Only the first and the last part can be empty.
    first = F.when(F.get("_parts", F.lit(0)) == "", 2).otherwise(1)
    last = F.when((F.size("_parts") > 1) & (F.element_at("_parts", -1) == ""), 1).otherwise(0)
    return df.withColumn(name, F.slice("_parts", first, F.greatest(F.size("_parts") - first + 1 - last, F.lit(0)))).drop("_parts")


def gram_hash(words: str, at: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(F.col(words), at + i) for i in range(n)))


def word_places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """docs (doc_id, text) as doc_id, th (a hash of the text: with doc_id it names a row), words, n_words, p, n, h: one row with p = -1 and no h for each
    document, and one for each place p and each n of sizes, with the hash of the n words there (null where fewer are left)."""
    rows = with_words(docs.select("doc_id", "text")).withColumn("th", F.xxhash64("text")).drop("text")
    rows = rows.withColumn("n_words", F.size("words"))
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    if len(sizes) == 1:
        rows = rows.withColumn("n", F.lit(sizes[0])).withColumn("h", gram_hash("words", F.col("p"), sizes[0]))
    else:
        each = F.array(*(F.struct(F.lit(n).alias("n"), gram_hash("words", F.col("p"), n).alias("h")) for n in sizes))
        rows = rows.withColumn("x", F.explode(F.when(F.col("p") >= 0, each).otherwise(F.slice(each, 1, 1))))
        rows = rows.withColumn("n", F.col("x.n")).withColumn("h", F.col("x.h")).drop("x")
    return rows.withColumn("h", F.when((F.col("p") >= 0) & (F.col("p") + F.col("n") <= F.col("n_words")), F.col("h")))


def words_at(start: Column, n: Column) -> Column:
    return F.concat_ws(" ", F.slice("words", F.greatest(start + 1, F.lit(1)), n))


def found_grams(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Where word n-grams stand in documents, in one pass and without moving a document.

    docs: doc_id, text. grams: sid, gram (words joined by a space), n (its words), h (gram_hash); the caller has checked its size, it is
    broadcast. Returns doc_id, th, n_words and p, sid: one row with p = -1 and no sid for each document, and one for each place. Equal hashes are
    held against the words themselves."""
    g = F.broadcast(grams.select("sid", "gram", F.col("n").alias("gn"), F.col("h").alias("gh")))
    rows = word_places(docs, sizes).join(g, F.col("h") == F.col("gh"), "left")
    same = (F.col("n") == F.col("gn")) & (words_at(F.col("p"), F.col("n")) == F.col("gram"))
    return rows.filter((F.col("p") == -1) | same).select("doc_id", "th", "n_words", "p", "sid")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, so that extra ones with clashing names cannot interfere."""
    return df.select(*(F.col(c) for c in columns))


def sliced(batches, rows: int = 256):
    """Arrow batches cut to so many rows, so that Python objects exist for a few texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def trimmed(f):
    """f, a function of Arrow data that runs in a Python worker; when it is done, freed memory goes back to the system, for workers outlive tasks."""

    def trim():
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(batches):
            yield from f(batches)
            trim()
    else:

        @wraps(f)
        def run(*tables):
            out = f(*tables)
            trim()
            return out

    return run
