"""Embedding whitening: principal components by a randomised range finder over all distinct rows, and every row in their whitened coordinates.

Passes over the rows run in Arrow batches in numpy; what a pass sums up has the size of dimensions x directions and is added up by Spark before it
reaches the driver."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, OVERSAMPLE, POWER_PASSES = 16, 10, 6
#: A component's residual may be so much of its distance from the next eigenvalue: about the error of its direction.
RESIDUAL = 1e-11
#: Eigenvalues below this share of the largest are rounding: rows have no coordinate there.
RANK = 1e-12
#: Entries beyond this have no exact place on the integer grid.
LARGEST = float(1 << 40)
ROWS = 4096


def gridded(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the vector on the integer grid, of each row that takes part: not null, every entry finite and of at most LARGEST, and as long as
    most vectors are (of equally frequent lengths the longest)."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > LARGEST))
    rows = vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    first = rows.groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"]).first()[0]
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return rows.filter(F.size("embedding") == F.lit(first or 0)).select("vec_id", x.alias("x"))


def matrix(column) -> np.ndarray:
    """The rows of a list column, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n * x - total, exactly: in 64-bit integers where they hold it."""
    small = int(np.abs(x).max(initial=0)) * n < 1 << 61 and all(abs(int(t)) < 1 << 61 for t in total)
    return x * n - np.array([int(t) for t in total], np.int64) if small else x.astype(object) * n - np.array([int(t) for t in total], object)


def squares(c: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = max((abs(int(v)) for v in (c.min(initial=0), c.max(initial=0))), default=0)
    if c.dtype != object and most * most * max(1, c.shape[1]) < 1 << 62:
        return (c * c).sum(1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in c.tolist()]


def summed(df: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of df of of(x), an array of this shape for a matrix of rows: a task adds up its batches, Spark the tasks, entry by entry."""
    size = int(np.prod(shape))

    def run(batches):
        import pyarrow as pa

        total = np.zeros(shape)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                total += of(matrix(batch["x"].slice(k, min(ROWS, batch.num_rows - k))))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.ravel())], ["k", "v"])

    parts = df.select("x").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[parts["k"].to_numpy()] = parts["v"].to_numpy()
    return out.reshape(shape)


def totals(df: DataFrame) -> np.ndarray:
    """The exact sums of the dimensions."""

    def run(batches):
        import pyarrow as pa

        total: list = []
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = matrix(batch["x"].slice(k, min(ROWS, batch.num_rows - k)))
                part = part.sum(0) if int(np.abs(part).max(initial=0)) * ROWS < 1 << 62 else part.astype(object).sum(0)
                total = [int(v) + w for v, w in zip(part, total or [0] * len(part), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array([Decimal(v) for v in total], pa.decimal128(38, 0))], ["k", "v"])

    rows = df.select("x").mapInArrow(run, "k long, v decimal(38,0)").groupBy("k").agg(F.sum("v").cast("decimal(38,0)").alias("v")).orderBy("k").collect()
    return np.array([int(r.v) for r in rows], object)


class Whitening:
    """Components of the rows' covariance. vectors, values: eigenvectors (a column each) and eigenvalues; trace: of the covariance; directions: how many
    the last search had; identity_error: the largest entry of the whitened rows' covariance less the identity."""

    n: int
    total: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    directions: int
    identity_error: float

    def __init__(self, fit: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = POWER_PASSES, seed: int = 1):
        self.n, self.total = fit.count(), totals(fit)
        d, n, total = len(self.total), self.n, self.total
        k = min(components, d)
        whole = lambda x: centred(x, n, total).astype(float) / n

        def through(q):
            """The covariance times q, and its trace, in one pass over the centred rows."""

            def of(x):
                c = whole(x)
                return np.append(c.T @ (c @ q), (c * c).sum())

            got = summed(fit, of, (d * q.shape[1] + 1,)) / max(1, n)
            return got[:-1].reshape(q.shape), got[-1]

        # The range of the covariance, found by random directions that are sharpened by power passes; Rayleigh-Ritz on each range.
        q = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(d, min(d, k + oversample))))[0]
        for left in range(passes, -1, -1):
            image, self.trace = through(q)
            small = q.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            off = np.linalg.norm(image @ turn - (q @ turn) * values, axis=0)
            gaps = np.abs(np.diff(values, append=0.0 if len(values) == d else values[-1]))
            gaps = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
            done = q.shape[1] == d or bool((off[:k] <= RESIDUAL * gaps[:k]).all())
            if done:
                break
            if left > 1:
                q = np.linalg.qr(image)[0]
            else:  # the passes did not separate the components: all directions, where the covariance is seen whole
                q = np.linalg.qr(np.concatenate([q @ turn, np.random.Generator(np.random.PCG64(seed + 1)).normal(size=(d, d - q.shape[1]))], 1))[0]
        self.directions = q.shape[1]
        # What is left are rounding errors, also where a covariance has no rank for k components.
        keep = int((values[:k] > RANK * max(values[0], 0)).sum()) if d and n else 0
        v = (q @ turn)[:, :keep]
        self.vectors = v * np.where(v[np.abs(v).argmax(0), np.arange(keep)] < 0, -1, 1) if keep else v
        self.values = values[:keep]
        scaled = self.vectors / np.sqrt(self.values)
        seen = summed(fit, lambda x: (lambda z: z.T @ z)(whole(x) @ scaled), (keep, keep)) / max(1, n)
        self.identity_error = float(np.abs(seen - np.eye(keep)).max(initial=0))

    def applied(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation (exact; null beyond a long) and whitened, an array with a number for each component."""
        n, total, scaled = self.n, self.total, self.vectors / np.sqrt(self.values)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(0, batch.num_rows, ROWS):
                    part = batch.slice(k, ROWS)
                    c = centred(matrix(part["x"]), n, total)
                    z = (c.astype(float) / n) @ scaled
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                    deviation = pa.array([v if v < 1 << 63 else None for v in squares(c)], pa.int64())
                    yield pa.RecordBatch.from_arrays([part["vec_id"], deviation, lists], ["vec_id", "deviation", "whitened"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def whitened(vectors: DataFrame, components: int = COMPONENTS, **options) -> DataFrame:
    """vec_id, deviation, whitened (an array), explained (an array), n and identity_error of each row of vectors (vec_id, embedding) that takes part
    (see gridded). The components are fitted on each distinct vector once, all of them; copies, however many, weigh no more than one.

    An empty table, or one without a usable vector, gives no rows. Components without variance (RANK) do not exist: there may be fewer than asked for,
    and none if all vectors are equal. Equal eigenvalues have no components of their own; any basis of theirs is right, and reruns choose the same up to
    rounding. Repeated rows are returned as often as they occur; columns other than vec_id and embedding are not read."""
    rows = written(gridded(vectors), "whitening-rows")
    fit = written(rows.select("x").distinct(), "whitening-fit")
    if not fit.take(1):
        return rows.select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"),
                           F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("identity_error"))
    w = Whitening(fit, components, **options)
    explained = F.array(*(F.lit(float(v / w.trace)) for v in w.values)).cast("array<double>")
    return w.applied(rows).withColumns({"explained": explained, "n": F.lit(w.n).cast("long"), "identity_error": F.lit(w.identity_error)})


def op12_whitening(spark, sf_dir):
    rows = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "z")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", "z.whitened", "z.explained", "identity_error")
