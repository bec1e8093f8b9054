"""Approximate nearest neighbours by several Hilbert orderings of projected, shifted vectors, reranked in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CURVES, DIMS, BITS = 3, 8, 7
#: Each curve is cut into ranges of about so many rows. Where a window has many ranges, neighbouring ones are searched together, up to so many rows.
RANGE_ROWS, MOST_ROWS = 2_000, 100_000
#: The window is measured, not set: so many queries, drawn by a hash, are answered exactly, and the curves and the window of least work are taken that
#: find this share of their true neighbours.
SAMPLE, RECALL = 256, 0.95
#: Queries that one task compares with a range, about; more are dealt to several tasks.
MOST_QUERIES = 20_000
#: Copies of one vector that make up more than this share of all rows are met by every query.
OFTEN = 16


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of integer points (rows of x, each coordinate below 2**bits) along a Hilbert curve: axes to transposed index by exchanging and inverting
    low bits from the top down, then Gray decoding, all points at once."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Directions projected on DIMS axes of a rotation drawn for the curve, shifted, and put on the curve's grid."""
    r = np.random.default_rng(1000 + curve)
    dim = vectors.shape[1]
    axes = np.linalg.qr(r.normal(size=(dim, dim)))[0][:, : min(DIMS, dim)]
    y = vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ axes * np.sqrt(dim)
    grid = ((y + r.uniform(-0.5, 0.5, y.shape[1])) / 6 + 0.5) * (1 << BITS)
    return hilbert(np.clip(grid, 0, (1 << BITS) - 1).astype(np.int64))


def valid_vectors(vec_id, embedding, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors (double) of the rows that take part, read from the Arrow buffers."""
    offsets, values = embedding.offsets.to_numpy(), embedding.values
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    good = np.flatnonzero((np.diff(offsets) == dim) & embedding.is_valid().to_numpy(zero_copy_only=False) & vec_id.is_valid().to_numpy(zero_copy_only=False))
    v = x[offsets[good][:, None] + np.arange(dim)] if dim else np.zeros((len(good), 0))
    with np.errstate(over="ignore", invalid="ignore"):
        ok = np.isfinite(v).all(1) & v.any(1) & np.isfinite(np.linalg.norm(v, axis=1))
    return good[ok], v[ok]


def _keyed(dim: int, kind: str):
    def run(batches):
        for batch in batches:
            at, x = valid_vectors(batch["vec_id"], batch["embedding"], dim)
            if len(at):
                keys = [pa.array(curve_keys(x, c)) for c in range(CURVES)]
                raw = np.ascontiguousarray(x.astype(kind))
                v = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * raw.itemsize * dim).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch["vec_id"].take(pa.array(at)), v, *keys], names=["vec_id", "v", *(f"k{c}" for c in range(CURVES))])

    return run


def vectors_of(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def k_best(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """Query ids, vector ids and inner products of the k best rows x for each query y, itself left out, ties to the smaller id. Single precision says
    which rows can be among them, within its error bound; these are computed in double precision, row by row, so that equal vectors score alike."""
    order = np.argsort(ids, kind="stable")  # equal scores keep the smaller id
    ids, x, got = ids[order], x[order], [[], [], []]
    far = np.linalg.norm(x, axis=1).max()
    coarse = (x / far).astype(np.float32).T
    margin = 4 * (x.shape[1] + 4) * 2.0**-24
    for at in range(0, len(asks), 256):
        q = y[at : at + 256]
        s = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ coarse
        s[asks[at : at + 256, None] == ids[None, :]] = -np.inf
        m = min(k, s.shape[1])
        edge = -np.partition(-s, m - 1, axis=1)[:, m - 1]
        i, r = np.nonzero((s >= edge[:, None] - margin) & np.isfinite(s))
        exact = (q[i] * x[r]).sum(1)
        o = np.lexsort((r, -exact, i))
        i, r, exact = i[o], r[o], exact[o]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        for out, value in zip(got, (asks[at + i[keep]], ids[r[keep]], exact[keep]), strict=True):
            out.append(value)
    return [np.concatenate(g) if g else np.zeros(0) for g in got]


def _found(got) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(g), t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def first_block(block, wide: int, blocks: int):
    """Where the window of so many ranges around a range begins; at the ends of a curve it is as wide."""
    return F.greatest(F.lit(0), F.least(block - wide // 2, F.lit(blocks - wide)))


def least_window(pairs: list[tuple], blocks: list[int], recall: float = RECALL) -> tuple[int, int]:
    """(curves, ranges of the window) of least work for that recall; pairs has for each true neighbour the query's range and its own on each curve."""
    if not pairs:  # a vector alone has no neighbours
        return 1, blocks[0]
    at = np.array(pairs, np.int64).reshape(len(pairs), -1, 2)
    need = np.empty(at.shape[:2], np.int64)  # ranges that the window must have to reach the neighbour
    for c, n in enumerate(blocks):
        own, near = at[:, c, 0], at[:, c, 1]
        low, high = np.ones(len(at), np.int64), np.full(len(at), n)
        while (low < high).any():  # a wider window holds each narrower one
            wide = (low + high) // 2
            first = np.clip(own - wide // 2, 0, n - wide)
            inside = (near >= first) & (near < first + wide)
            low, high = np.where(inside, low, wide + 1), np.where(inside, wide, high)
        need[:, c] = low
    best = (1, blocks[0])
    for curves in range(1, len(blocks) + 1):
        least = np.sort(need[:, :curves].min(1))
        wide = int(least[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)]) if len(least) else 1
        if curves * wide / max(blocks[:curves]) < best[0] * best[1] / blocks[0]:
            best = (curves, wide)
    return best


def nearest(vectors: DataFrame, queries, k: int = 20, window: float | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that queries (a condition on vec_id) picks, the k nearest others found by inner product, ties to the
    smaller vec_id.

    Every valid vector has a key on each curve, of its projection, shifted by another amount each time. Keys are range-partitioned, equal keys by
    vec_id, so that ranges have like numbers of rows. A query is sent to the ranges of a window around its own on each curve, meets all rows there, and
    its k best of each range are merged over ranges and curves.

    The window is fitted: SAMPLE queries are answered exactly, in one pass, and the narrowest window that finds the share recall of their neighbours is
    taken, on as many curves as make the least work. Where nearness on curves says much, that is a range or two, whatever the number of rows; vectors
    spread evenly over all directions need a window near the whole of one curve, which is a search of all rows but a few, never more. window (a
    share of each curve) sets it by hand; 1.0 is an exact search.

    Of equal vectors only the k + 1 of least vec_id can be among anyone's k nearest, so only these are searched. Vectors whose copies make up more than
    a sixteenth of all rows are met by every query. Where a window would hold no more than k others, everything is searched. Vectors that are null, zero,
    of another length than most, or hold null or non-finite components take no part, nor do rows without vec_id. Rows that repeat a vec_id and vector
    count once. An empty table, and one without queries, gives no rows; columns other than vec_id and embedding are not read."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "f4" if element == "float" else "f8"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    most = vectors.filter("embedding IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    keys = [f"k{c}" for c in range(CURVES)]
    schema = "vec_id long, v binary, " + ", ".join(f"{c} long" for c in keys)
    rows = written(vectors.mapInArrow(_keyed(most["d"] if most else 0, kind), schema), "ann-keys")
    copies = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    searched = written(rows.withColumn("at", copies).filter(F.col("at") <= k + 1).drop("at").dropDuplicates(["v", "vec_id"]), "ann-searched")
    asked = rows.filter(queries(F.col("vec_id"))).dropDuplicates(["v", "vec_id"])
    both = written(searched.withColumn("ask", F.lit(False)).unionByName(asked.withColumn("ask", F.lit(True))), "ann-both")
    n, n_asked, n_rows = searched.count(), both.filter("ask").count(), rows.count()
    if not n or not n_asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ranges = -(-n // RANGE_ROWS)
    curves, blocks = [], []
    for c in keys:
        placed = both.repartitionByRange(ranges, c, "vec_id").select("vec_id", "v", "ask", F.spark_partition_id().alias("block"))
        curves.append(written(placed, "ann-curve"))
        blocks.append(curves[-1].agg(F.max("block")).first()[0] + 1)

    if window is None:
        draw = both.filter("ask").orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "v").limit(SAMPLE).collect()
        some, y = np.array([r["vec_id"] for r in draw]), np.stack([np.frombuffer(r["v"], kind) for r in draw]).astype(np.float64)

        def exact(batches):
            for batch in batches:
                if batch.num_rows:
                    yield _found(k_best(batch["vec_id"].to_numpy(), vectors_of(batch["v"], kind), some, y, k))

        truth = written(ranked(searched.select("vec_id", "v").mapInArrow(exact, FOUND), k), "ann-truth")  # SAMPLE * k rows
        for c, at in enumerate(curves):
            near = at.filter(~F.col("ask")).groupBy("vec_id").agg(F.min("block").alias(f"near{c}"))
            own = at.filter("ask").groupBy("vec_id").agg(F.min("block").alias(f"own{c}"))
            truth = truth.join(near.join(F.broadcast(truth.select("vec_id").distinct()), "vec_id"), "vec_id")
            truth = truth.join(own.join(F.broadcast(truth.select("query_id").distinct()).withColumnRenamed("query_id", "vec_id"), "vec_id").withColumnRenamed("vec_id", "query_id"), "query_id")
        pairs = [[x for c in range(CURVES) for x in (r[f"own{c}"], r[f"near{c}"])] for r in truth.collect()]
        used, wide = least_window(pairs, blocks, recall)
    else:
        used, wide = CURVES if window < 1 else 1, max(1, round(window * blocks[0]))
    if n * wide <= (k + 1) * blocks[0]:
        used, wide = 1, blocks[0]

    slices = max(1, -(-n_asked * wide // (blocks[0] * MOST_QUERIES)))
    step = max(1, min(wide // 8, MOST_ROWS // RANGE_ROWS))
    # OFTEN vectors at most are that frequent; their few searched rows go to each range of the first curve.
    often = rows.groupBy("v").count().filter(F.col("count") > n_rows // OFTEN).select("v")
    often = searched.join(F.broadcast(often), "v").select("vec_id", "v", F.lit(0).alias("curve"), F.explode(F.sequence(F.lit(0), F.lit((blocks[0] - 1) // step))).alias("block"))
    there, asks = often, None
    for c in range(used):
        at = curves[c].withColumn("curve", F.lit(c))
        rest = at.filter(~F.col("ask")).select("vec_id", "v", "curve", F.floor(F.col("block") / step).cast("int").alias("block"))
        there = there.unionByName(rest if c else rest.join(F.broadcast(often.select("vec_id", "v").distinct()), ["vec_id", "v"], "left_anti"))
        first = first_block(F.col("block"), min(wide, blocks[c]), blocks[c])
        reach = F.sequence(F.floor(first / step).cast("int"), F.floor((first + min(wide, blocks[c]) - 1) / step).cast("int"))
        ask = at.filter("ask").select("vec_id", "v", "curve", F.explode(reach).alias("block"))
        asks = ask if asks is None else asks.unionByName(ask)
    there = there.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    asks = asks.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_found([[], [], []])])
        return pa.Table.from_batches([_found(k_best(left["vec_id"].to_numpy(), vectors_of(left["v"], kind), right["vec_id"].to_numpy(), vectors_of(right["v"], kind), k))])

    place = ["curve", "block", "slice"]
    found = there.groupBy(*place).cogroup(asks.groupBy(*place)).applyInArrow(met, FOUND)
    return ranked(found.distinct(), k)


def op3_neighbours(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
