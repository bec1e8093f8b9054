"""Mixing sources to target weights by entropy balancing, rounded to whole copies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, written

#: No document is taken more often than this.
CAP = 3
#: Rounding order inside a source: size bins, then this many residues of the id, then size and id.
SALTS = 1024
#: Offset of the systematic rounding; not a simple fraction, so that equal rates do not sit on a rounding edge.
OFFSET = 0.371
#: So many documents of each source settle what rounding leaves over.
LAST = 64
#: Up to so many sources (one short row each) are broadcast to the documents.
BROADCAST_SOURCES = 100_000
#: Newton iterations at most, and the last step's length at which they end.
NEWTON_STEPS, TOLERANCE = 60, 1e-13


def token_counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns carry, size: the number of [^\\x20\\x09-\\x0D]+ words, 0 for null or blank text."""
    size = F.coalesce(F.regexp_count("text", F.lit(SPACED_WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *carry, size.alias("size"))


def cyclic_targets(totals: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: int = CAP) -> DataFrame:
    """totals (source, source_size) with target: shares of the whole by weights repeated over the sources in code-point order (null last),
    held at cap times a source's size, the excess shared again by weight. With sources sorted by cap*size/weight the capped ones form a
    prefix, so one running sum settles every round of resharing. One row a source: the windows below see as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    t = totals.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = t.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    # The common level of the rest is that of the first source that is not capped; levels only rise up to it.
    common = F.min(F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(whole)["level"]
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(common * F.col("weight")).alias("target"))


def balanced_rates(cells: DataFrame, targets: DataFrame, steps: int = NEWTON_STEPS, cap: int = CAP) -> DataFrame:
    """targets (source, source_size, target) with rate. Of all rates that meet the token constraints, one a source, those nearest to 1 in relative
    entropy (weighted by tokens) tilt each document by exp(lambda) of its source. The lambdas minimise the convex dual, the sum over documents of
    size * exp(lambda) less the sum over sources of lambda * target. Each Newton iteration is one aggregate over the cells of documents (source,
    tokens) that gives every source its gradient and its curvature; a document is in one constraint, so the Hessian has no other entries. The
    iterations end when each constraint is met up to TOLERANCE of its target. A first step from 0 that overshoots is held to 1, and so is each later
    one. (With one constraint a source the minimum is known, ln(target / size): that is what tests hold the iterations against.)"""
    tilts = written(targets.withColumn("tilt", F.lit(0.0)), "mix-tilts")
    side = broadcast_side(tilts)
    for _ in range(steps):
        at = cells.alias("c").join(side(tilts.select("source", "tilt")).alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
        # The tilt has one value in a source, so whole tokens are summed before exp(tilt) is taken: the sum does not depend on its order.
        now = at.groupBy("c.source", "tilt").agg(F.sum("tokens").alias("tokens")).select("source", (F.col("tokens") * F.exp("tilt")).alias("curvature"))
        both = tilts.alias("t").join(side(now).alias("n"), F.col("t.source").eqNullSafe(F.col("n.source")))
        newton = F.when((F.col("curvature") > 0) & (F.col("target") > 0), (F.col("target") - F.col("curvature")) / F.col("curvature")).otherwise(0.0)
        step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), newton))
        moved = written(both.select("t.source", "source_size", "target", (F.col("tilt") + step).alias("tilt"), F.abs(step).alias("moved")), "mix-tilts")
        tilts = moved.drop("moved")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) <= TOLERANCE:
            break
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.least(F.exp("tilt"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return tilts.select("source", "source_size", "target", rate.alias("rate"))


def broadcast_side(rows: DataFrame):
    """Rows of one short line a source as a broadcast side, if there are no more sources than BROADCAST_SOURCES; else as they are."""
    return F.broadcast if rows.count() <= BROADCAST_SOURCES else lambda side: side


def size_bin(size: Column) -> Column:
    """A monotone bin of sizes that differ by an eighth at most: the bit length and the top four bits."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken, and the columns carry, one row for each input row.

    copies are whole. Of each source, the LAST documents first by id residue are set aside. The others are ordered by size bin, id residue, size
    and id, and the k-th takes floor(rate*k + o) - floor(rate*(k-1) + o), so neighbours of like size stand in for each other. The global k of a
    row is the row number in its (source, bin, residue) cell plus the rows in earlier cells: no task sorts a source, however large, and the
    window over cells sees a bounded number of them. The documents set aside then take, from the largest to the smallest, whichever copies
    bring the source nearest to its target. Reruns agree, for nothing is drawn at random.

    Nulls: a null text has size 0; a null source is a source of its own, sorted last; rows with a null id are never set aside. Equal rows are
    interchangeable. Without documents the result is empty. Columns outside carry are not read."""
    rows = token_counts(docs, carry).withColumn("salt", F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALTS)), F.lit(-1)).cast("int"))
    rows = written(rows.withColumn("bin", size_bin(F.col("size"))), "mix-sizes")
    tokens = written(rows.groupBy("source", "bin").agg(F.sum("size").alias("tokens")), "mix-tokens")
    totals = tokens.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    rates = balanced_rates(tokens, cyclic_targets(totals, weights))
    # First within (source, a sixteenth of the residues), then within the source: each time cut at LAST distinct ids before rows move, so a hot
    # source is spread and its last task sees 16 * LAST ids at most.
    key = F.struct("salt", "doc_id")
    ids = rows.filter(F.col("doc_id").isNotNull() & (F.col("size") > 0)).select("source", (F.col("salt") % 16).alias("part"), key.alias("key"))
    edge = ids.withColumn("n", F.dense_rank().over(Window.partitionBy("source", "part").orderBy("key"))).filter(F.col("n") <= LAST)
    edge = edge.withColumn("n", F.dense_rank().over(Window.partitionBy("source").orderBy("key"))).filter(F.col("n") <= LAST)
    edge = edge.groupBy("source").agg(F.max("key").alias("edge"))
    rates = rates.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left").select("r.*", "edge")
    rates = written(rates, "mix-rates-of")
    rates = broadcast_side(rates)(rates)  # a hot source's rows then stay where they are; else AQE splits the skewed join
    rows = rows.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
    rows = rows.select("d.*", "source_size", "target", "rate", F.coalesce((key <= F.col("edge")) & F.col("doc_id").isNotNull() & (F.col("size") > 0), F.lit(False)).alias("aside"))
    rows = written(rows, "mix-rates")

    cell = ["source", "bin", "salt"]
    most = rows.filter(~F.col("aside"))
    # Rows ahead of a cell: those of smaller bins, and of the same bin those of smaller residues. No window sees more than the residues of a bin or
    # the bins of a source.
    before = lambda by, order: F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = written(most.groupBy(*cell).count(), "mix-cells")
    bins = cells.groupBy("source", "bin").agg(F.sum("count").alias("count")).withColumn("below", before(["source"], "bin")).drop("count")
    cells = cells.withColumn("ahead", before(["source", "bin"], "salt")).alias("c").join(bins.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.bin") == F.col("b.bin")))
    cells = cells.select("c.source", "c.bin", "c.salt", (F.col("ahead") + F.col("below")).alias("ahead"))
    most = most.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy(F.col("size"), F.col("doc_id"))))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cell]
    at = F.col("k") + F.col("ahead")
    copies = (F.floor(F.col("rate") * at + OFFSET) - F.floor(F.col("rate") * (at - 1) + OFFSET)).cast("long")
    most = written(most.alias("d").join(cells.alias("c"), same[0] & same[1] & same[2]).select("d.source", "d.doc_id", "d.size", "source_size", "target", "rate", copies.alias("copies"), *(f"d.{c}" for c in carry)), "mix-most")

    taken = most.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("so_far"))
    last = rows.filter("aside").groupBy("source", "source_size", "target", "rate").agg(
        F.sort_array(F.collect_list(F.struct("size", "salt", "doc_id", *carry)), asc=False).alias("each"), F.sum("size").alias("n"))
    last = last.alias("l").join(taken.alias("t"), F.col("l.source").eqNullSafe(F.col("t.source")), "left").select("l.*", F.coalesce("so_far", F.lit(0)).alias("so_far"))
    start = F.struct((F.col("target") - F.col("so_far") - F.col("rate") * F.col("n")).alias("carry"), F.array().cast("array<bigint>").alias("copies"))

    def greedy(state: Column, x: Column) -> Column:
        due = state["carry"] + F.col("rate") * x["size"]
        c = F.least(F.lit(float(CAP)), F.greatest(F.lit(0.0), F.floor(due / x["size"] + 0.5).cast("double")))
        return F.struct((due - c * x["size"]).alias("carry"), F.concat(state["copies"], F.array(c.cast("long"))).alias("copies"))

    last = last.withColumn("copies", F.aggregate("each", start, greedy)["copies"])
    last = last.select("source_size", "target", "rate", F.explode(F.arrays_zip("each", "copies")).alias("x"))
    last = last.select(F.col("x.each.doc_id").alias("doc_id"), F.col("x.each.size").alias("size"), "source_size", "target", "rate", F.col("x.copies").alias("copies"),
                       *(F.col(f"x.each.{c}").alias(c) for c in carry))
    out = most.drop("source").unionByName(last)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op8_mix(spark, sf_dir):
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT + 1] AS weight,
  (source_size * 3)::DOUBLE AS most FROM t),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER before, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, most <= level * weight AS capped FROM l),
g AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE
  (SELECT level FROM c WHERE NOT capped ORDER BY most / weight, level LIMIT 1) * weight END AS target FROM c),
d2 AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0) ELSE 0.0 END AS rate,
  length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS bin, coalesce(((doc_id % 1024) + 1024) % 1024, -1) AS salt,
  CASE WHEN doc_id IS NOT NULL AND size > 0 THEN dense_rank() OVER (PARTITION BY d.source, doc_id IS NOT NULL AND size > 0 ORDER BY coalesce(((doc_id % 1024) + 1024) % 1024, -1), doc_id) ELSE 65 END AS n
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY bin, salt, size, doc_id NULLS FIRST) AS k FROM d2 WHERE n > 64),
most AS (SELECT source, doc_id, size, source_size, target, (floor(rate * k + 0.371) - floor(rate * (k - 1) + 0.371))::BIGINT * size AS taken FROM k),
last AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, salt DESC, doc_id DESC) AS r, sum(size) OVER (PARTITION BY source) AS n_last FROM d2 WHERE n <= 64),
first AS (SELECT l.source, 0 AS r, l.target - coalesce((SELECT sum(taken) FROM most m WHERE m.source IS NOT DISTINCT FROM l.source), 0)::BIGINT - l.rate * l.n_last::BIGINT AS carry, 0.0::DOUBLE AS c
  FROM last l WHERE l.r = 1),
steps AS (SELECT source, r, carry, c FROM first UNION ALL
  SELECT l.source, l.r::INT, s.carry + l.rate * l.size - least(3.0, greatest(0.0, floor((s.carry + l.rate * l.size) / l.size + 0.5))) * l.size,
  least(3.0, greatest(0.0, floor((s.carry + l.rate * l.size) / l.size + 0.5)))
  FROM steps s JOIN last l ON l.source IS NOT DISTINCT FROM s.source AND l.r = s.r + 1)
SELECT doc_id, size, source_size, target, taken FROM most
UNION ALL SELECT l.doc_id, l.size, l.source_size, l.target, s.c::BIGINT * l.size FROM last l JOIN steps s ON l.source IS NOT DISTINCT FROM s.source AND l.r = s.r
"""
