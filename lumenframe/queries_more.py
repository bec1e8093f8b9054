"""More registered queries: colour spaces, gain-map parameters, files and their parts. Each SQL is written apart from the Column code."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from .functions import color, tone, xmp
from .operators import gainmap, relational, stats
from .plans import views
from .plans.stored import shared_folder, stored
from .queries import _GAIN, _INV, EMB, EV, ORACLE_SQL, QUERIES, RGB, _decode_sql, dots, lin, query, rounded, san, srgb, three, tone_sql, u8
from .sources import datasource, hdr, images

POINTS = [(space, i, v) for space, p in color.CHROMATICITIES.items() for i, v in enumerate(v for xy in p for v in xy)]
KNOWN = "known(space, i, v) AS (VALUES " + ", ".join(f"('{s}', {i}, {v}::DOUBLE)" for s, i, v in POINTS) + ")"
ORDER = "CASE space " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(color.CHROMATICITIES)) + " END"

# Matrices by Cramer's rule and cofactors, from the chromaticities alone.
_XYZ = "xyz AS (SELECT space, i // 2 AS c, max(v) FILTER (i % 2 = 0) / max(v) FILTER (i % 2 = 1) AS x, 1::DOUBLE AS y, (1 - sum(v)) / max(v) FILTER (i % 2 = 1) AS z FROM known GROUP BY space, i // 2)"
_ROW = "w AS (SELECT space, " + ", ".join(f"max({a}) FILTER (c = {k}) AS {n}{a}" for k, n in enumerate("rgbw") for a in "xz") + " FROM xyz GROUP BY space)"
_SCALE = ("s AS (SELECT *, rx*(bz-gz) - gx*(bz-rz) + bx*(gz-rz) AS det, wx*(bz-gz) - gx*(bz-wz) + bx*(gz-wz) AS sr, rx*(bz-wz) - wx*(bz-rz) + bx*(wz-rz) AS sg, "
          "rx*(wz-gz) - gx*(wz-rz) + wx*(gz-rz) AS sb FROM w)")  # fmt: skip
_A = "a AS (SELECT space, i, j, CASE i WHEN 0 THEN x[j+1] WHEN 1 THEN 1 ELSE z[j+1] END * k[j+1] / det AS v FROM (SELECT space, det, [rx, gx, bx] AS x, [rz, gz, bz] AS z, [sr, sg, sb] AS k FROM s), (SELECT unnest(range(3))::INT AS i), (SELECT unnest(range(3))::INT AS j))"
_ADJ = ("adj AS (SELECT p.space, n.i, n.j, p.v*q.v - t.v*u.v AS v FROM (SELECT unnest(range(9))::INT // 3 AS i, unnest(range(9))::INT % 3 AS j) n JOIN a p ON p.i = (n.j+1)%3 AND p.j = (n.i+1)%3 "
        "JOIN a q ON q.space = p.space AND q.i = (n.j+2)%3 AND q.j = (n.i+2)%3 JOIN a t ON t.space = p.space AND t.i = (n.j+1)%3 AND t.j = (n.i+2)%3 "
        "JOIN a u ON u.space = p.space AND u.i = (n.j+2)%3 AND u.j = (n.i+1)%3)")  # fmt: skip
_DET = "det AS (SELECT a.space, sum(a.v*adj.v) AS d FROM a JOIN adj ON adj.space = a.space AND adj.i = a.j AND adj.j = a.i WHERE a.i = 0 GROUP BY a.space)"


@query(f"WITH {KNOWN}, {_XYZ}, {_ROW}, {_SCALE}, {_A}, {_ADJ}, {_DET} SELECT b.space AS source, t.space AS target, t.i, b.j, round(sum(t.v / d * b.v), 6) + 0.0 AS value "
       "FROM adj t JOIN det USING (space) JOIN a b ON b.i = t.j AND b.space <> t.space GROUP BY 1, 2, 3, 4")  # fmt: skip
def space_matrices(spark, d):
    rows = [(a, b, i, j, float(v)) for a in color.CHROMATICITIES for b in color.CHROMATICITIES if a != b for (i, j), v in np.ndenumerate(color.matrix(a, b))]
    return spark.createDataFrame(rows, "source string, target string, i int, j int, value double").withColumn("value", F.round("value", 6) + 0.0)


SHIFTS = (-0.011, -0.005, 0.0, 0.004, 0.011)


def _shifted(spark, d):
    """One candidate a customer: the chromaticities of a known space with one of the eight numbers moved: k, space, c, shift and xy0 to xy7."""
    df = views.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    pick = lambda values, i: F.element_at(F.array(*values), (i + 1).cast("int"))
    known = [F.array(*(F.lit(float(v)) for t, _, v in POINTS if t == s)) for s in color.CHROMATICITIES]
    k = F.col("k")
    df = df.select("k", pick(map(F.lit, color.CHROMATICITIES), k % 3).alias("space"), pick(known, k % 3).alias("v"), (F.floor(k / 3) % 8).cast("int").alias("c"), pick(map(F.lit, SHIFTS), F.floor(k / 24) % 5).alias("shift"))
    return df.select("k", "space", "c", "shift", *((F.get("v", F.lit(i)) + F.when(F.col("c") == i, F.col("shift")).otherwise(0.0)).alias(f"xy{i}") for i in range(8)))


XY = [f"xy{i}" for i in range(8)]
_CAND = f"cand AS (SELECT c_custkey AS k, [{', '.join(f"'{s}'" for s in color.CHROMATICITIES)}][c_custkey % 3 + 1] AS space, (c_custkey // 3 % 8)::INT AS c, [{', '.join(f'{s}::DOUBLE' for s in SHIFTS)}][c_custkey // 24 % 5 + 1] AS shift FROM customer)"
_NEAR = ("near AS (SELECT cand.k, t.space AS found FROM cand JOIN known o ON o.space = cand.space JOIN known t ON t.i = o.i GROUP BY 1, 2 "
         "HAVING bool_and(abs(o.v + CASE WHEN o.i = c THEN shift ELSE 0 END - t.v) <= 0.01))")  # fmt: skip


@query(f"WITH {KNOWN}, {_CAND}, {_NEAR} SELECT k, space, c, shift, (SELECT arg_min(found, {ORDER.replace('space', 'found', 1)}) FROM near WHERE near.k = cand.k) AS found FROM cand")
def classify_color_space(spark, d):
    return _shifted(spark, d).select("k", "space", "c", "shift", color.space_of(*(F.col(x) for x in XY)).alias("found"))


@query(f"WITH {KNOWN}, {_CAND}, {_NEAR}, f AS (SELECT cand.*, near.found IS NOT NULL AS ok FROM cand LEFT JOIN near ON near.k = cand.k AND near.found = 'rec709') "
       "SELECT k, space, c, shift, ok, CASE WHEN NOT ok THEN 'not Rec.709' END AS problem, CASE WHEN NOT ok THEN 'not Rec.709' END AS strict_problem FROM f "
       "UNION ALL SELECT -1, 'absent', 0, 0.0, false, NULL, 'no chromaticities'")  # fmt: skip
def is_rec709(spark, d):
    df = _shifted(spark, d)
    df = df.unionByName(spark.createDataFrame([(-1, "absent", 0, 0.0)], "k long, space string, c int, shift double"), allowMissingColumns=True)
    xy = [F.col(x) for x in XY]
    return df.select("k", "space", "c", "shift", F.coalesce(color.is_rec709(*xy), F.lit(False)).alias("ok"), color.tone_mapping_problem(*xy).alias("problem"), color.tone_mapping_problem(*xy, strict=True).alias("strict_problem"))


@query("SELECT n_nationkey AS k, linear, display, back, canvas FROM nation JOIN (VALUES (0, 'linear-rec709', 'display-srgb', 'linear-rec709', 'srgb'), (1, 'linear-p3', 'display-p3', 'linear-p3', 'display-p3'), "
       "(2, 'linear-rec2020', 'display-rec2020', 'linear-rec2020', NULL), (3, 'other', NULL, NULL, NULL)) t(i, linear, display, back, canvas) ON i = n_nationkey % 4")  # fmt: skip
def space_lookup(spark, d):
    names = F.array(*(F.lit(s) for s in (*color.LINEAR.values(), "other")))
    df = views.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.element_at(names, (F.col("n_nationkey") % 4 + 1).cast("int")).alias("linear"))
    df = df.withColumn("display", color.looked_up(F.col("linear"), color.LINEAR_TO_DISPLAY))
    return df.select("k", "linear", "display", color.looked_up(F.col("display"), color.DISPLAY_TO_LINEAR).alias("back"), color.looked_up(F.col("display"), color.DISPLAY_TO_CANVAS).alias("canvas"))


_XYY = "g AS (SELECT k, i, j, l, i/10.0::DOUBLE AS cx, j/10.0::DOUBLE AS cy FROM (SELECT p_partkey AS k, (p_partkey % 9)::INT AS i, (p_size % 9)::INT AS j, [0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][p_partkey % 3 + 1] AS l FROM part))"
_XYY += ", z AS (SELECT k, i, j, l, CASE WHEN cy < 1e-6 THEN 0 ELSE cx/cy*l END AS r, CASE WHEN cy < 1e-6 THEN 0 ELSE l END AS g, CASE WHEN cy < 1e-6 THEN 0 ELSE (1-cx-cy)/cy*l END AS b FROM g)"


@query(f"WITH {_XYY} SELECT k, i, j, l, " + ", ".join(f"round({e}, 4) + 0.0 AS {c}" for e, c in zip(dots(_INV), RGB, strict=True)) + " FROM z")
def xyy_to_rgb(spark, d):
    k = F.col("p_partkey")
    df = views.table(spark, d, "part").select(k.alias("k"), (k % 9).cast("int").alias("i"), (F.col("p_size") % 9).cast("int").alias("j"), F.element_at(F.array(*map(F.lit, (0.5, 1.0, 2.0))), (k % 3 + 1).cast("int")).alias("l"))
    rgb = color.xyy_to_rgb(F.col("i") / 10, F.col("j") / 10, F.col("l"), "rec2020")
    return df.select("k", "i", "j", "l", *((F.round(v, 4) + 0.0).alias(c) for v, c in zip(rgb, RGB, strict=True)))


_EXPOSED = "ex AS (SELECT *, CASE WHEN image_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE*(1 + image_id % 4) END AS e FROM emb)"
_LDR = tone_sql("reinhard", "e", "ex", "image_id, p, e")


@query(f"WITH {EMB}, {_EXPOSED} SELECT image_id, p, r, g, b FROM ({_LDR})")
def hdr_to_ldr(spark, d):
    """Each image with its file's exposure; every fifth file has none."""
    px = views.embedding_pixels(spark, d)
    own = F.when(F.col("image_id") % 5 != 0, 0.5 * (1 + F.col("image_id") % 4))
    return tone.hdr_to_ldr(px, own).select("image_id", "p", *RGB)


# Gain maps with parameters of their own, over the embedding images.
OPTIONS = gainmap.Options(offset_sdr=(1 / 32, 1 / 64, 0.05), offset_hdr=(1 / 64, 0.02, 1 / 32), gamma=(2.0, 1.0, 0.5), min_boost=0.5)


def gain_sql(o: gainmap.Options, exposure: float, quantised: bool, cut: str = "") -> str:
    """gt, gb, ge and gm for the options: pixels, boosts, pictures and maps."""
    e = f"{float(exposure)!r}::DOUBLE"
    gt = f"gt AS (SELECT a.*, m.r AS m_r, m.g AS m_g, m.b AS m_b FROM (SELECT image_id, p, {three([san(c) for c in RGB], ('x_r', 'x_g', 'x_b'))}, {three([san(c) + '*' + e for c in RGB], ('h_r', 'h_g', 'h_b'))} FROM emb {cut}) a JOIN ({tone_sql('aces', exposure, 'emb', 'image_id, p', None)}) m USING (image_id, p))"
    gain = lambda c, k, low: f"(CASE WHEN {low} + {o.offset_sdr[k]!r}::DOUBLE > 0 THEN (h_{c} + {o.offset_hdr[k]!r}::DOUBLE)/({low} + {o.offset_sdr[k]!r}::DOUBLE) ELSE 1 END)"
    gb = f"gb AS (SELECT image_id, greatest(max(greatest({', '.join(gain(c, k, f'm_{c}') for k, c in enumerate(RGB))})), max(greatest(x_r, x_g, x_b)), 1.0001::DOUBLE) AS max_boost FROM gt GROUP BY image_id)"
    sdr = ", ".join(f"{u8(srgb(f'greatest(m_{c},0)')) if quantised else srgb(f'greatest(m_{c},0)')} AS sdr_{c}" for c in RGB)
    low = f"log2({o.min_boost!r}::DOUBLE)"
    ge = f"ge AS (SELECT *, {low} AS log_min, CASE WHEN log2(max_boost) > {low} THEN log2(max_boost) ELSE {low} + 1e-6 END AS log_max, {sdr} FROM gt JOIN gb USING (image_id))"
    below = lambda c: lin(f"(sdr_{c}/255.0::DOUBLE)") if quantised else f"m_{c}"
    part = lambda c, k: f"pow(least(1::DOUBLE, greatest(0::DOUBLE, (log2({gain(c, k, below(c))}) - log_min)/(log_max - log_min))), {o.gamma[k]!r}::DOUBLE)"
    gm = "gm AS (SELECT *, " + ", ".join(f"{u8(part(c, k)) if quantised else part(c, k)} AS gm_{c}" for k, c in enumerate(RGB)) + " FROM ge)"
    return f"{EMB}, {gt}, {gb}, {ge}, {gm}"


def gain_decode_sql(o: gainmap.Options, w: str, quantised: bool, digits: int) -> str:
    by = "255.0::DOUBLE" if quantised else "1.0::DOUBLE"
    out = []
    for k, c in enumerate(RGB):
        part = f"pow(gm_{c}/{by}, {1 / o.gamma[k]!r}::DOUBLE)"
        out.append(f"round(least(65504::DOUBLE, greatest(0::DOUBLE, ({lin(f'(sdr_{c}/{by})')} + {o.offset_sdr[k]!r}::DOUBLE)*pow(2::DOUBLE, {w}*(log_min*(1-{part}) + log_max*{part})) - {o.offset_hdr[k]!r}::DOUBLE)), {digits}) AS {c}")
    return ", ".join(out)


_WEIGHT = "(CASE WHEN greatest(0, log_max) - greatest(0, log_min) <= 0 THEN 1 ELSE least(1::DOUBLE, greatest(0::DOUBLE, (log2(1.5::DOUBLE) - greatest(0, log_min))/(greatest(0, log_max) - greatest(0, log_min)))) END)"


def _gain(spark, d, options, exposure=8.0, quantised=True):
    toned = gainmap.with_tone(views.embedding_pixels(spark, d), exposure=exposure)
    return gainmap.encoded(toned, gainmap.boosts(toned, options), quantised, options)


@query(f"WITH {gain_sql(OPTIONS, 8, True)} SELECT image_id, p, " + ", ".join(f"{k}_{c}" for k in ("sdr", "gm") for c in RGB) + " FROM gm")
def gainmap_encode_options(spark, d):
    return _gain(spark, d, OPTIONS).select("image_id", "p", *(f"{k}_{c}" for k in ("sdr", "gm") for c in RGB))


@query(f"WITH {gain_sql(OPTIONS, 8, True)} SELECT image_id, p, {gain_decode_sql(OPTIONS, _WEIGHT, True, 4)} FROM gm")
def gainmap_decode_options(spark, d):
    g = _gain(spark, d, OPTIONS)
    return rounded(gainmap.decoded(g, gainmap.weight_for(1.5, F.col("log_min"), F.col("log_max")), options=OPTIONS), "image_id", "p", digits=4)


@query(f"WITH {gain_sql(gainmap.DEFAULT, 8, False)} SELECT image_id, p, {gain_decode_sql(gainmap.DEFAULT, '1', False, 4)} FROM gm")
def gainmap_float_roundtrip(spark, d):
    return rounded(gainmap.decoded(_gain(spark, d, gainmap.DEFAULT, quantised=False), quantised=False), "image_id", "p", digits=4)


@query(f"WITH {gain_sql(OPTIONS, 8, True)} SELECT DISTINCT image_id, round(greatest(0::DOUBLE, log_min), 5) AS capacity_min, round(greatest(0::DOUBLE, log_max), 5) AS capacity_max FROM ge")
def gainmap_capacity(spark, d):
    toned = gainmap.with_tone(views.embedding_pixels(spark, d), exposure=8.0)
    low, high = gainmap.capacity(*gainmap.log_range(F.col("max_boost"), OPTIONS))
    return gainmap.boosts(toned, OPTIONS).select("image_id", F.round(low, 5).alias("capacity_min"), F.round(high, 5).alias("capacity_max"))


@query(f"WITH {_GAIN} SELECT image_id, p, {_decode_sql('1')} FROM (SELECT * FROM gm WHERE NOT (image_id % 5 = 0 AND p = 3))")
def sdr_gainmap_join(spark, d):
    """Picture, map and scalars as three tables; the map lacks a pixel of every fifth image."""
    g = _gain(spark, d, gainmap.DEFAULT)
    sdr, gm = (g.select("image_id", "p", *(f"{k}_{c}" for c in RGB)) for k in ("sdr", "gm"))
    scalars = g.groupBy("image_id").agg(F.max("log_min").alias("log_min"), F.max("log_max").alias("log_max"))
    return rounded(gainmap.decoded(gainmap.joined(sdr, gm.filter("NOT (image_id % 5 = 0 AND p = 3)"), scalars)), "image_id", "p", digits=4)


_SMALL = "gm AS (SELECT a.* EXCLUDE (gm_r, gm_g, gm_b), b.gm_r, b.gm_g, b.gm_b FROM full_ a JOIN full_ b ON b.image_id = a.image_id AND b.p = (a.p // 4 // 2 * 2) * 4 + a.p % 4 // 2 * 2)"


@query(f"WITH {_GAIN.replace('gm AS (', 'full_ AS (', 1)}, {_SMALL} SELECT image_id, p, {_decode_sql('1')} FROM gm")
def small_gainmap_join(spark, d):
    """Pictures of 4 x 4 with maps of 2 x 2: every second pixel of every second line."""
    g = stored(_gain(spark, d, gainmap.DEFAULT), "gain")
    x, y = F.col("p") % 4, F.floor(F.col("p") / 4)
    gm = g.filter((x % 2 == 0) & (y % 2 == 0)).select("image_id", (y + x / 2).cast("int").alias("p"), *(f"gm_{c}" for c in RGB))
    sizes = g.groupBy("image_id").agg(F.max("log_min").alias("log_min"), F.max("log_max").alias("log_max")).withColumns({"width": F.lit(4), "height": F.lit(4), "map_width": F.lit(2), "map_height": F.lit(2)})
    return rounded(gainmap.decoded(gainmap.joined_sizes(g.select("image_id", "p", *(f"sdr_{c}" for c in RGB)), gm, sizes)), "image_id", "p", digits=4)


_SIDES = "l AS (SELECT * FROM emb WHERE image_id % 11 <> 1), m AS (SELECT image_id, p, r, g, b, a FROM emb WHERE image_id % 11 <> 2 AND NOT (image_id % 7 = 0 AND p >= 12))"
_SIZES = "SELECT coalesce(l.image_id, m.image_id) AS image_id, bool_and(l.p IS NOT NULL AND m.p IS NOT NULL) AS same, max(abs(l.r::DOUBLE - m.r::DOUBLE)) AS worst FROM l FULL JOIN m ON l.image_id = m.image_id AND l.p = m.p GROUP BY 1"


@query(f"WITH {EMB}, {_SIDES} SELECT image_id, same AS \"match\", CASE WHEN same THEN 0 ELSE -1 END::BIGINT AS mismatched, CASE WHEN same THEN round(worst, 6) ELSE -1 END::DOUBLE AS max_abs, CASE WHEN same THEN 0.0::DOUBLE ELSE -1 END::DOUBLE AS rmse FROM ({_SIZES})")
def compare_sizes(spark, d):
    """Images that lack lines on one side, or the whole image, match nothing; figures that there are none of are -1."""
    px = views.embedding_pixels(spark, d).select("image_id", "p", *"rgba")
    left, right = px.filter("image_id % 11 <> 1"), px.filter("image_id % 11 <> 2 AND NOT (image_id % 7 = 0 AND p >= 12)")
    return stats.compared(left, right).select("image_id", "match", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("mismatched", "max_abs", "rmse")))


_WEDGE = "g AS (SELECT event_id AS p, event_id % 16 AS x, event_id // 16 AS y, (max(event_id) OVER () // 16)::DOUBLE AS top FROM events), c AS (SELECT p, x/15.0::DOUBLE*0.735::DOUBLE AS cx, (1-y/top)*0.834::DOUBLE AS cy FROM g), z AS (SELECT p, CASE WHEN cy < 1e-6 THEN 0 ELSE cx/cy*0.5 END AS r, CASE WHEN cy < 1e-6 THEN 0 ELSE 0.5 END::DOUBLE AS g, CASE WHEN cy < 1e-6 THEN 0 ELSE (1-cx-cy)/cy*0.5 END AS b FROM c)"


@query(f"WITH {_WEDGE} SELECT p, 0.0::DOUBLE AS r, round(greatest(0, {dots(_INV)[1]}), 4) AS g, 0.0::DOUBLE AS b FROM z")
def channel_isolate(spark, d):
    at, height = views.places(spark, d, 16)
    return views.cie_wedge(spark, 16, height, luminance=0.5, channel="g", at=at).select("p", *(F.round(F.col(c), 4).alias(c) for c in RGB))


# Codec steps.
_Q = "(v // 20000)::INT"


@query(f"WITH {EV} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS \"at\", {_Q}*10 AS r, 1 AS g, 2 AS b, 128+{_Q} AS e FROM ev")
def old_rle_expand(spark, d):
    """Events as pixels, written as old run-length pixels and read back."""
    px = views.event_pixels(spark, d).withColumn("v", F.floor(F.col("v") / 20000).cast("int"))
    runs = relational.runs(px, "v").select("image_id", "first_p", "n", (F.col("value") * 10).alias("r"), F.lit(1).alias("g"), F.lit(2).alias("b"), (F.col("value") + 128).alias("e"))
    return relational.old_runs_expanded(relational.old_runs(runs))


for _bits in (24, 32):

    @query(f"WITH {EV} SELECT image_id, p, (v*977) % {1 << _bits} AS v FROM ev")
    def _undelta(spark, d, modulus=1 << _bits):
        px = views.event_pixels(spark, d).withColumn("v", F.col("v") * 977)
        return relational.undeltas(relational.deltas(px, modulus).select("image_id", "p", "d"), modulus).select("image_id", "p", "v")

    QUERIES[f"pxr24_undelta_{_bits}"], ORACLE_SQL[f"pxr24_undelta_{_bits}"] = QUERIES.pop("_undelta"), ORACLE_SQL.pop("_undelta")

_LINES = ", ".join(f"('{k}', {v})" for k, v in relational.BLOCK_LINES.items())
_SHAPES = "(SELECT DISTINCT (1 + p_partkey % 5)::INT AS width, p_size AS height FROM part)"


@query(f"WITH s AS (SELECT codec, lines AS n, width, height, (height + lines - 1) // lines AS blocks FROM (VALUES {_LINES}) t(codec, lines), {_SHAPES}), "
       "b AS (SELECT *, unnest(range(blocks))::BIGINT AS block FROM s) SELECT codec, width, height, block, (block*n)::BIGINT AS first_y, least(n, height - block*n)::BIGINT AS lines, "
       "(400 + blocks*8 + (SELECT coalesce(sum(8 + b.width*least(b.n, b.height - k*b.n)*16), 0) FROM (SELECT unnest(range(b.block)) AS k)))::BIGINT AS \"at\" FROM b")  # fmt: skip
def exr_offsets_fixed(spark, d):
    shapes = views.table(spark, d, "part").select((1 + F.col("p_partkey") % 5).cast("int").alias("width"), F.col("p_size").alias("height")).distinct()
    shapes = shapes.withColumn("codec", F.explode(F.array(*map(F.lit, relational.BLOCK_LINES))))
    out = relational.offsets_fixed(shapes, 400)
    return out.select("codec", "width", "height", "block", "first_y", F.col("lines").cast("long").alias("lines"), "at")


@query("SELECT source, (300 + count(*)*8 + sum(n_chars + 8))::BIGINT AS total FROM documents GROUP BY source")
def exr_total_size(spark, d):
    """The bytes of a file are where its last block ends."""
    at = relational.offsets(views.table(spark, d, "documents").select("source", "doc_id", "n_chars"), "n_chars", 300, "source", "doc_id")
    return at.groupBy("source").agg(F.max(F.col("at") + 8 + F.col("n_chars")).alias("total"))


_NAMES = [("R", 2), ("G", 2), ("B", 4), ("A", 2), ("Z", 4), ("depth.V", 4), ("U", 4)]


@query("WITH n(k, name, bytes) AS (VALUES " + ", ".join(f"({k}, '{n}', {b})" for k, (n, b) in enumerate(_NAMES)) + "), c AS (SELECT i AS image_id, name, bytes FROM n, (SELECT DISTINCT 1 + p_partkey % 127 AS i FROM part) WHERE (i >> k) & 1 = 1) "
       "SELECT c.image_id, c.name, (SELECT count(*) FROM c o WHERE o.image_id = c.image_id AND o.name < c.name) AS place, (SELECT coalesce(sum(o.bytes), 0)::BIGINT FROM c o WHERE o.image_id = c.image_id AND o.name < c.name) AS \"at\" FROM c")  # fmt: skip
def channel_order(spark, d):
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(b).alias("bytes")) for k, (n, b) in enumerate(_NAMES)))
    masks = views.table(spark, d, "part").select((1 + F.col("p_partkey") % 127).alias("image_id")).distinct()
    df = masks.select("image_id", F.explode(rows).alias("x")).filter("shiftright(image_id, x.k) & 1 = 1").select("image_id", "x.name", "x.bytes")
    return relational.channel_order(df).select("image_id", "name", F.col("place").cast("long").alias("place"), "at")


# XMP text.
def _sql_escape(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_VERSIONS = ["1.0", "a<b & \"c\" 'd'>"]
_V = "(CASE WHEN i % 2 = 0 THEN '1.0' ELSE 'a<b & \"c\" ''d''>' END)"
_PRIMARY = f"'{xmp.HEAD}{xmp.CONTAINER} hdrgm:Version=\"' || {_sql_escape(_V)} || '\"><Container:Directory><rdf:Seq>{xmp.ITEM.format('Primary')}/></rdf:li>{xmp.ITEM.format('GainMap')} Item:Length=\"' || i*37 || '\"/></rdf:li></rdf:Seq></Container:Directory>{xmp.TAIL}'"


def _version():
    return F.when(F.col("i") % 2 == 0, _VERSIONS[0]).otherwise(_VERSIONS[1])


@query(f"SELECT i, {_PRIMARY} AS packet FROM (SELECT vec_id AS i FROM embeddings)")
def xmp_primary(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("i")).select("i", xmp.primary(F.col("i") * 37, _version()).alias("packet"))


_SECOND = [("GainMapMin", "i*0.25"), ("GainMapMax", "(i*0.25 + i*0.25 + i*0.25 + 3)/3"), ("Gamma", "1.0"), ("OffsetSDR", "0.015625"), ("OffsetHDR", "0.03125"), ("HDRCapacityMin", "0"), ("HDRCapacityMax", "1 + i*0.5")]
_SECONDARY = f"'{xmp.HEAD} hdrgm:Version=\"' || {_sql_escape(_V)} || '\"" + "".join(f" hdrgm:{n}=\"' || printf('%.6f', ({e})::DOUBLE) || '\"" for n, e in _SECOND) + f" hdrgm:BaseRenditionIsHDR=\"False\">{xmp.TAIL}'"


@query(f"SELECT i, {_SECONDARY} AS packet FROM (SELECT vec_id AS i FROM embeddings)")
def xmp_secondary(spark, d):
    i = F.col("i").cast("double")
    values = {"gain_map_min": i * 0.25, "gain_map_max": xmp.mean_of(F.array(i * 0.25 + 1, i * 0.25, i * 0.25 + 2)), "gamma": F.lit(1.0), "offset_sdr": F.lit(0.015625),
              "offset_hdr": F.lit(0.03125), "hdr_capacity_min": F.lit(0.0), "hdr_capacity_max": i * 0.5 + 1}
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("i")).select("i", xmp.secondary(values, _version()).alias("packet"))


_PARSED = "i % 4 <> 2"


@query(f"SELECT i, CASE WHEN {_PARSED} THEN CASE i % 4 WHEN 0 THEN i*0.25::DOUBLE ELSE 0.0::DOUBLE END END AS low_g, CASE WHEN {_PARSED} THEN CASE i % 4 WHEN 0 THEN i*0.25::DOUBLE + 1 WHEN 1 THEN i + 0.5::DOUBLE ELSE 1.0::DOUBLE END END AS high_r, "
       f"CASE WHEN {_PARSED} THEN CASE i % 4 WHEN 0 THEN i*0.25::DOUBLE + 1 WHEN 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END END AS high_b, CASE WHEN {_PARSED} THEN CASE i % 4 WHEN 0 THEN 0.03125::DOUBLE ELSE 0.015625::DOUBLE END END AS offset_hdr, "
       f"CASE WHEN {_PARSED} THEN CASE i % 4 WHEN 0 THEN 1 + i*0.5::DOUBLE ELSE 3.0::DOUBLE END END AS capacity FROM (SELECT vec_id AS i FROM embeddings)")  # fmt: skip
def xmp_parse(spark, d):
    """Both packets of a file one after the other, lists of three, no capacity, and only what must be there."""
    i = F.col("i").cast("double")
    values = {"gain_map_min": i * 0.25, "gain_map_max": i * 0.25 + 1, "gamma": F.lit(1.0), "offset_sdr": F.lit(0.015625), "offset_hdr": F.lit(0.03125), "hdr_capacity_min": F.lit(0.0), "hdr_capacity_max": i * 0.5 + 1}
    whole = F.concat(xmp.primary(F.col("i"), F.lit("1.0")), F.lit("\n\u0001 binary é <x:xmp"), xmp.secondary(values, F.lit("1.0")))
    lists = F.concat(F.lit('<x:xmpmeta><rdf:Description hdrgm:Version="1.0" hdrgm:HDRCapacityMax="3"><hdrgm:GainMapMax><rdf:Seq><rdf:li> '), (i + 0.5).cast("string"),
                     F.lit("</rdf:li><rdf:li>1.5</rdf:li>\n<rdf:li>2.5</rdf:li></rdf:Seq></hdrgm:GainMapMax></rdf:Description></x:xmpmeta>"))
    none = F.lit('<x:xmpmeta><rdf:Description hdrgm:Version="1.0" hdrgm:GainMapMax="4"/></x:xmpmeta>')
    least = F.concat(none, F.lit('<x:xmpmeta><rdf:Description hdrgm:Version="1.0" hdrgm:HDRCapacityMax="3"/></x:xmpmeta>'))
    df = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("i"))
    df = df.withColumn("m", xmp.parsed(F.when(F.col("i") % 4 == 0, whole).when(F.col("i") % 4 == 1, lists).when(F.col("i") % 4 == 2, none).otherwise(least)))
    return df.select("i", F.get("m.gain_map_min", F.lit(1)).alias("low_g"), F.get("m.gain_map_max", F.lit(0)).alias("high_r"), F.get("m.gain_map_max", F.lit(2)).alias("high_b"),
                     F.get("m.offset_hdr", F.lit(0)).alias("offset_hdr"), F.col("m.hdr_capacity_max").alias("capacity"))


# Files.
def _number(name):
    return F.regexp_extract(name, r"(-?\d+)\.", 1).cast("long")


@query(f"WITH {gain_sql(gainmap.DEFAULT, 1, True)} SELECT image_id, 'ultrahdr' AS format, round(log2(max_boost), 4) AS capacity, round(log2(max_boost), 4) AS high, 0.015625::DOUBLE AS offset_sdr FROM gb")
def jpeg_metadata(spark, d):
    """What the metadata of gain-map files says, read back from their bytes."""
    files = images.gain_map_files(views.embedding_pixels(spark, d), 4, 4)
    m = images.gain_map_info(files).select(_number("image_id").alias("image_id"), "metadata")
    first = lambda k: F.regexp_extract(F.col("metadata")[k], r"-?[0-9.]+(?:e-?\d+)?", 0).cast("double")
    return m.select("image_id", F.col("metadata")["format"].alias("format"), F.round(first("hdrCapacityMax"), 4).alias("capacity"), F.round(first("gainMapMax"), 4).alias("high"), first("offsetSdr").alias("offset_sdr"))


@query("SELECT vec_id AS image_id, 'sRGB' AS description, 9 AS tags, NULL::VARCHAR AS adgc, true AS whole FROM embeddings")
def icc_extract(spark, d):
    """The colour profile of gain-map files: its name, tags, the identifier of an adaptive gain curve (none here) and whether its length is as it says."""
    files = images.gain_map_files(views.embedding_pixels(spark, d), 4, 4)
    icc = images.icc_profiles(files)
    return icc.select(_number("path").alias("image_id"), "description", "tags", "adgc", (F.length("profile") == F.col("size")).alias("whole"))


@query(f"WITH {EMB} {tone_sql('reinhard', 4, 'emb', 'image_id, p')}")
def png_encode(spark, d):
    """Display values as PNG files, and read back."""
    shown = tone.displayed(views.embedding_pixels(spark, d), exposure=4.0).select("image_id", "p", *((F.col(c) / 255).alias(c) for c in RGB), F.lit(1.0).alias("a"))
    back = images.pixels(images.decoded(images.encoded(images.from_pixels(shown, 4, 4), "png")))
    return back.select(_number("image_id").alias("image_id"), "p", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in RGB))


@query("SELECT vec_id || '.exr' AS source, vec_id || '.hdr' AS path, NULL::VARCHAR AS problem FROM embeddings UNION ALL SELECT 'broken.exr', NULL, 'unreadable' UNION ALL SELECT 'notes.txt', NULL, 'unreadable'")
def batch_convert(spark, d):
    """A batch with files named twice, a broken one and one of another kind: each path once, errors as rows."""
    files = images.encoded(images.from_pixels(views.embedding_pixels(spark, d), 4, 4), "exr").select("path", "content")
    odd = spark.createDataFrame([("broken.exr", bytearray(b"not an image")), ("notes.txt", bytearray(b"text"))], "path string, content binary")
    out = images.batch_converted(files.unionByName(files.filter("length(path) > 5")).unionByName(odd), "hdr")
    return out.select("source", "path", F.when(F.col("error").isNotNull(), "unreadable").alias("problem"))


_LINE = "px AS (SELECT event_id AS p, (0.1::DOUBLE + (event_id % 64)/63.0::DOUBLE*7.9::DOUBLE)::FLOAT::DOUBLE AS r FROM events WHERE event_id < (SELECT (max(event_id) + 1) // 64 * 64 FROM events)), e0 AS (SELECT *, greatest(128, ceil(log2(r)) + 128) AS e FROM px), e1 AS (SELECT p, r, CASE WHEN floor(r/pow(2::DOUBLE, e-128)*255) > 255 THEN e + 1 ELSE e END AS e FROM e0)"


@query(f"WITH {_LINE} SELECT p, round(((floor(r/pow(2::DOUBLE, e-128)*255) + 0.5::DOUBLE)*pow(2::DOUBLE, e-128)/255)::FLOAT::DOUBLE, 6) AS r, round((0.5::DOUBLE*pow(2::DOUBLE, e-128)/255)::FLOAT::DOUBLE, 6) AS g FROM e1")
def hdr_packed_roundtrip(spark, d):
    """A gradient as a Radiance file with run-length lines, and read back."""
    at, height = views.places(spark, d, 64)
    whole = at.count() // 64  # full lines
    px = views.gradient(spark, 64, height, "horizontal", 0.1, 8.0, "r", at).filter(F.col("y") < whole).withColumn("image_id", F.lit("g"))
    folder = f"{shared_folder(spark)}/hdr-{uuid.uuid4().hex}"
    hdr.written(hdr.hdr_parts(px, 64, whole), folder)
    back = datasource.block_pixels(hdr.hdr_blocks(spark, folder))
    return back.select((F.col("y").cast("long") * 64 + F.col("x")).alias("p"), *(F.round(F.col(c).cast("double"), 6).alias(c) for c in "rg"))


@query(f"WITH {gain_sql(gainmap.DEFAULT, 1, True)} SELECT image_id, true AS pictures, round(log2(max_boost), 4) AS capacity FROM gb")
def gainmap_separate_files(spark, d):
    """Picture, map and metadata apart."""
    parts = images.separate_files(views.embedding_pixels(spark, d), 4, 4)
    soi = F.lit(bytearray(b"\xff\xd8"))
    both = F.startswith(F.col("sdr"), soi) & F.startswith(F.col("gain_map"), soi)
    return parts.select(F.col("image_id").cast("long").alias("image_id"), both.alias("pictures"), F.round(F.get_json_object("metadata", "$.hdrCapacityMax").cast("double"), 4).alias("capacity"))
