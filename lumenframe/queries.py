"""Registered queries of the image engine and their SQL."""

import numpy as np
from pyspark.sql import functions as F

from .functions import bits, color, tone
from .operators import gainmap, relational, stats
from .plans import views
from .sources import images

R6 = 5
RGB = ("r", "g", "b")
QUERIES, ORACLE_SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df, *keys, cols=RGB, digits=R6):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in cols))


# SQL of the views, and of the steps, written apart from the Column code.
EMB = "emb AS (SELECT vec_id AS image_id, label, p, p % 4 AS x, p // 4 AS y, embedding[p*4+1] AS r, embedding[p*4+2] AS g, embedding[p*4+3] AS b, embedding[p*4+4] AS a FROM embeddings, (SELECT unnest(range(16))::INT AS p))"
LI = "li AS (SELECT l_suppkey AS image_id, l_orderkey, l_linenumber, (l_extendedprice/10000)::FLOAT AS r, (l_quantity/10)::FLOAT AS g, ((l_discount+l_tax)*10)::FLOAT AS b FROM lineitem)"
EV = "ev AS (SELECT user_id AS image_id, event_id AS p, floor(value*100)::BIGINT AS v, value/100 AS r FROM events)"
LIKEY = "l_orderkey, l_linenumber"


def san(c):
    return f"(CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 0 OR isinf({c}) THEN 0.0::DOUBLE ELSE {c}::DOUBLE END)"


def lin(c):
    return f"(CASE WHEN {c} <= 0.04045 THEN {c}/12.92::DOUBLE ELSE pow(({c}+0.055::DOUBLE)/1.055::DOUBLE, 2.4::DOUBLE) END)"


def srgb(c):
    return f"(CASE WHEN {c} <= 0.0031308 THEN {c}*12.92::DOUBLE ELSE 1.055::DOUBLE*pow({c}, 1::DOUBLE/2.4::DOUBLE) - 0.055::DOUBLE END)"


def u8(c):
    return f"floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {c}*255+0.5)))::INT"


def dots(m, cols=RGB):
    return ["(" + " + ".join(f"{float(k)!r}::DOUBLE*{c}" for k, c in zip(row, cols, strict=True)) + ")" for row in m]


def three(exprs, names=RGB):
    return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names, strict=True))


def tone_sql(mapper, exposure, source, keys, out=u8):
    """Nested selects of one mapper over the view source."""
    q = f"SELECT {keys}, {three([san(c) for c in RGB])} FROM {source}"
    step = lambda q, e: f"SELECT {keys}, {three(e)} FROM ({q})"
    e = exposure if isinstance(exposure, str) else f"{float(exposure)!r}::DOUBLE"
    q = step(q, [f"({c}*{e})::FLOAT::DOUBLE" for c in RGB])
    if mapper == "reinhard":
        q = step(q, [f"{c}/(1+{c})" for c in RGB])
    elif mapper == "aces":
        q = step(q, dots(tone.ACES_IN))
        q = step(q, [f"({c}*({c}+0.0245786::DOUBLE)-0.000090537::DOUBLE)/({c}*(0.983729::DOUBLE*{c}+0.432951::DOUBLE)+0.238081::DOUBLE)" for c in RGB])
        q = step(q, dots(tone.ACES_OUT))
    elif mapper == "neutral":
        low = "least(r,g,b)"
        q = step(q, [f"{c} - (CASE WHEN {low} < 0.08 THEN {low} - 6.25::DOUBLE*{low}*{low} ELSE 0.04::DOUBLE END)" for c in RGB])
        q = f"SELECT {keys}, r, g, b, greatest(r,g,b) AS peak FROM ({q})"
        q = f"SELECT *, 1 - 0.0576::DOUBLE/(peak + 0.24::DOUBLE - 0.76::DOUBLE) AS n FROM ({q})"
        q = f"SELECT *, 1 - 1/(0.15::DOUBLE*(peak-n)+1) AS m FROM ({q})"
        q = step(q, [f"CASE WHEN peak < 0.76 THEN {c} ELSE {c}*(n/peak)*(1-m)+n*m END" for c in RGB])
    else:
        q = step(q, dots(color.matrix("rec709", "rec2020")))
        q = step(q, dots(tone.AGX_IN))
        q = step(q, [f"greatest(0::DOUBLE, least(1::DOUBLE, (log2(greatest({c},1e-10::DOUBLE)) + 12.47393::DOUBLE)/16.499999::DOUBLE))" for c in RGB])
        p = lambda c: f"15.5::DOUBLE*{c}**6 - 40.14::DOUBLE*{c}**5 + 31.96::DOUBLE*{c}**4 - 6.868::DOUBLE*{c}**3 + 0.4298::DOUBLE*{c}**2 + 0.1191::DOUBLE*{c} - 0.00232::DOUBLE"
        q = step(q, [p(c) for c in RGB])
        q = step(q, dots(tone.AGX_OUT))
        q = step(q, [f"pow(greatest(0::DOUBLE, {c}), 2.2::DOUBLE)" for c in RGB])
        q = step(q, dots(color.matrix("rec2020", "rec709")))
    q = step(q, [f"({c})::FLOAT::DOUBLE" for c in RGB])
    return q if out is None else step(step(q, [srgb(f"greatest({c},0)") for c in RGB]), [out(c) for c in RGB])


@query(f"WITH {EMB} SELECT image_id, p, {three([f'round({san(c)},6)' for c in 'rgba'], 'rgba')} FROM emb")
def sanitize_pixels(spark, d):
    return views.embedding_pixels(spark, d).select("image_id", "p", *(F.round(color.sanitise(F.col(c)), 6).alias(c) for c in "rgba"))


@query(f"WITH {LI} SELECT {LIKEY}, {three([f'round({lin(c)},{R6})' for c in ('r::DOUBLE', 'g::DOUBLE', 'b::DOUBLE')])} FROM li")
def srgb_to_linear(spark, d):
    return views.lineitem_pixels(spark, d).select("l_orderkey", "l_linenumber", *(F.round(color.to_linear(F.col(c).cast("double")), R6).alias(c) for c in RGB))


@query(f"WITH {LI} SELECT {LIKEY}, {three([f'round({srgb(c)},{R6})' for c in ('r::DOUBLE', 'g::DOUBLE', 'b::DOUBLE')])} FROM li")
def linear_to_srgb(spark, d):
    return views.lineitem_pixels(spark, d).select("l_orderkey", "l_linenumber", *(F.round(color.to_display(F.col(c).cast("double")), R6).alias(c) for c in RGB))


def _space(a, b):
    @query(f"WITH {LI} SELECT {LIKEY}, {three([f'round({e},{R6})' for e in dots(color.matrix(a, b))])} FROM li")
    def f(spark, d):
        df = views.lineitem_pixels(spark, d).withColumns({c: F.col(c).cast("double") for c in RGB})
        return rounded(tone.stepped(df, [lambda c: color.convert(c, a, b)]), "l_orderkey", "l_linenumber")

    QUERIES[f"convert_{a}_{b}"], ORACLE_SQL[f"convert_{a}_{b}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")

    # Linear to display of the target and back.
    fwd = f"SELECT {LIKEY}, {three(dots(color.matrix(a, b)))} FROM li"
    enc = f"SELECT {LIKEY}, {three([srgb(f'greatest({c},0)') for c in RGB])} FROM ({fwd})"
    dec = f"SELECT {LIKEY}, {three([lin(c) for c in RGB])} FROM ({enc})"
    back = f"SELECT {LIKEY}, {three([f'round(({e})::FLOAT::DOUBLE, 6) + 0.0' for e in dots(color.matrix(b, a))])} FROM ({dec})"

    @query(f"WITH {LI} {back}")
    def g(spark, d):
        df = views.lineitem_pixels(spark, d).withColumns({c: F.col(c).cast("double") for c in RGB})
        steps = [lambda c: color.convert(c, a, b), lambda c: [color.to_display(F.greatest(x, F.lit(0.0))) for x in c], lambda c: [color.to_linear(x) for x in c], lambda c: color.convert(c, b, a)]
        # As floats: a value halfway between two rounded ones would be decided by the last bit of pow().
        return tone.stepped(df, steps).select("l_orderkey", "l_linenumber", *((F.round(F.col(c).cast("float").cast("double"), 6) + 0.0).alias(c) for c in RGB))

    QUERIES[f"display_roundtrip_{a}_{b}"], ORACLE_SQL[f"display_roundtrip_{a}_{b}"] = QUERIES.pop("g"), ORACLE_SQL.pop("g")


for _a in color.CHROMATICITIES:
    for _b in color.CHROMATICITIES:
        if _a != _b:
            _space(_a, _b)


def _tone(mapper):
    def emb(spark, d):
        return tone.displayed(views.embedding_pixels(spark, d), mapper=mapper, exposure=4.0).select("image_id", "p", *RGB)

    def li(spark, d):
        return tone.displayed(views.lineitem_pixels(spark, d), mapper=mapper).select("l_orderkey", "l_linenumber", *RGB)

    QUERIES[f"tonemap_{mapper}"], ORACLE_SQL[f"tonemap_{mapper}"] = emb, f"WITH {EMB} {tone_sql(mapper, 4, 'emb', 'image_id, p')}"
    QUERIES[f"tonemap_{mapper}_hdr"], ORACLE_SQL[f"tonemap_{mapper}_hdr"] = li, f"WITH {LI} {tone_sql(mapper, 1, 'li', LIKEY)}"


for _m in tone.MAPPERS:
    _tone(_m)

_SWEEP = " UNION ALL ".join(f"SELECT {e}::DOUBLE AS exposure, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM ({tone_sql('reinhard', e, 'emb', 'image_id, p')})" for e in (0.5, 1, 2, 4))


@query(f"WITH {EMB} SELECT exposure, round(r,4) AS r, round(g,4) AS g, round(b,4) AS b FROM ({_SWEEP})")
def exposure_sweep(spark, d):
    px = views.embedding_pixels(spark, d).withColumn("exposure", F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0, 4.0)))))
    px = px.withColumns({c: color.sanitise(F.col(c)) * F.col("exposure") for c in RGB})
    out = tone.displayed(px).groupBy("exposure").agg(*(F.avg(c).alias(c) for c in RGB))
    return rounded(out, "exposure", digits=4)


_TWO = "(2::DOUBLE)"
_RG = "SELECT *, greatest(r,g,b) AS top FROM (SELECT image_id, l_orderkey, l_linenumber, r::DOUBLE AS r, g::DOUBLE AS g, b::DOUBLE AS b FROM li)"
_RG = f"SELECT *, least(255, greatest(128, ceil(log2(CASE WHEN top < 1e-32 THEN 1 ELSE top END)) + 128)) AS e0 FROM ({_RG})"
_RG = f"SELECT *, CASE WHEN floor(top/pow(2::DOUBLE, e0-128)*255) > 255 AND e0 < 255 THEN e0 + 1 ELSE e0 END AS e1 FROM ({_RG})"
_RGBE = f"SELECT image_id, {LIKEY}, " + ", ".join(f"(CASE WHEN top < 1e-32 THEN 0 ELSE least(255, greatest(0, floor({c}/pow(2::DOUBLE, e1-128)*255))) END)::INT AS {c}" for c in RGB) + f", (CASE WHEN top < 1e-32 THEN 0 ELSE e1 END)::INT AS e FROM ({_RG})"


def _rgbe(spark, d):
    px = views.lineitem_pixels(spark, d).withColumns({c: F.col(c).cast("double") for c in RGB})
    return bits.with_rgbe(px).select("image_id", "l_orderkey", "l_linenumber", *RGB, "e")


@query(f"WITH {LI} SELECT {LIKEY}, r, g, b, e FROM ({_RGBE})")
def rgbe_encode(spark, d):
    return _rgbe(spark, d).drop("image_id")


def _unrgbe(c, div="1"):
    return f"round((CASE WHEN e = 0 THEN 0.0::DOUBLE ELSE ({c}+0.5::DOUBLE)*pow(2::DOUBLE, e-128)/255 END)/{div}, {R6}) AS {c}"


@query(f"WITH {LI} SELECT {LIKEY}, {', '.join(_unrgbe(c) for c in RGB)} FROM ({_RGBE})")
def rgbe_roundtrip(spark, d):
    return _rgbe(spark, d).select("l_orderkey", "l_linenumber", *(F.round(bits.from_rgbe(F.col(c), F.col("e")), R6).alias(c) for c in RGB))


@query(f"WITH {LI} SELECT {LIKEY}, {', '.join(_unrgbe(c, '(1.25::DOUBLE*(1 + image_id % 4))') for c in RGB)} FROM (SELECT * FROM ({_RGBE}))")
def physical_radiance(spark, d):
    """Each image is a file of its own, whose header has two EXPOSURE lines."""
    lines = F.array(F.lit(1.25), (1 + F.col("image_id") % 4).cast("double"))
    px = _rgbe(spark, d).withColumn("exposure", bits.cumulative(lines))
    return px.select("l_orderkey", "l_linenumber", *(F.round(bits.from_rgbe(F.col(c), F.col("e")) / F.col("exposure"), R6).alias(c) for c in RGB))


def _float_sql(c, digits, low):
    e = f"floor(log2(CASE WHEN {c} >= {low!r}::DOUBLE THEN {c} ELSE 1 END))"
    return f"floor({c}*pow(2::DOUBLE, {digits}-{e})+0.5)/pow(2::DOUBLE, {digits}-{e})"


def _d(c):
    return f"{c}::DOUBLE"


_HALF = {c: f"CASE WHEN {c} < 5.9604644775390625e-08 THEN 0 WHEN {c} < 6.103515625e-05 THEN floor({c}*16777216+0.5)/16777216 ELSE {_float_sql(_d(c), 10, 2.0**-14)} END" for c in RGB}


@query(f"WITH {LI} SELECT {LIKEY}, " + ", ".join(f"round({_HALF[c]}, 6) AS {c}" for c in RGB) + " FROM li")
def half_roundtrip(spark, d):
    return views.lineitem_pixels(spark, d).select("l_orderkey", "l_linenumber", *(F.round(bits.half_value(F.col(c).cast("double")), 6).alias(c) for c in RGB))


@query(f"WITH {LI} SELECT {LIKEY}, " + ", ".join(f"round(CASE WHEN {c} = 0 THEN 0 ELSE {_float_sql(_d(c), 15, 2.0**-126)} END, 6) AS {c}" for c in RGB) + " FROM li")
def f24_roundtrip(spark, d):
    return views.lineitem_pixels(spark, d).select("l_orderkey", "l_linenumber", *(F.round(bits.f24_value(F.col(c).cast("double")), 6).alias(c) for c in RGB))


@query(f"WITH {LI} SELECT {LIKEY}, {three([u8(c + '::DOUBLE') for c in RGB])} FROM li")
def quantize_u8(spark, d):
    return views.lineitem_pixels(spark, d).select("l_orderkey", "l_linenumber", *(color.to_u8(F.col(c).cast("double")).alias(c) for c in RGB))


_RANGE = ", ".join(f"round(min({c}::DOUBLE),6) AS min_{c}, round(max({c}::DOUBLE),6) AS max_{c}, round(avg({c}::DOUBLE),6) AS avg_{c}, round(max({c}::DOUBLE)-min({c}::DOUBLE),6) AS range_{c}" for c in RGB)


@query(f"WITH {EMB} SELECT label, {_RANGE} FROM emb GROUP BY label")
def range_metadata(spark, d):
    return stats.range_metadata(views.embedding_pixels(spark, d), "label")


@query(f"WITH {LI} SELECT image_id, {_RANGE} FROM li GROUP BY image_id")
def range_metadata_hdr(spark, d):
    return stats.range_metadata(views.lineitem_pixels(spark, d), "image_id")


# Gain maps over the embedding images at exposure 8.
_GT = f"SELECT a.*, m.r AS m_r, m.g AS m_g, m.b AS m_b FROM (SELECT image_id, p, {three([san(c) for c in RGB], ('x_r', 'x_g', 'x_b'))}, {three([san(c) + '*8.0::DOUBLE' for c in RGB], ('h_r', 'h_g', 'h_b'))} FROM emb) a JOIN ({tone_sql('aces', 8, 'emb', 'image_id, p', None)}) m USING (image_id, p)"
_RATIO = "greatest(" + ", ".join(f"CASE WHEN m_{c}+0.015625 > 0 THEN (h_{c}+0.015625::DOUBLE)/(m_{c}+0.015625::DOUBLE) ELSE 1 END" for c in RGB) + ")"
_GB = f"SELECT image_id, greatest(max({_RATIO}), max(greatest(x_r,x_g,x_b)), 1.0001::DOUBLE) AS max_boost FROM gt GROUP BY image_id"
_SDR = ", ".join(f"{u8(srgb(f'greatest(m_{c},0)'))} AS sdr_{c}" for c in RGB)
_GE = f"SELECT *, log2(max_boost) AS log_max, {_SDR} FROM gt JOIN gb USING (image_id)"
_GM = "SELECT *, " + ", ".join(u8(f"least(1::DOUBLE, greatest(0::DOUBLE, log2((h_{c}+0.015625::DOUBLE)/({lin(f'(sdr_{c}/255.0::DOUBLE)')}+0.015625::DOUBLE))/log_max))") + f" AS gm_{c}" for c in RGB) + " FROM ge"
_GAIN = f"{EMB}, gt AS ({_GT}), gb AS ({_GB}), ge AS ({_GE}), gm AS ({_GM})"


def _toned(spark, d):
    return gainmap.with_tone(views.embedding_pixels(spark, d), exposure=8.0)


def _gain(spark, d):
    t = _toned(spark, d)
    return gainmap.encoded(t, gainmap.boosts(t))


@query(f"WITH {EMB}, gt AS ({_GT}) SELECT image_id, round(max_boost, 5) AS max_boost FROM ({_GB})")
def gainmap_boost(spark, d):
    return gainmap.boosts(_toned(spark, d)).select("image_id", F.round("max_boost", 5).alias("max_boost"))


@query(f"WITH {_GAIN} SELECT image_id, p, sdr_r, sdr_g, sdr_b, gm_r, gm_g, gm_b FROM gm")
def gainmap_encode(spark, d):
    return _gain(spark, d).select("image_id", "p", *(f"{k}_{c}" for k in ("sdr", "gm") for c in RGB))


def _decode_sql(w):
    return ", ".join(f"round(least(65504::DOUBLE, greatest(0::DOUBLE, ({lin(f'(sdr_{c}/255.0::DOUBLE)')}+0.015625::DOUBLE)*pow(2::DOUBLE, {w}*log_max*(gm_{c}/255.0::DOUBLE))-0.015625::DOUBLE)),4) AS {c}" for c in RGB)


@query(f"WITH {_GAIN} SELECT image_id, p, {_decode_sql('1')} FROM gm")
def gainmap_decode(spark, d):
    return rounded(gainmap.decoded(_gain(spark, d)), "image_id", "p", digits=4)


@query(f"WITH {_GAIN} SELECT image_id, p, {_decode_sql('least(1::DOUBLE, greatest(0::DOUBLE, log2(1.5::DOUBLE)/log_max))')} FROM gm")
def gainmap_decode_boosted(spark, d):
    g = _gain(spark, d)
    return rounded(gainmap.decoded(g, gainmap.weight_for(1.5, F.col("log_min"), F.col("log_max"))), "image_id", "p", digits=4)


def _pair(spark, d):
    a = views.embedding_pixels(spark, d)
    b = a.withColumns({c: (F.floor(F.col(c).cast("double") * 64 + 0.5) / 64).cast("float") for c in RGB})
    return a.select("image_id", "p", *"rgba"), b.select("image_id", "p", *"rgba")


_B = f"{EMB}, em2 AS (SELECT image_id, p, {three([f'(floor({c}::DOUBLE*64+0.5)/64)::FLOAT' for c in RGB])}, a FROM emb)"
_DELTA = {c: f"abs(e.{c}::DOUBLE-f.{c}::DOUBLE)" for c in "rgba"}
_REF = {c: f"greatest(abs(e.{c}::DOUBLE),abs(f.{c}::DOUBLE))" for c in "rgba"}
_OK = " AND ".join(f"(CASE WHEN {_REF[c]} < 0.01 THEN {_DELTA[c]} <= 1e-6 ELSE {_DELTA[c]} <= {_REF[c]}*0.01::DOUBLE END)" for c in "rgba")
_DIFF = f"diff AS (SELECT e.image_id, e.p, greatest({', '.join(_DELTA.values())}) AS abs_delta, greatest({', '.join(f'CASE WHEN {_REF[c]} > 0 THEN {_DELTA[c]}/{_REF[c]} ELSE 0 END' for c in 'rgba')}) AS rel_delta, {' + '.join(f'{v}*{v}' for v in _DELTA.values())} AS squares, {_OK} AS ok FROM emb e JOIN em2 f USING (image_id, p))"


@query(f"WITH {_B}, {_DIFF} SELECT image_id, bool_and(ok) AS \"match\", count(*) FILTER (NOT ok) AS mismatched, round(max(abs_delta),6) AS max_abs, round(max(rel_delta),6) AS max_rel, round(sqrt(sum(squares)/(count(*)*4)),6) AS rmse FROM diff GROUP BY image_id")
def compare_images(spark, d):
    return stats.compared(*_pair(spark, d))


@query(f"WITH {_B}, {_DIFF} SELECT image_id, p, round(abs_delta,6) AS abs_delta FROM diff WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY p) <= 3")
def mismatch_samples(spark, d):
    return stats.mismatch_samples(*_pair(spark, d), 3)


_COLUMN = "SELECT e.image_id, e.x, round(0.5::DOUBLE + e.x/3.0::DOUBLE*1.5::DOUBLE, 6) AS intensity, round(max(abs(f.r::DOUBLE-e.r::DOUBLE)),6) AS worst FROM emb e JOIN em2 f USING (image_id, p) GROUP BY e.image_id, e.x"


@query(f"WITH {_B} SELECT * FROM ({_COLUMN}) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY worst DESC, x) <= 2")
def worst_columns(spark, d):
    return stats.worst_columns(*_pair(spark, d), width=4, n=2, low=0.5, high=2.0)


@query(f"WITH {EV} SELECT image_id, round(max(step),6) AS step FROM (SELECT image_id, abs(r-lead(r) OVER (PARTITION BY image_id ORDER BY p)) AS step FROM ev) GROUP BY image_id")
def continuity(spark, d):
    step = F.abs(F.col("r") - F.lead("r").over(relational.line()))
    return views.event_pixels(spark, d).withColumn("step", step).groupBy("image_id").agg(F.round(F.max("step"), 6).alias("step"))


@query(f"WITH {EMB}, dst AS (SELECT i % 6 AS dx, i // 6 AS dy FROM (SELECT unnest(range(36))::INT AS i)) SELECT image_id, dx, dy, r, g, b FROM dst JOIN emb ON emb.x = least(3, floor(dx*4/6.0)) AND emb.y = least(3, floor(dy*4/6.0))")
def resize_nearest(spark, d):
    return relational.nearest(views.embedding_pixels(spark, d), 4, 4, 6, 6).select("image_id", "dx", "dy", *RGB)


@query(f"WITH {EV} SELECT image_id, p, ((v - lag(v,1,0) OVER (PARTITION BY image_id ORDER BY p)) % 65536 + 65536) % 65536 AS d FROM ev")
def pxr24_delta(spark, d):
    return relational.deltas(views.event_pixels(spark, d)).select("image_id", "p", "d")


@query(f"WITH {EV} SELECT image_id, p, v % 65536 AS v FROM ev")
def pxr24_undelta(spark, d):
    return relational.undeltas(relational.deltas(views.event_pixels(spark, d)).select("image_id", "p", "d")).select("image_id", "p", "v")


_BYTE = f"{EV}, byt AS (SELECT image_id, p, v % 256 AS v FROM ev)"


@query(f"WITH {_BYTE} SELECT image_id, p, coalesce((v - lag(v) OVER (PARTITION BY image_id ORDER BY p) + 128 + 256) % 256, v) AS d FROM byt")
def predictor_encode(spark, d):
    return relational.predicted(views.event_pixels(spark, d).withColumn("v", F.col("v") % 256)).select("image_id", "p", "d")


@query(f"WITH {_BYTE} SELECT image_id, p, v FROM byt")
def predictor_decode(spark, d):
    enc = relational.predicted(views.event_pixels(spark, d).withColumn("v", F.col("v") % 256))
    return relational.unpredicted(enc.select("image_id", "p", "d")).select("image_id", "p", "v")


_RUN = "sum(new) OVER (PARTITION BY image_id ORDER BY p)"


@query(f"WITH {EV}, q AS (SELECT image_id, p, v // 10000 AS v FROM ev), n AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER (PARTITION BY image_id ORDER BY p) THEN 0 ELSE 1 END AS new FROM q), r AS (SELECT *, {_RUN} AS run FROM n) SELECT image_id, run::BIGINT AS run, min(p) AS first_p, count(*) AS n, min(v) AS value FROM r GROUP BY image_id, run")
def run_detect(spark, d):
    px = views.event_pixels(spark, d).withColumn("v", F.floor(F.col("v") / 10000))
    return relational.runs(px, "v")


@query(f"WITH {EV} SELECT v, row_number() OVER (ORDER BY v) - 1 AS rank FROM (SELECT DISTINCT v FROM ev UNION SELECT 0)")
def lut_rank(spark, d):
    return relational.value_ranks(views.event_pixels(spark, d), "v")


@query(f"WITH {EV}, l AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS rank FROM (SELECT DISTINCT v FROM ev UNION SELECT 0)) SELECT image_id, p, rank FROM ev JOIN l USING (v)")
def lut_apply(spark, d):
    px = views.event_pixels(spark, d)
    return relational.looked_up(px, relational.value_ranks(px, "v"), "v").select("image_id", "p", "rank")


@query(f"WITH {EV} SELECT v, count(*) AS n FROM ev GROUP BY v")
def symbol_frequency(spark, d):
    return views.event_pixels(spark, d).groupBy("v").agg(F.count("*").alias("n"))


@query(f"WITH {EV} SELECT min(v // 8) AS first_byte, max(v // 8) AS last_byte, count(DISTINCT v) AS n FROM ev WHERE v > 0")
def value_bitmap(spark, d):
    return views.event_pixels(spark, d).filter("v > 0").agg(F.min(F.floor(F.col("v") / 8)).alias("first_byte"), F.max(F.floor(F.col("v") / 8)).alias("last_byte"), F.count_distinct("v").alias("n"))


_DOC = "docs AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS block FROM documents)"


@query(f"WITH {_DOC} SELECT source, block, (300 + count(*) OVER (PARTITION BY source)*8 + coalesce(sum(n_chars+8) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))::BIGINT AS \"at\" FROM docs")
def exr_offsets_variable(spark, d):
    return relational.offsets(views.table(spark, d, "documents").select("source", "doc_id", "n_chars"), "n_chars", 300, "source", "doc_id").select("source", "block", "at")


_LINES = ", ".join(f"('{k}', {v})" for k, v in relational.BLOCK_LINES.items())


@query(f"SELECT codec, h, ((h + lines - 1) // lines)::BIGINT AS blocks FROM (VALUES {_LINES}) t(codec, lines), (SELECT DISTINCT p_size AS h FROM part)")
def exr_block_layout(spark, d):
    codecs = F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.lit(n).alias("lines")) for c, n in relational.BLOCK_LINES.items())))
    t = views.table(spark, d, "part").select(F.col("p_size").alias("h")).distinct().select("h", codecs.alias("c")).select("h", "c.codec", "c.lines")
    return t.select("codec", "h", F.ceil(F.col("h") / F.col("lines")).alias("blocks"))


_G = "g AS (SELECT event_id AS p, event_id % {w} AS x, event_id // {w} AS y, (max(event_id) OVER () // {w})::DOUBLE AS top FROM events)"


@query("WITH " + _G.format(w=16) + " SELECT p, round((0.1::DOUBLE + x/15.0::DOUBLE*7.9::DOUBLE)::FLOAT::DOUBLE,6) AS r, 0.0::DOUBLE AS g FROM g")
def gen_gradient(spark, d):
    at, height = views.places(spark, d, 16)
    return views.gradient(spark, 16, height, "horizontal", 0.1, 8.0, "r", at).select("p", F.round(F.col("r").cast("double"), 6).alias("r"), F.col("g").cast("double").alias("g"))


_HUE = "CASE WHEN h < 60 THEN [c, k, 0] WHEN h < 120 THEN [k, c, 0] WHEN h < 180 THEN [0, c, k] WHEN h < 240 THEN [0, k, c] WHEN h < 300 THEN [k, 0, c] ELSE [c, 0, k] END"


@query("WITH " + _G.format(w=16) + f", s AS (SELECT p, y/top*360 AS h, x/15.0::DOUBLE*0.9::DOUBLE AS c FROM g), k AS (SELECT *, c*(1-abs((h/60) % 2 - 1)) AS k, 0.9::DOUBLE-c AS m FROM s), v AS (SELECT p, m, {_HUE} AS v FROM k) SELECT p, " + ", ".join(f"round(((v[{i + 1}]+m)*4)::FLOAT::DOUBLE,5) AS {c}" for i, c in enumerate(RGB)) + " FROM v")
def gen_rainbow(spark, d):
    at, height = views.places(spark, d, 16)
    return views.rainbow(spark, 16, height, 0.9, 4.0, at).select("p", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in RGB))


@query("WITH " + _G.format(w=12) + " SELECT p, round((1 - sqrt((x*x+y*y)::DOUBLE)/sqrt(121+top*top))::FLOAT::DOUBLE,6) AS r FROM g")
def gen_sdf(spark, d):
    at, height = views.places(spark, d, 12)
    return views.radial(spark, 12, height, at).select("p", F.round(F.col("r").cast("double"), 6).alias("r"))


_INV = np.linalg.inv(color.rgb_to_xyz("rec2020")).tolist()


@query("WITH " + _G.format(w=16) + ", c AS (SELECT p, x/15.0::DOUBLE*0.735::DOUBLE AS cx, (1-y/top)*0.834::DOUBLE AS cy FROM g), z AS (SELECT p, CASE WHEN cy < 1e-6 THEN 0 ELSE cx/cy END AS r, CASE WHEN cy < 1e-6 THEN 0 ELSE 1 END::DOUBLE AS g, CASE WHEN cy < 1e-6 THEN 0 ELSE (1-cx-cy)/cy END AS b FROM c) SELECT p, " + ", ".join(f"round(greatest(0, {e}),4) AS {c}" for e, c in zip(dots(_INV), RGB, strict=True)) + " FROM z")
def gen_cie_wedge(spark, d):
    at, height = views.places(spark, d, 16)
    return views.cie_wedge(spark, 16, height, at=at).select("p", *(F.round(F.col(c), 4).alias(c) for c in RGB))


@query("SELECT ext, count(*) AS n FROM (SELECT DISTINCT url, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages) WHERE ext IN ('html', 'htm') GROUP BY ext")
def file_filter_dedupe(spark, d):
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    df = views.table(spark, d, "pages").select("url", F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    return df.filter(F.col("ext").isin("html", "htm")).dropDuplicates(["url"]).groupBy("ext").agg(F.count("*").alias("n"))


def flagship(spark, d):
    """Range metadata of the embedding images by label, with their mean display value."""
    px = views.embedding_pixels(spark, d)
    shown = tone.displayed(px, exposure=4.0).groupBy("label").agg(*(F.round(F.avg(c), 4).alias(f"shown_{c}") for c in RGB))
    return stats.range_metadata(px, "label").join(shown, "label")


def _files(px, kind, **options):
    """The embedding images as files and back, for the round trips; 6 digits."""
    whole = images.from_pixels(px.select("image_id", "p", *(F.col(c).cast("float").alias(c) for c in "rgba")), 4, 4)
    back = images.pixels(images.decoded(images.encoded(whole, kind, **options)))
    name = F.regexp_extract("image_id", r"(-?\d+)\.", 1).cast("long").alias("image_id")
    return back.select(name, "p", *(F.round(F.col(c).cast("double"), R6).alias(c) for c in RGB))


def _emb_sql(each):
    return f"WITH {EMB} SELECT image_id, p, " + ", ".join(f"round(({each(c)})::FLOAT::DOUBLE, {R6}) AS {c}" for c in RGB) + " FROM emb"


def _half_or_0(c):
    v = san(c)
    return f"CASE WHEN {v} < 5.9604644775390625e-08 THEN 0 WHEN {v} < 6.103515625e-05 THEN floor({v}*16777216+0.5)/16777216 ELSE {_float_sql(v, 10, 2.0**-14)} END"


def _exr_query(compression):
    @query(_emb_sql(san if compression == "none" else _half_or_0))
    def run(spark, d):
        return _files(views.embedding_pixels(spark, d), "exr", compression=compression)

    QUERIES[f"exr_{compression}_roundtrip"], ORACLE_SQL[f"exr_{compression}_roundtrip"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _c in ("none", "rle", "zips", "zip", "pxr24", "piz"):
    _exr_query(_c)

_HDR = f"SELECT image_id, p, {', '.join(f'{san(c)} AS {c}' for c in RGB)} FROM emb"
_HDR = f"SELECT *, greatest(r,g,b) AS top FROM ({_HDR})"
_HDR = f"SELECT *, least(255, greatest(128, ceil(log2(CASE WHEN top < 1e-32 THEN 1 ELSE top END)) + 128)) AS e0 FROM ({_HDR})"
_HDR = f"SELECT *, CASE WHEN top < 1e-32 THEN 0 WHEN floor(top/pow(2::DOUBLE, e0-128)*255) > 255 AND e0 < 255 THEN e0 + 1 ELSE e0 END AS e FROM ({_HDR})"
_HDR_OUT = ", ".join(
    f"round((CASE WHEN e = 0 THEN 0.0::DOUBLE ELSE (least(255, floor({c}/pow(2::DOUBLE, e-128)*255))+0.5::DOUBLE)*pow(2::DOUBLE, e-128)/255 END)::FLOAT::DOUBLE, {R6}) AS {c}" for c in RGB
)


@query(f"WITH {EMB} SELECT image_id, p, {_HDR_OUT} FROM ({_HDR})")
def hdr_roundtrip(spark, d):
    return _files(views.embedding_pixels(spark, d), "hdr")


def _gainmap_query(kind):
    def run(spark, d):
        back = images.pixels(images.decoded(images.gain_map_files(views.embedding_pixels(spark, d), 4, 4, kind)))
        return back.select(F.regexp_extract("image_id", r"(-?\d+)\.", 1).cast("long").alias("image_id"), "p", *(F.round(F.col(c).cast("double"), R6).alias(c) for c in RGB))

    return run


# No SQL says what JPEG loses; tests bound the error of these two.
QUERIES["gainmap_ultrahdr_roundtrip"] = _gainmap_query("ultrahdr")
QUERIES["gainmap_adobe_roundtrip"] = _gainmap_query("adobe-gainmap")


@query("SELECT vec_id AS image_id, 4 AS width, 4 AS height, 'linear-rec709' AS space, 'A,B,G,R' AS channels, 'zip' AS compression FROM embeddings")
def image_info(spark, d):
    whole = images.from_pixels(views.embedding_pixels(spark, d), 4, 4)
    info = images.file_info(images.encoded(whole, "exr"))
    field = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return info.select(F.regexp_extract("image_id", r"(-?\d+)\.", 1).cast("long").alias("image_id"), "width", "height", "space", field("channels"), field("compression"))


from . import queries_codec, queries_more  # noqa: E402, F401  they register their queries here
