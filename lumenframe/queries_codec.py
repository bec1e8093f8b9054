"""Registered queries of the codecs' inner steps on given tables: Huffman codes, packed bits, run-length packets, wavelet levels, byte planes. Each SQL
goes another way than the Columns: lists merged one by one, bits one by one, a walk over positions, pairs joined line by line."""

import uuid

from pyspark.sql import functions as F

from .operators import entropy, planes, runlength, stretches, wavelet
from .plans import views
from .plans.stored import shared_folder, stored
from .queries import EV, ORACLE_SQL, QUERIES, _half_or_0, query, rounded
from .sources import datasource

# Huffman codes of each user's event values, in steps of 256.
_SYM = f"{EV}, sym AS (SELECT image_id, p, v // 256 AS v FROM ev), cnt AS (SELECT image_id, v, count(*) AS n FROM sym GROUP BY ALL)"
_LEN = (
    "queue AS (SELECT image_id, 0 AS step, list_sort(list({'w': n, 'k': 0, 's': v, 'm': [v]})) AS l, []::BIGINT[] AS m FROM cnt GROUP BY image_id "
    "UNION ALL SELECT image_id, step + 1, list_sort(list_append(l[3:], {'w': l[1].w + l[2].w, 'k': 1, 's': step::BIGINT, 'm': l[1].m || l[2].m})), l[1].m || l[2].m FROM queue WHERE len(l) > 1), "
    "taken AS (SELECT image_id, v, count(*) AS k FROM (SELECT image_id, unnest(m) AS v FROM queue) GROUP BY ALL), "
    "len AS (SELECT image_id, v, n, coalesce(k, 1)::INT AS length FROM cnt LEFT JOIN taken USING (image_id, v))"
)
_CODE = (
    "per AS (SELECT image_id, length, count(*) AS c FROM len GROUP BY ALL), "
    "fst AS (SELECT a.image_id, a.length, coalesce(sum(b.c * pow(2, a.length - b.length)), 0)::BIGINT AS f FROM per a LEFT JOIN per b ON a.image_id = b.image_id AND b.length > a.length GROUP BY ALL), "
    "code AS (SELECT image_id, v, length, f + row_number() OVER (PARTITION BY image_id, length ORDER BY v) - 1 AS code FROM len JOIN fst USING (image_id, length))"
)


def _symbols(spark, d):
    return views.event_pixels(spark, d).select("image_id", "p", F.floor(F.col("v") / 256).alias("v"))


def _lengths(spark, d):
    return entropy.code_lengths(_symbols(spark, d).groupBy("image_id", "v").agg(F.count("*").alias("n")))


@query(f"WITH RECURSIVE {_SYM}, {_LEN} SELECT * FROM len")
def huffman_lengths(spark, d):
    return _lengths(spark, d)


@query(f"WITH RECURSIVE {_SYM}, {_LEN}, {_CODE} SELECT * FROM code")
def canonical_codes(spark, d):
    return entropy.canonical_codes(_lengths(spark, d)).select("image_id", "v", "length", "code")


_BITS = "bit AS (SELECT image_id, start + i AS b, (code >> (length - 1 - i)) & 1 AS x FROM (SELECT image_id, code, length, sum(length) OVER (PARTITION BY image_id ORDER BY p) - length AS start, unnest(range(length)) AS i FROM sym JOIN code USING (image_id, v)))"


@query(f"WITH RECURSIVE {_SYM}, {_LEN}, {_CODE}, {_BITS} SELECT image_id, (b // 32)::BIGINT AS word, sum(x << (31 - b % 32)::INT)::BIGINT AS bits FROM bit GROUP BY 1, 2")
def packed_words(spark, d):
    """Every user's symbols as one stream of bits, in 32-bit words."""
    codes = entropy.canonical_codes(_lengths(spark, d))
    return entropy.packed(entropy.coded(_symbols(spark, d), codes))


@query(f"WITH {_SYM} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS p, v FROM sym")
def huffman_decode(spark, d):
    """The symbols back from the bits, by the code lengths alone."""
    codes = stored(entropy.canonical_codes(_lengths(spark, d)), "codes")
    bits = stored(entropy.coded(_symbols(spark, d), codes), "coded")
    return entropy.unpacked(stored(entropy.packed(bits), "words"), codes, bits.groupBy("image_id").agg(F.sum("length").alias("size")))


# Run-length packets of each user's event values, in steps of 20 or all but a few the same.
_BYT = f"{EV}, byt AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS p, CASE WHEN image_id % 2 = 0 THEN v // 2000 % 256 ELSE CASE WHEN v > 3500 THEN v // 100 % 256 ELSE 0 END END::INT AS b FROM ev)"
_WALK = (
    "nxt AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS size, lead(CASE WHEN new THEN p END IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY p) AS change "
    "FROM (SELECT *, b IS DISTINCT FROM lag(b) OVER (PARTITION BY image_id ORDER BY p) AS new FROM byt)), "
    "run AS (SELECT image_id, p, b, size, coalesce(change, size) - p AS r FROM nxt), "
    "stop AS (SELECT *, coalesce(min(CASE WHEN r >= 3 THEN p END) OVER (PARTITION BY image_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), size) AS triple FROM run), "
    "pos AS (SELECT image_id, p, b, r < 3 AS literal, CASE WHEN r >= 3 THEN least(r, 128) ELSE least(triple - p, 127) END AS n FROM stop), "
    "pack AS (SELECT image_id, p AS start, n, literal, b FROM pos WHERE p = 0 UNION ALL SELECT q.image_id, q.p, q.n, q.literal, q.b FROM pack JOIN pos q ON q.image_id = pack.image_id AND q.p = pack.start + pack.n)"
)
_ROWS = (
    "place AS (SELECT *, sum(CASE WHEN literal THEN n + 1 ELSE 2 END) OVER (PARTITION BY image_id ORDER BY start) - CASE WHEN literal THEN n + 1 ELSE 2 END AS a FROM pack), "
    "out AS (SELECT image_id, a AS \"at\", (CASE WHEN literal THEN 256 - n ELSE n - 1 END)::INT AS b FROM place UNION ALL SELECT image_id, a + 1, b FROM place WHERE NOT literal "
    "UNION ALL SELECT t.image_id, t.a + 1 + q.p - t.start, q.b FROM place t JOIN byt q ON q.image_id = t.image_id AND q.p >= t.start AND q.p < t.start + t.n WHERE t.literal)"
)


def _bytes(spark, d):
    v = F.col("v")
    b = F.when(F.col("image_id") % 2 == 0, F.floor(v / 2000) % 256).otherwise(F.when(v > 3500, F.floor(v / 100) % 256).otherwise(0))
    return stored(stretches.dense(views.event_pixels(spark, d)).select("image_id", "p", b.cast("int").alias("b")), "bytes")


@query(f"WITH RECURSIVE {_BYT}, {_WALK} SELECT image_id, start, n::BIGINT AS n, literal, CASE WHEN literal THEN -1 ELSE b END AS b FROM pack")
def rle_packets(spark, d):
    return runlength.packets(_bytes(spark, d)).select("image_id", "start", F.col("n").cast("long").alias("n"), "literal", F.coalesce("b", F.lit(-1)).alias("b"))


@query(f"WITH RECURSIVE {_BYT}, {_WALK}, {_ROWS} SELECT image_id, \"at\"::BIGINT AS \"at\", b FROM out")
def rle_bytes(spark, d):
    return runlength.coded(_bytes(spark, d))


@query(f"WITH {_BYT} SELECT image_id, p, b FROM byt")
def rle_decode(spark, d):
    """The packets' bytes decoded by jumping pointers."""
    return runlength.decoded(runlength.coded(_bytes(spark, d)))


# Wavelet levels of the embedding vectors as images of 8 x 8.
_VALUES = {"14": ("least(16383, floor(abs(c::DOUBLE)*8000))::BIGINT", "false"), "16": ("floor(abs(c::DOUBLE)*60000)::BIGINT % 65536", "true")}
_SIG = "(CASE WHEN {0} >= 32768 THEN {0} - 65536 ELSE {0} END)"
_LOW = {"14": "(({a} + {b}) >> 1) & 65535", "16": "CASE WHEN ((a + 32768) & 65535) < b THEN (((((a + 32768) & 65535) + b) >> 1) + 32768) & 65535 ELSE (((a + 32768) & 65535) + b) >> 1 END"}
_HIGH = {"14": "({a} - {b}) & 65535", "16": "(((a + 32768) & 65535) - b) & 65535"}


def _wavelet_sql(kind: str, levels: int) -> str:
    """Pairs along x, then along y, of each level in turn."""
    sides = {"a": _SIG.format("a"), "b": _SIG.format("b")}
    low, high = _LOW[kind].format(**sides), _HIGH[kind].format(**sides)
    ctes = [f"px0 AS (SELECT vec_id AS image_id, i % 8 AS x, i // 8 AS y, {_VALUES[kind][0]} AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS c FROM embeddings))"]
    at = 0
    for p in (1, 2, 4)[:levels]:
        for axis, other in ("xy", "yx"):
            on = f"q.image_id = t.image_id AND q.{axis} = t.{axis} + {p} AND q.{other} = t.{other}"
            pair = f"pair{at} AS (SELECT t.image_id, t.x, t.y, q.x AS x2, q.y AS y2, t.v AS a, q.v AS b FROM px{at} t JOIN px{at} q ON {on} WHERE t.{axis} % {2 * p} = 0 AND t.{other} % {p} = 0)"
            off = f"SELECT image_id, x, y, v FROM px{at} WHERE {axis} % {p} <> 0 OR {other} % {p} <> 0"
            ctes += [pair, f"px{at + 1} AS (SELECT image_id, x, y, {low} AS v FROM pair{at} UNION ALL SELECT image_id, x2, y2, {high} FROM pair{at} UNION ALL {off})"]
            at += 1
    return f"WITH {', '.join(ctes)} SELECT image_id, x, y, v::BIGINT AS v FROM px{at}"


def _squares(spark, d, kind):
    e = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "c"))
    size = F.abs(F.col("c").cast("double"))
    v = F.least(F.lit(16383), F.floor(size * 8000)) if kind == "14" else F.floor(size * 60000) % 65536
    return e.select("image_id", (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("i") / 8).alias("y"), v.alias("v"), F.lit(kind == "16").alias("wide"))


def _wavelet_query(kind, levels):
    @query(_wavelet_sql(kind, levels))
    def run(spark, d):
        return wavelet.transformed(_squares(spark, d, kind), 8, 8, levels=levels).drop("wide")

    name = f"wavelet_{kind}_level{levels}"
    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _kind in ("14", "16"):
    for _levels in (1, 2, 3):
        _wavelet_query(_kind, _levels)

    @query(_wavelet_sql(_kind, 0))
    def _back(spark, d, kind=_kind):
        return wavelet.transformed(wavelet.transformed(_squares(spark, d, kind), 8, 8), 8, 8, inverse=True).drop("wide")

    QUERIES[f"wavelet_{_kind}_back"], ORACLE_SQL[f"wavelet_{_kind}_back"] = QUERIES.pop("_back"), ORACLE_SQL.pop("_back")


# Byte planes of each user's events, in segments of 50 values of 2, 3 and 4 bytes.
_SEG = f"{EV}, num AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY p) - 1 AS p FROM ev), seg AS (SELECT image_id, p // 50 AS segment, p, (2 + p // 50 % 3)::INT AS width, (v*977*(p+1)) % (1::BIGINT << (8*(2 + p // 50 % 3))::INT) AS v FROM num)"


def _segments(spark, d):
    df = stretches.dense(views.event_pixels(spark, d)).withColumn("segment", F.floor(F.col("p") / 50))
    df = df.withColumn("width", (2 + F.col("segment") % 3).cast("int"))
    return stored(df.select("image_id", "segment", "p", "width", ((F.col("v") * 977 * (F.col("p") + 1)) % F.expr("shiftleft(1L, 8 * width)")).alias("v")), "segments")


_PLANES = "SELECT image_id, (start + j*n + k)::BIGINT AS \"at\", ((v >> (8*(width-1-j))::INT) & 255)::INT AS b FROM (SELECT *, unnest(range(width)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY image_id, segment) AS n, p % 50 AS k, (SELECT coalesce(sum(o.width), 0) FROM seg o WHERE o.image_id = seg.image_id AND o.segment < seg.segment) AS start FROM seg))"


@query(f"WITH {_SEG} {_PLANES}")
def byte_planes(spark, d):
    return planes.split(_segments(spark, d))


@query(f"WITH {_SEG} SELECT image_id, segment, p, v FROM seg")
def byte_planes_merged(spark, d):
    values = _segments(spark, d)
    return planes.merged(planes.split(values), values)


# All events as one image 64 pixels wide, coded block by block and put together from parts, then read by byte ranges.
def _one_image(spark, d, compression):
    """Where the image's folder is."""
    datasource.register(spark)
    events = views.table(spark, d, "events").select("event_id", "value", "user_id")
    height = (events.agg(F.max("event_id")).first()[0] or 0) // 64 + 1
    px = events.select(F.lit("events").alias("image_id"), (F.col("event_id") % 64).alias("x"), F.floor(F.col("event_id") / 64).alias("y"), (F.col("value") / 100).alias("r"), (F.col("user_id") / 64).alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))
    at = f"{shared_folder(spark)}/image-{uuid.uuid4().hex}"
    parts = datasource.exr_parts(px, 64, height, compression)
    parts.repartition("path").sortWithinPartitions("path", "part").write.format("parts").mode("append").save(at)
    return at


_ALL = "px AS (SELECT event_id, (value/100)::FLOAT::DOUBLE AS r, (user_id/64.0)::FLOAT::DOUBLE AS g FROM events)"


def _assembled(compression):
    value = _half_or_0 if compression != "none" else str
    sql = f"WITH {_ALL} SELECT event_id % 64 AS x, event_id // 64 AS y, round({value('r')}, 5) AS r, round({value('g')}, 5) AS g, 0.5::DOUBLE AS b FROM px"

    @query(sql)
    def run(spark, d):
        blocks = spark.read.format("exr").option("path", _one_image(spark, d, compression)).option("split", 1 << 16).load()
        px = datasource.block_pixels(blocks).filter("a > 0")  # the last line's end has no events
        return rounded(px.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), *(F.col(c).cast("double").alias(c) for c in "rgb")), "x", "y")

    QUERIES[f"exr_assembled_{compression}"], ORACLE_SQL[f"exr_assembled_{compression}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _c in ("none", "zip", "piz"):
    _assembled(_c)


@query("SELECT 64 AS width, (max(event_id) // 64 + 1)::INT AS height, 'zip' AS compression, 'A,B,G,R' AS channels, ((max(event_id) // 64 + 1 + 15) // 16)::INT AS blocks, true AS head_only FROM events")
def exr_headers(spark, d):
    """What the header says, from the file's first bytes."""
    rows = spark.read.format("exr").option("path", _one_image(spark, d, "zip")).option("what", "headers").load()
    return rows.select("width", "height", "compression", "channels", "blocks", (F.col("bytes_read") <= datasource.HEAD).alias("head_only"))
