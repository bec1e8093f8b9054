"""Huffman codes, packed bits, run-length packets, wavelet levels and byte planes against the file codecs, with stretches cut anywhere."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import queries
from lumenframe.operators import entropy, planes, runlength, stretches, wavelet
from lumenframe.plans import stored
from lumenframe.sources import blocks

SF = "/root/testdata/sf0.001"
NAMES = ["huffman_lengths", "canonical_codes", "packed_words", "huffman_decode", "rle_packets", "rle_bytes", "rle_decode", "wavelet_14_level1", "wavelet_16_level3", "wavelet_16_back", "byte_planes", "byte_planes_merged",
         "display_roundtrip_rec709_p3"]


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


R = np.random.default_rng(0)
IMAGES = {1: np.repeat(R.integers(0, 5, 120), R.choice([1, 1, 1, 2, 2, 3, 4, 7, 150, 300], 120)), 2: R.integers(0, 256, 500), 3: np.array([5]), 4: np.array([7] * 300), 5: np.array([1, 1]), 6: np.array([1, 1, 1]),
          None: np.array([9, 9, 9, 9, 1])}


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(i, p, int(b)) for i, x in IMAGES.items() for p, b in enumerate(x)], "image_id long, p long, b int")


def of(df, i):
    return df[df.image_id.isna()] if i is None else df[df.image_id == i]


@pytest.mark.parametrize("stretch", [4096, 13])
def test_packets_are_the_codec_s(px, stretch):
    got = runlength.coded(px, stretch).toPandas()
    for i, x in IMAGES.items():
        own = of(got, i).sort_values("at")
        assert own["at"].tolist() == list(range(len(own))) and bytes(own.b.tolist()) == blocks.rle_encode(x.astype(np.uint8))


def test_packets_come_back(spark, px):
    got = runlength.decoded(runlength.coded(px), 13).toPandas()
    for i, x in IMAGES.items():
        assert of(got, i).sort_values("p").b.tolist() == x.tolist()
    cut = spark.createDataFrame([(1, 0, 254), (1, 1, 7)], "image_id long, at long, b int")  # two literals, of which one is there
    assert [(r.p, r.b) for r in runlength.decoded(cut).collect()] == [(0, 7)]
    assert runlength.decoded(cut.limit(0)).count() == 0 and runlength.coded(px.limit(0)).count() == 0


def test_huffman(px):
    symbols = px.withColumnRenamed("b", "v")
    codes = entropy.canonical_codes(entropy.code_lengths(symbols.groupBy("image_id", "v").agg(F.count("*").alias("n"))))
    table = codes.toPandas()
    for i, x in IMAGES.items():
        own = of(table, i)
        least = blocks.code_lengths(dict(zip(own.v.tolist(), own.n.tolist(), strict=True)))
        assert sum(own.n * own.length) == sum(n * least[v] for v, n in zip(own.v, own.n, strict=True))
        lengths = np.zeros(256, np.int64)
        lengths[own.v.astype(int)] = own.length
        assert (blocks.canonical(lengths)[own.v.astype(int)].astype(np.int64) == own.code).all()
    coded = entropy.coded(symbols, codes)
    words = entropy.packed(coded, 13)
    got = words.toPandas()
    for i in (1, 2, 4):
        own = of(table, i).set_index("v")
        raw, _ = blocks.pack_bits(own.code[IMAGES[i]].to_numpy(), own.length[IMAGES[i]].to_numpy())
        assert b"".join(int(b).to_bytes(4, "big") for b in of(got, i).sort_values("word").bits)[: len(raw)] == raw
    back = entropy.unpacked(words, codes, coded.groupBy("image_id").agg(F.sum("length").alias("size"))).toPandas()
    for i, x in IMAGES.items():
        assert of(back, i).sort_values("p").v.tolist() == x.tolist()


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_codes_are_read_stretch_by_stretch(spark, monkeypatch, stretch):
    """Pointers are followed from stretch to stretch, and not from bit to bit."""
    images = {1: R.geometric(0.3, 5000) % 40, 2: np.array([7] * 300), 3: np.array([5]), None: R.integers(0, 200, 700)}
    symbols = spark.createDataFrame([(i, p, int(v)) for i, x in images.items() for p, v in enumerate(x)], "image_id long, p long, v int")
    codes = entropy.canonical_codes(entropy.code_lengths(symbols.groupBy("image_id", "v").agg(F.count("*").alias("n"))))
    coded = entropy.coded(symbols, codes)
    words, seen, walked = stored.stored(entropy.packed(coded), "t"), [], entropy.walked
    monkeypatch.setattr(entropy, "walked", lambda links, tag: seen.append(links.count()) or walked(links, tag))
    more = {} if stretch == 256 else {"stretch": stretch}
    back = entropy.unpacked(words, codes, coded.groupBy("image_id").agg(F.sum("length").alias("size")), **more).toPandas()
    for i, x in images.items():
        assert of(back, i).sort_values("p").p.tolist() == list(range(len(x))) and of(back, i).sort_values("p").v.tolist() == x.tolist()
    assert seen[0] <= 32 * sum(-(-r.n // stretch) for r in words.groupBy("image_id").agg(F.count("*").alias("n")).collect())


def test_long_codes_are_packed(spark):
    codes = [(1, p, (1 << n) - 1 if p % 2 else 1, n) for p, n in enumerate([58, 1, 33, 58, 2, 31, 32, 40])]
    got = entropy.packed(spark.createDataFrame(codes, "image_id long, p long, code long, length int")).orderBy("word").collect()
    raw, total = blocks.pack_bits(np.array([c for *_, c, _ in codes], np.uint64), np.array([n for *_, n in codes]))
    assert b"".join(r.bits.to_bytes(4, "big") for r in got)[: len(raw)] == raw and len(got) == -(-total // 32)


@pytest.mark.parametrize("width, height", [(8, 8), (7, 5), (9, 6), (1, 4), (13, 11)])
@pytest.mark.parametrize("top", [1000, 60000])
def test_wavelet_is_the_codec_s(spark, width, height, top):
    x = R.integers(0, top + 1, (height, width)).astype(np.uint16)
    px = spark.createDataFrame([(1, i, j, int(x[j, i]), top >= 1 << 14) for j in range(height) for i in range(width)], "image_id long, x int, y int, v int, wide boolean")
    forth = wavelet.transformed(px, width, height)
    want, got, back = x.copy(), np.zeros(x.shape, int), np.zeros(x.shape, int)
    blocks.wavelet(want, top)
    for r in forth.collect():
        got[r.y, r.x] = r.v
    for r in wavelet.transformed(forth, width, height, inverse=True).collect():
        back[r.y, r.x] = r.v
    assert (got == want).all() and (back == x).all()


@pytest.mark.parametrize("stretch", [4096, 10])
def test_byte_planes(spark, stretch):
    values = [(i, s, 100 * s + k, 2 + s % 3, int(R.integers(0, 1 << (8 * (2 + s % 3))))) for i in (1, 2) for s in range(7) for k in range(0 if s == 3 else 5 + s)]
    v = spark.createDataFrame(values, "image_id long, segment long, p long, width int, v long")
    data = planes.split(v, stretch)
    got = data.toPandas()
    for i in (1, 2):
        want = b""
        for s in range(7):
            each = [x.to_bytes(w, "big") for a, g, _, w, x in values if (a, g) == (i, s)]
            want += b"".join(bytes(z[j] for z in each) for j in range(len(each[0]) if each else 0))
        own = of(got, i).sort_values("at")
        assert own["at"].tolist() == list(range(len(want))) and bytes(own.b.tolist()) == want
    assert {(r.image_id, r.p): r.v for r in planes.merged(data, v, stretch).collect()} == {(i, p): x for i, _, p, _, x in values}


def test_stored_tables_are_released(spark):
    df = stored.stored(spark.range(3), "t")
    at = stored.MADE[-1].removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(at)
    stored.release(spark)
    assert not os.path.isdir(at) and not stored.MADE


def test_stretches(spark):
    data = [(i, int(p), int(n)) for i in (1, 2, None) for p, n in zip(np.sort(R.choice(300, 60, replace=False)), R.integers(0, 9, 60), strict=True)]
    df = spark.createDataFrame(data, "image_id long, p long, n long")
    sums = stretches.with_before(df, {"before": F.col("n")}, stretch=7).collect()
    last = stretches.with_previous(df, {"was": F.col("n")}, stretch=7).collect()
    for r in sums:
        assert r.before == sum(n for i, p, n in data if i == r.image_id and p < r.p)
    for r in last:
        earlier = [(p, n) for i, p, n in data if i == r.image_id and p < r.p]
        assert r.was == (max(earlier)[1] if earlier else None) and r["_first"] == (not earlier)
    chain = spark.createDataFrame([(1, 0, 3), (1, 3, 4), (1, 4, 9), (1, 5, 6), (2, 0, 5)], "image_id long, at long, next long")
    assert sorted((r.image_id, r["at"], r["rank"]) for r in stretches.walked(chain, "t").collect()) == [(1, 0, 0), (1, 3, 1), (1, 4, 2), (2, 0, 0)]


@pytest.mark.parametrize("name, most", [("huffman_lengths", 2), ("xmp_parse", 1)])
def test_folds_are_worked_out_once(spark, name, most):
    """A fold that a plan repeats for each field, or for each element of a list, costs time for each."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("aggregate(") <= most
