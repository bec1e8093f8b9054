"""The manifest against a plain one: trees of every small size, parts cut anywhere, null and repeated rows, groups of one row, tampering."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import merkle, registry

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The root, and for each leaf its siblings and the root that f(leaf) folds to."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])

    def siblings(k):
        out = []
        for level in levels[:-1]:
            out.append((k & 1, level[k ^ 1] if k ^ 1 < len(level) else None))
            k >>= 1
        return out

    return levels[-1][0], [siblings(k) for k in range(len(nodes))]


def fold(node, steps):
    for right, x in steps:
        node = sha(node) if x is None else sha(x, node) if right else sha(node, x)
    return node


def plain(rows):
    leaf = lambda d, t, g, s, n: sha(*map(field, (d, s, g, n, t)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    subs = {}
    for g, part in by.items():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[g] = tree([leaf(*r) for r in part])
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    root, over = tree([subs[g][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for r, steps in zip(by[g], subs[g][1], strict=True):
            steps = steps + over[j]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            back = fold(leaf(*r[:4], r[4] + 1) if hit else leaf(*r), steps)
            out.append((r[0], leaf(*r), subs[g][0], root, sha(*(x for _, x in steps if x)), back, back == root))
    return sorted(out, key=repr)


ROWS = [(k, f"text {k} é", g, None if k % 5 else "s", None if k % 11 == 3 else k) for g, n in (("en", 45), ("fr", 9), (None, 4), ("", 1), ("ê", 2), ("z", 1)) for k in range(n)]
ROWS += [(None, "no id", "en", "s", 1), (3, "another of the id", "en", "s", 1), (7, None, "fr", None, None), (50, "", "en", "s", 0), (51, "long " * 50_000, "en", "s", 250_000)] + [(60, "copies", "en", "s", 6)] * 30


@pytest.mark.parametrize("part, ranges, stride", [(20_000, 50_000, 8), (3, 10, 1), (7, 13, 2), (1, 5, 3)])
def test_against_a_plain_tree(spark, monkeypatch, tmp_path, part, ranges, stride):
    for name, v in (("PART_ROWS", part), ("RANGE_ROWS", ranges), ("STRIDE", stride)):
        monkeypatch.setattr(merkle, name, v)
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, SCHEMA).withColumn("node", F.lit("clash")).withColumn("part", F.lit(1)).write.parquet(at)
    got = merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(ROWS)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(1, "a", None, None, None)], [(1, "a", "x", None, 1), (14, "b", "y", None, 2)]])
def test_small_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=repr) == plain(rows) if rows else True
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(con.sql(registry.ORACLE_SQL["op13_merkle_manifest"]).fetchall()) == len(rows)


@pytest.mark.parametrize("n", range(1, 18))
def test_subtrees_tile_any_stretch(n):
    leaves = [hashlib.sha256(bytes([k])).hexdigest().encode() for k in range(n)]
    root, _ = tree([x.decode() for x in leaves])
    for a in range(n):
        for z in range(a + 1, n + 1):
            tops = [t for lo, hi in ((0, a), (a, z), (z, n)) for t in merkle.subtrees(lo, n, leaves[lo:hi])[1]]
            high = (n - 1).bit_length()
            assert sum(min(n, (k + 1) << h) - (k << h) for h, k, _ in tops) == n
            assert merkle.climbed(tops, n, high)[0].decode() == root
