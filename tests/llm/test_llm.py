"""Each operator against a plain version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import decontamination, jaccard, licenses, mixing, neighbours, registry, secret_scan, suffix_arrays, suffix_automata, toxicity, urls

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97} x{i % 89}" for i in range(4000))
SHARED = " ".join(f"shared{i}" for i in range(70))
ROWS = [(1, None, "a"), (2, "", "a"), (3, LONG, "b"), (4, "start " + SHARED + " end", None), (5, SHARED + " tail", "b"), (5, SHARED + " tail", "b"), (6, "same words here", "a"),
        (7, "same words here", "a"), (8, LONG + " more", "c"), (None, "same words here", "c"), (9, "É È The MIT License. AKIA" + "Z" * 20, "a"), (10, " \t\n", "a")]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("words", F.lit(1)).withColumn("n_words", F.lit("clash")).withColumn("b", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(rows, split, n):
    first, out = {}, {}
    key = lambda d: 1 << 62 if d is None else d
    for d, t in rows:
        s = split(t)
        for i in range(len(s) - n + 1):
            k = s[i : i + n] if isinstance(s, bytes) else tuple(s[i : i + n])
            first[k] = min(first.get(k, 1 << 63), key(d))
    for d, t in rows:
        s = split(t)
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - n + 1):
            if first[s[i : i + n] if isinstance(s, bytes) else tuple(s[i : i + n])] < key(d):
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(s, np.uint8)[~gone]) if isinstance(s, bytes) else b" ".join(x for x, g in zip(s, gone, strict=True) if not g)
        out[d] = (len(s), kept)
    return out


@pytest.mark.parametrize("op, split", [(suffix_arrays.ByteRepeats(), lambda t: t), (suffix_automata.WordRepeats(), lambda t: t.split())])
def test_substrings(docs, empty, op, split):
    got = op.run(docs, "t").collect()
    want = cut([(d, (t or "").encode()) for d, t, _ in ROWS], split, 50)
    assert len(got) == len(ROWS) and {r.doc_id: (r.n, bytes(r.kept)) for r in got} == want
    assert op.run(empty, "t").count() == 0


def test_shards_merge():
    r = np.random.default_rng(1)
    base = r.integers(97, 101, 400).astype(np.uint8)
    parts = [base[k : k + 80] for k in r.integers(0, 320, 60)]
    payload, offsets = np.concatenate(parts), np.arange(61) * 80
    args = (payload, offsets, np.full(60, 31), np.zeros(60, np.uint64), np.arange(60) % 23)
    one, many = suffix_arrays.flagged(*args, shard=1 << 30), suffix_arrays.flagged(*args, shard=200)
    auto = suffix_automata.flagged(payload, offsets, np.full(60, 31), np.zeros(60, np.uint64), np.arange(60) % 23, shard=100)
    assert one.any() and (one == many).all() and (one == auto).all()


@pytest.mark.parametrize("n, percent, most, hot", [(3, 90, 4_000, 2_000), (5, 80, 4_000, 2), (3, 70, 2, 2_000), (3, 80, 3, 3)])
def test_jaccard(spark, docs, empty, monkeypatch, n, percent, most, hot):
    monkeypatch.setattr(jaccard, "MOST_MEMBERS", most)  # small: groups are split, and opened once for a few askers each
    monkeypatch.setattr(jaccard, "MOST_TOKENS", 100 * most)
    monkeypatch.setattr(jaccard, "HOT_TOKEN", hot)  # small: the documents of nearly every shared token are dealt to several shards
    rows = [(d, t) for d, t, _ in ROWS if d is not None] + [(100 + k, " ".join(f"t{i}" if i != k else "zz" for i in range(60 + k))) for k in range(8)]
    rows += [(200 + k, " ".join(f"u{i}" if i not in (3 * k, 40) else f"y{k}" for i in range(60 + k % 5))) for k in range(14)]
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.JaccardJoin(n, percent).run(spark.createDataFrame(rows, "doc_id long, text string"), "t").collect()
    assert {r.doc_id: (r.size, r.component_id) for r in got} == {d: (len(sets[d]), root[d]) for d in sets}
    assert jaccard.JaccardJoin(n, percent).run(docs, "t").filter("doc_id IS NULL").first().component_id == 6
    assert jaccard.JaccardJoin(n, percent).run(empty, "t").count() == 0


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        a, b = registry.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        a, b = a.sort_values("doc_id").reset_index(drop=True), b.sort_values("doc_id").reset_index(drop=True)
        for c in b.columns:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), (name, c)


def test_decontamination_edges(spark, docs, empty):
    bench = spark.createDataFrame([(1, "same words"), (2, None), (3, SHARED), (None, "w0 x0 w1")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contaminated(docs, bench).collect()}
    assert got[6].n_hit == 2 and got[6]["items"] == ["1"] and got[4].n_hit == 70 and got[1].n_words == 0 and got[3].n_hit > 0 and got[3]["items"] == []
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_licenses_and_mixing_edges(docs, empty):
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert got[9].base_labels == ["mit"] and got[1].n_words == 0 and licenses.scanned(empty).count() == 0
    mix = mixing.mixed(docs).collect()
    assert len(mix) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in mix) and mixing.mixed(empty).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "https://A.Org/x"), (4, "http://www.example.org/es/1"), (5, "http://x.com/de/1?q=1#f"), (6, "http://x.com"), (7, "http://notorg/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1][:3] == ("", "", None) and got[3] == ("a.org", "/x", "org/", "allow") and got[4][2:] == ("example.org/es/", "block")
    assert got[5] == ("x.com", "/de/1", "com/de/", "block") and got[6][2] is None and got[7][2] is None
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_secrets(docs, empty):
    text = "token: secret: abcdefghijklmn password='abcdefghijkl' AKIAABCDEFGHIJKLMN 0123456789abcdef ſecret=abcdefghijklmn"
    kinds = [(text[a:z], k) for a, z, k in secret_scan.base_spans(text)]
    assert kinds == [("password='abcdefghijkl", 0), ("AKIAABCDEFGHIJKLMN", 1), ("0123456789abcdef", 2)]
    net = secret_scan.trained(docs)
    test = secret_scan.made_up(99)
    p = np.array([net.probability(secret_scan.encoded([(x, *piece) for piece in secret_scan.pieces(a, z)])).max() for x, a, z, *_ in test])
    with pytest.raises(ValueError, match="pieces"):
        secret_scan.encoded([("x" * 65, 0, 65)])
    assert ((p >= net.threshold) == np.array([t[3] for t in test])).mean() > 0.9
    got = {r.doc_id: r.secrets for r in secret_scan.scanned(docs, net).collect()}
    assert [s.kind for s in got[9]] == ["access"] and got[1] == [] and secret_scan.scanned(empty, net).count() == 0
    assert "[SECRET]" in {r.doc_id: r.text for r in secret_scan.redacted(docs, net).collect()}[9]


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(300)]
    bad = [(k, " ".join([words[i] for i in r.integers(0, 300, 30)] + (["nastiness" if k % 3 else "vileness"] if k % 4 == 0 else []))) for k in range(400)]
    d, y = spark.createDataFrame(bad, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    model = toxicity.trained(d, y)
    got = toxicity.scored(d, model).join(y, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert got.filter("predicted = toxic").count() > 0.95 * got.count()
    assert toxicity.scored(docs, model).count() == len(ROWS) and toxicity.scored(empty, model).count() == 0
    assert toxicity.fold("Іd1ОT") == "idiot"
    auto = toxicity.Model({"trash": 5.0}).automaton()
    assert [len(s) for s in toxicity.features(auto, ["such trash", "a trash can", "hightrash", None])[1]] == [1, 0, 0, 0]


def test_neighbours(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (460, [1.0])]
    got = defaultdict(list)
    for q in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, window=1.0).collect():
        got[q.query_id].append((q["rank"], q.vec_id))
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == np.argsort(-s[q], kind="stable")[:20].tolist()


def test_hilbert_is_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(neighbours.hilbert(grid, 3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_digests(spark):
    out = suffix_automata.op10_substring_dedup(spark, SF).filter("n_words = 0 OR n_removed = n_words").collect()
    assert all(r.kept_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
