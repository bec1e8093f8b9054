"""What is trained or iterated: the lexicon, the network, the mixing rates, against plain versions and on what training never saw."""

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import mixing, secret_scan, toxicity


def test_every_distinct_training_text_counts(spark):
    r = np.random.default_rng(6)
    common = ["the", "and", "of", "with"]  # all texts share their most frequent words
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(200)]
    rows = [(k, " ".join(common + [words[i] for i in r.integers(0, 200, 30)]), k % 5 == 0) for k in range(300)]
    rows += [(1000 + k, rows[0][1] + (" also" if k % 2 else ""), True) for k in range(40)] + [(2000, None, False), (2001, "", False)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(y)) for d, _, y in rows], "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    own = got.weight[[d for d in range(1, 300)]]
    assert (own == toxicity.UNIT).all()  # distinct texts, each with its whole weight
    copies = got.weight[[0, *range(1000, 1040)]].sum() / toxicity.UNIT
    assert 0.9 < copies < 2.1  # forty near copies count as one document or two
    assert toxicity.signature(None) == toxicity.signature("") != toxicity.signature("a")


def test_scores_against_a_plain_matcher(spark):
    model = toxicity.Model({"idiot": 4.0, "scum": 3.0}, ("scum layer",), (-2.0, 1.0, 1.0))
    rows = [(1, "You IDI0T and scum"), (2, "a scum layer on the pond"), (3, "nothing at all"), (4, None), (5, "idiots! idiots!"), (6, "myidiot"), (6, "myidiot")]
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        folded = toxicity.fold(text or "")
        found = sum(w for e, w in model.lexicon.items() for k in range(len(folded)) if folded.startswith(e, k) and not folded[k - 1 : k].isalpha() and not folded.startswith("scum layer", k))
        words = folded.count(" ") + folded.count("\n") + 1
        x = (np.log1p(found), np.log1p(100 * found / (words + 20))) if found else (0, 0)
        assert np.isclose(got[d].score, 1 / (1 + np.exp(2 - sum(x)))), d


def test_exception_phrases_are_learned(spark):
    r = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 7)) for _ in range(300)]
    prose = lambda: " ".join(words[i] for i in r.integers(0, 300, 25))
    rows = [(k, f"{prose()} {'you weasel now' if k % 2 else 'a weasel you'} {prose()}", 1) for k in range(300)] + [(1000 + k, f"{prose()} the brown weasel hunts {prose()}", 0) for k in range(20)]
    rows += [(2000 + k, prose(), 0) for k in range(700)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.learned(toxicity.training_rows(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")))
    assert "brown weasel" in model.exceptions and any("weasel".startswith(e) or e == "weasel" for e in model.lexicon)
    got = toxicity.features(model.automaton(), ["the brown weasel", "you weasel"])[1]
    assert [len(x) for x in got] == [0, 1]


def test_network_finds_kinds_it_was_not_trained_on(spark):
    net = secret_scan.trained(spark.createDataFrame([(1, "plain words under the bridge and antidisestablishmentarianism 12.34.56.78")], "doc_id long, text string"))
    held = secret_scan.made_up(99, 800, held=True)
    assert not {x[4] for x in held} & {x[4] for x in secret_scan.made_up()}
    held = [x for x in held if not secret_scan.base_spans(x[0])]
    got = [max(net.probability(secret_scan.encoded([(t, p, q) for p, q in secret_scan.pieces(a, z)]))) >= net.threshold for t, a, z, _, _ in held]
    truth = np.array([y for *_, y, _ in held], bool)
    got = np.array(got)
    assert got[truth].mean() > 0.95 and got[~truth].mean() < 0.05
    key = "kX9vQ2mLr7TzB4nWc8YpD3sHf6JgA1uE"
    text = f"set {key} now, " + "0123456789abcdef" + "/" + key * 4 + " end"
    spans = secret_scan.spans_of([text, None], net)
    kinds = {(text[a:z], secret_scan.KINDS[i]) for a, z, i, _ in spans[0]}
    assert (key, "cnn") in kinds and ("0123456789abcdef", "hex") in kinds and ("0123456789abcdef/" + key * 4, "cnn") in kinds and spans[1] == []


def test_base_findings_of_a_whole_table(spark):
    """The query's base columns against a scan text by text; candidates past any width are covered by their pieces."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in secret_scan.op7_secrets(spark, "/root/testdata/sf0.001").collect()}
    for r in docs.collect():
        base = secret_scan.base_spans(r.text or "")
        assert [got[r.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(i == k for *_, i in base) for k in range(3)]
    for n in (12, 63, 64, 65, 96, 97, 1000):
        parts = secret_scan.pieces(5, 5 + n)
        assert set().union(*(range(a, z) for a, z in parts)) == set(range(5, 5 + n)) and all(z - a <= secret_scan.WIDTH for a, z in parts)


def test_newton_meets_the_constraints(spark):
    sizes = [("a", 1000, 2900.0), ("b", 70, 210.0), (None, 5_000_000, 120.0), ("c", 0, 0.0), ("d", 300, 300.0)]
    targets = spark.createDataFrame(sizes, "source string, source_size long, target double")
    cells = spark.createDataFrame([(s, k, n // 4 if k < 3 else n - 3 * (n // 4)) for s, n, _ in sizes for k in range(4)], "source string, bin int, tokens long")
    got = {r.source: r.rate for r in mixing.balanced_rates(cells, targets).collect()}
    for s, n, t in sizes:
        assert np.isclose(got[s], t / n if n else 0.0, rtol=1e-12)


def test_taken_words_come_near_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("of", F.col("source"))
    got = mixing.mixed(docs, carry=("of",)).groupBy("of").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + r.most for r in got)
