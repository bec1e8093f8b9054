"""The pipeline and its stages against plain versions, with null ids, repeated rows and null texts."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lumenframe.llm import mixing, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """rows (doc_id, text, source)"""
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def test_mixing_stage_keeps_every_row(spark):
    rows = [(k, f"word{k} " * (1 + k % 7), "ab"[k % 2]) for k in range(300)] + [(None, f"none{k} " * 5, "b") for k in range(20)]
    rows += [(1000, "again and again", "b")] * 9 + [(5, "another text of id 5", "b"), (None, None, "a")]
    docs = table(spark, rows)
    want = Counter((r.doc_id, r["size"], r.copies, r.taken) for r in mixing.mixed(docs).filter("copies > 0").collect())
    got = pipeline.mixing_stage(spark, docs, None).collect()
    assert Counter((r.doc_id, len((r.text or "").split()), r.copies, r.taken) for r in got) == want
    assert sum(n for k, n in want.items() if k[0] is None) > 5 and sum(n for k, n in want.items() if k[0] == 1000) > 5
    assert pipeline.mixing_stage(spark, docs.limit(0), None).count() == 0


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def deduplicated(rows):
    """One row of each component of linked rows: the least id, null last."""
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    key = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    return [rows[min((j for j in range(len(rows)) if root[j] == c), key=key)] for c in sorted(set(root))]


LONG = " ".join(f"w{i}" for i in range(80))
COPIES = [(7, LONG, "a"), (3, LONG + " end", "b"), (3, LONG + " end", "b"), (None, LONG, "a"), (None, "nobody else says this at all", "a"), (4, "one two three four five six", "a"),
          (4, "one two three four five six", "a"), (4, "a text of its own under the same id", "b"), (None, "twice without any id at all", "c"), (None, "twice without any id at all", "c"),
          (9, None, "a"), (None, "", "a"), (3, "clean words that share the id of a copy", "a")]


def test_jaccard_stage_keeps_one_row_of_each_group(spark):
    got = pipeline.jaccard_stage(spark, table(spark, COPIES), None).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in deduplicated(COPIES))
    assert pipeline.jaccard_stage(spark, table(spark, COPIES).limit(0), None).count() == 0


def test_decontamination_stage_judges_each_row(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(15))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"see {item} there", "a"), (1, "clean under the same id", "a"), (None, f"{item}", "a"), (None, "clean without id", "b"), (2, None, "a"), (3, "x " + item, "b"), (3, "x " + item, "b")]
    got = pipeline.decontamination_stage(spark, table(spark, rows), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in rows if item not in (t or ""))
    assert pipeline.decontamination_stage(spark, table(spark, rows).limit(0), str(tmp_path)).count() == 0


KEY = "token = 'q8ZkX0vT3mLw9RbYcN5d'"


def toxic_rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvw") for _ in range(6)) for _ in range(150)]
    prose = lambda n=25: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, f"{prose()} you zyzzyva {prose(5)}" if k % 3 == 0 else prose(), "ab"[k % 2]) for k in range(240)]
    return rows, prose


def test_toxicity_stage_drops_what_the_model_rejects(spark, tmp_path):
    rows, prose = toxic_rows()
    rows += [(None, f"{prose()} zyzzyva zyzzyva", "a"), (None, prose(), "a"), (500, None, "a"), (501, "", None), (7, prose(), "b")]
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.toxicity_stage(spark, table(spark, rows).withColumn("score", F.lit("clash")), str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, _ in rows if "zyzzyva" not in (t or ""))
    assert len({r[pipeline.ROW] for r in got}) == len(got)
    assert pipeline.toxicity_stage(spark, table(spark, rows).limit(0), str(tmp_path)).count() == 0


def test_secrets_stage_redacts_and_keeps_rows(spark):
    rows = [(1, f"see {KEY} there", "a"), (None, "AKIA" + "Q" * 16, "b"), (1, "plain words", "a"), (2, None, "a"), (3, "", "a"), (4, "deadbeef" * 4 + " x " + KEY, "b"), (4, "plain words", "a")]
    got = pipeline.secrets_stage(spark, table(spark, rows), None).collect()
    plain = lambda t: t if t is None else _marked(t)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter((d, plain(t), None if t is None else len(plain(t))) for d, t, _ in rows)
    assert pipeline.secrets_stage(spark, table(spark, rows).limit(0), None).count() == 0


def _marked(text):
    for a, z, _ in reversed(secret_scan.base_spans(text)):
        if "[SECRET]" not in text[a:z]:
            text = text[:a] + "[SECRET]" + text[z:]
    return text


def test_the_whole_pipeline(spark, tmp_path):
    rows, prose = toxic_rows()
    item = prose(14)
    rows += [(300 + k, rows[1][1] + (" end" if k % 2 else ""), "a") for k in range(12)] + [(400, f"{prose()} {item} {prose()}", "b"), (401, f"{prose()} {KEY} {prose()}", "a")]
    rows += [(None, rows[2][1], "a"), (None, prose(), None), (500, None, "a"), (1, prose(), "b")]
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table(spark, rows).withColumn("pipeline_note", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    kept = deduplicated([x for x in rows if "zyzzyva" not in (x[1] or "")])
    kept = [(d, t and _marked(t), s) for d, t, s in kept if item not in (t or "")]
    want = mixing.mixed(table(spark, kept), carry=("text",)).filter("copies > 0").select("doc_id", "text", "copies", "taken").collect()
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.text, r.copies, r.taken) for r in got) == Counter(map(tuple, want)) and len(got) > 100
    assert {r.doc_id for r in got} >= {401, None} and not {300, 400} & {r.doc_id for r in got}
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, str(empty)).count() == 0
