"""Licence notices in files that hold many of them, against a plain search."""

import random

from lumenframe.llm import licenses


def test_all_notices_of_a_file(spark):
    texts = {label: text for label, text, _ in licenses.TEMPLATES}
    pick = random.Random(4)
    rows = [(0, list(texts)), (1, ["bsd", "apache-2.0", "proprietary"]), (2, [])] + [(k, pick.sample(list(texts), 1 + k % 11)) for k in range(3, 60)]
    docs = spark.createDataFrame([(k, " some other prose ".join(texts[x] for x in labels)) for k, labels in rows], "doc_id long, text string")
    got = {r.doc_id: {x.tid for x in r.places or []} & set(texts) for r in licenses.scanned(docs).collect()}
    for k, labels in rows:
        assert got[k] >= set(labels), k
