"""Licence scans by a positional rare-token index. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import found_grams, gram_hash, written

# Base phrases, and notices with the phrase that must stand in the text (publicly known licence wording).
BASE = [("apache", "apache license"), ("gpl", "general public license"), ("mit", "mit license")]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "without fee"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "all rights reserved", "rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released"),
]
#: Too frequent in any prose to index.
STOP = frozenset("a all and any are for in into is of or the this to under use with".split())
#: The weight share of a notice that must stand at its place.
SHARE = 0.6


def postings() -> list[tuple[str, str, bool, int, bool, int, int]]:
    """(template, label, base, off, in the key phrase, words of the key phrase, words) and the word, for each indexed word of each template."""
    out = []
    for label, phrase in BASE:
        words = phrase.split()
        out += [(f"base {label}", label, True, k, True, len(words), w) for k, w in enumerate(words)]
    for label, text, phrase in TEMPLATES:
        words, key = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out += [(label, label, False, k, at <= k < at + len(key), len(key), w) for k, w in enumerate(words) if w not in STOP]
    return out


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)


def template_table(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_rows(postings())} AS t(tid, label, base, off, mandatory, n_mandatory, word)")


def scanned(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score and places (template, first word), one row for
    each input row.

    One pass over the documents finds the places of the templates' words (a fixed table of under 200 rows, so broadcast). Their IDF is taken over all
    documents. Each place is looked up in the postings; a posting proposes where its template would start, and of all words of that template those
    at the right relative positions are summed by IDF. A start counts if the mandatory phrase stands there word by word and share of the weight is
    found, however many notices and licence words the file holds. Base phrases are templates that are mandatory throughout. score is the largest
    share of a counted place, 0 without one.

    Nulls and blank texts have no words and no labels; a repeated row gets the same answer again; no documents, no rows."""
    spark = docs.sparkSession
    templates = template_table(spark)
    words = templates.select(F.col("word").alias("sid")).distinct()
    grams = words.select("sid", F.col("sid").alias("gram"), F.lit(1).alias("n")).withColumn("w", F.array("sid")).withColumn("h", gram_hash("w", F.lit(0), 1))
    places = written(found_grams(docs, grams.drop("w"), [1]), "licence-places")
    rows, found = places.filter("p = -1").select("doc_id", "th", "n_words"), places.filter("p >= 0").select("doc_id", "th", "p", "sid").distinct()
    seen = found.select("doc_id", "th", "sid").distinct()
    n = rows.count()
    idf = words.join(seen.groupBy("sid").count(), "sid", "left").select("sid", F.log(F.lit(float(n) + 1) / (F.coalesce("count", F.lit(0)) + 1)).alias("idf"))
    idf = idf.withColumn("idf", F.greatest("idf", F.lit(1e-6)))
    idf = written(idf, "licence-idf")
    t = templates.withColumnRenamed("word", "sid").join(F.broadcast(idf), "sid")
    t = t.withColumn("whole", F.sum("idf").over(Window.partitionBy("tid")))
    at = found.join(F.broadcast(t), "sid").withColumn("start", F.col("p") - F.col("off"))
    at = at.groupBy("doc_id", "th", "tid", "label", "base", "start", "n_mandatory", "whole").agg(
        F.sum("idf").alias("idf"), F.sum(F.col("mandatory").cast("int")).alias("got"))
    at = at.filter(F.col("got") == F.col("n_mandatory")).withColumn("share", F.least(F.round(F.col("idf") / F.col("whole"), 6), F.lit(1.0)))
    at = at.filter(F.col("base") | (F.col("share") >= share))
    of = at.groupBy("doc_id", "th").agg(
        F.sum(F.col("base").cast("int")).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"), F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"), F.max("share").alias("score"), F.sort_array(F.collect_list(F.struct("start", "tid"))).alias("places"))
    on = F.col("r.th").eqNullSafe(F.col("o.th")) & F.col("r.doc_id").eqNullSafe(F.col("o.doc_id"))
    none = F.array().cast("array<string>")
    return rows.alias("r").join(of.alias("o"), on, "left").select(
        "r.doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "places")


def op6_licenses(spark, sf_dir):
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")
    return out.withColumn("base_labels", F.concat_ws(",", "base_labels")).withColumn("labels", F.concat_ws(",", "labels"))


assert all(re.fullmatch(r"[a-z0-9. -]+", x) for row in postings() for x in row if isinstance(x, str))

OP6_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_rows(postings())}) v(tid, label, base, off, mandatory, n_mandatory, word)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
f AS (SELECT * FROM p WHERE word IN (SELECT word FROM t)),
idf AS (SELECT word, greatest(ln(((SELECT count(*) FROM d)::DOUBLE + 1) / (count(DISTINCT doc_id) + 1)), 1e-6) AS idf FROM (SELECT DISTINCT word FROM t) LEFT JOIN f USING (word) GROUP BY word),
w AS (SELECT t.*, idf, sum(idf) OVER (PARTITION BY tid) AS whole FROM t JOIN idf USING (word)),
a AS (SELECT f.doc_id, tid, label, base, p - off AS start, n_mandatory, whole, sum(idf) AS idf, sum(mandatory::INT) AS got
  FROM f JOIN w USING (word) GROUP BY ALL),
s AS (SELECT *, least(round(idf / whole, 6), 1.0) AS share FROM a WHERE got = n_mandatory),
o AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM s WHERE base OR share >= {SHARE} GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN o USING (doc_id)
"""
