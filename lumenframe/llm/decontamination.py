"""Benchmark decontamination: a prefix-filtered set join with exact containment. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, found_grams, gram_hash, with_words, word_places, words_at, written

WINDOW = 10
#: Words of a shingle; a shorter window is one shingle of its own length.
SHINGLE = 5


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """wid, item_id, n (words of the window), off, gram, gn (words of the shingle), h: one row for each shingle of each distinct item window."""
    rows = with_words(benchmark.select("item_id", "text")).filter(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(window)))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))))
    rows = rows.select("item_id", "n", F.slice("words", F.col("at") + 1, F.col("n")).alias("w")).distinct()
    rows = rows.withColumn("wid", F.concat_ws(" ", "w")).withColumn("gn", F.least(F.col("n"), F.lit(shingle)))
    rows = rows.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("gn"))))
    h = F.coalesce(*(F.when(F.col("gn") == k, gram_hash("w", F.col("off"), k)) for k in range(1, shingle + 1)))
    return rows.select("wid", "item_id", "n", "off", F.concat_ws(" ", F.slice("w", F.col("off") + 1, F.col("gn"))).alias("gram"), "gn", h.alias("h"))


def _in_blocks(table: DataFrame, weight, found, shingle: int, sizes: str = "n") -> DataFrame:
    """found(part of table, its shingle sizes) for parts whose summed weight keeps the broadcast bound; rows for whole documents come from the first."""
    size = table.agg(F.sum(weight).alias("b"), F.sort_array(F.collect_set(sizes)).alias("n")).first()
    blocks, out = max(1, -(-(size["b"] or 0) // BROADCAST_BYTES)), None
    for k in range(blocks):
        part = found(table.filter(F.pmod("h", F.lit(blocks)) == k) if blocks > 1 else table, size["n"] or [shingle])
        part = part.filter("p >= 0") if k and "p" in part.columns else part
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items whose windows occur, sorted as strings), spans (start, end of hit words, merged), one row
    for each input row.

    A window is a set of positioned shingles. They are ordered by rarity, that is by their places in all documents, which a first pass counts.
    Containment must be whole, so the rarest shingle alone is a long enough prefix, and a window that has a shingle without places cannot occur. A second
    pass looks up the prefix shingles only: a place proposes a start of the window, the positional bound asks that it lies in the document, the length
    bound that the window fits, and the words there are held against the window itself, as long as the item's window is.

    Shingles and prefixes are broadcast after their size is measured; larger ones are taken in blocks that each keep the bound, one pass over the documents
    each. Nulls: a null or empty text has no words; items without words have no windows; a null item_id counts for hits but names no item. Texts are
    read whole, whatever their length. A repeated row gets the same answer again. Empty tables give no rows, or documents without hits. Columns other
    than doc_id (item_id) and text are not read."""
    windows = written(item_windows(benchmark, window, shingle), "decon-windows")
    grams = windows.select("gram", F.col("gn").alias("n"), "h").distinct().withColumn("sid", F.monotonically_increasing_id())
    grams = written(grams, "decon-grams")
    counts = written(_in_blocks(grams, F.octet_length("gram") + 64, lambda part, sizes: found_grams(docs, part, sizes).filter("p >= 0").groupBy("sid").count(), shingle), "decon-counts")

    ws = windows.select("wid", "n", "off", "gram", "gn", "h").distinct().join(grams.select("gram", "sid"), "gram").drop("gram").join(counts, "sid", "left")
    each = ws.groupBy("wid", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "off", "gn", "h")).alias("rarest")).filter("rarest.count > 0")
    each = written(each.select("wid", "n", F.col("rarest.off").alias("off"), F.col("rarest.gn").alias("gn"), F.col("rarest.h").alias("h"), F.monotonically_increasing_id().alias("w")), "decon-prefixes")

    def contained(part: DataFrame, sizes: list[int]) -> DataFrame:
        g = F.broadcast(part.select("w", "wid", F.col("n").alias("wn"), "off", "gn", F.col("h").alias("gh")))
        places = word_places(docs, sizes).join(g, F.col("h") == F.col("gh"), "left").withColumn("start", F.col("p") - F.col("off"))
        bound = (F.col("n") == F.col("gn")) & (F.col("start") >= 0) & (F.col("start") + F.col("wn") <= F.col("n_words"))
        places = places.filter((F.col("p") == -1) | (bound & (words_at(F.col("start"), F.col("wn")) == F.col("wid"))))
        return places.select("doc_id", "th", "n_words", "p", "start", F.col("wn").alias("n"), "w")

    places = written(_in_blocks(each, F.octet_length("wid") + 96, contained, shingle, "gn"), "decon-places")
    rows, hits = places.filter("p = -1").select("doc_id", "th", "n_words"), places.filter("p >= 0").select("doc_id", "th", "start", "n", "w").distinct()
    hits = written(hits, "decon-hits")

    key = ["doc_id", "th"]
    reach = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*key, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    spans = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(reach), F.lit(-1))).cast("int"))
    spans = spans.withColumn("run", F.sum("new").over(Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    of = windows.select("wid", "n", "item_id").distinct().join(each.select("wid", "n", "w"), ["wid", "n"]).select("w", "item_id")
    items = hits.select(*key, "w").distinct().join(of, "w").groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    def and_(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        on = F.col("l.th").eqNullSafe(F.col("r.th")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
        return left.alias("l").join(right.alias("r"), on, "left").select("l.*", *(F.col(f"r.{c}") for c in columns))

    out = and_(and_(rows, spans, "n_hit", "spans"), items, "items")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce("items", none).alias("items"), "spans")


def op1_decontaminate(spark, sf_dir):
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s0 FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s0, s0 + n - 1), ' ') AS t FROM bw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s0 FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
h AS (SELECT doc_id, s0, dw.n, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.t = array_to_string(list_slice(w, s0, s0 + dw.n - 1), ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s0, s0 + n)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""
