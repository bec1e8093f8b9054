"""Huffman codes as Columns: lengths by merging two queues, canonical codes, and bits packed into words and read back."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.xmp import let
from ..plans.stored import stored
from .stretches import STRETCH, walked, with_before

LONGEST = 58
WORD = 32
#: Words of a stretch that is read by itself, and of what is worked on at once.
WORDS, PIECE = 256, 8192


def _merged(counts: Column) -> Column:
    """Of counts in ascending order: leaves and inner nodes in the order in which two queues give them up, each with the step that takes it. Each step
    takes the least two of both queues (leaves first where they are equal) and puts their sum at the end of the second; sums only grow, so both stay in
    order. A fold over half steps."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("long").alias("held"), F.array().cast("array<bigint>").alias("sums"), F.array().cast("array<int>").alias("leaves"), F.array().cast("array<int>").alias("inner"))

    def half(s, t):
        leaf = (s.i < F.size(counts)) & ((s.j >= F.size(s.sums)) | (F.get(counts, s.i) <= F.get(s.sums, s.j)))
        weight = F.when(leaf, F.get(counts, s.i)).otherwise(F.get(s.sums, s.j))
        step = F.array(F.floor(t / 2).cast("int"))
        return F.struct(
            F.when(leaf, s.i + 1).otherwise(s.i).alias("i"), F.when(leaf, s.j).otherwise(s.j + 1).alias("j"), F.when(s.held.isNull(), weight).alias("held"),
            F.when(s.held.isNull(), s.sums).otherwise(F.concat(s.sums, F.array(s.held + weight))).alias("sums"),
            F.when(leaf, F.concat(s.leaves, step)).otherwise(s.leaves).alias("leaves"), F.when(leaf, s.inner).otherwise(F.concat(s.inner, step)).alias("inner"))

    return F.aggregate(F.sequence(F.lit(0), 2 * F.size(counts) - 3), state, half)


def code_lengths(counts: DataFrame) -> DataFrame:
    """image_id, v, n, length: a code of least cost for each image's symbols (image_id, v, n). An image has no more than 65,537 symbols, so they are one
    row; a lone symbol has one bit."""
    rows = counts.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("symbols"))

    # The last step makes the root; inner nodes are given up in the order in which they were made, so depths follow backwards from it.
    def of_tree(tree, m):
        depth = lambda a, x: F.concat(a, F.array(F.get(a, m - 2 - x) + 1))
        return let(F.aggregate(F.reverse(tree["inner"]), F.array(F.lit(0)), depth), lambda depths: F.transform(tree["leaves"], lambda x: F.get(depths, m - 2 - x) + 1))

    def of_counts(counts):
        return F.when(F.size(counts) > 1, let(_merged(counts), lambda tree: of_tree(tree, F.size(counts)))).otherwise(F.array(F.lit(1)))

    rows = rows.withColumn("lengths", let(F.transform("symbols", lambda x: x["n"]), of_counts))
    return rows.select("image_id", F.explode(F.arrays_zip("symbols", "lengths")).alias("x")).select("image_id", "x.symbols.v", "x.symbols.n", F.col("x.lengths").alias("length"))


def first_codes(lengths: DataFrame) -> DataFrame:
    """image_id, counts and firsts: arrays by length from 1, how many codes there are and the first of them. Longer codes are smaller numbers: half of what
    the longer ones take up, carried down from the longest."""
    per = lengths.groupBy("image_id", "length").agg(F.count("*").alias("n")).groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("m"))
    rows = per.withColumn("counts", F.transform(F.sequence(F.lit(1), F.lit(LONGEST)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0))))
    state = F.struct(F.lit(0).cast("long").alias("code"), F.array().cast("array<bigint>").alias("firsts"))
    down = lambda s, n: F.struct(F.shiftright(s.code + n, 1).alias("code"), F.concat(F.array(s.code), s.firsts).alias("firsts"))
    return rows.withColumn("firsts", F.aggregate(F.reverse("counts"), state, down)["firsts"]).select("image_id", "counts", "firsts")


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """lengths (image_id, v, length and any others) with code: by length, and by symbol within a length."""
    firsts = first_codes(lengths).select(F.col("image_id").alias("_i"), "firsts")
    rank = F.row_number().over(Window.partitionBy("image_id", "length").orderBy("v")) - 1
    rows = lengths.withColumn("_k", rank).join(firsts, lengths["image_id"].eqNullSafe(F.col("_i")))
    return rows.withColumn("code", F.get("firsts", F.col("length") - 1) + F.col("_k")).drop("_i", "_k", "firsts")


def coded(px: DataFrame, codes: DataFrame) -> DataFrame:
    """image_id, p, code, length of symbols (image_id, p, v). A symbol that half of an image has is no hot key: the codes of all images are broadcast
    while they are few, and joined by image and symbol, with Spark splitting large partitions, where they are many."""
    c = codes.select(F.col("image_id").alias("_i"), F.col("v").alias("_v"), "code", "length")
    if codes.limit((1 << 17) + 1).count() <= 1 << 17:
        c = F.broadcast(c)
    return px.join(c, px["image_id"].eqNullSafe(F.col("_i")) & (px["v"] == F.col("_v"))).select("image_id", "p", "code", "length")


def packed(codes: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """image_id, word, bits: codes (image_id, p, code, length of at most LONGEST bits) one after the other in the order of p, highest bit first, in words
    of 32 bits. A code's place is the sum of the lengths before it; its parts meet those of its neighbours in a bitwise or."""
    df = with_before(codes, {"at": F.col("length").cast("long")}, stretch=stretch)
    df = df.withColumn("_end", F.col("at") + F.col("length")).withColumn("word", F.explode(F.sequence(F.floor(F.col("at") / WORD), F.floor((F.col("at") + F.col("length") - 1) / WORD))))
    left = ((F.col("word") + 1) * WORD - F.col("_end")).cast("int")
    part = F.when(left >= 0, F.expr("shiftleft(code, _left)")).otherwise(F.expr("shiftrightunsigned(code, -_left)")).bitwiseAND(F.lit((1 << WORD) - 1))
    return df.withColumn("_left", left).select("image_id", "word", part.alias("bits")).groupBy("image_id", "word").agg(F.bit_or("bits").alias("bits"))


def _followed(batch, starts: list[np.ndarray]):
    """Of stretches (w, more, counts, firsts, bits) and the bits of each at which a code may begin: for each such begin, in order, its stretch, the bit behind
    its last code and the codes, then all codes: which begin they follow from, which in order they are, and their place among the image's codes."""
    rows = len(batch["w"])
    words = batch["w"].flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
    n = pc.list_value_length(batch["w"]).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(n)
    row = np.repeat(np.arange(rows), n)
    after = np.append(words[1:], np.uint64(0))
    after[end - 1] = batch["more"].to_numpy(zero_copy_only=False).astype(np.uint64)
    ahead = ((words << np.uint64(WORD) | after)[:, None] >> (WORD - np.arange(WORD)).astype(np.uint64)) & np.uint64((1 << WORD) - 1)
    ahead = ahead.astype(np.int64)
    counts, firsts = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, WORD) for c in ("counts", "firsts"))
    earlier = np.cumsum(counts, axis=1) - counts
    length, place = np.zeros(ahead.shape, np.int64), np.zeros(ahead.shape, np.int64)
    for k in np.flatnonzero(counts.any(axis=0)).tolist():
        rank = (ahead >> (WORD - 1 - k)) - firsts[row, k][:, None]
        fits = (length == 0) & (rank >= 0) & (rank < counts[row, k][:, None])
        length[fits] = k + 1
        place[fits] = (rank + earlier[row, k][:, None])[fits]
    first = (end - n) * WORD
    bit = np.arange(len(words) * WORD) - np.repeat(first, n * WORD)
    length = np.where(bit < np.repeat(batch["bits"].to_numpy(zero_copy_only=False).astype(np.int64), n * WORD), length.ravel(), 0)
    place = place.ravel()
    of = np.repeat(np.arange(rows), [len(x) for x in starts])
    at, last = first[of] + np.concatenate(starts), (end * WORD)[of]
    total, codes, live, step = np.zeros(len(of), np.int64), [], np.arange(len(of)), 0
    while True:
        live = live[at[live] < last[live]]
        live = live[length[at[live]] > 0]
        if not len(live):
            break
        codes.append((live, np.full(len(live), step), place[at[live]]))
        total[live] += 1
        at[live] += length[at[live]]
        step += 1
    codes.append((np.zeros(0, np.int64),) * 3)
    return of, at - first[of], total, *(np.concatenate(x) for x in zip(*codes, strict=True))


def _pieces(batches):
    """Batches cut to about PIECE words."""
    for batch in batches:
        a, ends = 0, np.cumsum(pc.list_value_length(batch["w"]).to_numpy(zero_copy_only=False))
        while a < batch.num_rows:
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, "right")))
            yield batch.slice(a, z - a)
            a = z


def unpacked(words: DataFrame, codes: DataFrame, sizes: DataFrame, stretch: int = WORDS) -> DataFrame:
    """image_id, p (from 0), v: packed words read back. codes: image_id, v, length, code. sizes: image_id, size, the bits that count.

    At a bit begins the code of the shortest length whose next bits lie among the codes of that length. Words are cut into stretches. Codes are followed
    through each stretch from each of the 32 bits at which its first one can begin; what is left is a chain from stretch to stretch, followed by jumping
    pointers, and the codes from the begin that it finds are read. Codes longer than 32 bits are not read."""
    same = lambda a, b: a.eqNullSafe(F.col(b))
    kind = words.schema["image_id"].dataType.simpleString()
    most = stretch * WORD
    # The first word of a stretch is also seen by the stretch before.
    own = F.floor(F.col("word") / stretch)
    both = F.when((F.col("word") % stretch == 0) & (F.col("word") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    cut = words.withColumn("s", F.explode(both)).withColumn("here", F.floor(F.col("word") / stretch) == F.col("s"))
    cut = cut.groupBy("image_id", "s").agg(F.array_sort(F.collect_list(F.when(F.col("here"), F.struct("word", "bits")))).alias("w"), F.max(F.when(~F.col("here"), F.col("bits"))).alias("more"))
    image = first_codes(codes).select("image_id", F.slice("counts", 1, WORD).alias("counts"), F.slice("firsts", 1, WORD).alias("firsts"))
    image = image.join(sizes.select(F.col("image_id").alias("_j"), "size"), same(image["image_id"], "_j")).withColumnRenamed("image_id", "_i").drop("_j")
    cut = cut.join(image, same(cut["image_id"], "_i"))
    cut = stored(cut.select("image_id", "s", F.col("w.bits").alias("w"), F.coalesce("more", F.lit(0).cast("long")).alias("more"), "counts", "firsts", (F.col("size") - F.col("s") * most).alias("bits")), "stretches")

    def entered(batches):
        for batch in _pieces(batches):
            s = batch["s"].to_numpy(zero_copy_only=False)
            starts = [np.arange(WORD if k else 1) for k in s.tolist()]
            of, at, total, *_ = _followed(batch, starts)
            yield pa.RecordBatch.from_arrays([batch["image_id"].take(pa.array(of)), pa.array(s[of] * most + np.concatenate(starts)), pa.array(s[of] * most + at), pa.array(total)], ["image_id", "at", "next", "n"])

    links = stored(cut.mapInArrow(entered, f"image_id {kind}, at long, next long, n long"), "links")
    found = walked(links.select("image_id", "at", "next"), "huffman").select(F.col("image_id").alias("_i"), F.col("at").alias("_a"))
    found = links.join(found, same(links["image_id"], "_i") & (links["at"] == F.col("_a"))).select("image_id", "at", "n")
    found = with_before(found, {"first": F.col("n")}, order="at", stretch=STRETCH * most)
    found = found.select(F.col("image_id").alias("_i"), F.floor(F.col("at") / most).alias("_s"), (F.col("at") % most).alias("start"), "first")
    begun = cut.join(found, same(cut["image_id"], "_i") & (cut["s"] == F.col("_s"))).drop("_i", "_s")

    def read(batches):
        for batch in _pieces(batches):
            starts = batch["start"].to_numpy(zero_copy_only=False)
            of, _, _, begin, step, place = _followed(batch, [starts[k : k + 1] for k in range(len(starts))])
            p = batch["first"].to_numpy(zero_copy_only=False)[of[begin]] + step
            yield pa.RecordBatch.from_arrays([batch["image_id"].take(pa.array(of[begin])), pa.array(p), pa.array(place)], ["image_id", "p", "place"])

    got = begun.mapInArrow(read, f"image_id {kind}, p long, place long")
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("length", "v")) - 1
    table = codes.select(F.col("image_id").alias("_i"), "v", rank.alias("_k"))
    return got.join(table, same(got["image_id"], "_i") & (got["place"] == F.col("_k"))).select("image_id", "p", "v")
