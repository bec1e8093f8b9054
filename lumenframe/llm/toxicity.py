"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, trimmed, written

# Look-alike letters of other scripts, and digits and signs that stand in for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "!": "i"}
#: In these phrases a listed word is no insult; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clownfish")

FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
FOLD |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF), None)
WORD = re.compile(r"[^\W\d_]+")
TAIL = re.compile(r"[^\W\d_]+\Z")

#: Labelled documents used to learn from, at most, drawn by a hash of the id. All documents are scored.
MAX_TRAIN = 30_000
#: Entries of the lexicon, at most: a size of the model.
MAX_ENTRIES = 4_000
#: Exception phrases that are learned, at most: a size of the model.
MAX_EXCEPTIONS = 1_000
#: Least hashes that say whether two texts are copies; the weight of a document without copies.
SKETCH, UNIT = 4, 1 << 20
SHORTEST, LONGEST = 4, 9
MIN_DOCS, MIN_LOG_ODDS = 6, 3.0
#: Log-likelihood gain over the base rate that an entry's documents must show, beyond the log of the number of entries that were tried.
MIN_GAIN = 2.0


def fold(text: str) -> str:
    """Lower case, look-alikes and stand-in digits and signs as Latin letters, invisible characters gone."""
    return text.lower().translate(FOLD)


@dataclass
class Model:
    """Entries (a word, or a stem of words) and weights; coefficients of the logistic scale over the features."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    scale: tuple[float, ...] = (-4.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            auto.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            auto.add_word(fold(phrase), (len(fold(phrase)), None))
        auto.make_automaton()
        return auto


def features(auto, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For each text log(1 + weight found) and log(1 + weight found per hundred words), and the spans found in the folded text. An entry counts where
    a word begins with it and no exception phrase covers it; of entries that begin at one place the heaviest counts."""
    out, spans = np.zeros((len(texts), 2)), []
    for k, text in enumerate(texts):
        folded, found, excepted = fold(text or ""), {}, []
        for end, (n, weight) in auto.iter(folded) if len(auto) else ():
            start = end - n + 1
            if start and folded[start - 1].isalpha():
                continue
            if weight is None:
                excepted.append((start, end + 1))
            elif start not in found or found[start][0] < weight:
                found[start] = (weight, end + 1)
        if excepted:
            found = {s: x for s, x in found.items() if not any(a <= s < b for a, b in excepted)}
        if found:
            total, words = sum(w for w, _ in found.values()), folded.count(" ") + folded.count("\n") + 1
            out[k] = np.log1p(total), np.log1p(100 * total / (words + 20))
        spans.append([(s, e) for s, (_, e) in sorted(found.items())])
    return out, spans


def phrases_at(folded: str, start: int, end: int) -> list[str]:
    """The word of the folded text that the found place begins, with the word before it and with the one after it, where one space parts them."""
    word = WORD.match(folded, start)
    z, out = word.end(), []
    if start > 1 and folded[start - 1] == " " and (before := TAIL.search(folded, max(0, start - 42), start - 1)):
        out.append(f"{before.group()} {folded[start:z]}")
    if folded[z : z + 1] == " " and (after := WORD.match(folded, z + 1)):
        out.append(f"{folded[start:z]} {after.group()}")
    return out


def probability(x: np.ndarray, scale) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(scale[0] + x @ np.asarray(scale[1:]), -30, 30)))


def fitted_scale(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression of weighted rows by Newton's method, slightly shrunk, with the rarer class weighted up to at most half of the other's weight."""
    a, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ones = (weight * y).sum()
    pos = max(1.0, min(0.5 * (weight.sum() - ones) / max(1.0, ones), 10.0))
    w = np.where(y > 0, pos, 1.0) * weight
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, a.T @ (w * (y - p)) - ridge * b)
        b = b + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _words(text: str | None) -> list[str]:
    return WORD.findall(fold(text or ""))


def _word_counts(batches, most: int = 200_000):
    """(word, n0, n1) rows, weights of the documents that hold a word; they are passed on whenever so many words have gathered."""
    counts: list[Counter] = [Counter(), Counter()]

    def rows():
        words = [list(c) for c in counts]
        zeros = [[0] * len(w) for w in words]
        return pa.RecordBatch.from_pydict({
            "word": pa.array(words[0] + words[1], pa.string()),
            "n0": pa.array([counts[0][w] for w in words[0]] + zeros[1], pa.int64()),
            "n1": pa.array(zeros[0] + [counts[1][w] for w in words[1]], pa.int64()),
        })

    for batch in sliced(batches):
        for text, toxic, weight in zip(*(batch[c].to_pylist() for c in ("text", "toxic", "weight")), strict=True):
            for w in {w for w in _words(text) if SHORTEST <= len(w) <= 40}:
                counts[toxic][w] += weight
        if sum(map(len, counts)) > most:
            yield rows()
            counts = [Counter(), Counter()]
    yield rows()


def signature(text: str | None) -> str:
    """Equal for copies and for most near copies, and for hardly any other texts: a hash of the SKETCH least hashes of the text's three-word shingles, or of
    all its words if it has no more shingles than that."""
    words = _words(text)
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(len(words) - 2)}
    if len(hashes) <= SKETCH:
        return "w" + xxhash.xxh128_hexdigest(" ".join(words))
    return "s" + xxhash.xxh128_hexdigest(" ".join(map(str, sorted(hashes)[:SKETCH])))


def _signed(batches):
    for batch in sliced(batches):
        yield batch.append_column("copies_of", pa.array([signature(t) for t in batch["text"].to_pylist()], pa.string()))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, toxic (0/1), weight: at most about max_train labelled documents, drawn by a hash of the id. Every one of them counts; documents
    that are (near) copies of each other and have one label share the weight of one document, UNIT, between them."""
    labels = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    if n > max_train:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")  # bounded by max_train rows of 12 bytes
    rows = written(rows.mapInArrow(_signed, "doc_id long, text string, toxic int, copies_of string"), "toxicity-signed")
    copies = rows.groupBy("copies_of", "toxic").agg((F.lit(float(UNIT)) / F.count("*")).cast("long").alias("weight"))
    # The weights are max_train short rows at most: broadcast, so that a large group of copies stays where it is.
    return rows.join(F.broadcast(copies), ["copies_of", "toxic"]).select("doc_id", "text", "toxic", "weight")


def learned(train: DataFrame) -> Model:
    """The lexicon, the exception phrases and the scale, from training rows (text, toxic, weight). Weights are whole numbers, so that sums do not depend
    on their order and reruns agree."""
    words = train.mapInArrow(_word_counts, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    totals = {r["toxic"]: r["n"] / UNIT for r in train.groupBy("toxic").agg(F.sum("weight").alias("n")).collect()}
    t0, t1 = totals.get(0, 0), totals.get(1, 0)
    if not t0 or not t1:
        return Model({})
    stems = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST))), lambda k: F.substring(F.col("word"), F.lit(1), k))
    entries = words.select(F.explode(F.array_distinct(F.concat(stems, F.array("word")))).alias("entry"), "n0", "n1")
    entries = entries.groupBy("entry").agg((F.sum("n0") / UNIT).alias("n0"), (F.sum("n1") / UNIT).alias("n1"))
    entries = written(entries.filter(F.col("n1") >= MIN_DOCS), "toxicity-entries")
    tried = np.log(max(1, entries.count()))
    odds = F.log((F.col("n1") + 0.5) / (t1 + 1.0)) - F.log((F.col("n0") + 0.5) / (t0 + 1.0))
    entries = entries.withColumn("w", F.round(odds, 6)).filter(F.col("w") >= MIN_LOG_ODDS)
    found = entries.orderBy(F.desc(F.round(F.col("w") * F.log(F.col("n1") + 1.0), 6)), "entry").limit(MAX_ENTRIES).collect()
    at = {r["entry"]: (r["w"], r["n1"]) for r in found}
    # A stem goes where one longer entry accounts for it, as "path" does not stand for "pathetic"; then a longer entry where a stem of its own says nearly as much.
    wide = {e[:k] for e in at for k in range(SHORTEST, len(e)) if e[:k] in at and at[e][1] >= 0.98 * at[e[:k]][1]}
    at = {e: x for e, x in at.items() if e not in wide}
    kept = {e: w for e, (w, _) in at.items() if not any(e[:k] in at and at[e[:k]][0] >= w - 0.7 for k in range(SHORTEST, len(e)))}
    model = Model(kept)

    def hits(batches):
        auto = model.automaton()
        for batch in sliced(batches):
            texts = [fold(t or "") for t in batch["text"].to_pylist()]
            places = features(auto, texts)[1]
            found = [sorted({t[a:b] for a, b in s}) for t, s in zip(texts, places, strict=True)]
            phrases = [sorted({p for a, b in s for p in phrases_at(t, a, b)}) for t, s in zip(texts, places, strict=True)]
            yield pa.RecordBatch.from_pydict({"toxic": batch["toxic"], "weight": batch["weight"], "found": pa.array(found, pa.list_(pa.string())), "phrases": pa.array(phrases, pa.list_(pa.string()))})

    def counted(column):
        """Weights of the training documents of either label that hold each of column's strings."""
        each = met.select("toxic", "weight", F.explode(column).alias("x")).groupBy("x").agg(
            *(F.sum(F.when(F.col("toxic") == y, F.col("weight")).otherwise(0)).alias(f"n{y}") for y in (0, 1)))
        return each.select("x", (F.col("n0") / UNIT).alias("n0"), (F.col("n1") / UNIT).alias("n1"))

    # Stems counted a word at a time so far; now by document, and kept if chance does not explain them.
    met = written(train.mapInArrow(hits, "toxic int, weight long, found array<string>, phrases array<string>").filter(F.size("found") > 0), "toxicity-hits")
    sure, base = {}, t1 / (t0 + t1)
    for r in counted("found").collect():  # MAX_ENTRIES rows at most
        n0, n1 = r["n0"] + 0.5, r["n1"] + 0.5
        w = np.log(n1 / (t1 + 1)) - np.log(n0 / (t0 + 1))
        gain = n1 * np.log(n1 / (n0 + n1) / base) + n0 * np.log(n0 / (n0 + n1) / (1 - base))
        if w >= 2 and gain >= MIN_GAIN + tried:
            sure[r["x"]] = round(float(w), 6)
    # Two-word phrases around entries that only clean documents hold: there the entry is no insult.
    mild = counted("phrases").filter(f"n0 >= {MIN_DOCS} AND n1 < 0.02 * n0").orderBy(F.desc("n0"), "x").limit(MAX_EXCEPTIONS).collect()
    model = Model(sure, tuple(dict.fromkeys([*EXCEPTIONS, *sorted(r["x"] for r in mild)])))

    def measured(batches):
        auto = model.automaton()
        for batch in sliced(batches):
            x, _ = features(auto, batch["text"].to_pylist())
            yield pa.RecordBatch.from_pydict({"a": pa.array(x[:, 0]), "b": pa.array(x[:, 1]), "toxic": batch["toxic"], "weight": batch["weight"]})

    got = train.mapInArrow(measured, "a double, b double, toxic int, weight long").toPandas()  # bounded by max_train rows
    got = got.sort_values(["toxic", "b", "a", "weight"])  # sums in one order, so that reruns agree
    model.scale = fitted_scale(got[["a", "b"]].to_numpy(), got["toxic"].to_numpy().astype(float), got["weight"].to_numpy() / UNIT)
    return model


def scored(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1), predicted (1 from threshold on) and n_found (places). Whole texts in one pass; a null or empty text has no places and
    scores what the scale gives to that. Equal rows score alike; an empty table stays empty; columns of those names in docs are replaced."""
    docs = docs.drop("score", "predicted", "n_found")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int, n_found int"

    @trimmed
    def run(batches):
        auto = model.automaton()
        for batch in sliced(batches):
            x, spans = features(auto, batch["text"].to_pylist())
            p = probability(x, model.scale)
            batch = batch.append_column("score", pa.array(p)).append_column("predicted", pa.array((p >= threshold).astype(np.int32)))
            yield batch.append_column("n_found", pa.array([len(s) for s in spans], pa.int32()))

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from the labels whose document is not held out."""
    return learned(written(training_rows(docs, labels.filter(~held_out(F.col("doc_id"))), max_train), "toxicity-train"))


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
