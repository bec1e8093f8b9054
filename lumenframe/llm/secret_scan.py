"""Secret scans: a character convolutional network in numpy over every candidate and its context."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, trimmed, written

# Fixed patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINT = re.compile(r"password|passwd|secret|token|api_?key", re.A | re.I)
#: Further candidates: unbroken runs, but for words: runs of letters of one case, with at most a capital first, of fewer than LONG_WORD characters.
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
WORD = re.compile(r"[A-Z]?[a-z]+[.-]?|[A-Z]+[.-]?")
LONG_WORD = 20
#: Runs that are known not to be secrets, the evidence for the negative examples: words with signs between them, numbers with signs between them.
NO_SECRET = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,5})(?:[._/-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,5}))*[._/-]*")
KINDS = ("assign", "access", "hex", "cnn")

WIDTH, CONTEXT = 64, 24
#: Labelled findings used to train, at most; texts that they are taken from, at most.
MAX_FINDINGS, MAX_TEXTS = 6_000, 20_000
#: Share of labelled secrets that the threshold must keep.
RECALL = 0.99
ALPHABET = "".join(map(chr, range(32, 127)))
CODE = np.zeros(256, np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, len(ALPHABET) + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base findings: leftmost and non-overlapping for each kind, those too short dropped."""
    out = []
    if HINT.search(text):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs that the network judges, whatever their length."""
    return [m.span() for m in RUN.finditer(text) if m.end() - m.start() >= LONG_WORD or not WORD.fullmatch(m.group())]


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate as overlapping pieces of WIDTH that cover it whole; it scores as the highest of them."""
    if end - start <= WIDTH:
        return [(start, end)]
    return [(a, a + WIDTH) for a in range(start, end - WIDTH, WIDTH // 2)] + [(end - WIDTH, end)]


def encoded(texts: list[tuple[str, int, int]]) -> np.ndarray:
    """Character codes of each piece (text, start, end; WIDTH characters at most): the context before, the piece, and the context after, with a mark on
    the piece."""
    out = np.zeros((len(texts), WIDTH + 2 * CONTEXT, 2), np.int64)
    for k, (text, a, z) in enumerate(texts):
        if z - a > WIDTH:
            raise ValueError(f"{z - a} characters: cut candidates by pieces() first")
        left = text[max(0, a - CONTEXT) : a].rjust(CONTEXT, "\x00")
        right = text[z : z + CONTEXT].ljust(CONTEXT, "\x00")
        raw = np.frombuffer((left + text[a:z].ljust(WIDTH, "\x00") + right).encode("latin-1", "replace"), np.uint8)
        out[k, :, 0] = CODE[raw]
        out[k, CONTEXT : CONTEXT + z - a, 1] = 1
    return out


class Network:
    """Embedding, one convolution of width 5 with ReLU, mean and max over positions, logistic output; trained by Adam with full reproducibility."""

    SIZE, FILTERS, SPAN = 8, 24, 5

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = len(ALPHABET) + 1
        self.p = {"e": r.normal(0, 0.3, (n, self.SIZE)), "w": r.normal(0, 0.15, (self.SPAN * (self.SIZE + 1), self.FILTERS)),
                  "c": np.zeros(self.FILTERS), "o": r.normal(0, 0.1, 2 * self.FILTERS), "b": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        p = self.p
        h = np.concatenate([p["e"][x[:, :, 0]], x[:, :, 1:]], 2)
        cols = np.concatenate([h[:, k : h.shape[1] - self.SPAN + 1 + k] for k in range(self.SPAN)], 2)
        a = np.maximum(cols @ p["w"] + p["c"], 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        return pooled @ p["o"] + p["b"][0], (cols, a, top, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[k : k + 512])[0] for k in range(0, len(x), 512)] or [np.zeros(0)])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.shift, -30, 30)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict:
        z, (cols, a, top, pooled) = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = {"o": pooled.T @ d, "b": np.array([d.sum()])}
        dp = d[:, None] * self.p["o"]
        da = np.repeat(dp[:, None, self.FILTERS :] / a.shape[1], a.shape[1], 1)
        n, f = np.ogrid[: len(x), : self.FILTERS]
        da[n, top, f] += dp[:, : self.FILTERS]
        da *= a > 0
        g["c"] = da.sum((0, 1))
        g["w"] = np.einsum("nti,ntf->if", cols, da)
        dc = da @ self.p["w"].T
        de = np.zeros_like(self.p["e"])
        each, t = self.SIZE + 1, dc.shape[1]
        for k in range(self.SPAN):
            np.add.at(de, x[:, k : k + t, 0].ravel(), dc[:, :, k * each : k * each + self.SIZE].reshape(-1, self.SIZE))
        g["e"] = de
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, open_: np.ndarray, epochs: int = 8, rate: float = 0.01, seed: int = 7) -> Network:
        """Trains on three fifths; a fifth calibrates the logistic scale, and the last sets the highest threshold that keeps RECALL of those of its
        secrets that the network decides (open_: no base pattern finds them)."""
        fifths = np.array_split(np.random.default_rng(seed).permutation(len(y)), 5)
        used, scale, last = np.concatenate(fifths[:3]), fifths[3], fifths[4]
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            for part in np.array_split(np.random.default_rng(seed + epoch).permutation(used), max(1, len(used) // 64)):
                g, step = self.gradient(x[part], y[part]), step + 1
                for k, v in g.items():
                    m[k][0][...] = 0.9 * m[k][0] + 0.1 * v
                    m[k][1][...] = 0.999 * m[k][1] + 0.001 * v * v
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)
        z, t = self.logits(x[scale]), y[scale]
        for _ in range(200):
            e = 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30))) - t
            self.slope, self.shift = float(np.clip(self.slope - 0.1 * (e * z).mean(), 0.2, 3)), float(self.shift - 0.1 * e.mean())
        decided = last[(y[last] > 0) & open_[last]]
        if len(decided):
            self.threshold = float(np.quantile(self.probability(x[decided]), 1 - RECALL, method="lower"))
        return self


#: Kinds of made-up secrets: (prefix, alphabet, groups, letters of a group from, to, sign between groups). The last three are for tests only.
UP, LOW, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SECRETS = {
    "base64": ("", UP + LOW + DIGIT + "+/", 1, 20, 90, ""), "upper hex": ("", DIGIT + "ABCDEF", 1, 20, 64, ""), "mixed": ("", UP + LOW + DIGIT, 1, 14, 60, ""),
    "upper": ("", UP + DIGIT, 1, 14, 40, ""), "lower": ("", LOW + DIGIT, 1, 14, 40, ""), "prefixed": ("sk_", UP + LOW + DIGIT, 1, 16, 40, ""),
    "grouped": ("", UP + DIGIT, 4, 4, 6, "-"), "two parts": ("", UP + LOW + DIGIT, 2, 10, 30, "."), "padded": ("", UP + LOW + DIGIT + "+/", 1, 22, 60, "=="),
    "web token": ("eyJ", UP + LOW + DIGIT + "-_", 3, 20, 60, "."), "url safe": ("", UP + LOW + DIGIT + "-_", 1, 24, 64, ""), "labelled": ("ghp_", UP + LOW + DIGIT, 1, 30, 40, ""),
}
HELD_KINDS = ("web token", "url safe", "labelled")
PLAIN = ("snake", "path", "repeated", "joined", "camel", "dotted", "time", "version", "mail", "number", "file", "kebab")
HELD_PLAIN = ("file", "kebab")
PARTS = ("under", "score", "value", "long", "name", "path", "file", "data", "index", "section", "chapter", "part", "user", "report", "final", "north", "order", "list", "image", "total")


def made_up(seed: int = 11, n: int = 2400, held: bool = False) -> list[tuple[str, int, int, int, str]]:
    """Labelled examples (text, start, end, secret, kind) of kinds that the documents may lack: random keys of the kinds SECRETS in and out of assignments,
    and harmless runs of the kinds PLAIN. held picks the kinds that training never sees, for tests."""
    r = np.random.default_rng(seed)
    pick = lambda options: options[r.integers(len(options))]
    word = lambda: pick(PARTS)
    number = lambda most: str(r.integers(most))
    kinds = [k for k in SECRETS if (k in HELD_KINDS) == held]
    plain = [k for k in PLAIN if (k in HELD_PLAIN) == held]
    before = ["the ", "see ", "in ", "", "of ", "and ", "| ", '"', "("]
    names = ["key", "auth", "credential", "private_key", "access", "pwd", "bearer", "client", "cert"]
    out = []
    for k in range(n):
        if k % 2:
            kind = pick(kinds)
            prefix, letters, groups, low, high, sign = SECRETS[kind]
            lead = f"{pick(names)}{pick([' = ', '=', ': ', ' '])}{pick(['', chr(34)])}" if r.random() < 0.5 else pick(before)
            body = [("".join(letters[i] for i in r.integers(0, len(letters), r.integers(low, high + 1)))) for _ in range(groups)]
            body = prefix + (sign.join(body) if groups > 1 else body[0] + sign)
        else:
            kind, lead = pick(plain), pick(before)
            body = {
                "snake": lambda: "_".join(word() for _ in range(r.integers(3, 7))), "path": lambda: "/".join(word() for _ in range(r.integers(3, 7))),
                "repeated": lambda: pick("-=_a0.") * int(r.integers(12, 60)), "joined": lambda: "".join(word() for _ in range(r.integers(3, 7))),
                "camel": lambda: "".join(word().title() for _ in range(r.integers(2, 6))), "dotted": lambda: ".".join(word() for _ in range(r.integers(2, 6))) + pick([".com", ".org", ".net"]),
                "time": lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}-{r.integers(10, 60)}", "version": lambda: f"{word()}-{number(30)}.{number(20)}.{number(400)}",
                "mail": lambda: f"{word()}.{word()}{number(99)}.{word()}.com", "number": lambda: f"{number(10**9)}.{number(10**9)}", "file": lambda: f"{word()}_{r.integers(2000, 2030)}_{word()}.pdf",
                "kebab": lambda: "-".join([word(), word(), number(99), word()]),
            }[kind]()
            body = body.ljust(12, "x")
        out.append((lead + body + pick([" and more", '"', ".", "\nnext", ")"]), len(lead), len(lead) + len(body), k % 2, kind))
    return out


def _findings(batches):
    """Windows around labelled findings: base findings are secrets; runs that NO_SECRET explains and no base finding touches are not. Runs without such
    evidence are not labelled at all."""
    for batch in sliced(batches):
        rows = []
        for text in batch["text"].to_pylist():
            text = text or ""
            base, plain = base_spans(text), 0
            for a, z, _ in base:
                rows += [(text[max(0, p - CONTEXT) : q + CONTEXT], min(p, CONTEXT), min(p, CONTEXT) + q - p, 1) for p, q in pieces(a, z)]
            for m in RUN.finditer(text):
                a, z = m.span()
                if plain < 8 and NO_SECRET.fullmatch(m.group()) and not any(s < z and a < e for s, e, _ in base):
                    rows += [(text[max(0, p - CONTEXT) : q + CONTEXT], min(p, CONTEXT), min(p, CONTEXT) + q - p, 0) for p, q in pieces(a, z)[:1]]
                    plain += 1
        if rows:
            t, a, z, y = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"text": pa.array(t, pa.string()), "a": pa.array(a, pa.int32()), "z": pa.array(z, pa.int32()), "y": pa.array(y, pa.int32())})


def trained(docs: DataFrame) -> Network:
    """The network, from labelled findings of at most about MAX_TEXTS documents drawn by a hash of the text (MAX_FINDINGS of them by hash), and made-up
    ones, which stand for the kinds that no base pattern finds. The base patterns label the findings of the documents."""
    n = docs.count()
    rows = docs.select("text").filter("text IS NOT NULL")
    if n > MAX_TEXTS:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * MAX_TEXTS / n))
    found = written(rows.mapInArrow(_findings, "text string, a int, z int, y int").distinct(), "secret-findings")
    got = []
    for y in (1, 0):  # each kind bounded by half of MAX_FINDINGS
        got += found.filter(F.col("y") == y).orderBy(F.xxhash64("text", "a", "z"), "text", "a", "z").limit(MAX_FINDINGS // 2).collect()
    samples = [(r["text"], r["a"], r["z"], r["y"], False) for r in got]
    samples += [(t, p, q, y, y == 1 and not base_spans(t)) for t, a, z, y, _ in made_up() for p, q in pieces(a, z)[:1]]
    return Network().fit(encoded([s[:3] for s in samples]), np.array([s[3] for s in samples], float), np.array([s[4] for s in samples]))


def spans_of(texts: list[str | None], network: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, probability) of each text's secrets, by start and kind."""
    texts, tried = [t or "" for t in texts], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        tried += [(k, a, z, i) for a, z, i in base]
        tried += [(k, a, z, 3) for a, z in candidates(text) if not any(s <= a and z <= e for s, e, _ in base)]
    each = [(n, texts[k], a, z) for n, (k, p, q, _) in enumerate(tried) for a, z in pieces(p, q)]
    highest = np.zeros(len(tried))
    for at in range(0, len(each), 512):
        part = each[at : at + 512]
        np.maximum.at(highest, [e[0] for e in part], network.probability(encoded([e[1:] for e in part])))
    out: list[list] = [[] for _ in texts]
    for (k, a, z, i), p in zip(tried, highest.tolist(), strict=True):
        if i < 3 or p >= network.threshold:
            out[k].append((a, z, i, p))
    return [sorted(o, key=lambda s: (s[0], s[2], s[1])) for o in out]


def scanned(docs: DataFrame, network: Network) -> DataFrame:
    """docs with secrets: array of (start, end, kind, probability), code points, end exclusive, by start and kind. Base findings stay whatever the
    network says; of the other candidates, which no base finding covers wholly, those at or above its threshold are added as kind cnn.

    Whole texts in one pass. A null or empty text has none; equal rows get equal answers; an empty table stays empty; a column named secrets in docs
    is replaced."""
    docs = docs.drop("secrets")
    kind = "array<struct<start: int, end: int, kind: string, probability: double>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", secrets {kind}"
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("probability", pa.float64())]))

    @trimmed
    def run(batches):
        for batch in sliced(batches):
            value = [[{"start": a, "end": z, "kind": KINDS[i], "probability": q} for a, z, i, q in o] for o in spans_of(batch["text"].to_pylist(), network)]
            yield batch.append_column("secrets", pa.array(value, arrow))

    return docs.mapInArrow(run, schema)


def redacted(docs: DataFrame, network: Network, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by mark; all rows and columns stay."""
    schema = docs.schema

    @trimmed
    def run(batches):
        for batch in sliced(batches):
            texts = batch["text"].to_pylist()
            for k, spans in enumerate(spans_of(texts, network)):
                if spans:
                    out, at = [], 0
                    for a, z, _, _ in spans:
                        if a >= at:
                            out += [texts[k][at:a], mark]
                        at = max(at, z)
                    texts[k] = "".join([*out, texts[k][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch[c] for c in schema.names], names=schema.names)

    return docs.mapInArrow(run, schema)


def op7_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scanned(docs, trained(docs))

    def joined(which):
        return F.concat_ws(",", F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter("secrets", lambda x: x["kind"] != "cnn")

    def count(kind):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
