"""Word-exact substring dedup by suffix automata: matching statistics of each document against the documents before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import bulk
from .spans import Repeats

WINDOW = 50
GRAM = 8
#: Words under one automaton; a larger reference is several of them, and documents are streamed through each.
SHARD = 50_000


class Automaton:
    """A suffix automaton of several sequences, grown one sequence at a time."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.words = [-1], [0], 0

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for c in sequence:
            q = nexts[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:  # the step exists, but from longer contexts too
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[last] + 1)
                link[q] = clone
                p = last
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                last = clone
                continue
            new = len(nexts)
            nexts.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = new
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = clone
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = new
        self.words += len(sequence)

    def matches(self, sequence, window: int) -> list[int]:
        """Starts of the windows that occur in what was added: where the matching statistic reaches window."""
        nexts, link, length = self.next, self.link, self.length
        state, n, out = 0, 0, []
        for i, c in enumerate(sequence):
            q = nexts[state].get(c)
            while q is None and state:
                state = link[state]
                n = length[state]
                q = nexts[state].get(c)
            if q is None:
                n = 0
                continue
            state, n = q, n + 1
            if n >= window:
                out.append(i - window + 1)
        return out


def flagged(payload, offsets, wins, keys, smallest, window: int = WINDOW, shard: int = SHARD) -> np.ndarray:
    """Whether each window also starts in a context of a smaller id. Only contexts of one anchor can share a window; they are taken in the order of
    their ids and streamed through the automata of those with smaller ids. What holds no new window adds nothing to them."""
    at = np.concatenate([[0], np.cumsum(wins)])
    out = np.zeros(at[-1], bool)
    order = np.lexsort((smallest, keys))
    first = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    last = np.concatenate([first[1:], [len(order)]]) if len(order) else first
    for a, z in zip(first.tolist(), last.tolist(), strict=True):
        if z - a < 2:  # the anchor's only distinct context is its own reference
            continue
        reference = [Automaton()]
        waiting: list[list] = []
        seen = None
        for c in order[a:z].tolist():
            if smallest[c] != seen:
                for x in waiting:
                    if reference[-1].words > shard:
                        reference.append(Automaton())
                    reference[-1].add(x)
                waiting, seen = [], smallest[c]
            sequence = payload[offsets[c] : offsets[c + 1]].tolist()
            for r in reference:
                found = r.matches(sequence, window)
                if found:
                    out[at[c] + np.array(found)] = True
            if not out[at[c] : at[c + 1]].all():
                waiting.append(sequence)
    return out


def parse(data, offsets):
    hashes, _, _, rows = bulk.words(data, offsets)
    return hashes, rows, hashes


class WordRepeats(Repeats):
    def __init__(self, window: int = WINDOW, gram: int = GRAM, **options):
        super().__init__(parse, lambda hashes: hashes, lambda *a: flagged(*a, window=window), window, gram, **options)

    def without(self, raw: bytes, lo, hi) -> bytes:
        words = raw.split()
        for a, b in zip(reversed(lo), reversed(hi), strict=True):
            del words[a:b]
        return b" ".join(words)


def op10_substring_dedup(spark, sf_dir):
    out = WordRepeats().run(spark.read.parquet(f"{sf_dir}/documents.parquet"), "substring_words")
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]), F.lit(0))
    return out.select("doc_id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
