"""Byte-exact substring dedup by suffix arrays: Larsson-Sadakane refinement and Kasai's common prefixes in numpy, shards merged by binary search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from . import bulk
from .spans import Repeats

U = np.uint64
WINDOW = 50
GRAM = 16
#: Bytes under one suffix array.
SHARD = 1 << 20


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number, zeros beyond the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for k in range(8):
        out |= padded[k : k + len(text)].astype(U) << U(56 - 8 * k)
    return out


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, from the eight bytes at each: sorted by these, then each unsettled group by the rank of what follows,
    the sorted length doubling every round. Groups that are settled are not touched again."""
    n = len(first)
    sa = np.argsort(first)
    new = np.concatenate([[True], first[sa[1:]] != first[sa[:-1]]]) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = start
    h = 8
    while h < n:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        pos = sa[at]
        follow = rank[np.minimum(pos + h, n)] + 1
        key = rank[pos] * np.int64(n + 2) + follow
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        sa[at] = pos
        # Groups keep their places, so a group's rank is where its part of the array begins.
        new[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[at]
        h *= 2
    return sa


def common_prefixes(sa: np.ndarray, first: np.ndarray, most: int, stride: int = 32) -> np.ndarray:
    """lcp[i] of sa[i - 1] and sa[i], at most most, by Kasai's recurrence: the common prefix of position p with the one before it in the order is at
    least that of p - 1, less one. Every stride-th position starts from nothing, all of them at once; the stride positions after it each carry on
    from what the position before them has found. Bytes are compared eight at a step."""
    n = len(sa)
    before = np.empty(n, np.int64)  # the position before each position in the order
    before[sa[1:]] = sa[:-1]
    before[sa[:1]] = n
    found = np.zeros(n, np.int64)
    for r in range(min(stride, n)):
        p = np.arange(r, n, stride)
        at = np.maximum(found[p - 1] - 1, 0) if r else np.zeros(len(p), np.int64)
        open_ = np.flatnonzero(before[p] < n)
        at[before[p] == n] = 0
        while len(open_):
            x, y = p[open_] + at[open_], before[p[open_]] + at[open_]
            diff = first[np.minimum(x, n - 1)] ^ first[np.minimum(y, n - 1)]
            diff[np.maximum(x, y) >= n] = U(1 << 63)
            # Leading equal bytes of the eight.
            lead = np.zeros(len(diff), np.int64)
            for j in range(1, 9):
                lead += (diff >> U(64 - 8 * j)) == 0
            at[open_] += lead
            open_ = open_[(lead == 8) & (at[open_] < most)]
        found[p] = np.minimum(at, most)
    return found[sa]


def shard_groups(text: np.ndarray, starts: np.ndarray, ids: np.ndarray, window: int):
    """Of one shard's windows (starts, and the id of each): the distinct windows in order, as fixed-size strings, their smallest ids, and the index
    of each window's string."""
    first = eights(text)
    sa = suffix_array(first)
    lcp = common_prefixes(sa, first, window)
    group = np.empty(len(text), np.int64)
    group[sa] = np.cumsum(np.concatenate([[0], (lcp[1:] < window).astype(np.int64)]))
    used, of = np.unique(group[starts], return_inverse=True)
    smallest = np.full(len(used), np.iinfo(np.int64).max)
    np.minimum.at(smallest, of, ids)
    sample = np.empty(len(used), np.int64)
    sample[of] = starts
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, window)[sample]).view(f"S{window}").ravel()
    return strings, smallest, of


def flagged(payload, offsets, wins, keys, smallest, window: int = WINDOW, shard: int = SHARD) -> np.ndarray:
    """Whether each window also starts in a context of a smaller id. Contexts are dealt to shards in the order of their anchors; each shard has its
    own suffix array, and shards that share an anchor compare their sorted distinct windows by binary search: the first shard of a window gathers its
    smallest id on the way to the last one, and the others take it from there."""
    order = np.argsort(keys, kind="stable")
    sizes = np.diff(offsets)[order]
    of_shard = (np.cumsum(sizes) - sizes) // shard
    at = np.concatenate([[0], np.cumsum(wins)])
    shards = []
    for s in np.unique(of_shard):
        mine = order[of_shard == s]
        size = np.diff(offsets)[mine]
        text = payload[bulk.ranges(offsets[mine], size)]
        local = np.cumsum(size) - size
        starts = bulk.ranges(local, wins[mine])
        ids = np.repeat(smallest[mine], wins[mine])
        shards.append((bulk.ranges(at[mine], wins[mine]), ids, *shard_groups(text, starts, ids, window), keys[mine[0]], keys[mine[-1]]))
    out = np.zeros(at[-1], bool)
    best = [x[3].copy() for x in shards]
    for i, x in enumerate(shards):
        for j in range(i + 1, len(shards)):
            y = shards[j]
            if y[5] > x[6]:  # equal windows have equal anchors
                break
            k = np.searchsorted(y[2], x[2])
            hit = (k < len(y[2])) & (y[2][np.minimum(k, len(y[2]) - 1)] == x[2])
            both = np.minimum(best[i][hit], best[j][k[hit]])
            best[i][hit] = np.minimum(best[i][hit], both)
            best[j][k[hit]] = both
    for (where, ids, _, _, of, _, _), b in zip(shards, best, strict=True):
        out[where] = b[of] < ids
    return out


class ByteRepeats(Repeats):
    def __init__(self, window: int = WINDOW, gram: int = GRAM, **options):
        super().__init__(lambda data, offsets: (bulk.BYTE[data], offsets, data), lambda data: bulk.BYTE[data], lambda *a: flagged(*a, window=window), window, gram, **options)

    def without(self, raw: bytes, lo, hi) -> bytes:
        edges = [0, *(x for r in zip(lo, hi, strict=True) for x in r), len(raw)]
        return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def op5_suffix_dedup(spark, sf_dir):
    out = ByteRepeats().run(spark.read.parquet(f"{sf_dir}/documents.parquet"), "substring_bytes")
    return out.select("doc_id", F.col("n").alias("n_bytes"), (F.col("n") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
