"""Repeated windows across documents, exactly and without comparing all pairs: the frame of the two substring operators.

1. Neighbouring documents form groups of some megabytes and are written once, so that they are never shuffled.
2. Winnowing gives each window an anchor gram that depends on the window's content alone. Each group sends the hashes of its anchors, once each,
   to key shards, which answer which of them stand in two documents or more. However often a gram occurs, a group sends it once.
3. Around such anchors a group cuts contexts (all windows of that anchor at that place). Equal contexts of a group become one class, which goes with
   its least id to the shard of the anchor; which places have which class stays with the group. Equal windows have equal anchors, so all classes
   that can hold a repeated window meet in one shard. The contexts of a hot anchor, one that very many groups hold, are cut into single windows,
   each of which is an anchor of its own, so that text around a passage that half of all documents share is dealt out. As most of that text stands
   nowhere else, the hashes of these windows are counted first, like those of the anchors, and only windows of two documents or more are sent.
4. A shard makes equal classes one, leaves out those that no other class shares an anchor with, and has a matcher (suffix arrays or suffix automata)
   find the windows of the others that also start in a smaller document.
5. The groups hear of each class whether it starts in a smaller document elsewhere, as one bit, and which of its windows do; they cut the texts.

A message goes from a group to a shard only if it holds a key, so messages are never more than keys, and a hot passage is one class a group. A null
doc_id counts as larger than any other; rows with one doc_id do not remove from each other. Null and empty texts have no windows; a text of any
length is worked on whole; an empty table gives no rows; columns other than doc_id and text are not read. Contexts are told apart by two 64-bit
hashes, of the anchor and of the whole context."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk
from .common import grouped, trimmed, written

U = np.uint64
LOW = U((1 << 32) - 1)
#: Context shards for each group, so that what one shard gathers stays below what a group holds.
SHARDS = 1
#: Megabytes of text in a group. Its texts are in memory while it is worked on, in Arrow buffers that grow by doubling: a little under 16 MB wastes least.
GROUP_MB = 12
#: An anchor is hot if more than so many groups hold it, however large the input: what its shard gathers has a bound in bytes, so many groups' contexts.
HOT_GROUPS = 256
#: Keys of one group that are gathered before they are sent.
MOST_KEYS = 8_000_000
LAST_ID = (1 << 63) - 1


def _one(f):
    """f as a function of one table, with freed memory given back; Spark looks at the number of arguments."""
    f = trimmed(f)
    return lambda table: f(table)


def _two(f):
    f = trimmed(f)
    return lambda left, right: f(left, right)


def pack(**arrays) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> dict:
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Shards in the order of the keys, below n (at most 2**32)."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


def short(keys: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The low 32 bits of keys as binary rows; row i has keys[cuts[i]:cuts[i + 1]]. A shard knows its keys' high bits, and that another key of it looks alike
    is rare and does no harm: a context more is compared."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer((keys & LOW).astype(np.uint32))])


def from_short(column) -> tuple[np.ndarray, np.ndarray]:
    """Of binary rows the low 32 bits of their keys, and the row of each."""
    data, offsets = bulk.utf8(column)
    return np.frombuffer(data.tobytes(), np.uint32).astype(U), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // 4)


def codes(shard: np.ndarray, low: np.ndarray) -> np.ndarray:
    return bulk.mix(shard.astype(U)) + low


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in among, which is sorted."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _ids(table) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow.compute as pc

    return pc.fill_null(table["doc_id"].cast(pa.int64()), LAST_ID).to_numpy(), table["th"].to_numpy()


def message(b: int | None, parts: list[np.ndarray], n: int) -> pa.RecordBatch:
    """s, b, once, more of group b's keys, by shard: parts have each key once a document."""
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    used = np.unique(shard_of(keys, n))
    lists = []
    for some in (keys[counts == 1], keys[counts > 1]):
        cuts = np.searchsorted(shard_of(some, n), used)
        lists.append(short(some, np.append(cuts, len(some))))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([b] * len(used), pa.int64()), *lists], names=["s", "b", "once", "more"])


class Repeats:
    """parse: (bytes, offsets) of rows to (symbol hashes, offsets of the rows' symbols, payload of the symbols). symbols: payload to symbol hashes. flagged: (payload, offsets of contexts,
    windows of each, keys, smallest ids) to one boolean a window, whether it also starts in a context of a smaller id; contexts are distinct."""

    def __init__(self, parse: Callable, symbols: Callable, flagged: Callable, window: int, gram: int, hot_groups: int = HOT_GROUPS):
        self.parse, self.symbols, self.flagged, self.window, self.gram, self.hot_groups = parse, symbols, flagged, window, gram, hot_groups

    def sent_keys(self, n: int):
        """s, b, once, more: for each key shard the keys that stand in one and in several documents of group b."""

        @trimmed
        def run(batches):
            now, parts = None, []
            for batch in batches:
                bs = batch["b"].to_numpy()
                cuts = np.append(heads(bs), len(bs))
                for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    # Files are in the order of groups; were they not, a group would send several messages, which does no harm.
                    if parts and (now != bs[first] or sum(map(len, parts)) > MOST_KEYS):
                        yield message(now, parts, n)
                        parts = []
                    now = int(bs[first])
                    for _, _, data, offsets in bulk.chunks(batch["text"].slice(first, last - first)):
                        symbols, at, _ = self.parse(data, offsets)
                        keys, start, _ = bulk.anchors(symbols, at, self.window, self.gram)
                        if len(keys):
                            parts.append(bulk.distinct_by_row(keys, np.searchsorted(at, start, "right"))[0])
            if parts:
                yield message(now, parts, n)

        return run

    def own_keys(self, symbols: np.ndarray, first: np.ndarray, wins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The single windows of contexts and the key of each."""
        single = bulk.ranges(first, wins)
        return single, bulk.mix(bulk.span_hashes(sums, single, single + self.window) ^ U(0x2545F4914F6CDD1D))

    def sent_windows(self, n: int):
        """As sent_keys, the keys of the single windows of one group's hot anchors."""

        def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
            low, row = from_short(keys["hot"])
            hot, parts, out = np.sort(codes(keys["s"].to_numpy()[row], low)), [], []
            b = docs["b"][0].as_py() if docs.num_rows else None
            for _, _, data, offsets in bulk.chunks(docs["text"]) if docs.num_rows and len(hot) else ():
                symbols, at, _ = self.parse(data, offsets)
                key, first, last = bulk.anchors(symbols, at, self.window, self.gram)
                pick = member(codes(shard_of(key, n), key & LOW), hot)
                if pick.any():
                    single, own = self.own_keys(symbols, first[pick], (last - first)[pick] + 1, bulk.prefix_sums(symbols))
                    parts.append(bulk.distinct_by_row(own, np.searchsorted(at, single, "right"))[0])
                    if sum(map(len, parts)) > MOST_KEYS:
                        out.append(message(b, parts, n))
                        parts = []
            if parts or not out:
                out.append(message(b, parts or [np.zeros(0, U)], n))
            return pa.Table.from_batches(out)

        return run

    def shared_keys(self):
        """s, b, keys, hot: of one shard's lists, for each group its keys that stand in several documents, and those among them that are hot."""
        def run(table: pa.Table) -> pa.Table:
            lists = [from_short(table[c]) for c in ("once", "more")]
            keys, row = (np.concatenate([x[k] for x in lists]) for k in (0, 1))
            weight = np.concatenate([np.ones(len(lists[0][0]), np.int64), np.full(len(lists[1][0]), 2)])
            order = np.lexsort((row, keys))
            keys, row, weight = keys[order], row[order], weight[order]
            at = heads(keys)
            count = np.diff(np.append(at, len(keys)))
            shared = np.repeat(np.add.reduceat(weight, at) > 1, count) if len(at) else np.zeros(0, bool)
            hot = shared & np.repeat(count > self.hot_groups, count) if len(at) else shared
            out = []
            for pick in (shared, hot):
                k, r = keys[pick], row[pick]
                by = np.argsort(r, kind="stable")
                out.append(short(k[by], np.searchsorted(r[by], np.arange(table.num_rows + 1))))
            answer = pa.table({"s": table["s"], "b": table["b"], "keys": out[0], "hot": out[1]})
            return answer.filter(pa.array(np.bincount(row[shared], minlength=table.num_rows) > 0))

        return run

    def contexts(self, key_shards: int, n: int):
        """s, b, data: the classes of one group for each context shard, and, with s = -1, which places of the group have them. keys: of anchors, of hot ones,
        and of the single windows of these that stand in several documents."""

        def cut(docs: pa.Table, keys: pa.Table):
            among = []
            for c in ("keys", "hot", "single"):
                low, row = from_short(keys[c])
                among.append(np.sort(codes(keys["s"].to_numpy()[row], low)))
            ids, th = _ids(docs)
            parts, payload_bytes, kind, done = [], bytearray(), None, 0
            for first_row, _, data, offsets in bulk.chunks(docs["text"]):
                symbols, at, payload = self.parse(data, offsets)
                key, first, last = bulk.anchors(symbols, at, self.window, self.gram)
                code = codes(shard_of(key, key_shards), key & LOW)
                pick = np.flatnonzero(member(code, among[0]))
                if not len(pick):
                    continue
                key, first, wins, hot = key[pick], first[pick], (last - first)[pick] + 1, member(code[pick], among[1])
                sums = bulk.prefix_sums(symbols)
                if hot.any():
                    single, own = self.own_keys(symbols, first[hot], wins[hot], sums)
                    pick = member(codes(shard_of(own, key_shards), own & LOW), among[2])
                    single, own = single[pick], own[pick]
                    key, first, wins = np.concatenate([key[~hot], own]), np.concatenate([first[~hot], single]), np.concatenate([wins[~hot], np.ones(len(single), np.int64)])
                    if not len(key):
                        continue
                size = wins + self.window - 1
                h = bulk.span_hashes(sums, first, first + size)
                order = np.lexsort((h, key))
                head = order[heads(key[order], h[order])]
                kept = np.full(len(key), -1)
                kept[head] = done + np.cumsum(size[head]) - size[head]
                kind = payload.dtype
                payload_bytes += memoryview(payload[bulk.ranges(first[head], size[head])]).cast("B")
                done += int(size[head].sum())
                doc = np.searchsorted(at, first, "right") - 1
                parts.append((key, h, wins.astype(np.int32), (doc + first_row).astype(np.int32), first - at[doc], kept))
            if not parts:
                return []
            key, h, wins, doc, lo, kept = (np.concatenate(x) for x in zip(*parts, strict=True))
            payload = np.frombuffer(payload_bytes, kind)
            parts.clear()
            order = np.lexsort((h, key))
            start = heads(key[order], h[order])
            head = order[start]  # the first place of its class, so the one of its chunk whose payload was kept
            cls = np.empty(len(key), np.int32)
            cls[order] = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.append(start, len(order))))
            least = np.minimum.reduceat(ids[doc][order], start)
            key, h, wins, kept = key[head], h[head], wins[head], kept[head]
            shard = shard_of(key, n)
            first_of = heads(shard)
            rows = []
            for a, z in zip(first_of.tolist(), [*first_of[1:].tolist(), len(shard)], strict=True):
                text = payload[bulk.ranges(kept[a:z], wins[a:z] + self.window - 1)]
                rows.append((int(shard[a]), pack(key=(key[a:z] & LOW).astype(np.uint32), wins=wins[a:z], id=least[a:z], payload=text)))
            used, doc = np.unique(doc, return_inverse=True)
            rows.append((-1, pack(cls=cls, doc=doc.astype(np.int32), lo=np.diff(lo, prepend=0), ids=ids[used], th=th[used], least=least, wins=wins, shards=shard[first_of], first=first_of)))
            return rows

        def run(docs: pa.Table, keys: pa.Table) -> pa.Table:
            rows = cut(docs, keys) if docs.num_rows and keys.num_rows else []
            b = docs["b"][0].as_py() if docs.num_rows else None
            return pa.table({"s": pa.array([r[0] for r in rows], pa.int32()), "b": pa.array([b] * len(rows), pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

        return run

    def marks(self, table: pa.Table) -> pa.Table:
        """s, b, data: of one shard's classes, for each group, which also start in a smaller document elsewhere, and the windows of the others that do. What a
        group keeps to itself stays as it is."""
        if table["s"][0].as_py() < 0:
            return table.select(["s", "b", "data"])
        blobs = [unpack(x) for x in table["data"].to_pylist()]
        for x in blobs:
            size = x["wins"].astype(np.int64) + self.window - 1
            end = np.cumsum(size)
            x["h"] = bulk.span_hashes(bulk.prefix_sums(self.symbols(x["payload"])), end - size, end)
        # Keys are their low bits here; two anchors that look alike are compared, which does no harm.
        key, h, wins, ids, payload = (np.concatenate([x[c] for x in blobs]) for c in ("key", "h", "wins", "id", "payload"))
        counts = [len(x["key"]) for x in blobs]
        blobs.clear()
        size = wins.astype(np.int64) + self.window - 1
        at = np.cumsum(size) - size
        order = np.lexsort((h, key))
        start = heads(key[order], h[order])
        head = order[start]
        cls = np.empty(len(key), np.int64)
        cls[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        smallest = np.minimum.reduceat(ids[order], start)
        ckey, cwins = key[head], wins[head].astype(np.int64)
        same = ckey[1:] == ckey[:-1]
        several = np.flatnonzero(np.append(same, False) | np.append(False, same))  # the others' windows stand in no other class
        text = payload[bulk.ranges(at[head[several]], size[head[several]])]
        flags = self.flagged(text, np.append(0, np.cumsum(size[head[several]])), cwins[several], ckey[several], smallest[several])
        flag_at, flagged = np.zeros(len(head), np.int64), np.zeros(len(head), bool)
        flag_at[several] = np.cumsum(cwins[several]) - cwins[several]
        if len(several):
            flagged[several] = np.logical_or.reduceat(flags, flag_at[several])
        out, done = [], 0
        for s, b, m in zip(table["s"].to_pylist(), table["b"].to_pylist(), counts, strict=True):
            c = cls[done : done + m]
            less = smallest[c] < ids[done : done + m]
            done += m
            part = np.flatnonzero(~less & flagged[c])
            if len(part) or less.any():
                bits = flags[bulk.ranges(flag_at[c[part]], cwins[c[part]])]
                out.append((s, b, pack(n=m, less=np.packbits(less), part=part.astype(np.int32), bits=np.packbits(bits))))
        return pa.table({"s": pa.array([r[0] for r in out], pa.int32()), "b": pa.array([r[1] for r in out], pa.int64()), "data": pa.array([r[2] for r in out], pa.binary())})

    def ranges_of(self, notes: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """By (doc_id, hash of the text), the symbol ranges to remove from the documents of one group: starts and ends, merged."""
        heard = {s: unpack(x) for s, x in zip(notes["s"].to_pylist(), notes["data"].to_pylist(), strict=True)}
        if not heard:
            return {}
        p = heard.pop(-1)
        n = len(p["least"])
        less, start, bits, end = np.zeros(n, bool), np.full(n, -1), [np.zeros(0, bool)], 0
        base = dict(zip(p["shards"].tolist(), p["first"].tolist(), strict=True))
        for s, x in heard.items():
            less[base[s] : base[s] + x["n"]] = np.unpackbits(x["less"])[: x["n"]].astype(bool)
            c = x["part"] + base[s]
            size = p["wins"][c].astype(np.int64)
            start[c] = end + np.cumsum(size) - size
            bits.append(np.unpackbits(x["bits"])[: int(size.sum())].astype(bool))
            end += len(bits[-1])
        flags, cls, doc, at = np.concatenate(bits), p["cls"], p["doc"], np.cumsum(p["lo"])
        whole = less[cls] | (p["ids"][doc] > p["least"][cls])
        # The flagged windows of each class as runs: first window and last one.
        edge = np.zeros(len(flags) + 1, bool)
        edge[start[start >= 0]], edge[-1] = True, True
        first = np.flatnonzero(flags & (edge[:-1] | ~np.append(False, flags[:-1])))
        last = np.flatnonzero(flags & (edge[1:] | ~np.append(flags[1:], False)))
        some = np.flatnonzero(~whole & (start[cls] >= 0))
        c = cls[some]
        begin = np.searchsorted(first, start[c])
        count = np.searchsorted(first, start[c] + p["wins"][c]) - begin
        run, base = bulk.ranges(begin, count), np.repeat(at[some] - start[c], count)
        lo = np.concatenate([at[whole], first[run] + base])
        hi = np.concatenate([at[whole] + p["wins"][cls[whole]] - 1, last[run] + base]) + self.window
        lo, hi, doc = merged(lo, hi, np.concatenate([doc[whole], np.repeat(doc[some], count)]))
        first = heads(doc)
        cuts = np.append(first, len(doc)).tolist()
        return {(int(p["ids"][d]), int(p["th"][d])): (lo[a:z], hi[a:z]) for d, a, z in zip(doc[first].tolist(), cuts[:-1], cuts[1:], strict=True)}

    def cut(self, docs: pa.Table, notes: pa.Table) -> pa.Table:
        """doc_id, n, spans (start, end in symbols), kept."""
        by = self.ranges_of(notes) if docs.num_rows else {}
        ids, th = _ids(docs)
        n, kept, spans = [], [], []
        for first, last, data, offsets in bulk.chunks(docs["text"]) if docs.num_rows else ():
            symbols, at, _ = self.parse(data, offsets)
            n += np.diff(at).tolist()
            for k, raw in zip(range(first, last), np.split(data, offsets[1:-1]), strict=True):
                lo, hi = by.get((int(ids[k]), int(th[k])), ((), ()))
                spans.append([{"start": int(a), "end": int(z)} for a, z in zip(lo, hi, strict=True)])
                kept.append(self.without(raw.tobytes(), lo, hi))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": docs["doc_id"].cast(pa.int64()), "n": pa.array(n, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.large_binary()).cast(pa.binary())})

    def without(self, raw: bytes, lo, hi) -> bytes:
        raise NotImplementedError

    def run(self, docs: DataFrame, tag: str, group_mb: float = GROUP_MB) -> DataFrame:
        """doc_id, n (symbols), spans (array of start, end), kept (binary), one row for each input row."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
        table, n = grouped(rows, "b", tag, group_mb)
        sent = table.select("b", "text").mapInArrow(self.sent_keys(n), "s int, b long, once binary, more binary")
        shared = written(sent.groupBy("s").applyInArrow(_one(self.shared_keys()), "s int, b long, keys binary, hot binary"), f"{tag}-keys")
        hot, none = shared.filter("length(hot) > 0"), F.lit(b"").cast("binary")
        keys = shared.withColumn("single", none)
        if hot.take(1):
            sent = table.groupBy("b").cogroup(hot.select("s", "b", "hot").groupBy("b")).applyInArrow(_two(self.sent_windows(n)), "s int, b long, once binary, more binary")
            again = sent.groupBy("s").applyInArrow(_one(self.shared_keys()), "s int, b long, keys binary, hot binary")
            keys = keys.unionByName(again.select("s", "b", none.alias("keys"), none.alias("hot"), F.col("keys").alias("single")))
        context = table.groupBy("b").cogroup(keys.groupBy("b")).applyInArrow(_two(self.contexts(n, n * SHARDS)), "s int, b long, data binary")
        # A shard's classes are one group, what a group keeps to itself is another, so that contexts are shuffled and not stored as well.
        notes = context.withColumn("own", F.when(F.col("s") < 0, F.col("b"))).groupBy("s", "own").applyInArrow(_one(self.marks), "s int, b long, data binary")
        return table.groupBy("b").cogroup(notes.groupBy("b")).applyInArrow(_two(self.cut), "doc_id long, n long, spans array<struct<start: long, end: long>>, kept binary")


def merged(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray | None = None):
    """Overlapping or touching ranges (of each doc) as one, sorted."""
    doc = np.zeros(len(lo), np.int64) if doc is None else doc.astype(np.int64)
    order = np.lexsort((lo, doc))
    lo, hi, doc = lo[order], hi[order], doc[order]
    # Documents apart on one line, so that a running maximum does not cross them.
    far = np.int64(hi.max() + 2) if len(hi) else np.int64(1)
    reach = np.maximum.accumulate(hi + doc * far)
    new = np.concatenate([[True], (lo + doc * far)[1:] > reach[:-1]]) if len(lo) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(lo)]]) - 1 if len(lo) else first
    return lo[first], reach[last] - doc[first] * far, doc[first]
