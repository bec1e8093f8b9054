"""N-gram Jaccard join with a token-group matrix, exact at its threshold.

Similar documents form groups, the matrix says which tokens each group's members hold between them, a document's overlap with a group's union bounds
its overlap with any member, and only groups that pass the bound are opened. Rows and columns of the matrix are spread: by token while groups are
sought, by group while unions are bounded and members compared."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bulk
from .common import grouped, trimmed, written
from .components import roots
from .spans import GROUP_MB, _ids, _one, _two, pack, unpack

#: Counters of shingle frequencies; a shingle's level says how often its counter exceeds the mean, in half powers of two.
COUNTERS = 1 << 21
SLICES = 64
#: Prefix tokens, or sets, that one shard of a shuffle gathers on average.
SHARD_TOKENS, SHARD_SETS = 100_000, 500
#: A group with more members, or more tokens in their sets, is split into equal parts, each a group of its own.
MOST_MEMBERS, MOST_TOKENS = 4_000, 4_000_000
#: Hot tokens, at most, whose list is broadcast; beyond it documents and list meet by token.
MOST_HOT = 1_000_000
#: The documents of a token that more of them have in their prefix are dealt to several shards.
HOT_TOKEN = 2_000
LEVEL_BITS = 5
#: Prefixes are longer than need be by this share of the set, and linked pairs share as many tokens more.
EXTRA = 0.03


def ceil_share(percent: int, n):
    return -(-(percent * n) // 100)


class JaccardJoin:
    """n words a shingle; two documents link when 100 * intersection >= percent * union of their shingle sets."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent

    def hashes(self, column):
        """(first row, offsets of the rows, shingle hashes, their rows) by runs of rows."""
        for first, last, data, offsets in bulk.chunks(column):
            words, _, _, at = bulk.words(data, offsets, lower=True)
            values, row = bulk.shingles(words, at, self.n)
            yield first, last, values, row

    def counted(self, batches):
        counts = np.zeros(COUNTERS, np.int32)  # of one task
        for batch in batches:
            for _, _, values, _ in self.hashes(batch["text"]):
                at, n = np.unique(values & np.uint64(COUNTERS - 1), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.int32)
        size = COUNTERS // SLICES
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(SLICES), pa.int32()), "data": pa.array([pack(c=counts[k * size : (k + 1) * size].astype(np.int32)) for k in range(SLICES)], pa.binary())})

    def levels(self, table: DataFrame) -> tuple[np.ndarray, int]:
        """The level of each counter, from all documents: as many bytes as counters, whatever the input; and the least level of which a token can be hot."""

        def total(t: pa.Table) -> pa.Table:
            return pa.table({"k": t["k"][:1], "data": pa.array([pack(c=sum(unpack(x)["c"].astype(np.int64) for x in t["data"].to_pylist()))], pa.binary())})

        got = table.select("text").mapInArrow(trimmed(lambda t: (yield from self.counted(t))), "k int, data binary").groupBy("k").applyInArrow(total, "k int, data binary").collect()
        counts = np.zeros(COUNTERS, np.int64)
        size = COUNTERS // SLICES
        for r in got:
            counts[r["k"] * size : (r["k"] + 1) * size] = unpack(bytes(r["data"]))["c"]
        level = lambda n: np.clip(2 * np.log2(np.maximum(n, 1) / max(1.0, counts.mean())), 0, (1 << LEVEL_BITS) - 1).astype(np.uint8)
        return level(counts), int(level(HOT_TOKEN))

    def sets(self, column, levels: np.ndarray):
        """(first row, last row, tokens, rows): distinct tokens of each row in the order of rarity. A token is the shingle's level and hash."""
        for first, last, values, row in self.hashes(column):
            level = levels[(values & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
            tokens = (level << np.uint64(63 - LEVEL_BITS)) | (values >> np.uint64(LEVEL_BITS + 1))
            yield first, last, *bulk.distinct_by_row(tokens, row)

    def signed(self, levels: np.ndarray):
        """doc_id, th, b, size, s1, s2 (a 128-bit signature of the set), prefix: the rarest tokens. Of sets x and y, as long as their overlap must be at
        least t, the first |x| - t + k and |y| - t + k tokens share k; t is at least percent of either size. Here k is 1 + EXTRA of the size, so of the
        smaller set's size for a pair."""

        def run(batches):
            for batch in batches:
                for first, last, tokens, row in self.sets(batch["text"], levels):
                    n = np.bincount(row, minlength=last - first)
                    at = np.concatenate([[0], np.cumsum(n)])
                    sums = []
                    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bulk.mix(tokens ^ np.uint64(salt)))])
                        sums.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
                    p = np.where(n > 0, np.minimum(n, n - ceil_share(self.percent, n) + 1 + (EXTRA * n).astype(np.int64)), 0)
                    prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32()), pa.array(tokens[bulk.ranges(at[:-1], p)].astype(np.int64)))
                    part = batch.slice(first, last - first)
                    yield pa.RecordBatch.from_arrays([part["doc_id"], part["th"], part["b"], pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), prefix],
                                                     names=["doc_id", "th", "b", "size", "s1", "s2", "prefix"])

        return run

    def leaders(self, table: pa.Table) -> pa.Table:
        """q, leader, n, need: in how many of one shard's tokens (token, rid, size, like) document q meets the leader, the least rid among the documents
        of like size that hold the token, and how many they would share if they were linked; with leader -1, how many of them any other document
        holds. Two rows a token at most, however often one occurs."""
        token, rid, size, like = (table[c].to_numpy() for c in ("token", "rid", "size", "like"))
        order = np.lexsort((rid, like, token))
        token, rid, size, like = (x[order].astype(np.int64) for x in (token, rid, size, like))
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (like[1:] != like[:-1])])
        lead = rid[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        follows = ~new & (lead != rid)
        run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        met = np.bincount(run)[run] > 1
        rows = np.concatenate([np.stack([rid[follows], lead[follows], size[follows]], 1), np.stack([rid[met], np.full(met.sum(), -1), size[met]], 1)])
        pairs, n = np.unique(rows, axis=0, return_counts=True)
        need = 1 + (EXTRA * ceil_share(self.percent, pairs[:, 2])).astype(np.int64)
        return pa.table({"q": pa.array(pairs[:, 0]), "leader": pa.array(pairs[:, 1]), "n": pa.array(n.astype(np.int64)), "need": pa.array(need)})

    def candidates(self, table: pa.Table) -> pa.Table:
        """g, q, size, n, need: how many of one shard's tokens (token, rid, size, high, g, gn) document q shares with the union of group g, and how many it must
        share over all shards to be linked with a member. Of two groups the one of fewer members (gn) asks, so a document alone asks a large group
        once and not each of its members the document. Rows without a document (rid -1) are groups that hold a hot token, with their least and
        largest size there; the documents of such a token are dealt to several shards, each of which has all its groups."""
        token, rid, size, high, g, gn = (table[c].to_numpy() for c in ("token", "rid", "size", "high", "g", "gn"))
        order = np.lexsort((g, token))
        token, rid, size, high, g, gn = (x[order].astype(np.int64) for x in (token, rid, size, high, g, gn))
        run = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        keep = np.bincount(run)[run] > 1
        token, rid, size, high, g, gn = (x[keep] for x in (token, rid, size, high, g, gn))
        names = ("g", "q", "size", "n", "need")
        if not len(token):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        new = np.concatenate([[True], token[1:] != token[:-1]])
        run = np.cumsum(new) - 1
        # The groups of each run and their least and largest size there.
        head = np.flatnonzero(new | np.concatenate([[True], g[1:] != g[:-1]]))
        low, high = np.minimum.reduceat(size, head), np.maximum.reduceat(high, head)
        groups_of = np.bincount(run[head])
        first_group = np.cumsum(groups_of) - groups_of
        out, p = [np.zeros((0, 4), np.int64)], self.percent
        askers = np.flatnonzero(rid >= 0)
        n_each = groups_of[run[askers]]
        blocks = np.cumsum(n_each) // 2_000_000
        for k in np.unique(blocks):
            e, each = askers[blocks == k], n_each[blocks == k]
            q = np.repeat(e, each)
            h = bulk.ranges(first_group[run[e]], each)
            # The order of two groups is the same at every token, so all tokens of a pair are counted on one side. Members of a group are compared there.
            there, here = head[h], q
            ok = (gn[there] > gn[here]) | ((gn[there] == gn[here]) & (g[there] > g[here]))
            ok &= (100 * high[h] >= p * size[q]) & (100 * size[q] >= p * low[h])
            pairs, n = np.unique(np.stack([g[head[h[ok]]], rid[q[ok]], size[q[ok]]], 1), axis=0, return_counts=True)
            out.append(np.column_stack([pairs, n]))
        out = np.concatenate(out)
        need = 1 + (EXTRA * ceil_share(p, out[:, 2])).astype(np.int64)
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in (out[:, 0], out[:, 1], out[:, 2], out[:, 3], need)], names=names)

    @staticmethod
    def salted(tokens: DataFrame, hot: DataFrame, shards: int, *columns: str) -> DataFrame:
        """s, token and columns of prefix tokens. The documents of a hot token are dealt to its parts, each a token of its own from here on."""
        t = tokens.join(hot, "token", "left")
        t = t.withColumn("token", F.when(F.col("parts").isNull(), F.col("token")).otherwise(F.xxhash64("token", F.pmod(F.xxhash64("rid"), F.col("parts")))))
        return t.select(F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int").alias("s"), "token", *columns)

    def fetched(self, levels: np.ndarray):
        """s, rid, gs, members, tokens of the wanted documents (s, th, doc_id, rid, gs, members) of one bucket."""

        def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
            sent = []
            if docs.num_rows and wanted.num_rows:
                ids, th = _ids(docs)
                place: dict = {}
                for k, key in enumerate(zip(ids.tolist(), th.tolist(), strict=True)):
                    place.setdefault(key, k)
                wanted = wanted.combine_chunks()
                wids, wth = _ids(wanted)
                at = np.array([place[key] for key in zip(wids.tolist(), wth.tolist(), strict=True)])
                used, of = np.unique(at, return_inverse=True)
                sent = [b""] * len(used)
                for first, last, tokens, row in self.sets(docs["text"].combine_chunks().take(pa.array(used)), levels):
                    cuts = np.searchsorted(row, np.arange(last - first + 1))
                    for k in range(first, last):
                        sent[k] = tokens[cuts[k - first] : cuts[k - first + 1]].tobytes()
                sent = [sent[k] for k in of.tolist()]
            else:
                wanted = wanted.slice(0, 0)
            lists = [wanted["gs"].cast(pa.list_(pa.int64())), wanted["members"].cast(pa.list_(pa.bool_()))]  # whose elements Spark may know as never null
            return pa.table([wanted["s"], wanted["rid"], *lists, pa.array(sent, pa.binary())], names=["s", "rid", "gs", "members", "tokens"])

        return run

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        p, x, y = self.percent, len(a), len(b)
        if 100 * min(x, y) < p * max(x, y):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= p * (x + y - both)

    def opened(self, table: pa.Table) -> pa.Table:
        """a, b: links that join all linked documents of each group and of its queries, of one shard's groups."""
        rid = table["rid"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["tokens"].combine_chunks()]  # in the order of tokens
        parts = defaultdict(lambda: ([], []))
        for k, (gs, members) in enumerate(zip(table["gs"].to_pylist(), table["members"].to_pylist(), strict=True)):
            for g, m in zip(gs, members, strict=True):
                parts[g][not m].append(k)
        edges = []
        for inside, queries in parts.values():
            n_inside = len(inside)
            union = np.unique(np.concatenate([sets[k] for k in inside]))
            groups: list[list[int]] = []  # linked so far, each in the order in which links were found
            for j, k in enumerate(inside + queries):
                x, member = sets[k], j < n_inside
                if not member:
                    spot = np.minimum(np.searchsorted(union, x), len(union) - 1)
                    if 100 * int((union[spot] == x).sum()) < self.percent * len(x):
                        continue
                hit = []
                for c, others in enumerate(groups):
                    for i, o in enumerate(others):
                        if self.linked(x, sets[o]):
                            edges.append((rid[k], rid[o]))
                            others.insert(0, others.pop(i))  # what linked once is tried first
                            hit.append(c)
                            break
                joined = [k] if member else []  # queries are compared with members only; they meet each other in their own groups
                for c in reversed(hit):
                    joined = groups.pop(c) + joined
                if joined:
                    groups.append(joined)
        edges = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    def run(self, docs: DataFrame, tag: str) -> DataFrame:
        """doc_id, size (of the shingle set), component_id: the smallest doc_id reachable by links, one row for each input row. Documents without
        words (null, empty or blank texts) link with nothing. Equal sets are one node from the start, so repeated rows and exact copies cost no comparison;
        a null doc_id counts as larger than any other and, alone, stays null. Texts are taken whole, whatever their length; an empty table gives no
        rows; columns other than doc_id and text are not read."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
        table, _ = grouped(rows, "b", tag, GROUP_MB)
        levels, warm = self.levels(table)
        schema = "doc_id long, th long, b long, size long, s1 long, s2 long, prefix array<long>"
        signed = written(table.select("doc_id", "th", "b", "text").mapInArrow(trimmed(self.signed(levels)), schema), f"{tag}-sets")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "b", "prefix")).alias("x")
        nodes = signed.filter("size > 0").groupBy("size", "s1", "s2").agg(first).select("size", "s1", "s2", "x.doc_id", "x.th", "x.b", "x.prefix")
        like = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / self.percent)))
        nodes = written(nodes.withColumn("rid", F.monotonically_increasing_id()).withColumn("like", like), f"{tag}-nodes")
        n = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
        shards = 1 + n // SHARD_TOKENS
        # Groups: each set follows the leader with which it shares the most tokens, if they could be linked by that, else it leads itself.
        tokens = nodes.select("rid", "size", "like", F.explode("prefix").alias("token"))
        often = tokens.filter(F.shiftrightunsigned("token", 63 - LEVEL_BITS) >= warm).groupBy("token").count().filter(F.col("count") > HOT_TOKEN)
        # Powers of two, so that the documents of two hot tokens are dealt alike and mostly meet the same leaders.
        hot = written(often.select("token", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("count") / HOT_TOKEN))).cast("long").alias("parts")), f"{tag}-hot")
        if hot.count() <= MOST_HOT:
            hot = F.broadcast(hot)
        lead = self.salted(tokens, hot, shards, "rid", "size", "like").groupBy("s").applyInArrow(_one(self.leaders), "q long, leader long, n long, need long")
        lead = lead.groupBy("q", "leader").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need")
        lead = written(lead, f"{tag}-met")
        alive = lead.filter("leader < 0").select("q", F.lit(True).alias("alive"))
        lead = lead.filter("leader >= 0").groupBy("q").agg(F.max(F.struct("n", (-F.col("leader")).alias("minus"))).alias("x")).select("q", (-F.col("x.minus")).alias("leader"))
        groups = nodes.select("rid").join(lead.withColumnRenamed("q", "rid"), "rid", "left").join(alive.withColumnRenamed("q", "rid"), "rid", "left")
        groups = groups.select("rid", F.coalesce("leader", "rid").alias("leader"), F.coalesce("alive", F.lit(False)).alias("alive"))
        # A leader that follows another takes its followers along.
        above = groups.select(F.col("rid").alias("leader"), F.col("leader").alias("above")).filter("leader != above")
        groups = groups.join(above, "leader", "left").select("rid", F.coalesce("above", "leader").alias("leader"), "alive")
        groups = written(groups, f"{tag}-leaders")
        weight = groups.join(nodes.select("rid", "size"), "rid").groupBy("leader").agg(F.greatest(F.count("*") / MOST_MEMBERS, F.sum("size") / MOST_TOKENS).alias("weight"))
        many = weight.filter("weight > 1").select("leader", F.ceil("weight").alias("parts"))
        part = F.pmod(F.xxhash64("rid"), F.coalesce("parts", F.lit(1)))
        groups = groups.join(many, "leader", "left").select("rid", "alive", F.xxhash64("leader", part).alias("g"))
        groups = written(groups, f"{tag}-parts")
        groups = groups.join(groups.groupBy("g").agg(F.count("*").alias("gn")), "g")
        nodes = written(nodes.join(groups, "rid"), f"{tag}-grouped")
        # Documents that meet too few tokens anywhere can link with nobody: they are done.
        tokens = nodes.filter("alive").select("rid", "size", F.col("size").alias("high"), "g", "gn", F.explode("prefix").alias("token"))
        columns = ("rid", "size", "high", "g", "gn")
        holders = tokens.join(hot, "token").groupBy("token", "parts", "g").agg(F.min("size").alias("size"), F.max("size").alias("high"), F.max("gn").alias("gn"))
        holders = holders.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("token", F.xxhash64("token", "part"))
        holders = holders.select(F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int").alias("s"), "token", F.lit(-1).cast("long").alias("rid"), *columns[1:])
        asks = self.salted(tokens, hot, shards, *columns).unionByName(holders)
        found = asks.groupBy("s").applyInArrow(_one(self.candidates), "g long, q long, size long, n long, need long")
        found = found.groupBy("g", "q").agg(F.max("size").alias("size"), F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("g", "q", "size")
        found = written(found, f"{tag}-candidates")
        # A group that many ask is opened several times, each time for an equal part of the askers.
        asked = found.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / MOST_MEMBERS, F.sum("size") / MOST_TOKENS)).alias("times"))
        once = F.coalesce("times", F.lit(1))
        members = nodes.select("g", "gn", F.col("rid").alias("q")).join(asked, "g", "left").filter("gn > 1 OR times IS NOT NULL")
        members = members.withColumn("time", F.explode(F.sequence(F.lit(0).cast("long"), once.cast("long") - 1)))
        members = members.select(F.xxhash64("g", "time").alias("g"), "q", F.lit(True).alias("member"))
        found = found.join(asked, "g").select(F.xxhash64("g", F.pmod(F.xxhash64("q"), once.cast("long"))).alias("g"), "q")
        wants = found.withColumn("member", F.lit(False)).unionByName(members).groupBy("g", "q").agg(F.max("member").alias("member"))
        shards = 1 + nodes.count() // SHARD_SETS
        wants = wants.withColumn("s", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")).groupBy("q", "s").agg(F.collect_list(F.struct("g", "member")).alias("x"))
        wants = nodes.select("rid", "doc_id", "th", "b").join(wants, F.col("rid") == F.col("q")).select("b", "s", "th", "doc_id", "rid", F.col("x.g").alias("gs"), F.col("x.member").alias("members"))
        schema = "s int, rid long, gs array<long>, members array<boolean>, tokens binary"
        sets = table.select("doc_id", "th", "b", "text").groupBy("b").cogroup(wants.groupBy("b")).applyInArrow(_two(self.fetched(levels)), schema)
        edges = sets.groupBy("s").applyInArrow(_one(self.opened), "a long, b long")
        root = roots(edges)
        label = nodes.select("rid", "size", "s1", "s2", "doc_id").join(root, F.col("rid") == F.col("u"), "left").withColumn("root", F.coalesce("v", "rid"))
        least = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        label = label.select("size", "s1", "s2", "root").join(least, "root").select("size", "s1", "s2", "component_id")
        out = signed.select("doc_id", "size", "s1", "s2").join(label, ["size", "s1", "s2"], "left")
        return out.select("doc_id", "size", F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_jaccard_join(spark, sf_dir):
    out = JaccardJoin(3, 90).run(spark.read.parquet(f"{sf_dir}/documents.parquet"), "jaccard")
    return out.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


