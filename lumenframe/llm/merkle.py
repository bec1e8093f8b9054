"""Merkle manifest of a dataset: one hash tree a group over range-sorted rows, one tree over the groups' roots, and a proof for every row.

Rows are range-sorted into parts of like size. The number of rows of each group in each part gives a part its offset in the group's tree, so a part
builds every subtree that lies whole inside it. The nodes at its ragged edges, a few for each level, are shuffled by their coordinates (group, level,
index) and joined STRIDE levels at a time up to the root. Sorted rows are a table in the shared folder, so a lost executor costs the tasks it ran."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LEAST_GROUPS, written

#: Fields of a row's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a part at most, rows that a range partition is meant to have, and range partitions at most: larger ones are cut into more parts.
PART_ROWS, RANGE_ROWS, MOST_RANGES = 20_000, 50_000, 20_000
#: Levels that a shuffle of ragged nodes joins: no more than 2 ** STRIDE nodes of one level meet.
STRIDE = 8


def encoded(value: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def digest(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def width(n: int, level: int) -> int:
    return (n + (1 << level) - 1) >> level


def subtrees(first: int, n: int, leaves: list[bytes]) -> tuple[list[tuple[int, list[bytes]]], list[tuple[int, int, bytes]]]:
    """Of leaves number first and on, in a tree of n: (index of the first, nodes) for each level of the subtrees that lie whole in them, and the topmost
    of these nodes as (level, index, node)."""
    levels, tops, level, lo, nodes = [], [], 0, first, leaves
    while nodes:
        levels.append((lo, nodes))
        size, hi = width(n, level), lo + len(nodes)
        if size == 1:
            tops.append((level, 0, nodes[0]))
            break
        a = lo + (lo & 1)  # the first with an even index
        if a != lo:
            tops.append((level, lo, nodes[0]))
        pairs = [digest(nodes[k - lo], nodes[k - lo + 1]) for k in range(a, hi - 1, 2)]
        if (hi & 1) and a < hi:  # the last is without its neighbour here, or has none
            if hi == size:
                pairs.append(digest(nodes[-1]))
            else:
                tops.append((level, hi - 1, nodes[-1]))
        level, lo, nodes = level + 1, a >> 1, pairs
    return levels, tops


def climbed(nodes: list[tuple[int, int, bytes]], n: int, stop: int) -> tuple[bytes, list[list[str]]]:
    """The node at level stop above all of nodes (level, index, node), which tile its leaves, and for each of nodes its path there: the sibling at each
    level, after < if it stands to the left, after > if to the right, or nothing where there is none."""
    known = {(level, k): x for level, k, x in nodes}
    for level in range(min(x[0] for x in nodes), stop):
        for k in [k for at, k in known if at == level]:
            if not k & 1:
                has = k + 1 < width(n, level)
                known[level + 1, k >> 1] = digest(known[level, k], known[level, k + 1]) if has else digest(known[level, k])
    paths = []
    for level, k, _ in nodes:
        path = []
        for at in range(level, stop):
            other = known.get((at, k ^ 1))
            path.append("" if other is None else ("<" if k & 1 else ">") + other.decode())
            k >>= 1
        paths.append(path)
    return known[stop, nodes[0][1] >> (stop - nodes[0][0])], paths


def sorted_parts(leaves: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """leaves with part and place (its order there), as a table. Equal rows are told apart by a salt, so that many of them are not one part."""
    n = min(max(LEAST_GROUPS, -(-leaves.count() // RANGE_ROWS)), MOST_RANGES)
    keys = [group, *order, "node", "_salt"]
    df = leaves.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt")
    df = df.withColumn("_at", F.monotonically_increasing_id())
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    part = F.shiftright("_at", 33) * (1 << 20) + F.floor(row / PART_ROWS)
    return written(df.withColumns({"part": part, "place": row % PART_ROWS}).drop("_at"), f"{tag}-sorted")


def offsets(rows: DataFrame, group: str) -> DataFrame:
    """part, the group, its first place in the part, the number of its rows in earlier parts, and in all: one row for each part and group."""
    counts = rows.groupBy("part", group).agg(F.count("*").alias("rows"), F.min("place").alias("start"))
    of = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("part", group, "start", "rows", before.alias("first"), F.sum("rows").over(of).alias("n"))


def segments(nodes, sides):
    """(first, n, nodes, whatever else sides have) of each group of a part, in the order of its rows."""
    place = nodes["place"].to_numpy()
    order = place.argsort(kind="stable")
    digests = nodes["node"].to_pylist()
    digests = [digests[k].encode() for k in order]
    for s in sorted(sides, key=lambda s: s["start"]):
        yield s, order[s["start"] : s["start"] + s["rows"]], digests[s["start"] : s["start"] + s["rows"]]


def edges(rows: DataFrame, sides: DataFrame, group: str) -> DataFrame:
    """The topmost nodes of each part's own subtrees: part, group, n, level, index, node. A group of one part gives its root."""
    kind = rows.schema[group].dataType.simpleString()

    def build(nodes, side):
        import pyarrow as pa

        out = []
        for s, _, leaves in segments(nodes, side.to_pylist()):
            for level, k, x in subtrees(s["first"], s["n"], leaves)[1]:
                out.append({"part": s["part"], group: s[group], "n": s["n"], "level": level, "index": k, "node": x.decode()})
        schema = pa.schema([("part", pa.int64()), side.schema.field(group), ("n", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.string())])
        return pa.Table.from_pylist(out, schema=schema)

    slim = rows.select("part", "place", "node")
    schema = f"part long, `{group}` {kind}, n long, level int, index long, node string"
    return slim.groupBy("part").cogroup(sides.groupBy("part")).applyInArrow(build, schema)


def joined_up(nodes: DataFrame, group: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """From the ragged nodes: (part, group, level, index, path to the group's root) for each, and (group, root)."""
    kind = nodes.schema[group].dataType.simpleString()
    top = height(F.col("n"))
    nodes = nodes.withColumn("top", top)
    highest = nodes.agg(F.max("top")).first()[0] or 0

    def build(key, table):
        import pyarrow as pa

        rows = table.to_pylist()
        n, stop = rows[0]["n"], rows[0]["stop"]
        node, paths = climbed([(r["level"], r["index"], r["node"].encode()) for r in rows], n, stop)
        base = {group: rows[0][group], "n": n, "top": rows[0]["top"]}
        out = [{**base, "part": r["part"], "level": r["level"], "index": r["index"], "path": p, "up": rows[0]["above"]} for r, p in zip(rows, paths, strict=True)]
        out.append({**base, "part": None, "level": stop, "index": rows[0]["above"], "node": node.decode()})
        schema = pa.schema([table.schema.field(group), ("n", pa.int64()), ("top", pa.int32()), ("part", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("node", pa.string()),
                            ("path", pa.list_(pa.string())), ("up", pa.int64())])
        return pa.Table.from_pylist(out, schema=schema)

    schema = f"`{group}` {kind}, n long, top int, part long, level int, index long, node string, path array<string>, up long"
    own = ["part", group, "n", "top", "level", "index", "node"]
    waiting, rounds = nodes.filter("level < top").select(*own), []
    roots = nodes.filter("level = top").select(*own)
    for base in range(0, highest, STRIDE):
        stop = F.least(F.lit(base + STRIDE), F.col("top")).cast("int")
        now = waiting.filter(F.col("level") < base + STRIDE).withColumn("stop", stop).withColumn("above", F.expr("shiftright(index, stop - level)"))
        done = written(now.groupBy(group, "above").applyInArrow(build, schema), f"{tag}-levels")
        made = done.filter("node IS NOT NULL").select(*own)
        roots = roots.unionByName(made.filter("level = top"))
        waiting = waiting.filter(F.col("level") >= base + STRIDE).unionByName(made.filter("level < top"))
        rounds.append(done.filter("path IS NOT NULL").withColumn("stop", stop))
    # Paths are put together from the top: a node's own steps, then those of the node that they lead to.
    whole = None
    found = [roots.filter("part IS NOT NULL").select("part", group, "level", "index", F.array().cast("array<string>").alias("path"))]
    for step in reversed(rounds):
        if whole is not None:
            above = whole.select(F.col(group).alias("_g"), F.col("level").alias("_l"), F.col("index").alias("_k"), F.col("path").alias("_rest"))
            on = step[group].eqNullSafe(F.col("_g")) & (step["stop"] == F.col("_l")) & (step["up"] == F.col("_k"))
            step = step.join(above, on, "left").withColumn("path", F.concat("path", F.coalesce("_rest", F.array().cast("array<string>"))))
        whole = step.select("part", group, "level", "index", "path")
        found.append(whole.filter("part IS NOT NULL"))
    return reduce(DataFrame.unionByName, found), roots.select(group, F.col("node").alias("root"))


class Forest:
    """The trees of leaves (a group, columns that give the order, node), one for each group."""

    def __init__(self, leaves: DataFrame, group: str, order: list[str], tag: str):
        self.group, self.tag = group, tag
        self.rows = sorted_parts(leaves, group, order, tag)
        self.sides = written(offsets(self.rows, group), f"{tag}-offsets")
        paths, roots = joined_up(written(edges(self.rows, self.sides, group), f"{tag}-edges"), group, tag)
        self.paths, self.roots = paths, written(roots, f"{tag}-roots")

    def proofs(self, keep: list[str], above: DataFrame | None = None) -> DataFrame:
        """The columns keep, node, path and root of each row. above (group, path, root) carries the paths on from the groups' roots."""
        group = self.group
        ends = self.paths
        if above is None:
            above = self.roots.select(group, F.array().cast("array<string>").alias("path"), "root")
        more = above.select(F.col(group).alias("_g"), F.col("path").alias("_rest"), F.col("root").alias("root"))
        ends = ends.join(more, ends[group].eqNullSafe(F.col("_g"))).withColumn("path", F.concat("path", "_rest")).drop("_g", "_rest")
        # One row for each part and group: the paths of its few topmost nodes.
        e, s = ends.alias("e"), self.sides.alias("s")
        tops = e.groupBy("part", group).agg(F.first("root").alias("root"), F.collect_list(F.struct("level", "index", "path")).alias("tops")).alias("t")
        side = s.join(tops, (F.col("s.part") == F.col("t.part")) & F.col(f"s.{group}").eqNullSafe(F.col(f"t.{group}"))).select("s.*", "t.root", "t.tops")
        fields = [f for f in self.rows.schema if f.name in keep]
        kept = [f.name for f in fields]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", node string, path array<string>, root string"

        def build(nodes, side):
            import numpy as np
            import pyarrow as pa

            # The strings that paths are made of; each row has the numbers of its own.
            strings, order, sizes, steps_of, roots = [""], [], [], [], []
            for s, rows, leaves in segments(nodes, side.to_pylist()):
                levels, tops = subtrees(s["first"], s["n"], leaves)
                ends = {(x["level"], x["index"]): x["path"] for x in s["tops"]}
                begin = []
                for _, level in levels:
                    begin.append(len(strings))
                    strings += [f"<{x.decode()}" for x in level] + [f">{x.decode()}" for x in level]
                for level, k, _ in tops:
                    tail = np.arange(len(strings), len(strings) + len(ends[level, k]))
                    strings += ends[level, k]
                    a, z = max(s["first"], k << level), min(s["first"] + len(leaves), (k + 1) << level)
                    at, steps = np.arange(a, z), []
                    for h in range(level):
                        lo, there = levels[h][0], len(levels[h][1])
                        other = at ^ 1
                        found = (other >= lo) & (other < lo + there)
                        steps.append(np.where(found, begin[h] + other - lo + np.where(at & 1, 0, there), 0))
                        at = at >> 1
                    steps += [np.full(z - a, t) for t in tail]
                    order.append(rows[a - s["first"] : z - s["first"]])
                    sizes.append(np.full(z - a, len(steps)))
                    steps_of.append(np.stack(steps, 1).ravel() if steps else np.zeros(0, np.int64))
                    roots += [s["root"]] * (z - a)
            order = np.concatenate(order)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array(ends), pa.array(strings, pa.string()).take(pa.array(np.concatenate(steps_of))))
            out = nodes.select([*kept, "node"]).take(pa.array(order))
            return out.append_column("path", paths).append_column("root", pa.array(roots, pa.string()))

        rows = self.rows.select("part", "place", "node", *kept)
        return rows.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(build, schema)


def manifest(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, leaf, altered (its leaf after tampering), subroot, root, and proof: the steps from the leaf through the root of its lang to
    the root of the table, each the sibling's digest after < or > for its side, or nothing where a node has none.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Leaves of one lang ascend by doc_id, null first, rows of one doc_id by leaf; equal rows
    have a leaf each. langs ascend by their UTF-8 bytes, null first. Tampering adds 1 to n_chars of rows whose crc32(doc_id) 7 divides; a null n_chars or
    doc_id stays. Empty and very long texts are hashed like any other, other columns are not read, and an empty table has no rows and no root."""
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, (F.col("n_chars").cast("decimal(38,0)") + 1).cast("string"))
    changed = F.coalesce(changed, F.col("n_chars").cast("string"))
    fields = {c: F.col(c) for c in FIELDS}
    leaves = docs.select("doc_id", "lang", leaf(*fields.values()).alias("node"), leaf(*(fields | {"n_chars": changed}).values()).alias("altered"))
    leaves = written(leaves, "merkle-leaves")
    langs = Forest(leaves, "lang", ["doc_id"], "merkle")
    over = Forest(langs.roots.select(F.lit(0).alias("all"), F.col("lang").alias("name"), F.col("root").alias("node")), "all", ["name"], "merkle-top")
    top = over.proofs(["name"]).select(F.col("name").alias("lang"), "path", "root")
    rows = langs.proofs(["doc_id", "altered", "lang"], written(top, "merkle-langs"))
    roots = langs.roots.select(F.col("lang").alias("_g"), F.col("root").alias("subroot"))
    rows = rows.join(roots, rows["lang"].eqNullSafe(F.col("_g")))
    return rows.select("doc_id", F.col("node").alias("leaf"), "altered", "subroot", "root", F.col("path").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    other = lambda x: F.substring(x, 2, 64)
    step = lambda node, x: F.sha2(F.when(x == "", node).when(F.startswith(x, F.lit("<")), F.concat(other(x), node)).otherwise(F.concat(node, other(x))), 256)
    return F.aggregate(proof, leaf, step)


def op13_merkle_manifest(spark, sf_dir):
    rows = manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("folded_root", folded(F.col("altered"), F.col("proof")))
    siblings = F.transform("proof", lambda x: F.substring(x, 2, 64))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
#: crc takes the bits of a decimal one by one.
OP13_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS t FROM documents WHERE doc_id IS NOT NULL),
crc AS (
  SELECT doc_id, t, 0 AS k, 0 AS b, 4294967295::BIGINT AS s FROM ids
  UNION ALL
  SELECT doc_id, t, CASE WHEN b = 7 THEN k + 1 ELSE k END, (b + 1) % 8,
    CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT *, CASE WHEN b = 0 THEN xor(s, ascii(t[k + 1])::BIGINT) ELSE s END AS x FROM crc WHERE k < length(t))),
hit AS (SELECT doc_id FROM crc WHERE k = length(t) AND xor(s, 4294967295::BIGINT) % 7 = 0),
l AS (SELECT *, {_LEAF} AS leaf FROM documents),
f AS (SELECT l.* REPLACE (CASE WHEN hit.doc_id IS NULL THEN n_chars ELSE n_chars + 1 END AS n_chars) FROM l LEFT JOIN hit USING (doc_id)),
leaves AS (SELECT doc_id, lang, leaf, {_LEAF} AS altered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM f),
tree AS (
  SELECT lang, 0 AS level, k, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lang, level + 1, k // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY k)) FROM tree WHERE n > 1 GROUP BY lang, level, k // 2, n),
sub AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM tree WHERE n = 1),
over_ AS (
  SELECT 0 AS level, k, n, subroot AS node FROM sub
  UNION ALL
  SELECT level + 1, k // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY k)) FROM over_ WHERE n > 1 GROUP BY level, k // 2, n),
walk AS (
  SELECT doc_id, leaf, altered, lang, k, k AS at, n, 0 AS level, altered AS fold, '' AS proof FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.altered, w.lang, w.k, w.at // 2, (w.n + 1) // 2, w.level + 1,
    sha256(CASE WHEN t.node IS NULL THEN w.fold WHEN w.at % 2 = 1 THEN t.node || w.fold ELSE w.fold || t.node END), w.proof || coalesce(t.node, '')
  FROM walk w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.k = xor(w.at, 1) WHERE w.n > 1),
up AS (
  SELECT doc_id, leaf, w.lang, w.k AS key, sub.subroot, sub.k AS at, sub.n, 0 AS level, fold, proof FROM walk w JOIN sub ON sub.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.key, w.subroot, w.at // 2, (w.n + 1) // 2, w.level + 1,
    sha256(CASE WHEN t.node IS NULL THEN w.fold WHEN w.at % 2 = 1 THEN t.node || w.fold ELSE w.fold || t.node END), w.proof || coalesce(t.node, '')
  FROM up w LEFT JOIN over_ t ON t.level = w.level AND t.k = xor(w.at, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.node AS verified FROM up, (SELECT node FROM over_ WHERE n = 1) r WHERE up.n = 1
"""
