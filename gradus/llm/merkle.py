"""A Merkle manifest of a table: a tree of hashes for each group of rows, one over the groups, and each row's proof from a multiproof of its block."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, ascii_lower, crc_mod

#: Children of a node, in bits; levels that are hashed after one shuffle, so that a block of leaves has 8 ** 3 of them; groups or nodes that are broadcast at most.
BITS, HOP, FEW = 3, 3, 50_000
BLOCK = BITS * HOP


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def placed(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """leaves (tree, id, leaf, ...) with pos, the place in the tree by id (null first), then leaf, and n, the tree's leaves.

    Rows are laid out by range and written; a place is the row's place in its range and the sum of what the ranges before hold of the tree. No tree is gathered anywhere.
    """
    laid = leaves.repartitionByRange("tree", "id", "leaf", F.monotonically_increasing_id()).sortWithinPartitions("tree", "id", "leaf")
    laid = scratch.written(laid.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    parts = laid.groupBy("tree", part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    parts = parts.select("tree", "part", (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    found = laid.withColumn("part", part).join(parts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    return scratch.written(found, f"{name}-placed")


def raised(nodes: list[str], size: int) -> list[list[str]]:
    """The levels above consecutive nodes of which the first begins a run; `size` of them make the level whole. It ends where the level has one node."""
    levels, total = [], size
    while total > 1 and len(levels) < HOP:
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
        total = -(-total // 8)
    return levels


NODES = "tree string, n long, level int, pos long, node binary"


def hop(level: int):
    """A block of nodes of a level -> the nodes of the next levels above it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, block = rows["n"][0].as_py(), rows["pos"][0].as_py() >> BLOCK
        out = [(level + k, (block << (BLOCK - BITS * k)) + i, bytes.fromhex(h)) for k, found in enumerate(raised([x.hex() for x in rows["node"].to_pylist()], ((n - 1) >> (BITS * level)) + 1), 1) for i, h in enumerate(found)]
        levels, pos, node = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"tree": pa.array([rows["tree"][0].as_py()] * len(out), pa.string()), "n": pa.array([n] * len(out), pa.int64()), "level": pa.array(levels, pa.int32()), "pos": pa.array(pos, pa.int64()), "node": pa.array(node, pa.binary())})

    return run


def nodes_over(leaves: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """All nodes above the leaves (tree, n, pos, leaf) of each tree: (tree, n, level, pos, node). Every 8 nodes of a level in a row become one while a level has several; a lone leaf has none above it."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    rows = leaves.select("tree", "n", "pos", F.col("leaf").alias("node"))
    found = leaves.sparkSession.createDataFrame([], NODES)
    level = 0
    while (most - 1) >> (BITS * level) > 0:
        blocks = rows.withColumn("block", F.shiftright("pos", BLOCK)).filter(F.shiftright(F.col("n") - 1, BITS * level) > 0)
        above = scratch.written(blocks.groupBy("tree", "block").applyInArrow(hop(level), NODES), name)
        found = found.unionByName(above) if level else above
        level += HOP
        rows = above.filter(F.col("level") == level).select("tree", "n", "pos", "node")
    return found


def missing(owners: DataFrame, low: int) -> DataFrame:
    """The minimal union of nodes that an owner (tree, n, block) lacks: (tree, n, block, level, pos).

    The owner has all leaves under its node `block` of level `low`, so it derives what is below; on each level up to the root it lacks that node's siblings.
    """
    up = F.expr(f"explode(filter(sequence({low}, 21), k -> shiftright(n - 1, {BITS} * k) > 0)) AS level")
    own = F.expr(f"shiftright(block, {BITS} * (level - {low}))")
    rows = owners.select("tree", "n", "block", up).withColumn("own", own).withColumn("first", F.col("own") - F.col("own") % 8)
    rows = rows.withColumn("pos", F.expr(f"explode(sequence(first, least(first + 7, shiftright(n - 1, {BITS} * level))))"))
    return rows.filter("pos <> own").select("tree", "n", "block", "level", "pos")


def fetched(owners: DataFrame, low: int, nodes: DataFrame) -> DataFrame:
    """Each owner's missing nodes, with their hashes. Nodes far up, which every block of a tree asks for, are broadcast where they are few; beyond that Spark splits the askers."""
    wanted, keys = missing(owners, low), ["tree", "level", "pos"]
    high = low + HOP
    top = nodes.filter(F.col("level") >= high).select(*keys, "node")
    top = F.broadcast(top) if top.count() <= FEW else top
    below = wanted.filter(F.col("level") < high).join(nodes.filter(F.col("level") < high).select(*keys, "node"), keys)
    return below.unionByName(wanted.filter(F.col("level") >= high).join(top, keys))


class Tree:
    """Nodes known by (level, place), in hex: a multiproof. Runs end where their level does."""

    def __init__(self, n: int, nodes: dict[tuple[int, int], str]):
        self.n, self.nodes, self.chains, self.folds = n, nodes, {}, {}

    def sides(self, level: int, pos: int) -> tuple[str, str]:
        """The siblings before and after a node."""
        first, end = pos - pos % 8, min(pos - pos % 8 + 8, ((self.n - 1) >> (BITS * level)) + 1)
        return "".join(self.nodes[level, i] for i in range(first, pos)), "".join(self.nodes[level, i] for i in range(pos + 1, end))

    def whole(self, level: int) -> bool:
        return (self.n - 1) >> (BITS * level) == 0

    def chain(self, level: int, pos: int) -> str:
        """The siblings from a node up to the root."""
        if self.whole(level):
            return ""
        above = level + 1, pos >> BITS
        if above not in self.chains:
            self.chains[above] = self.chain(*above)
        return "".join(self.sides(level, pos)) + self.chains[above]

    def fold(self, level: int, pos: int, node: str) -> str:
        """The root that a node and the siblings give. What is folded from a node as it is known is shared by all below it."""
        if self.whole(level):
            return node
        left, right = self.sides(level, pos)
        up, at = digest(left + node + right), (level + 1, pos >> BITS)
        if up != self.nodes.get(at):
            return self.fold(*at, up)
        if at not in self.folds:
            self.folds[at] = self.fold(*at, up)
        return self.folds[at]


PROOFS = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def expand(rows: pa.Table, held: pa.Table) -> pa.Table:
    """A block's leaves, and the nodes that were fetched for it: proofs of each leaf, from nodes that the block shares."""
    rows = rows.sort_by("pos")
    n, pos = rows["n"][0].as_py() if rows.num_rows else 0, rows["pos"].to_numpy()
    leaves = [x.hex() for x in rows["leaf"].to_pylist()]
    own: dict[tuple[int, int], str] = {}
    top: dict[tuple[int, int], str] = {}
    place, trees = 0, 1
    for upper, level, p, node, size in zip(*(held[c].to_pylist() for c in ("upper", "level", "pos", "node", "n")), strict=True):
        if upper and level < 0:
            place, trees = p, size
        else:
            (top if upper else own)[level, p] = node.hex()
    if leaves:
        own |= {(0, p): h for p, h in zip(pos.tolist(), leaves, strict=True)}
        block = int(pos[0]) >> BLOCK
        for k, found in enumerate(raised(leaves, n), 1):
            own |= {(k, (block << (BLOCK - BITS * k)) + i): h for i, h in enumerate(found)}
    tree, over = Tree(n, own), Tree(trees, top)
    out: list[tuple] = []
    roots: dict[str, str] = {}
    folded = lambda h: roots[h] if h in roots else roots.setdefault(h, over.fold(0, place, h))
    rest = over.chain(0, place) if leaves else ""
    for p, leaf, changed in zip(pos.tolist(), leaves, rows["tampered"].to_pylist(), strict=True):
        subroot = tree.fold(0, p, leaf)
        root = folded(subroot)
        other = root if changed is None else folded(tree.fold(0, p, changed.hex()))
        out.append((leaf, subroot, root, digest(tree.chain(0, p) + rest), other, other == root))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    return pa.table({"id": rows["id"].cast(pa.int64()), **{c: pa.array(columns[k], pa.string()) for k, c in enumerate(names)}, "verified": pa.array(columns[5], pa.bool_())})


def manifest(docs: DataFrame, columns: list[str], tree_col: str = "lang", id_col: str = "doc_id", tampered: list[Column] | None = None, when: Column | None = None) -> DataFrame:
    """The manifest of a table with a proof for each row, and whether the row as it is found now still gives the root.

    A row's leaf is the hash of `columns`, null told apart from empty. Within each value of tree_col leaves ascend by id (null first; equal ids by leaf, so that repeated
    rows are leaves of their own); every 8 in a row become a node, and so on to the subroot. Subroots ascend by tree_col (null first, bytewise) under one root.
    A proof is the siblings from the leaf to the root. Rows for which `when` holds are hashed anew as `tampered` and folded with the original siblings.

    Leaves are hashed by one pass over the table and written; from there on only hashes move. Each block of 512 leaves asks for the siblings above it once,
    derives what lies under it, and expands its own leaves' proofs. Texts of any length are hashed whole by Spark. An empty table gives an empty result; other columns are ignored.

    Returns (id, leaf, subroot, root, proof_sha256, folded_root, verified).
    """
    scratch = Scratch(docs.sparkSession)
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    changed = F.when(when, leaf_of(tampered)) if tampered else F.lit(None).cast("binary")
    hashed = docs.select(tree.alias("tree"), F.col(f"`{id_col}`").cast("long").alias("id"), leaf_of([F.col(f"`{c}`") for c in columns]).alias("leaf"), changed.alias("tampered"))
    leaves = placed(scratch.written(hashed, "hashed"), scratch, "leaves")
    nodes = nodes_over(leaves, scratch, "nodes")
    ends = leaves.filter("n = 1").select("tree", F.col("leaf")).unionByName(nodes.filter(F.expr(f"shiftright(n - 1, {BITS} * level) = 0")).select("tree", F.col("node").alias("leaf")))
    roots = placed(ends.select(F.lit("").alias("tree"), F.col("tree").alias("id"), "leaf"), scratch, "roots")
    over = nodes_over(roots, scratch, "over")
    trees = roots.select("tree", "n", F.col("pos").alias("block"), F.col("id").alias("of"))
    chains = fetched(trees.drop("of"), 0, roots.select("tree", "n", F.lit(0).alias("level"), "pos", F.col("leaf").alias("node")).unionByName(over))
    chains = chains.join(trees.select("tree", "block", "of"), ["tree", "block"]).select(F.col("of").alias("tree"), "n", "level", "pos", "node")
    chains = chains.unionByName(trees.select(F.col("of").alias("tree"), "n", F.lit(-1).alias("level"), F.col("block").alias("pos"), F.lit(None).cast("binary").alias("node")))
    chains = scratch.written(chains, "chains")
    whole, leaves = leaves, leaves.withColumn("block", F.shiftright("pos", BLOCK))
    blocks = leaves.select("tree", "n", "block").distinct()
    own = fetched(blocks, HOP, nodes).select("tree", "block", F.lit(False).alias("upper"), "level", "pos", "node", "n")
    rest = blocks.drop("n").join(F.broadcast(chains) if chains.count() <= FEW else chains, "tree")
    held = scratch.written(own.unionByName(rest.select("tree", "block", F.lit(True).alias("upper"), "level", "pos", "node", "n")), "fetched")
    scratch.close(whole, held)
    found = leaves.groupBy("tree", "block").cogroup(held.groupBy("tree", "block")).applyInArrow(expand, PROOFS)
    return found.withColumnRenamed("id", id_col)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of documents, where 3 divides the id's crc32 checked against texts whose A-Z were lower-cased (null texts and rows with a null id stay)."""
    tampered = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    return manifest(docs, COLUMNS, tampered=tampered, when=crc_mod(F.col("doc_id"), 3) == 0)


SQL = """
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS rid, doc_id, text, coalesce('=' || lang, '') AS tree,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           list_reduce(list_transform(range(8 * length(doc_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1)) ELSE 0 END::BIGINT),
                       lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295::BIGINT) AS crc
    FROM documents),
h AS (
    SELECT rid, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, xor(crc, 4294967295) % 3 = 0 AS hit,
           sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS other FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
nodes AS (
    SELECT tree, n, 0 AS level, pos, leaf AS node FROM leaves
    UNION ALL
    SELECT tree, n, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE (n - 1) >> (3 * level) > 0 GROUP BY tree, n, level, pos // 8),
roots AS (
    SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE (n - 1) >> (3 * level) = 0),
tops AS (
    SELECT n, 0 AS level, pos, subroot AS node FROM roots
    UNION ALL
    SELECT n, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE (n - 1) >> (3 * level) > 0 GROUP BY n, level, pos // 8),
runs AS (SELECT tree, level, pos // 8 AS run, list(node ORDER BY pos) AS own FROM nodes WHERE (n - 1) >> (3 * level) > 0 GROUP BY ALL),
top_runs AS (SELECT level, pos // 8 AS run, list(node ORDER BY pos) AS own FROM tops WHERE (n - 1) >> (3 * level) > 0 GROUP BY ALL),
up AS (
    SELECT rid, tree, n, 0 AS level, pos, CASE WHEN hit THEN other ELSE leaf END AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT rid, tree, n, level + 1, pos // 8, sha256(array_to_string(own[1:(pos % 8)::INT], '') || node || array_to_string(own[(pos % 8 + 2)::INT:], '')),
           proof || array_to_string(own[1:(pos % 8)::INT], '') || array_to_string(own[(pos % 8 + 2)::INT:], '')
    FROM up JOIN runs USING (tree, level) WHERE run = pos // 8),
over AS (
    SELECT rid, roots.n, 0 AS level, roots.pos, node, proof FROM up JOIN roots USING (tree) WHERE (up.n - 1) >> (3 * level) = 0
    UNION ALL
    SELECT rid, n, level + 1, pos // 8, sha256(array_to_string(own[1:(pos % 8)::INT], '') || node || array_to_string(own[(pos % 8 + 2)::INT:], '')),
           proof || array_to_string(own[1:(pos % 8)::INT], '') || array_to_string(own[(pos % 8 + 2)::INT:], '')
    FROM over JOIN top_runs USING (level) WHERE run = pos // 8)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM over JOIN leaves USING (rid) JOIN roots USING (tree), (SELECT node AS root FROM tops WHERE (n - 1) >> (3 * level) = 0)
WHERE (over.n - 1) >> (3 * level) = 0
"""
