"""Merkle manifest of a dataset: blocks are reduced where they lie, a small top tree is broadcast to all proofs."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, materialise, scratch_dir

#: Columns of documents that a leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Proof step: L and R tell on which side the sibling stands, - that there is none.
LEFT, RIGHT, NONE = "L", "R", "-"
STEPS = T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("digest", T.StringType())]))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each - if null, else its UTF-8 byte count, a colon and itself."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[k : k + 2])).hexdigest().encode() for k in range(0, len(nodes), 2)]


def _levels(nodes: list[bytes], depth: int | None) -> list[list[bytes]]:
    """Nodes of each level that has a parent level and last the one that is left: depth levels up, or
    until one node remains."""
    out = [nodes]
    while len(out) <= depth if depth is not None else len(out[-1]) > 1:
        out.append(_parents(out[-1]))
    return out


def _paths(levels: list[list[bytes]]) -> tuple[list[list[str]], list[list[str]]]:
    """Of each node of the first level the sides and the siblings on its way up, '' where there is none."""
    n = len(levels[0])
    at, sides, digests = np.arange(n), [], []
    for nodes in levels[:-1]:
        other = at ^ 1
        known = np.array([x.decode() for x in nodes] + [""], object)
        digests.append(known[np.minimum(other, len(nodes))])
        sides.append(np.where(other >= len(nodes), NONE, np.where(at & 1, LEFT, RIGHT)))
        at = at >> 1
    if not sides:
        return [[] for _ in range(n)], [[] for _ in range(n)]
    return np.stack(sides, axis=1).tolist(), np.stack(digests, axis=1).tolist()


@dataclass(frozen=True)
class TopTree:
    """The tree above the nodes that are left: for each (grp, pos) its tree's root, the sides and the siblings
    above it."""

    above: dict[tuple[str, int], tuple[str, list[str], list[str]]]
    root: str | None


def _top_tree(nodes: list[tuple[str, int, str]]) -> TopTree:
    """Trees of all groups and, over their roots in the order of the groups, the last tree."""
    groups: dict[str, list[bytes]] = {}
    for grp, _, digest in sorted(nodes):
        groups.setdefault(grp, []).append(digest.encode())
    if not groups:
        return TopTree({}, None)
    trees = {g: _levels(x, None) for g, x in groups.items()}
    over = _levels([t[-1][0] for t in trees.values()], None)
    above, upper = {}, zip(*_paths(over))
    for (grp, tree), (sides, digests) in zip(trees.items(), upper):
        for pos, (s, d) in enumerate(zip(*_paths(tree))):
            above[grp, pos] = (tree[-1][0].decode(), s + sides, d + digests)
    return TopTree(above, over[-1][0].decode())


def _reduced(nodes: DataFrame, block_bits: int, folder: str) -> DataFrame:
    """Nodes (grp, pos, n_grp, digest) to the node of each block of 2^block_bits neighbours: as many levels up,
    or, in a group of one block, until one node remains."""
    size = 1 << block_bits

    def run(key, table):
        table = table.sort_by("pos")
        n = table.column("n_grp")[0].as_py()
        levels = _levels([d.encode() for d in table.column("digest").to_pylist()], None if n <= size else block_bits)
        row = {"grp": key[0].as_py(), "pos": key[1].as_py(), "n_grp": -(-n // size), "digest": levels[-1][0].decode()}
        return pa.Table.from_pylist([row])

    blocks = nodes.select("grp", F.shiftright("pos", block_bits).alias("block"), "pos", "n_grp", "digest")
    found = blocks.groupBy("grp", "block").applyInArrow(run, "grp string, pos long, n_grp long, digest string")
    return materialise(found, "merkle-nodes", folder)


def _numbered(rows: DataFrame, by: list[str], folder: str) -> DataFrame:
    """Adds pos (gapless from 0 within grp, in the order of by) and n_grp.

    Rows are exchanged once, by ranges of (grp, *by, the row's place in its input), so neither a group nor
    rows equal in all columns are held by one task."""
    place = F.monotonically_increasing_id()
    keys = ["grp", *by, "place"]
    dealt = rows.withColumn("place", place).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("place")
    dealt = dealt.withColumns({"part": F.shiftright(place, 33), "row": place.bitwiseAND((1 << 33) - 1)})
    dealt = materialise(dealt, "merkle-ranges", folder)
    # One row for each range and group in it, so a group's window has at most as many rows as there are ranges.
    ranges = dealt.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    in_grp = Window.partitionBy("grp")
    shift = F.sum("n").over(in_grp.orderBy("part")) - F.col("n") - F.col("first")
    ranges = ranges.select("grp", "part", shift.alias("shift"), F.sum("n").over(in_grp).alias("n_grp"))
    return dealt.join(ranges, ["grp", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _with_paths(nodes: DataFrame, block_bits: int, kept: list[str], top: TopTree | None, upper: DataFrame | None) -> DataFrame:
    """The kept columns of nodes with subroot and proof: the way inside their block, which is built again, and
    then the block's own way, from the top tree or from the table upper (grp, pos, subroot, proof)."""
    shared = nodes.sparkSession.sparkContext.broadcast(top.above) if top else None

    def finish(table: pa.Table, subroot: str, over_sides: list[str], over: list[str]) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n_grp")[0].as_py()
        nodes = [d.encode() for d in table.column("digest").to_pylist()]
        levels = _levels(nodes, None if n <= 1 << block_bits else block_bits)
        sides, siblings = _paths(levels)
        steps = pa.StructArray.from_arrays(
            [pa.array([x for own in sides for x in own + over_sides], pa.string()), pa.array([x for own in siblings for x in own + over], pa.string())],
            ["side", "digest"],
        )
        ends = np.arange(len(nodes) + 1) * (len(levels) - 1 + len(over))
        proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)
        return pa.table([*[table.column(c) for c in kept], pa.array([subroot] * len(nodes), pa.string()), proof], [*kept, "subroot", "proof"])

    def from_top(key, table):
        return finish(table, *shared.value[key[0].as_py(), key[1].as_py()])

    def from_table(table, own):
        steps = own.column("proof")[0].as_py()
        return finish(table, own.column("subroot")[0].as_py(), [s["side"] for s in steps], [s["digest"] for s in steps])

    schema = T.StructType([nodes.schema[c] for c in kept]).add("subroot", T.StringType()).add("proof", STEPS)
    blocks = nodes.withColumn("block", F.shiftright("pos", block_bits)).groupBy("grp", "block")
    if upper is None:
        return blocks.applyInArrow(from_top, schema)
    ways = upper.select("grp", F.col("pos").alias("block"), "subroot", "proof").groupBy("grp", "block")
    return blocks.cogroup(ways).applyInArrow(from_table, schema)


def merkle_proofs(leaves: DataFrame, group: str, by: str, block_bits: int = 12, most_top: int = 1 << 14) -> DataFrame:
    """Merkle trees over rows with a column leaf (hex digest): adds pos, subroot, root and proof.

    Within each value of group (null first, then by UTF-8 bytes) leaves ascend by the column by (null
    first), equal ones by leaf.  Every two consecutive nodes become the sha256 of their hex digests one
    after the other, a last single one the sha256 of its own, until one remains: the group's subroot.  The
    subroots, in the order of their groups, give root in the same way.  proof lists the steps from leaf to
    root as (side, digest): L or R is where the sibling stands, - a step without one (empty digest).

    1. One exchange by ranges of (group, by, leaf) numbers the leaves; a group of any size lies in many tasks.
    2. Blocks of 2^block_bits neighbours are reduced to a node each, over and over, until at most most_top
       nodes are left; where more groups than that are left, their subroots go on as one group.
    3. The driver builds the tree above these nodes and broadcasts its paths: at most most_top of them, each
       of at most 2 log2(most_top) digests that are held once (some 15 MB at the default).
    4. Executors build their blocks again and append each block's path to the ways inside it.

    Rows that repeat are leaves of their own.  All other columns stay (they pass through Python by blocks, so
    leave wide ones out); columns of the new names are replaced.  A table without rows stays empty.  The
    result is a table in the shared folder.
    """
    if not 1 <= block_bits <= 16 or most_top < 1:
        raise ValueError("block_bits must be from 1 to 16 and most_top at least 1")
    spark = leaves.sparkSession
    folder = scratch_dir(spark, "merkle")
    names = [c for c in leaves.columns if c not in ("pos", "subroot", "root", "proof")]
    inner = [f"c{k}" for k in range(len(names))]
    at = dict(zip(names, inner))
    rows = leaves.select(*[F.col(f"`{n}`").alias(i) for n, i in at.items()])
    # A null group is the empty string, all others begin with =, so nulls come first.
    grp = F.coalesce(F.concat(F.lit("="), F.col(at[group]).cast("string")), F.lit(""))
    rows = rows.withColumns({"grp": grp, "digest": F.col(at["leaf"])})
    tables = [materialise(_numbered(rows, [at[by], "digest"], folder), "merkle-leaves", folder)]
    merged = None  # the table of subroots that go on as one group
    while True:
        tables.append(_reduced(tables[-1], block_bits, folder))
        n, widest = tables[-1].agg(F.count("*"), F.coalesce(F.max("n_grp"), F.lit(0))).first()
        if n <= most_top:
            break
        if widest == 1:
            merged = len(tables)
            roots = tables[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
            tables.append(materialise(_numbered(roots, ["name"], folder), "merkle-subroots", folder))
    top = _top_tree([tuple(r) for r in tables[-1].select("grp", "pos", "digest").collect()])

    known, ways = top, None
    for k in range(len(tables) - 2, 0, -1):
        if merged == k + 1:
            ways = ways.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "proof")
        else:
            kept = ["name", "digest"] if merged == k else ["grp", "pos"]
            ways = materialise(_with_paths(tables[k], block_bits, kept, known, ways), "merkle-ways", folder)
        known = None
    found = _with_paths(tables[0], block_bits, [*inner, "pos"], known, ways)
    root = F.lit(top.root).cast("string").alias("root")
    result = materialise(found.select(*[F.col(i).alias(n) for n, i in at.items()], "pos", "subroot", root, "proof"), "merkle-proofs")
    discard(spark, folder)
    return result


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf and the steps of its proof give."""

    def step(node: Column, s: Column) -> Column:
        pair = F.when(s["side"] == LEFT, F.concat(s["digest"], node)).when(s["side"] == RIGHT, F.concat(node, s["digest"]))
        return F.sha2(pair.otherwise(node), 256)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """sha256 over the siblings of a proof, in order."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), ""), 256)


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it still verifies after some are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    leaf = leaf_digest(*map(F.col, FIELDS))
    changed = leaf_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    leaves = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(tampered, changed).otherwise(leaf).alias("now"))
    found = merkle_proofs(leaves, "lang", "doc_id").withColumn("folded_root", folded(F.col("now"), F.col("proof")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
