"""A Merkle manifest of a table, in blocks laid out after van Emde Boas.

Every row has a leaf, the SHA-256 of its columns. In each group the leaves stand in order of a key, and runs of ``ARITY``
nodes are hashed to one, level by level, until one node is left, the group's subroot; the subroots, in order of the
groups, are hashed in the same way to the root. Inputs of a hash are digests as lowercase hexadecimal text.

A tree of any size is cut into aligned subtrees of ``HEIGHT`` levels above their leaves, the blocks. The nodes of a block
are one array in van Emde Boas order: the tree is split at half of its height into a top and the bottom trees below it,
each of which lies in one piece, split in the same way. ``place`` computes addresses in it; construction writes and
sibling retrieval reads through them, so a path from a leaf to the top touches few stretches of memory, whatever the size
of a cache line or page. The roots of blocks are the leaves of the next blocks, until a block is alone.

In Spark rows are put in order by ranges, so that no group has to fit a task; a block holds at most ``ARITY ** HEIGHT``
leaves; the blocks of one level are built by one job and stored, and the number of levels is the logarithm of the largest
group by that number. Proofs go the other way: what a block's root has above it is worked out once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tristrata.llm.common import batch, unused, written
from tristrata.sources.files import folder_names

BITS = 3
ARITY = 1 << BITS
#: Levels of a block above its leaves.
HEIGHT = 4
SIZE = ARITY ** HEIGHT

BLOCK = "tree long, block long, total long, n int, nodes binary, root binary"
PATH = "tree long, i long, places array<int>, siblings array<string>"
PATHS = pa.schema([("tree", pa.int64()), ("i", pa.int64()), ("places", pa.list_(pa.int32())), ("siblings", pa.list_(pa.string()))])


def complete(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def place(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Addresses of the nodes ``index`` of a ``depth`` (0 for the root) in the layout of a complete tree."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return place(top, depth, index)
    below = depth - top
    tree, inside = index >> (BITS * below), index & ((1 << (BITS * below)) - 1)
    return complete(top) + tree * complete(levels - top) + place(levels - top, below, inside)


def digest(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def height_of(total: int) -> int:
    """Levels above the leaves of a block in a tree of ``total`` leaves of this level."""
    height = 0
    while height < HEIGHT and ARITY ** height < total:
        height += 1
    return height


class Block:
    """The nodes of a subtree over ``n`` leaves; runs at the end may be short."""

    def __init__(self, nodes: np.ndarray, n: int, height: int):
        self.nodes, self.n, self.height = nodes, n, height

    @classmethod
    def build(cls, leaves: Sequence[bytes], height: int) -> Block:
        block = cls(np.zeros((complete(height + 1), 32), np.uint8), len(leaves), height)
        row = [leaf.hex() for leaf in leaves]
        block._put(height, row)
        for depth in range(height - 1, -1, -1):
            row = [digest("".join(row[i:i + ARITY])) for i in range(0, len(row), ARITY)]
            block._put(depth, row)
        return block

    def _put(self, depth: int, row: list[str]) -> None:
        digests = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        self.nodes[place(self.height + 1, depth, np.arange(len(row)))] = digests

    def width(self, depth: int) -> int:
        return -(-self.n // ARITY ** (self.height - depth))

    def run(self, depth: int, first: int) -> str:
        """The digests of a run of siblings, as they are hashed."""
        index = np.arange(first, min(first + ARITY, self.width(depth)))
        return self.nodes[place(self.height + 1, depth, index)].tobytes().hex()

    def paths(self) -> list[tuple[list[int], list[str]]]:
        """For every leaf, from below: its ancestors' places in their runs, and the runs without them."""
        places: list[list[int]] = [[] for _ in range(self.n)]
        siblings: list[list[str]] = [[] for _ in range(self.n)]
        for depth in range(self.height, 0, -1):
            shift = BITS * (self.height - depth)
            known: dict[int, str] = {}
            for leaf in range(self.n):
                node = leaf >> shift
                at = node & (ARITY - 1)
                if node not in known:
                    run = self.run(depth, node - at)
                    for i in range(len(run) // 64):
                        known[node - at + i] = run[:64 * i] + run[64 * i + 64:]
                places[leaf].append(at)
                siblings[leaf].append(known[node])
        return list(zip(places, siblings))

    def root(self) -> bytes:
        return self.nodes[place(self.height + 1, 0, np.zeros(1, np.int64))[0]].tobytes()


def fold(node: str, places: Sequence[int], siblings: Sequence[str]) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for at, run in zip(places, siblings):
        node = digest(run[:64 * at] + node + run[64 * at:])
    return node


def row_digest(columns: Sequence[Column | str]) -> Column:
    """The leaf of a row: SHA-256 of its columns, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    def field(column: Column | str) -> Column:
        text = (F.col(column) if isinstance(column, str) else column).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0: ranges are sorted apart, and know what lies before them."""
    part, at, before = (unused(df, n) for n in ("part", "at", "before"))
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ordered = written(ordered.withColumn(part, F.shiftright(at, 33)), "ordered")
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n"), F.min(at).alias("first"))  # a row per range
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(part, (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias(before))
    return ordered.join(sizes, part).withColumn(name, (F.col(at) + F.col(before)).cast("long")).select(*df.columns, name)


def _build_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("i")
    total = rows.column("total")[0].as_py()
    block = Block.build(rows.column("leaf").to_pylist(), height_of(total))
    return pa.table({
        "tree": rows.column("tree")[:1], "block": rows.column("block")[:1], "total": rows.column("total")[:1],
        "n": pa.array([block.n], pa.int32()), "nodes": pa.array([block.nodes.tobytes()], pa.binary()), "root": pa.array([block.root()], pa.binary())})


def _block_of(nodes: bytes, n: int, total: int) -> Block:
    return Block(np.frombuffer(nodes, np.uint8).reshape(-1, 32), n, height_of(total))


def grow(leaves: DataFrame, path: str) -> DataFrame:
    """Store the blocks of all trees over ``leaves`` ``(tree, i, total, leaf)``, a folder for each level; gives ``(tree, root)``."""
    spark, levels = leaves.sparkSession, []
    most = leaves.agg(F.max("total")).first()[0] or 0
    while True:
        blocks = leaves.withColumn("block", F.shiftright("i", BITS * HEIGHT)).groupBy("tree", "block").applyInArrow(_build_block, BLOCK)
        blocks.write.parquet(f"{path}/level={len(levels)}")
        levels.append(spark.read.schema(BLOCK).parquet(f"{path}/level={len(levels)}"))
        if most <= SIZE:
            break
        most = -(-most // SIZE)
        leaves = levels[-1].filter(F.col("total") > SIZE).select(
            "tree", F.col("block").alias("i"), F.ceil(F.col("total") / SIZE).alias("total"), F.col("root").alias("leaf"))
    return _roots(levels)


def _roots(levels: Sequence[DataFrame]) -> DataFrame:
    roots = None
    for blocks in levels:
        whole = blocks.filter(F.col("total") <= SIZE).select("tree", "root")
        roots = whole if roots is None else roots.unionByName(whole)
    return roots


def _leaf_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every leaf of blocks that come with the path from their root up."""
    for rows in batches:
        for row in rows.to_pylist():
            paths = _block_of(row["nodes"], row["n"], row["total"]).paths()
            out = [(row["tree"], row["block"] * SIZE + j, p + row["places"], s + row["siblings"]) for j, (p, s) in enumerate(paths)]
            for k in range(0, len(out), 512):
                yield batch(PATHS, *zip(*out[k:k + 512]))


def with_paths(levels: Sequence[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The blocks of the lowest level with the path from their root up; ``above`` has ``(tree, places, siblings)`` of trees
    whose root is not the root of all."""
    placed = None
    for blocks in reversed(levels):
        whole = blocks.filter(F.col("total") <= SIZE)
        if above is None:
            whole = whole.withColumns({"places": F.array().cast("array<int>"), "siblings": F.array().cast("array<string>")})
        else:
            whole = whole.join(above, "tree")
        if placed is not None:
            paths = placed.mapInArrow(_leaf_paths, PATH).withColumnRenamed("i", "block")
            whole = whole.unionByName(blocks.filter(F.col("total") > SIZE).join(paths, ["tree", "block"]))
        placed = whole
    return placed


def _prove(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
    """Proof and folded root of each of the leaves of one block."""
    row = blocks.to_pylist()[0]
    paths = _block_of(row["nodes"], row["n"], row["total"]).paths()
    proofs, folded = [], []
    for i, leaf, claim in zip(*(leaves.column(c).to_pylist() for c in ("i", "leaf", "claim"))):
        places, siblings = paths[i - row["block"] * SIZE]
        siblings = siblings + row["siblings"]
        proofs.append(digest("".join(siblings)))
        folded.append(fold((leaf if claim is None else claim).hex(), places + row["places"], siblings))
    return pa.table({**{c: leaves.column(c) for c in ("tree", "key", "leaf")}, "proof_sha256": proofs, "folded_root": folded})


@dataclass
class Manifest:
    """A stored manifest: leaves in their places, blocks of the groups' trees and of the tree above them, roots.

    ``leaves`` has ``key, group, leaf, claim`` and the place ``tree, i, total``; ``groups`` has ``tree, group, subroot``. ``root`` is None for a table without rows.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame
    root: str | None

    def prove(self) -> DataFrame:
        """``key, group, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

        The proof holds the siblings of the path from the leaf to the root, ``proof_sha256`` is their digest. The
        root is folded anew from the claim (the leaf where there is none) and those siblings; it is ``verified`` if
        it is the manifest's.
        """
        of_groups = with_paths(self.top).mapInArrow(_leaf_paths, PATH).select(F.col("i").alias("tree"), "places", "siblings")
        blocks = with_paths(self.levels, of_groups)
        rows = self.leaves.select("tree", F.shiftright("i", BITS * HEIGHT).alias("block"), "i", "key", "leaf", "claim")
        schema = f"tree long, key {dict(self.leaves.dtypes)['key']}, leaf binary, proof_sha256 string, folded_root string"
        proved = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_prove, schema)
        return proved.join(self.groups, "tree").select(
            "key", "group", F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(self.root).alias("root"), "proof_sha256", "folded_root",
            (F.col("folded_root") == F.lit(self.root)).alias("verified"))


def write_manifest(
    docs: DataFrame, path: str, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
    key: str = "doc_id", claim: Column | None = None,
) -> Manifest:
    """Write the manifest of ``docs`` below ``path``, which must not exist yet.

    Leaves are digests of ``columns``; they stand by ``key`` in each ``group``, nulls first, and groups by their UTF-8
    bytes, the null group first. Rows of one key stand in order of their leaves, so the root does not depend on how the
    table is split; rows that repeat whole are leaves of their own. Null and empty values differ. ``claim`` is the
    digest of a row as it is handed over to be verified, null where that is the leaf. Other columns are ignored.
    """
    spark = docs.sparkSession
    claim = F.lit(None).cast("string") if claim is None else claim
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("group"), F.unhex(row_digest(columns)).alias("leaf"), F.unhex(claim).alias("claim"))
    # Rows that repeat whole are dealt by their place in the input, as any order of them is right.
    rows = numbered(rows.withColumn("spread", F.monotonically_increasing_id()), ["group", "key", "leaf", "spread"], "number")
    groups = rows.groupBy("group").agg(F.min("number").alias("first"), F.count("*").alias("total"))
    groups = written(numbered(groups, ["group"], "tree"), "groups")
    at = groups.select(F.col("group").alias("of_group"), "first", "total", "tree")
    placed = rows.join(at, F.col("group").eqNullSafe(F.col("of_group"))).withColumn("i", F.col("number") - F.col("first"))
    placed = placed.select("key", "group", "leaf", "claim", "tree", "i", "total")
    placed.write.parquet(f"{path}/leaves")
    leaves = spark.read.schema(placed.schema).parquet(f"{path}/leaves")
    roots = grow(leaves.select("tree", "i", "total", "leaf"), f"{path}/groups")
    count = F.lit(groups.count()).cast("long")
    tops = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), count.alias("total"), F.col("root").alias("leaf"))
    grow(tops, f"{path}/top")
    named = groups.select("tree", "group").join(roots, "tree").select("tree", "group", F.lower(F.hex("root")).alias("subroot"))
    named.write.parquet(f"{path}/subroots")
    return read_manifest(spark, path)


def _stored_levels(spark: SparkSession, path: str) -> list[DataFrame]:
    names = [n for n in folder_names(spark, path) if n.startswith("level=")]
    return [spark.read.schema(BLOCK).parquet(f"{path}/level={n}") for n in range(len(names))]


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    top = _stored_levels(spark, f"{path}/top")
    root = _roots(top).first()
    return Manifest(spark.read.parquet(f"{path}/leaves"), _stored_levels(spark, f"{path}/groups"), top, spark.read.parquet(f"{path}/subroots"),
                    None if root is None else root.root.hex())
