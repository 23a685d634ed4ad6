"""Exact deduplication by Patricia tries.

Texts are equal when they are the same bytes after lower-casing A-Z. Each task first puts the texts it reads into a
compressed radix trie of its own, whose terminal nodes hold the owner (the smallest or largest identifier) and the
number of rows; so a text copied a million times leaves a task once. What is left is partitioned by length and content
hash and sorted, and a second trie per partition inserts the full bytes below a prefix of length and hash. A subtree
is complete when the next prefix begins, and is then given out and dropped; the first trie, which has no order, gives
out its largest subtree whenever its bytes pass a limit. Both merge exactly, as the second trie adds up what it gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tristrata.llm.common import batch, bounded_batches, text_or_empty, unused, written

#: Bytes of text that the trie of a task may hold before it gives out a subtree.
TRIE_BYTES = 32 << 20

OWNERS = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("owner_rows", pa.int64()), ("rows", pa.int64())])
OWNERS_SCHEMA = "n_bytes long, content_hash long, text binary, owner long, owner_rows long, rows long"
GROUPS = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("group_size", pa.int64())])
GROUPS_SCHEMA = "text_sha256 string, keep_id long, keep_rows long, group_size long"
KEYS = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string())])


class Node:
    """A node of a compressed radix trie: the bytes that lead to it, its children by first byte, its terminal state."""

    __slots__ = ("label", "children", "owner", "owner_rows", "rows")

    def __init__(self, label: bytes):
        self.label, self.children = label, {}
        self.owner, self.owner_rows, self.rows = None, 0, 0


class Trie:
    """Byte strings with the owner and the number of rows of each."""

    def __init__(self, largest: bool):
        self.better = max if largest else min
        self.root, self.bytes = Node(b""), 0

    def add(self, key: bytes, owner: int | None, rows: int = 1, owner_rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.bytes += len(child.label) + 200
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, key, at)
            middle = node.children[key[at]] = Node(label[:same])
            child.label = label[same:]
            middle.children[label[same]] = child
            self.bytes += 200
            node, at = middle, at + same
        node.rows += rows
        if owner == node.owner:
            node.owner_rows += owner_rows
        elif owner is not None and (node.owner is None or self.better(node.owner, owner) == owner):
            node.owner, node.owner_rows = owner, owner_rows

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int, int]]:
        """Give out and drop the subtree below one first byte, or everything."""
        if first is None:
            stack = [(b"", self.root)]
            self.root, self.bytes = Node(b""), 0
        else:
            child = self.root.children.pop(first)
            stack = [(b"", child)]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node.label
            if first is not None:
                self.bytes -= len(node.label) + 200
            if node.rows:
                yield key, node.owner, node.owner_rows, node.rows
            stack.extend((key, c) for c in node.children.values())

    def largest_subtree(self) -> int:
        def weight(node: Node) -> int:
            total, stack = 0, [node]
            while stack:
                n = stack.pop()
                total += len(n.label)
                stack.extend(n.children.values())
            return total

        return max(self.root.children, key=lambda b: weight(self.root.children[b]))


def _shared(label: bytes, key: bytes, at: int) -> int:
    """Length of the common start of ``label`` and ``key[at:]``, which differ somewhere, by bisection."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def normalised(text: str) -> bytes:
    """UTF-8 with A-Z in lower case; bytes.lower() leaves everything else."""
    return text.encode("utf-8", "surrogatepass").lower()


def _local_owners(largest: bool, limit: int):
    def insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(largest)

        def rows_of(found):
            block, size = [], 0
            for text, *state in found:
                block.append((len(text), xxhash.xxh64_intdigest(text) - (1 << 63), text, *state))
                size += len(text)
                if size > 4 << 20 or len(block) >= 4000:
                    yield batch(OWNERS, *zip(*block))
                    block, size = [], 0
            if block:
                yield batch(OWNERS, *zip(*block))

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                trie.add(normalised(text), doc)
            while trie.bytes > limit:
                yield from rows_of(trie.take(trie.largest_subtree()) if trie.root.children else trie.take())
        yield from rows_of(trie.take())
    return insert


def _merged_owners(largest: bool):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, prefix = Trie(largest), None
        block: list[tuple] = []

        def take():
            # Texts are hashed as the trie gives them out; only hashes wait in the block.
            block.extend((hashlib.sha256(text).hexdigest(), *state) for text, *state in trie.take())

        for rows in batches:
            for n_bytes, content_hash, text, owner, owner_rows, n in zip(*(c.to_pylist() for c in rows.columns)):
                if (n_bytes, content_hash) != prefix:
                    take()
                    prefix = (n_bytes, content_hash)
                trie.add(text, owner, n, owner_rows)
            if len(block) >= 2000:
                yield batch(GROUPS, *zip(*block))
                block.clear()
        take()
        if block:
            yield batch(GROUPS, *zip(*block))
    return merge


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield batch(KEYS, rows.column(0), [hashlib.sha256(normalised(t)).hexdigest() for t in rows.column(1).to_pylist()])


def _id_and_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))


def text_groups(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per distinct normalised text: ``text_sha256``, ``keep_id`` (null when all ids are null), ``keep_rows``
    (rows with that id and text), ``group_size``.

    A null text counts as an empty one. Null ids never own a text that has another row.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    local = _id_and_text(docs, id_column, text_column).mapInArrow(_local_owners(keep == "largest", trie_bytes), OWNERS_SCHEMA)
    dealt = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_merged_owners(keep == "largest"), GROUPS_SCHEMA)


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``kept`` marks the row whose id is ``keep_id``; rows that repeat that id with the same text are all marked (use
    ``drop_exact_duplicates`` to keep one). A null text is an empty one; a null id is kept only in a group of null
    ids. Other columns of ``docs`` are ignored. Empty tables give empty results.
    """
    keys = _id_and_text(docs, id_column, text_column).mapInArrow(_keys, "doc_id long, text_sha256 string")
    groups = text_groups(docs, keep, id_column, text_column, trie_bytes)
    return keys.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text", trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """The rows of ``docs`` without copies: of rows with equal texts the one with the smallest or largest id stays.

    All columns are kept as they are. Where the staying id occurs several times with that text, one of those rows stays.
    """
    groups = written(text_groups(docs, keep, id_column, text_column, trie_bytes).filter("group_size > 1"), "text-groups")
    sha, owner, times = (unused(docs, name) for name in ("sha", "owner", "times"))
    copies = groups.select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(owner), F.col("keep_rows").alias(times))
    names = docs.columns
    at = names.index(text_column)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            digests = [hashlib.sha256(normalised(t or "")).hexdigest() for t in rows.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(digests, pa.string())], names=[*names, sha])

    marked = docs.mapInArrow(hashed, T.StructType([*docs.schema.fields, T.StructField(sha, T.StringType())]))
    # The same plan at all sizes: rows are dealt by hash, and a hash with very many rows is split by the skew rule.
    marked = marked.join(copies.hint("merge"), sha, "left")
    is_owner = F.col(id_column).cast("long").eqNullSafe(F.col(owner))
    if groups.filter("keep_rows > 1").isEmpty():
        return marked.filter(F.col(times).isNull() | is_owner).select(*names)
    once = marked.filter(F.col(times).isNull() | is_owner & (F.col(times) == 1))
    again = marked.filter((F.col(times) > 1) & is_owner).dropDuplicates([sha])
    return once.unionByName(again).select(*names)
