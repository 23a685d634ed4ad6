"""SimHash near-duplicates by covering locality-sensitive hashing.

Bits ``i`` of a fingerprint carry vectors ``m(i) = (1, x)`` of ``radius + 1`` bits, where ``x`` counts through all
values. For every ``v`` there is a mask of the bits with odd ``<m(i), v>``. The bits in which two fingerprints within
the radius differ span at most ``radius`` dimensions, so some ``v`` other than zero is orthogonal to all of them, and
both agree under its mask: every such pair shares a bucket in some table. (``v = (1, 0)`` selects all bits and is left
out.) Each mask selects half of the bits.

``words`` fingerprints per document, of hashes mixed differently, raise the recall where similar texts often differ in more
bits than the radius: documents are linked if they are within the radius in any of them.

Distinct fingerprints only are compared. A bucket of up to ``MAX_BUCKET`` of them goes to one task, which gives out a
spanning forest of its links and never all pairs. Larger buckets are hashed again by a covering of the bits that their
mask left free; after three levels eight bits are left, that is at most 256 distinct fingerprints, so every bucket
ends in a task and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tristrata.llm.common import batch, bounded_batches, few_files, runs, text_or_empty, unused, written
from tristrata.llm.components import components

#: Distinct fingerprints of one bucket that a task compares with each other.
MAX_BUCKET = 4096

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fps", pa.list_(pa.int64()))])
EDGES = pa.schema([("word", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``size`` words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is one if it is set in over half of the hashes; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes themselves for word 0, else another value of each (the splitmix64 finaliser)."""
    if not word:
        return hashes
    z = hashes + np.uint64((word * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def text_fingerprints(text: str, size: int, words: int = 1, distinct: bool = False) -> list[int]:
    """The fingerprints of a text, over every shingle or over each different one once."""
    # bytes.lower() changes A-Z only, and bytes.split() separates at \x20 and \x09-\x0D only.
    hashes = shingle_hashes(text.encode("utf-8", "surrogatepass").lower().split(), size)
    return hash_fingerprints(np.unique(hashes) if distinct else hashes, words)


def hash_fingerprints(hashes: np.ndarray, words: int) -> list[int]:
    """``words`` fingerprints of the hashes, each of other values of them."""
    return [fingerprint(_mixed(hashes, w)) for w in range(words)]


def fingerprints(docs: DataFrame, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text", words: int = 1,
                 distinct: bool = False) -> DataFrame:
    """One row ``(doc_id, text_key, fps)`` per row of ``docs``, ``fps`` signed 64-bit integers. A null text is an empty one."""
    bounded_batches(docs.sparkSession)

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(FINGERPRINTS, rows.column(0), rows.column(1), [text_fingerprints(t, shingle, words, distinct) for t in rows.column(2).to_pylist()])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(hash_texts, "doc_id long, text_key long, fps array<long>")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits`` such that two values that differ in at most ``radius`` of them agree under one mask."""
    width = 1 << radius
    vectors = [width | i % width for i in range(len(bits))]
    masks = []
    for v in range(1, 2 * width):
        if v != width:
            masks.append(sum(1 << bit for bit, m in zip(bits, vectors) if (m & v).bit_count() % 2))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free(mask: int) -> list[int]:
    return [i for i in range(64) if not mask >> i & 1]


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all pairs of distinct ``values`` within ``radius`` bits."""
    rest, links = values, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                links.extend(zip(repeat(node), found))
                queue.extend(found)
    return links


def _bucket_links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in runs(batches, "bucket", "word"):
            values = np.unique(bucket.column("fp").to_numpy().astype(np.int64).view(np.uint64))
            if found := spanning_links(values, radius):
                pairs = np.array(found, np.uint64).view(np.int64)
                yield batch(EDGES, [bucket.column("word")[0].as_py()] * len(pairs), pairs[:, 0], pairs[:, 1])
    return link


def linked_fingerprints(distinct: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges ``(word, u, v)`` between values of ``fp`` that connect whatever links of at most ``radius`` bits connect.

    ``distinct`` holds every pair ``(word, fp)`` once; only fingerprints of the same word are linked. Repeated edges
    may occur. Buckets are told apart by a hash of word, mask and masked bits, as a collision only adds comparisons.
    """
    spark = distinct.sparkSession
    schema = "word int, u long, v long"
    if radius < 1:
        return spark.createDataFrame([], schema)
    keyed = distinct.select("word", "fp", F.explode(F.array(*(F.lit(_signed(m)) for m in covering_masks(list(range(64)), radius)))).alias("mask"))
    edges = None
    depth = 0
    while True:
        keyed = keyed.withColumn("bucket", F.xxhash64("word", "mask", F.col("fp").bitwiseAND(F.col("mask"))))
        # Rows are dealt once, by bucket. Buckets of one fingerprint, nearly all of them, end here.
        sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).filter("n > 1")
        sized = written(sized, "shared-buckets")
        shared = sized.filter(F.col("n") <= max_bucket).select("bucket", "word", "fp")
        links = shared.repartition("bucket").sortWithinPartitions("bucket", "word").mapInArrow(_bucket_links(radius), schema)
        edges = links if edges is None else edges.unionByName(links)
        inside = sized.filter(F.col("n") > max_bucket).select("word", "fp", "mask")
        if inside.isEmpty():
            return edges
        depth += 1
        used = [row.mask & (2 ** 64 - 1) for row in inside.select("mask").distinct().collect()]  # at most as many as there are masks
        finer = [(_signed(m), _signed(n)) for m in used for n in {m | x for x in covering_masks(_free(m), radius)}]
        tables = spark.createDataFrame(finer, "mask long, finer long")
        keyed = inside.join(F.broadcast(tables), "mask").select("word", "fp", F.col("finer").alias("mask")).distinct()
        if depth == 3:
            max_bucket = 1 << 62


def linked_nodes(nodes: DataFrame, radius: int = 4, max_bucket: int = MAX_BUCKET, sharing: bool = True) -> DataFrame:
    """Edges ``(u, v)`` between nodes of which a fingerprint, of the same place in ``fps``, differs in at most ``radius`` bits.

    ``nodes`` holds every ``(node, fps)`` once. Edges connect whatever such links connect, and may repeat. ``sharing`` is
    False if no two nodes have a fingerprint in common.
    """
    valued = nodes.select("node", F.posexplode("fps").alias("word", "fp"))
    # One node stands for a fingerprint; others that share it are linked to that one.
    standing = valued.groupBy("word", "fp").agg(F.min("node").alias("first"), F.count("*").alias("n"))
    standing = written(few_files(standing, valued.count()), "distinct-fingerprints")
    links = linked_fingerprints(standing.select("word", "fp"), radius, max_bucket)
    for end in ("u", "v"):
        firsts = standing.select("word", F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
        links = links.join(firsts, ["word", end])
    edges = links.select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    if sharing:
        shared = valued.join(standing.filter("n > 1"), ["word", "fp"]).select(F.col("node").alias("u"), F.col("first").alias("v"))
        edges = edges.unionByName(shared)
    return edges


def near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text",
    max_bucket: int = MAX_BUCKET, words: int = 1, distinct: bool = False,
) -> DataFrame:
    """One row ``(doc_id, fps, fingerprint, component_id)`` per row of ``docs``.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and into runs of ``shingle`` words, repeats
    included unless ``distinct``. Documents are linked where one of their ``words`` fingerprints differs in at most
    ``radius`` bits, and ``component_id`` is the smallest id that links reach, the document's own included.
    ``fingerprint`` is the first one in 16 hexadecimal digits.

    Null and empty texts have the fingerprint zero and are linked like others. Rows with equal ids or equal texts are
    rows of their own. A null id is never a component id unless all ids it reaches are null. Empty tables give empty
    results. Other columns of ``docs`` are ignored.
    """
    return _placed(docs, radius, shingle, id_column, text_column, max_bucket, words, distinct).drop("text_key")


def _placed(docs: DataFrame, radius: int, shingle: int, id_column: str, text_column: str, max_bucket: int, words: int, distinct: bool) -> DataFrame:
    """What ``near_duplicates`` gives, with the ``text_key`` of each row."""
    prints = written(fingerprints(docs, shingle, id_column, text_column, words, distinct), "fingerprints")
    # Documents of equal fingerprints are one node, named by its first fingerprint.
    nodes = prints.groupBy("fps").agg(F.min("doc_id").alias("least_id"))
    nodes = written(nodes.withColumn("node", F.xxhash64("fps") if words > 1 else F.col("fps")[0]), "nodes")
    edges = linked_nodes(nodes, radius, max_bucket, sharing=words > 1)
    placed = nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("fps", "component_id")
    return prints.join(named, "fps").select(
        "doc_id", "text_key", "fps", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, radius: int = 4, shingle: int = 5, words: int = 6, distinct: bool = True, id_column: str = "doc_id",
    text_column: str = "text", max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: the row with the smallest id of each group stays.

    Groups are the components of ``near_duplicates``. With six fingerprints of five-word shingles, each counted once, most
    texts of a Jaccard similarity of 0.9 and more are found, and few below 0.75. Texts without words have no shingle
    to be alike in, and all stay. Rows with a null id stay if their group has no other, and rows of the group that
    repeat the id that stays do so, too. Every row goes or stays by its own text, whatever other rows of its id do.
    """
    found = _placed(docs, radius, shingle, id_column, text_column, max_bucket, words, distinct)
    leaving = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.exists("fps", lambda x: x != 0))
    return without_rows(docs, leaving, id_column, text_column)


def text_key(text_column: str = "text"):
    """A 64-bit hash of the text; a null text is an empty one."""
    return F.xxhash64(text_or_empty(text_column)).alias("text_key")


def without_rows(docs: DataFrame, leaving: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id, null included, and text are no pair ``(doc_id, text_key)`` of ``leaving``.

    Rows of an equal id with another text stay. Only ids and hashes are listed that go, so texts are not dealt by group.
    """
    gone, key, text = unused(docs, "gone"), unused(docs, "gone_id"), unused(docs, "gone_text")
    leaving = written(leaving.select(F.col("doc_id").alias(key), F.col("text_key").alias(text)).distinct(), "near-duplicates").withColumn(gone, F.lit(True))
    same = F.col(id_column).cast("long").eqNullSafe(F.col(key)) & (text_key(text_column) == F.col(text))
    return docs.join(leaving.hint("merge"), same, "left").filter(F.col(gone).isNull()).select(*docs.columns)
