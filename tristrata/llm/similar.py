"""Near-duplicates by SimHash and MinHash, linked by exact Jaccard similarity of word shingles.

A text is the set of its shingles. First come pairs whose SimHash fingerprints (``WORDS`` of 64 bits over the set) are
within ``RADIUS`` bits, found by the covering tables of ``simhash``; their sets are compared, and the similar ones joined.
That settles copies with few edits. Texts of a similarity of 0.8 differ in more bits than covering tables can bear, so
what is still apart goes on to ``BANDS`` hashes per text, each of ``ROWS`` minima (MinHash): a pair of similarity 0.8
shares none of them with a chance of (1 - 0.8^6)^40, about one in 190,000, more similar ones less.

These candidates are linked after their sets have been compared, too, in two steps. Of each bucket one text is compared
with all others that are not joined to it yet, which settles small buckets and joins most of the large ones. Buckets that
hold texts still apart are then dealt to tasks whole, with each text once; a task counts what its sets share and gives out
a spanning forest of the links, never pairs. Buckets above a size are dealt as a grid of blocks of chunks, in which a text
is copied once for each row of blocks, not for each partner. Buckets of the same texts count once. Nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, few_files, runs, text_or_empty, written
from tristrata.llm.components import components
from tristrata.llm.simhash import hash_fingerprints, linked_nodes, shingle_hashes, text_key, without_rows

#: SimHash fingerprints of a text, and the bits in which those of a candidate pair may differ.
WORDS, RADIUS = 3, 4
BANDS, ROWS = 40, 6
#: Texts and shingles of one chunk of a bucket; a task compares two chunks at most.
CHUNK_TEXTS, CHUNK_SHINGLES = 2048, 1 << 22

_FACTORS = np.random.default_rng(8).integers(0, 1 << 32, (BANDS * ROWS, 2), np.uint32) | np.array([1, 0], np.uint32)

SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()),
                      ("fps", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def shingle_set(text: str, size: int) -> np.ndarray:
    """The different shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass").lower().split(), size))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def band_hashes(shingles: np.ndarray) -> list[int]:
    short = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 512):
        part = short[i:i + 512] * _FACTORS[:, :1]
        part += _FACTORS[:, 1:]
        np.minimum(least, part.min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), b)) for b, row in enumerate(rows)]


def sketches(docs: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, text_key, node, size, fps, bands)`` per row with words; rows with the same set of shingles are one ``node``."""
    bounded_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for doc_id, key, text in zip(*(c.to_pylist() for c in rows.columns)):
                found = shingle_set(text, shingle)
                if len(found):
                    out.append((doc_id, key, _signed(xxhash.xxh64_intdigest(found.tobytes(), 7)), len(found),
                                hash_fingerprints(found, WORDS), band_hashes(found)))
            yield batch(SKETCHES, *(zip(*out) if out else [[]] * 6))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_key(text_column), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, text_key long, node long, size int, fps array<long>, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, thousandths: int) -> bool:
    """Whether two sets, in order, have at least this Jaccard similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1000 * both >= thousandths * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, thousandths: int, shingle: int) -> DataFrame:
    """The ``pairs`` ``(u, v)`` of nodes whose ``texts`` ``(node, text)`` are similar."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, own = None, None
        for rows in batches:
            out = []
            for u, v, text_u, text_v in zip(*(rows.column(c).to_pylist() for c in ("u", "v", "text_u", "text_v"))):
                if u != node:
                    node, own = u, shingle_set(text_u, shingle)
                if similar(own, shingle_set(text_v, shingle), thousandths):
                    out.append((u, v))
            yield batch(LINKS, *(zip(*out) if out else [[]] * 2))

    for end in ("v", "u"):
        side = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
        pairs = pairs.join(side.hint("merge"), end)
    return pairs.mapInArrow(compare, "u long, v long")


def spanning_links(nodes: list[int], roots: list[int], sets: list[np.ndarray], sides: np.ndarray, thousandths: int) -> list[tuple[int, int]]:
    """Links that join whatever links between similar sets of different ``roots`` join, one for each join.

    Sets of side 0 and 1 are compared with the other side only, those of side 2 with all. Shingles that many sets have
    are columns of a matrix, of which products are counted; the others are looked up set by set.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    _, label = np.unique(np.array(roots, np.int64), return_inverse=True)
    values, place, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    dense = found >= max(2, n / 8)
    sparse = (found > 1) & ~dense
    columns = np.cumsum(dense) - 1
    kept = dense[place]
    matrix = np.zeros((n, int(dense.sum())), np.float32)
    matrix[owner[kept], columns[place[kept]]] = 1
    # Of each of the other shingles the sets that have it, one after the other; and the shingles of each set.
    kept = sparse[place]
    shingle, holder = place[kept], owner[kept]
    by_shingle = np.argsort(shingle, kind="stable")
    holders = holder[by_shingle]
    begins = np.searchsorted(shingle[by_shingle], np.arange(len(values) + 1))
    own = np.searchsorted(holder, np.arange(n + 1))
    links = []
    for first in range(0, n, 256):
        counts = matrix[first:first + 256] @ matrix.T
        for i in range(first, min(first + 256, n)):
            shared = counts[i - first].astype(np.int64)
            mine = shingle[own[i]:own[i + 1]]
            if len(mine):
                lengths = begins[mine + 1] - begins[mine]
                at = np.repeat(begins[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                shared += np.bincount(holders[at], minlength=n)
            near = 1000 * shared >= thousandths * (sizes + sizes[i] - shared)
            near &= (label != label[i]) & ((sides != sides[i]) | (sides == 2))
            if near.any():
                joined, some = np.unique(label[near], return_index=True)
                links += [(nodes[i], nodes[j]) for j in np.flatnonzero(near)[some].tolist()]
                label[np.isin(label, joined)] = label[i]
        if (label == label[0]).all():
            break
    return links


def _block_links(thousandths: int, shingle: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, "bucket", "a", "b"):
            sets = [shingle_set(t.as_py(), shingle) for t in block.column("text")]
            links = spanning_links(block.column("node").to_pylist(), block.column("root").to_pylist(), sets,
                                   block.column("side").to_numpy(), thousandths)
            if links:
                yield batch(LINKS, *zip(*links))
    return link


def blocks(active: DataFrame, chunk_texts: int = CHUNK_TEXTS, chunk_shingles: int = CHUNK_SHINGLES) -> DataFrame:
    """``(bucket, a, b, side, node, root)``: who meets in which block of the buckets with texts of several roots.

    ``active`` has ``(bucket, node, size, root)``. Buckets of two are left out, as one is compared with the other before.
    """
    per_bucket = active.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("shingles"), F.min("root").alias("least"), F.max("root").alias("most"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("s2"))
    apart = per_bucket.filter("least < most and n > 2").groupBy("n", "shingles", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    chunks = F.ceil(F.greatest(F.col("n") / chunk_texts, F.col("shingles") / chunk_shingles)).cast("int")
    placed = active.join(apart.select("bucket", chunks.alias("chunks")).hint("merge"), "bucket")
    placed = placed.withColumn("c", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    placed = placed.select("bucket", "node", "root", "c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    side = F.when(F.col("c") == F.col("other"), 2).when(F.col("c") < F.col("other"), 0).otherwise(1)
    return placed.select("bucket", F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b"), side.alias("side"), "node", "root")


def _fitting(a: str, b: str, thousandths: int):
    """Whether sets of these sizes can be similar: the smaller one cannot share more than it has."""
    return 1000 * F.least(a, b).cast("long") >= thousandths * F.greatest(a, b).cast("long")


def fingerprint_pairs(found: DataFrame, thousandths: int, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(u, v)`` of nodes, each once, that connect what SimHash fingerprints within ``radius`` bits connect."""
    nodes = found.groupBy("node").agg(F.any_value("size").alias("size"), F.any_value("fps").alias("fps"))
    nodes = written(few_files(nodes, found.count()), "nodes")
    pairs = linked_nodes(nodes.select("node", "fps"), radius).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = pairs.filter("u < v").distinct()
    for end in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"size_{end}")).hint("merge"), end)
    return pairs.filter(_fitting("size_u", "size_v", thousandths)).select("u", "v")


def _as_edges(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v"))


def similar_links(found: DataFrame, docs: DataFrame, thousandths: int, shingle: int, text_column: str, chunk_texts: int = CHUNK_TEXTS,
                  chunk_shingles: int = CHUNK_SHINGLES, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` between similar nodes that connect whatever candidates of at least that similarity connect."""
    near = written(fingerprint_pairs(found, thousandths, radius), "fingerprint-pairs")
    keyed = found.select("node", "size", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket")
    active = written(keyed.join(shared.hint("merge"), "bucket").distinct(), "candidates")
    one_text = found.groupBy("node").agg(F.min("text_key").alias("text_key"))
    candidates = active.select("node").unionByName(near.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    wanted = candidates.join(one_text.hint("merge"), "node")
    texts = docs.select(text_key(text_column), text_or_empty(text_column).alias("text")).dropDuplicates(["text_key"])
    texts = written(texts.join(wanted.hint("merge"), "text_key").select("node", "text"), "candidate-texts")

    # Links found go straight to the components, and what these join stands for them in the next step.
    roots = written(components(verified(near, texts, thousandths, shingle), near.count()), "roots")

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))

    # One text with all others: the smallest node, which is the same one in buckets of the same texts.
    first = F.min(F.struct("node", "size", "root")).alias("first")
    placed = rooted(active, roots)
    star = placed.join(placed.groupBy("bucket").agg(first).hint("merge"), "bucket").filter("node > first.node and root <> first.root")
    pairs = star.filter(_fitting("size", "first.size", thousandths)).select(F.col("first.node").alias("u"), F.col("node").alias("v")).distinct()
    links = _as_edges(roots).unionByName(verified(pairs, texts, thousandths, shingle))
    roots = written(components(links, active.count() + roots.count()), "roots")
    met = blocks(rooted(active, roots), chunk_texts, chunk_shingles).join(texts.hint("merge"), "node")
    dealt = met.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b").select("bucket", "a", "b", "side", "node", "root", "text")
    return _as_edges(roots).unionByName(dealt.mapInArrow(_block_links(thousandths, shingle), "u long, v long"))


def drop_similar(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text",
    chunk_texts: int = CHUNK_TEXTS, chunk_shingles: int = CHUNK_SHINGLES, radius: int = RADIUS,
) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: the row with the smallest id of each group stays.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; two are linked if the Jaccard similarity of
    their sets of runs of ``shingle`` words (of all words, if there are fewer) is at least ``similarity``, compared in
    thousandths. SimHash fingerprints within ``radius`` bits are the first candidates, MinHash bands those of texts that
    are apart after that. Groups are what links connect. Texts without words all stay. Rows with a null id stay if their group has
    no other, and rows of the group that repeat the id that stays do so, too. An empty table stays one.
    """
    found = written(sketches(docs, shingle, id_column, text_column), "sketches")
    edges = similar_links(found, docs, round(1000 * similarity), shingle, text_column, chunk_texts, chunk_shingles, radius)
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("least_id"))
    # Links of a few blocks for each text, which are as many as its bands at most.
    placed = nodes.join(components(edges, found.count() * BANDS).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least.hint("merge"), "root").select("node", "component_id")
    leaving = found.select("doc_id", "text_key", "node").join(named.hint("merge"), "node").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without_rows(docs, leaving, id_column, text_column)
