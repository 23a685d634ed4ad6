"""Token ids in raw shard files, with a minimal perfect hash index from document keys to places in them.

Layout of a store (a folder that all executors reach):

* ``shards/``: raw payloads. 16 bytes of header (8 of magic, the width of an id, padding), then the ids of the documents
  in ascending order of their keys, little-endian, two bytes wide when the vocabulary allows, else four.
* ``index/``: one file for each bucket of keys. A minimal perfect hash sends each of the bucket's ``n`` keys to a slot of
  its own in ``0 .. n - 1``: per level a bit array of twice the number of keys left, in which a key owns its bit if no
  other key hashes there; the others try the next level; a slot is the rank of the bit. Each slot has a stored 32-bit
  fingerprint of its key, which turns away other keys, and its postings: shard, offset, first id of all, lengths.
* ``postings/`` and ``manifest/``: Parquet tables that name the files that count. A task that is repeated writes
  files of new names, and only those of committed tasks are listed, so lost executors leave nothing wrong behind.

A lookup hashes the key to a bucket and to a slot and reads one range of a shard: a constant number of steps.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tristrata.llm.common import batch, bounded_batches, runs, text_or_empty
from tristrata.llm.tokens import encoder

MAGIC, HEADER = b"IDSHARD1", 16
#: Keys of one index bucket, on average.
BUCKET_KEYS = 1 << 15
#: Stands for a null key; a document with this very key shares its postings.
NULL_KEY = -(1 << 63)

POSTINGS = pa.schema([("key", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("lengths", pa.list_(pa.int32()))])
BUCKETS = pa.schema([("bucket", pa.int64()), ("index_file", pa.string()), ("n_keys", pa.int64())])
PLACES = pa.schema([("key", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("start", pa.int64()), ("lengths", pa.list_(pa.int32()))])
TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit keys (the splitmix64 finaliser) with a seed."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 2) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        bits = np.concatenate([np.unpackbits(b, count=s, bitorder="little") for b, s in zip(levels, sizes)]) if levels else np.empty(0, np.uint8)
        self.bits = bits.astype(bool)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, sizes, left = [], [], keys
        while len(left):
            size = max(64, 2 * len(left))
            place = (_mixed(left, 3 + len(levels)) % np.uint64(size)).astype(np.int64)
            taken = np.bincount(place, minlength=size)
            levels.append(np.packbits(taken == 1, bitorder="little"))
            sizes.append(size)
            left = left[taken[place] != 1]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; some slot or -1 for keys it was not built over."""
        out = np.full(len(keys), -1, np.int64)
        waiting = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(waiting):
                break
            place = (_mixed(keys[waiting], 3 + level) % np.uint64(size)).astype(np.int64) + self.begins[level]
            hit = self.bits[place]
            out[waiting[hit]] = self.ranks[place[hit]]
            waiting = waiting[~hit]
        return out


class Index:
    """One bucket: perfect hash, fingerprints, and the postings of each slot."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, edges: np.ndarray, shard: np.ndarray, offset: np.ndarray,
                 start: np.ndarray, length_edges: np.ndarray, lengths: np.ndarray, shards: list[str]):
        self.hashing, self.prints, self.edges = hashing, prints, edges
        self.shard, self.offset, self.start = shard, offset, start
        self.length_edges, self.lengths, self.shards = length_edges, lengths, shards

    @classmethod
    def build(cls, rows: list[tuple[int, str, int, int, list[int]]]) -> Index:
        """From postings ``(key, shard, offset, start, lengths)``."""
        keys = np.unique(np.array([r[0] for r in rows], np.int64))
        hashing = PerfectHash.build(keys)
        slot = hashing.slots(np.array([r[0] for r in rows], np.int64))
        prints = np.empty(len(keys), np.uint32)
        prints[hashing.slots(keys)] = fingerprints(keys)
        start = np.array([r[3] for r in rows], np.int64)
        order = np.lexsort((start, slot))
        names = sorted({r[1] for r in rows})
        number = {n: i for i, n in enumerate(names)}
        lengths = [np.array(rows[i][4], np.int32) for i in order]
        return cls(
            hashing, prints, np.searchsorted(slot[order], np.arange(len(keys) + 1)), np.array([number[rows[i][1]] for i in order], np.int32),
            np.array([rows[i][2] for i in order], np.int64), start[order],
            np.cumsum([0, *map(len, lengths)]).astype(np.int64), np.concatenate(lengths), names)

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, str, int, int, list[int]]]:
        """Postings of those ``keys`` that the index holds."""
        slots = self.hashing.slots(keys)
        held = slots >= 0
        held[held] = self.prints[slots[held]] == fingerprints(keys[held])
        for key, slot in zip(keys[held].tolist(), slots[held].tolist()):
            for p in range(self.edges[slot], self.edges[slot + 1]):
                lengths = self.lengths[self.length_edges[p]:self.length_edges[p + 1]].tolist()
                yield key, self.shards[self.shard[p]], int(self.offset[p]), int(self.start[p]), lengths

    _ARRAYS = (("prints", "<u4"), ("edges", "<i8"), ("shard", "<i4"), ("offset", "<i8"), ("start", "<i8"), ("length_edges", "<i8"), ("lengths", "<i4"))

    def to_bytes(self) -> bytes:
        parts = [b.tobytes() for b in self.hashing.levels] + [getattr(self, n).astype(k).tobytes() for n, k in self._ARRAYS]
        head = json.dumps({"sizes": self.hashing.sizes, "shards": self.shards, "parts": [len(p) for p in parts]}).encode()
        return b"IDINDEX1" + len(head).to_bytes(8, "little") + head + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        if raw[:8] != b"IDINDEX1":
            raise ValueError("not an index file")
        at = 16 + int.from_bytes(raw[8:16], "little")
        head = json.loads(raw[16:at])
        parts = []
        for n in head["parts"]:
            parts.append(raw[at:at + n])
            at += n
        levels = len(head["sizes"])
        hashing = PerfectHash([np.frombuffer(p, np.uint8) for p in parts[:levels]], head["sizes"])
        return cls(hashing, *(np.frombuffer(p, k) for p, (_, k) in zip(parts[levels:], cls._ARRAYS)), head["shards"])


def _shard_writer(path: str, tokenizer: str, end_id: int | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sink = encoder(tokenizer), None
        name, offset, run, out = "", 0, None, []
        for rows in batches:
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if sink is None:
                    files, folder = _files(f"{path}/shards")
                    files.create_dir(folder, recursive=True)
                    name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:12]}.ids"
                    sink = files.open_output_stream(f"{folder}/{name}")
                    sink.write(MAGIC + encode.dtype.itemsize.to_bytes(8, "little"))
                ids = encode.encode(text).tobytes()
                if end_id is not None:
                    ids += int(end_id).to_bytes(encode.dtype.itemsize, "little")
                sink.write(ids)
                n = len(ids) // encode.dtype.itemsize
                key = NULL_KEY if key is None else key
                if run is not None and run[0] == key:
                    run[3].append(n)
                else:
                    if run is not None:
                        out.append(tuple(run))
                    run = [key, name, offset, [n]]
                offset += n
            if len(out) >= 2000:
                yield batch(POSTINGS, *zip(*out))
                out = []
        if sink is not None:
            sink.close()
            out.append(tuple(run))
            yield batch(POSTINGS, *zip(*out))
    return write


def _index_writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(f"{path}/index")
        for part in runs(batches, "bucket"):
            index = Index.build(list(zip(*(part.column(c).to_pylist() for c in ("key", "shard", "offset", "start", "lengths")))))
            bucket = part.column("bucket")[0].as_py()
            name = f"{bucket:08d}-{uuid.uuid4().hex[:12]}.mph"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{folder}/{name}") as sink:
                sink.write(index.to_bytes())
            yield batch(BUCKETS, [bucket], [name], [len(index.prints)])
    return write


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, id_column: str = "doc_id", text_column: str = "text",
                bucket_keys: int = BUCKET_KEYS) -> None:
    """Encode all texts and write the store below ``path``, which must not exist yet.

    Documents are ordered by key, then by a hash of the text, nulls first; each range of keys is one shard, and a
    repeated key may span shards. A null text gives the end id alone. Other columns are ignored.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    rows = rows.withColumns({"order": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange("key", "order", "spread").sortWithinPartitions("key", "order").select("key", "text")
    ordered.mapInArrow(_shard_writer(path, tokenizer, end_id), "key long, shard string, offset long, lengths array<int>").write.parquet(f"{path}/postings")
    postings = spark.read.schema("key long, shard string, offset long, lengths array<int>").parquet(f"{path}/postings")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row per shard: their first ids follow from the sizes of those before.
    sizes = postings.groupBy("shard").agg(F.sum(total).alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    buckets = postings.count() // bucket_keys + 1
    placed = postings.join(firsts, "shard").select(
        "key", "shard", "offset", (F.col("first") + F.col("offset")).alias("start"), "lengths", _bucket_column("key", buckets))
    dealt = placed.repartition("bucket").sortWithinPartitions("bucket")
    manifest = dealt.mapInArrow(_index_writer(path), "bucket long, index_file string, n_keys long")
    manifest.withColumn("buckets", F.lit(buckets).cast("long")).write.parquet(f"{path}/manifest")


def _bucket_column(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")


def bucket_of(key: int, buckets: int) -> int:
    """The bucket of one key outside Spark: its XXH64 with Spark's seed."""
    digest = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    return (digest - (1 << 64) if digest >> 63 else digest) % buckets


def _finder(path: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(f"{path}/index")
        name, index = None, None
        for rows in batches:
            names = rows.column(0).to_pylist()
            keys = rows.column(1).to_numpy().astype(np.int64)
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    if names[a] != name:
                        with files.open_input_stream(f"{folder}/{names[a]}") as source:
                            name, index = names[a], Index.from_bytes(source.read())
                    found = list(index.find(keys[a:b]))
                    for i in range(0, len(found), 2000):
                        yield batch(PLACES, *zip(*found[i:i + 2000]))
    return find


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """Places ``(key, shard, offset, start, lengths)`` of the distinct ``keys`` that the index of the store holds.

    A key of several documents has one row per shard, with the number of ids of each document; unknown keys have none.
    A null key finds the documents without one. An unknown key is taken for a known one once in four thousand millions.
    """
    bounded_batches(spark)
    manifest = spark.read.schema("bucket long, index_file string, n_keys long, buckets long").parquet(f"{path}/manifest")
    first = manifest.select("buckets").first()
    if first is None:
        return spark.createDataFrame([], "key long, shard string, offset long, start long, lengths array<int>")
    wanted = keys.select(F.coalesce(F.col(key_column).cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    routed = wanted.withColumn("bucket", _bucket_column("key", first.buckets)).join(manifest.select("bucket", "index_file"), "bucket")
    dealt = routed.repartition("index_file").sortWithinPartitions("index_file").select("index_file", "key")
    return dealt.mapInArrow(_finder(path), "key long, shard string, offset long, start long, lengths array<int>")


def _reader(path: str, with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(f"{path}/shards")
        name, source, kind = None, None, None
        for rows in batches:
            out = []
            for key, shard, offset, start, lengths in zip(*(c.to_pylist() for c in rows.columns)):
                if shard != name:
                    if source is not None:
                        source.close()
                    name, source = shard, files.open_input_file(f"{folder}/{shard}")
                    head = source.read(HEADER)
                    if head[:8] != MAGIC:
                        raise ValueError(f"{shard} is not a shard")
                    kind = np.dtype(f"<u{int.from_bytes(head[8:], 'little')}")
                source.seek(HEADER + offset * kind.itemsize)
                for n in lengths:
                    ids = np.frombuffer(source.read(n * kind.itemsize), kind)
                    if len(ids) != n:
                        raise ValueError(f"{shard} ends before id {offset + n}")
                    out.append((None if key == NULL_KEY else key, start, n, zlib.crc32(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                    start += n
                    if len(out) >= 1000:
                        yield batch(TOKENS, *zip(*out))
                        out = []
            if out:
                yield batch(TOKENS, *zip(*out))
        if source is not None:
            source.close()
    return read


def read_documents(spark: SparkSession, path: str, keys: DataFrame, key_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of every document of the ``keys``, through the index, from the shards.

    ``start`` counts the ids of all documents before it. Shards are read in order of their places, each by one task.
    """
    places = lookup(spark, path, keys, key_column)
    ordered = places.repartition("shard").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(_reader(path, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def fetch(path: str, key: int, index_files: dict[int, str], buckets: int) -> Iterable[np.ndarray]:
    """The ids of one key's documents outside Spark: one index file and one range of a shard are read."""
    files, folder = _files(path)
    name = index_files.get(bucket_of(key, buckets))
    if name is None:
        return
    with files.open_input_stream(f"{folder}/index/{name}") as source:
        index = Index.from_bytes(source.read())
    for _, shard, offset, _, lengths in index.find(np.array([key], np.int64)):
        with files.open_input_file(f"{folder}/shards/{shard}") as payload:
            kind = np.dtype(f"<u{int.from_bytes(payload.read(HEADER)[8:], 'little')}")
            payload.seek(HEADER + offset * kind.itemsize)
            for n in lengths:
                yield np.frombuffer(payload.read(n * kind.itemsize), kind)
