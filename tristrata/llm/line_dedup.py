"""Removal of lines that many documents share, by a sharded minimal perfect hash over all different lines.

A line is told by the 128-bit hash of its key: the line without ASCII white space at its ends, A-Z lower-cased. Documents
per hash are counted in Spark. The hashes are dealt to shards of about ``SHARD_LINES``; each shard is one file with a minimal
perfect hash, and in the order of its slots an array of 32-bit fingerprints and one of counts, some seven bytes a line.

Documents probe those arrays; no line meets another one. Only hashes travel: the probes of all texts are ordered by
shard, hash and text, and a task reads the shards of its range of probes one after the other, so it holds one shard at a
time, however large the index, and the probes of a line that half of all texts have are split over tasks. What comes back
to a text are the hashes of its lines to drop.

The index stays in its folder: other documents can be probed against it, and their unknown lines count as zero.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, runs, text_or_empty, written
from tristrata.llm.token_store import PerfectHash
from tristrata.session import new_work_path

WHITE = b" \t\n\x0b\x0c\r"
#: Different lines of one shard, on average.
SHARD_LINES = 1 << 17
#: Line hashes in one row of a text; longer texts have several rows.
PIECE = 4096

HASHES = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("piece", pa.int32()), ("hashes", pa.binary()), ("n", pa.int64())])
COUNTS = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64())])
PROBES = pa.schema([("shard", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64())])
FILES = pa.schema([("shard", pa.int64()), ("n_lines", pa.int64())])
HITS = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("low", pa.int64())])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
RESULT_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"


def key_of(line: bytes) -> bytes:
    """bytes.lower() changes A-Z only."""
    return line.strip(WHITE).lower()


def counted_key(line: bytes, least_chars: int) -> bytes | None:
    """The key of a line, or None if it is shorter than ``least_chars`` code points and so never dropped."""
    key = key_of(line)
    return key if len(key) >= least_chars and len(key.decode("utf-8", "replace")) >= least_chars else None


def line_hashes(text: bytes, least_chars: int) -> set[bytes]:
    """The different line hashes of a text."""
    keys = {counted_key(line, least_chars) for line in text.split(b"\n")}
    keys.discard(None)
    return {xxhash.xxh3_128_digest(k) for k in keys}


def _pairs(hashes: bytes) -> np.ndarray:
    """Two 64-bit numbers, high and low, of every 128-bit hash."""
    return np.frombuffer(hashes, ">i8").reshape(-1, 2).astype(np.int64)


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high & 0xFFFFFFFF) % shards


class LineIndex:
    """One shard: a minimal perfect hash over the low halves; fingerprints from the high halves and counts by slot."""

    def __init__(self, hashing: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.hashing, self.prints, self.counts = hashing, prints, counts

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, n: np.ndarray) -> LineIndex:
        order = np.lexsort((high, low))
        high, low, n = high[order], low[order], n[order]
        # Two lines of one shard with the same low half, one pair in 2^64 times the number of shards, are one line.
        first = np.flatnonzero(np.diff(low, prepend=~low[:1]))
        keys, n = low[first], np.add.reduceat(n, first) if len(first) else n
        hashing = PerfectHash.build(keys)
        prints, counts = np.empty(len(keys), np.uint32), np.empty(len(keys), np.min_scalar_type(int(n.max(initial=0))))
        slots = hashing.slots(keys)
        prints[slots] = (high[first] >> 32).astype(np.uint32)
        counts[slots] = n
        return cls(hashing, prints, counts)

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many documents have each line; zero for lines the index does not know."""
        slots = self.hashing.slots(low)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == (high[known] >> 32).astype(np.uint32)
        found = np.zeros(len(low), np.int64)
        found[known] = self.counts[slots[known]]
        return found

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        levels = np.concatenate([*self.hashing.levels, np.empty(0, np.uint8)])
        np.savez(out, sizes=np.array(self.hashing.sizes, np.int64), levels=levels, prints=self.prints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> LineIndex:
        with np.load(io.BytesIO(raw)) as arrays:
            sizes = arrays["sizes"].tolist()
            ends = np.cumsum([-(-s // 8) for s in sizes], dtype=np.int64)
            return cls(PerfectHash(np.split(arrays["levels"], ends[:-1]) if sizes else [], sizes), arrays["prints"], arrays["counts"])


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _hash_texts(least_chars: int):
    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            seen: dict[tuple[int, int], list] = {}
            for t1, t2, text in zip(*(c.to_pylist() for c in rows.columns)):
                if (t1, t2) in seen:
                    seen[t1, t2][1] += 1
                else:
                    seen[t1, t2] = [sorted(line_hashes(text, least_chars)), 1]
            out = [(t1, t2, i // PIECE, b"".join(hashes[i:i + PIECE]), n)
                   for (t1, t2), (hashes, n) in seen.items() for i in range(0, len(hashes), PIECE)]
            yield batch(HASHES, *(zip(*out) if out else [[]] * 5))
    return hash_texts


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, t1, t2, text)``: the text as bytes and two hashes that tell it."""
    text = text_or_empty(text_column)
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"),
                       F.xxhash64(F.lit(11), text).alias("t2"), text.cast("binary").alias("text"))


def _text_hashes(docs: DataFrame, least_chars: int, id_column: str, text_column: str) -> DataFrame:
    """``(t1, t2, piece, hashes, n)``: the line hashes of every different text, and how many rows have it."""
    rows = _keyed(docs, id_column, text_column).select("t1", "t2", "text")
    found = rows.mapInArrow(_hash_texts(least_chars), "t1 long, t2 long, piece int, hashes binary, n long")
    # Copies of a text meet before the shuffle, so that a text of a third of all rows is one row a task.
    return written(found.groupBy("t1", "t2", "piece").agg(F.any_value("hashes").alias("hashes"), F.sum("n").alias("n")), "line-hashes")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        hashes, n = rows.column("hashes").to_pylist(), rows.column("n").to_numpy()
        if not hashes:
            continue
        kinds, place = np.unique(np.frombuffer(b"".join(hashes), "V16"), return_inverse=True)
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, place, np.repeat(n, [len(h) // 16 for h in hashes]))
        pairs = _pairs(kinds.tobytes())
        yield batch(COUNTS, pairs[:, 0], pairs[:, 1], total)


def _index_writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(path)
        for part in runs(batches, "shard"):
            high, low, n = (part.column(c).to_numpy().astype(np.int64) for c in ("high", "low", "n"))
            index = LineIndex.build(high[n > 0], low[n > 0], n[n > 0])
            shard = part.column("shard")[0].as_py()
            # A task that runs twice writes the same bytes; a name appears only with a whole file behind it.
            hidden = f"{folder}/.{shard:012d}.{uuid.uuid4().hex}"
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(hidden) as sink:
                sink.write(index.to_bytes())
            files.move(hidden, f"{folder}/{shard:012d}.npz")
            yield batch(FILES, [shard], [len(index.prints)])
    return write


def _build(hashes: DataFrame, path: str, shard_lines: int) -> int:
    """Write the index of all line hashes below ``path``; gives the number of its shards."""
    pieces = hashes.select("hashes", "n").mapInArrow(_count, "high long, low long, n long")
    counted = written(pieces.groupBy("high", "low").agg(F.sum("n").alias("n")), "line-counts")
    shards = counted.count() // shard_lines + 1
    dealt = counted.withColumn("shard", F.col("high").bitwiseAND(F.lit(0xFFFFFFFF)) % shards)
    # A row that counts nothing for each shard: every shard has its file, so a file that is missing is an error.
    nothing = hashes.sparkSession.range(shards).select(*(F.lit(0).cast("long").alias(c) for c in ("high", "low", "n")), F.col("id").alias("shard"))
    dealt = dealt.unionByName(nothing).repartitionByRange("shard").sortWithinPartitions("shard")
    made = dealt.mapInArrow(_index_writer(f"{path}/shards"), "shard long, n_lines long")
    made.withColumn("shards", F.lit(shards).cast("long")).write.parquet(f"{path}/manifest")
    return shards


def _route(shards: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            hashes = rows.column("hashes").to_pylist()
            sizes = [len(h) // 16 for h in hashes]
            pairs = _pairs(b"".join(hashes))
            t1, t2 = (np.repeat(rows.column(c).to_numpy(), sizes) for c in ("t1", "t2"))
            yield batch(PROBES, _shard_of(pairs[:, 0], shards), pairs[:, 0], pairs[:, 1], t1, t2)
    return route


def _probe(path: str, min_documents: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _files(path)
        held, index = None, None
        for rows in batches:
            shard, high, low, t1, t2 = (c.to_numpy() for c in rows.columns)
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if shard[a] != held:
                    with files.open_input_stream(f"{folder}/{shard[a]:012d}.npz") as source:
                        held, index = shard[a], LineIndex.from_bytes(source.read())
                hit = np.flatnonzero(index.find(high[a:b], low[a:b]) >= min_documents)
                if len(hit):
                    yield batch(HITS, t1[a:b][hit], t2[a:b][hit], low[a:b][hit])
    return probe


def _drop(least_chars: int, with_text: bool):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for doc_id, text, drops in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "drops"))):
                lines = text.split(b"\n")
                kept = lines
                if drops:
                    gone, kept = set(drops), []
                    for line in lines:
                        key = counted_key(line, least_chars)
                        # The low half of the hash is what hits carry.
                        if key is None or int.from_bytes(xxhash.xxh3_128_digest(key)[8:], "big", signed=True) not in gone:
                            kept.append(line)
                left = b"\n".join(kept)
                out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(left).hexdigest(),
                            left.decode("utf-8", "replace") if with_text else None))
            yield batch(RESULT, *(zip(*out) if out else [[]] * 5))
    return drop


def write_index(
    docs: DataFrame, path: str, min_chars: int = 1, id_column: str = "doc_id", text_column: str = "text", shard_lines: int = SHARD_LINES,
) -> None:
    """Write the index of all lines of ``docs`` below ``path``, which must not exist yet."""
    bounded_batches(docs.sparkSession)
    _build(_text_hashes(docs, max(1, min_chars), id_column, text_column), path, shard_lines)


def drop_shared_lines(
    docs: DataFrame, min_documents: int = 10, min_chars: int = 1, id_column: str = "doc_id", text_column: str = "text",
    with_text: bool = True, index: str | None = None, shard_lines: int = SHARD_LINES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_sha256, kept_text``.

    Texts are split at line feeds. Lines whose key has at least ``min_chars`` code points and is found in at least
    ``min_documents`` rows lose all their occurrences; the others, as they were, are joined by line feeds into
    ``kept_text``. Keys of no code point are never dropped. Counts come from ``docs`` itself or, with ``index``, from an
    index written before with the same ``min_chars``.

    A null text is an empty one, and that has one empty line. Rows are documents of their own, also where ids or whole
    rows repeat; a line that one text repeats counts once there. An empty table gives an empty result. A text of which
    all lines go is left empty. Other columns of ``docs`` are ignored.
    """
    spark, least = bounded_batches(docs.sparkSession), max(1, min_chars)
    hashes = _text_hashes(docs, least, id_column, text_column)
    if index is None:
        index = new_work_path(spark, "line-index")
        shards = _build(hashes, index, shard_lines)
    else:
        shards = spark.read.schema("shard long, n_lines long, shards long").parquet(f"{index}/manifest").select("shards").first()[0]
    routed = hashes.mapInArrow(_route(shards), "shard long, high long, low long, t1 long, t2 long")
    ordered = routed.repartitionByRange("shard", "high", "low", "t1").sortWithinPartitions("shard")
    hits = written(ordered.mapInArrow(_probe(f"{index}/shards", min_documents), "t1 long, t2 long, low long"), "line-hits")
    drops = hits.groupBy("t1", "t2").agg(F.collect_list("low").alias("drops"))
    placed = _keyed(docs, id_column, text_column).join(drops.hint("merge"), ["t1", "t2"], "left").select("doc_id", "text", "drops")
    return placed.mapInArrow(_drop(least, with_text), RESULT_SCHEMA)
