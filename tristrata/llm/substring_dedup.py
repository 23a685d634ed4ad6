"""Removal of repeated passages by Rabin-Karp hashes of every window of words.

A task hashes all windows of the texts it reads: each word gets a 64-bit hash, and a window the polynomial of its
words' hashes, rolled forward by prefix sums. Of windows that repeat within a batch, all but the earliest (by document,
then start) are repeats whatever the rest of the corpus holds; so only the earliest occurrences leave the task, and a
passage that every document has costs each batch one entry. They are shuffled by hash range in sorted, packed blocks and
counted there: all but the earliest occurrence of a hash are repeats. The repeats, packed again, meet the texts by a hash
of the text and merge into maximal removal intervals.

The number of hash ranges follows from the number of characters, so that a range fits into a task. Windows are equal
when their 64-bit hashes are: with ``n`` different windows about ``n * n / 2**65`` pairs of them are mistaken for
repeats, 0.0005 for 10**8 windows and one in two million windows for 10**13.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, runs, text_or_empty

#: Words whose windows are compared within a task before they are sent on.
BATCH_WORDS = 1 << 20
#: Characters of the corpus for each hash range.
RANGE_CHARACTERS = 3 << 22
#: Most partitions of a shuffle; beyond, a task works through several ranges or groups of documents, one after the other.
MAX_PARTITIONS = 50_000
#: Distinct words whose hashes a worker holds.
MAX_CACHED_WORDS = 1 << 18
#: The odd base of the window polynomial, and an odd multiplier that spreads its values over all ranges.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

SENT = pa.schema([("slot", pa.int64()), ("is_found", pa.bool_()), ("payload", pa.binary())])
FOUND = pa.schema([("target", pa.int64()), ("payload", pa.binary())])
MEETING = pa.schema([("target", pa.int64()), ("is_text", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("payload", pa.binary())])
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("kept_text", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])
RESULT_SCHEMA = ("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, "
                 "removed array<struct<start: int, stop: int>>")


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space (\\x20 and \\x09-\\x0D), which is what bytes.split() separates at."""
    return text.encode("utf-8", "surrogatepass").split()


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class WordHashes(dict):
    """Hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to ``n - 1``."""
    forward, backward = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    forward[0] = backward[0] = 1
    return np.cumprod(forward, dtype=np.uint64), np.cumprod(backward, dtype=np.uint64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values: sum of value times base to the place, modulo 2**64, mixed."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    forward, backward = _powers(1 << max(10, (len(words) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * forward[:len(words)], dtype=np.uint64)])
    starts = len(words) - size + 1
    rolled = (sums[size:] - sums[:starts]) * backward[:starts]
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(SPREAD)
    rolled ^= rolled >> np.uint64(29)
    return rolled


def _planes(values: np.ndarray) -> bytes:
    """Integers by significance of their bytes, so that high bytes, mostly zero, compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _packed(*columns: np.ndarray) -> bytes:
    """Integer columns as one compressed block."""
    parts = [_planes(c) for c in columns]
    head = np.array([len(parts), *(len(p) for p in parts)], "<u8").tobytes() + "".join(c.dtype.str.ljust(4) for c in columns).encode()
    return zstandard.compress(head + b"".join(parts), 1)


def _unpacked(block: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    lengths = np.frombuffer(raw, "<u8", n, 8).tolist()
    kinds = raw[8 + 8 * n:8 + 12 * n].decode()
    at, out = 8 + 12 * n, []
    for i, length in enumerate(lengths):
        out.append(_from_planes(raw[at:at + length], kinds[4 * i:4 * i + 4].strip()))
        at += length
    return out


def _id_order(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Ranks of identifiers, equal for equal ones; unknown (null) ones come first."""
    order = np.lexsort((ids, known))
    new = np.ones(len(ids), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (known[order][1:] != known[order][:-1])
    ranks = np.empty(len(ids), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def _repeats(hashes: np.ndarray, rank: np.ndarray, start: np.ndarray, with_earliest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the earliest occurrence of each hash in order of hashes (if asked for), and of those later than it."""
    order = np.argsort(hashes, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = hashes[order[1:]] != hashes[order[:-1]]
    alone = first.copy()
    alone[:-1] &= first[1:]
    shared = order[~alone]
    if not len(shared):
        return order, shared
    shared = shared[np.lexsort((start[shared], rank[shared], hashes[shared]))]
    begins = np.ones(len(shared), bool)
    begins[1:] = hashes[shared[1:]] != hashes[shared[:-1]]
    earliest = shared[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    later = shared[(rank[shared] != rank[earliest]) | (start[shared] != start[earliest])]
    if not with_earliest:
        return order[:0], later
    kept = np.concatenate([order[alone], shared[begins]])
    return kept[np.argsort(hashes[kept], kind="stable")], later


def _groups(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(value, begin, end)`` of each run of equal values of a sorted array: only values that occur."""
    begins = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1 if len(ordered) else np.empty(0, int)
    edges = [0, *begins.tolist(), len(ordered)] if len(ordered) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(ordered[a]), a, b


def _by_document(doc: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Starts of each document index, sorted."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order].astype("<u4")
    edges = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(doc[a]), start[a:b]


def _targets(numbers: np.ndarray, digests: np.ndarray, targets: int) -> np.ndarray:
    """The task in which a document meets its repeats, by id and text, so that copies of a text are spread."""
    mixed = (numbers.astype(np.int64).view(np.uint64) * np.uint64(SPREAD)) ^ digests.astype(np.int64).view(np.uint64)
    mixed *= np.uint64(BASE)
    return ((mixed >> np.uint64(32)) % np.uint64(targets)).astype(np.int64)


def _found_blocks(doc: np.ndarray, start: np.ndarray, numbers: np.ndarray, known: np.ndarray, digests: np.ndarray, targets: int) -> Iterator[tuple[int, bytes]]:
    """Repeats as one block per target."""
    target = _targets(numbers, digests, targets)[doc]
    order = np.lexsort((start, doc, target))
    for t, a, b in _groups(target[order]):
        chosen = order[a:b]
        docs, index = np.unique(doc[chosen], return_inverse=True)
        yield t, _packed(index.astype("<u4"), start[chosen].astype("<u4"), numbers[docs], known[docs].astype("u1"), digests[docs])


def _hash_windows(size: int, slots: int, targets: int, batch_words: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = _word_hashes()
        ids: list[int | None] = []
        digests: list[int] = []
        values: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(v) for v in values])
            words = np.concatenate(values)
            ends = np.cumsum(lengths)
            hashes = window_hashes(words, size)
            doc = np.repeat(np.arange(len(values)), lengths)[:len(hashes)]
            place = np.arange(len(hashes))
            inside = place + size <= ends[doc]
            hashes, doc = hashes[inside], doc[inside]
            start = (place[inside] - (ends - lengths)[doc]).astype(np.int64)
            known = np.array([i is not None for i in ids])
            numbers = np.array([i or 0 for i in ids], np.int64)
            hashed = np.array(digests, np.int64)
            kept, later = _repeats(hashes, _id_order(numbers, known)[doc], start, True)
            out = [(t, True, block) for t, block in _found_blocks(doc[later], start[later], numbers, known, hashed, targets)]
            slot = ((hashes[kept] >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
            for s, a, b in _groups(slot):
                chosen = kept[a:b]
                docs, index = np.unique(doc[chosen], return_inverse=True)
                steps = np.diff(hashes[chosen], prepend=np.uint64(0))
                out.append((s, False, _packed(
                    steps, index.astype("<u4"), start[chosen].astype("<u4"), numbers[docs], known[docs].astype("u1"), hashed[docs])))
            for i in range(0, len(out), 200):
                yield batch(SENT, *zip(*out[i:i + 200]))

        pending = 0
        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < size:
                    continue
                ids.append(doc)
                digests.append(text_hash(text))
                values.append(np.fromiter(map(known_words.__getitem__, words), np.uint64, len(words)))
                pending += len(words)
                if pending >= batch_words:
                    yield from flush()
                    ids, digests, values, pending = [], [], [], 0
        if values:
            yield from flush()
    return send


def _count_windows(targets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "slot"):
            slot, out, blocks = part.column("slot")[0].as_py(), [], []
            for is_found, payload in zip(part.column("is_found").to_pylist(), part.column("payload")):
                if is_found:
                    out.append((slot, payload.as_py()))
                else:
                    blocks.append(_unpacked(payload.as_py()))
            del part
            if blocks:
                sizes = np.cumsum([0, *(len(b[3]) for b in blocks)])
                hashes = np.concatenate([np.cumsum(b[0], dtype=np.uint64) for b in blocks])
                doc = np.concatenate([b[1] + np.uint32(s) for b, s in zip(blocks, sizes)])
                start = np.concatenate([b[2] for b in blocks])
                numbers, known, digests = (np.concatenate([b[i] for b in blocks]) for i in (3, 4, 5))
                blocks.clear()
                _, later = _repeats(hashes, _id_order(numbers, known).astype(np.uint32)[doc], start, False)
                del hashes
                out += _found_blocks(doc[later], start[later], numbers, known, digests, targets)
            for i in range(0, len(out), 200):
                yield batch(FOUND, *zip(*out[i:i + 200]))
    return count


def _compressed(targets: int):
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            digests = np.array([text_hash(t) for t in texts], np.int64)
            numbers = np.array([d or 0 for d in rows.column(0).to_pylist()], np.int64)
            yield batch(MEETING, _targets(numbers, digests, targets), [1] * len(texts), rows.column(0), digests,
                        [zstandard.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts])
    return compress


def _remove(size: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, {}
        for rows in batches:
            out = []
            for target, is_text, doc, digest, payload in zip(*(c.to_pylist() for c in rows.columns)):
                if target != last:
                    last, found = target, {}
                if not is_text:
                    index, start, numbers, known, digests = _unpacked(payload)
                    for d, starts in _by_document(index.astype(np.int64), start):
                        found.setdefault((int(numbers[d]) if known[d] else None, int(digests[d])), []).append(starts)
                    continue
                words = words_of(zstandard.decompress(payload).decode("utf-8", "surrogatepass"))
                starts = found.get((doc, digest))
                spans = merged(np.concatenate(starts), size) if starts else []
                removed = sum(stop - start for start, stop in spans)
                kept, at = [], 0
                for start, stop in [*spans, (len(words), len(words))]:
                    kept += words[at:start]
                    at = stop
                text = b" ".join(kept)
                out.append((doc, len(words), removed, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass") if with_text else None,
                            [{"start": a, "stop": b} for a, b in spans]))
            if out:
                yield batch(RESULT, *zip(*out))
    return remove


def merged(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal intervals covered by windows of ``size`` words from ``starts`` on."""
    starts = np.unique(starts.astype(np.int64))
    begins = np.flatnonzero(np.diff(starts, prepend=starts[0] - size - 1) > size)
    ends = np.append(begins[1:], len(starts)) - 1
    return [(int(starts[a]), int(starts[b]) + size) for a, b in zip(begins, ends)]


def _dealt(rows: DataFrame, numbers: int, column: str) -> DataFrame:
    """Rows in partitions by a number below ``numbers``: one number to a partition, or some to each of ``MAX_PARTITIONS``."""
    return rows.repartitionById(min(numbers, MAX_PARTITIONS), (F.col(column) % min(numbers, MAX_PARTITIONS)).cast("int"))


def remove_repeated_passages(
    docs: DataFrame, window: int = 20, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True,
    batch_words: int = BATCH_WORDS, range_characters: int = RANGE_CHARACTERS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text, removed``.

    Every word covered by a window of ``window`` words is removed if the same words also start earlier: in a document
    with a smaller id, or earlier in the same document. All windows of the input are judged as they stand there.
    ``removed`` holds the maximal intervals of removed words, ``kept_text`` the other words joined by a space.

    Null and empty texts have no words. A null id is smaller than any other. Rows with equal ids count as one document
    when starts are compared, so rows repeated whole remove nothing from each other. Texts shorter than a window stay as
    they are. Empty tables give empty results. Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    characters = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    slots = characters // range_characters + 1
    targets = 8 * slots
    sent = texts.mapInArrow(_hash_windows(window, slots, targets, batch_words), "slot long, is_found boolean, payload binary")
    counted = _dealt(sent, slots, "slot").sortWithinPartitions("slot").mapInArrow(_count_windows(targets), "target long, payload binary")
    nothing = F.lit(None).cast("long")
    found = counted.select("target", F.lit(0).alias("is_text"), nothing.alias("doc_id"), nothing.alias("text_hash"), "payload")
    packed = texts.mapInArrow(_compressed(targets), "target long, is_text int, doc_id long, text_hash long, payload binary")
    # A task gets the repeats of its documents first, packed, and then reads one text after the other.
    met = _dealt(found.unionByName(packed), targets, "target").sortWithinPartitions("target", "is_text")
    return met.mapInArrow(_remove(window, with_text), RESULT_SCHEMA)
