"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are compared as letters and digits in lower case, with one space for everything between. An item of ``n``
characters may occur with up to ``e`` edits, a tenth of its length. By the q-gram lemma such an occurrence shares at
least ``n - q + 1 - q * e`` q-grams with the item, and they lie on diagonals (place in the document minus place in the
item) that differ by at most ``e``. So shared q-grams are counted in bands of diagonals, each overlapping the next by
half, which is more than ``e``; bands that reach the bound are aligned with the item, and what needs at most ``e`` edits
is reported. The longest ``q`` up to a limit is taken for which the bound is one at least, so nothing within the budget is
lost: an item of 12 characters is found by its 6-grams, one of 5, which allows no edit, by its only 5-gram.

The benchmark is the query set: its items are taken in blocks of a bounded number of characters, whose q-gram index goes
to all tasks, and each block is matched against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, text_or_empty, written

#: Longest q-grams; shorter ones are taken for items that might share none of this length.
Q = 8
#: Edits allowed, as a share of the item's characters.
EDIT_RATE = 0.1
#: Characters of the items whose index is sent to all tasks at once, about 20 bytes each.
BLOCK_CHARACTERS = 1 << 20
_FILTER_BITS = 22

HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
HITS_SCHEMA = "doc_id long, item_id long, edits long, start long, stop long"


class _Folded(dict):
    """Code points for str.translate: letters and digits in lower case, spaces for the rest, one for one."""

    def __missing__(self, point: int) -> int:
        letter = chr(point)
        low = letter.lower()
        self[point] = value = (ord(low) if len(low) == 1 else point) if letter.isalnum() else 32
        return value


_FOLDED = _Folded()


def normalised(text: str) -> str:
    return " ".join(text.translate(_FOLDED).split())


def _places(text: str) -> np.ndarray:
    """For each character of the normalised text its place in ``text``."""
    points = np.frombuffer(text.translate(_FOLDED).encode("utf-32-le", "surrogatepass"), "<u4")
    space = points == 32
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(kept)
    if len(at) and space[at[0]]:
        at = at[1:]
    return at[:-1] if len(at) and space[at[-1]] else at


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    wide = points.astype(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for i in range(q):
        hashes *= np.uint64(0x100000001B3)
        hashes += wide[i:i + n]
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    return hashes


def budget(length: int, q: int, rate: float) -> tuple[int, int, int]:
    """Edits allowed for an item of ``length`` characters, the q of its q-grams, ``q`` at most, and how many an occurrence shares at least.

    ``edits`` edits leave one of ``edits + 1`` pieces of the item whole, so q-grams no longer than a piece are shared for certain.
    """
    if not 0 <= rate < 1:
        raise ValueError(f"the share of edits is at least 0 and below 1, not {rate!r}")
    edits = int(rate * length)
    own = min(q, length // (edits + 1))
    return edits, own, length - own + 1 - own * edits


@dataclass
class Index:
    """q-grams of a block of items: sorted hashes with their postings (item and place), and a bit table that rules most others out."""

    ids: list
    texts: list[str]
    edits: np.ndarray
    needed: np.ndarray
    hashes: np.ndarray
    begins: np.ndarray
    counts: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    width: int
    q: int

    @classmethod
    def build(cls, items: list[tuple[int | None, str]], q: int, rate: float) -> Index:
        """An index of the q-grams of items that all take this ``q``."""
        budgets = [budget(len(t), q, rate) for _, t in items]
        grams = [qgram_hashes(_points(t), q) for _, t in items]
        hashes = np.concatenate([*grams, np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        lengths = [len(g) for g in grams]
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        different, begins, counts = np.unique(hashes[order], return_index=True, return_counts=True)
        return cls(
            [i for i, _ in items], [t for _, t in items], np.array([b[0] for b in budgets], np.int64), np.array([b[2] for b in budgets], np.int64),
            different, begins, counts, np.repeat(np.arange(len(items)), lengths)[order], np.concatenate([*map(np.arange, lengths), np.empty(0, int)]).astype(np.int64)[order],
            table, max((b[0] for b in budgets), default=0) + 1, q)

    def regions(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item, first diagonal, last diagonal)`` of bands that share enough q-grams with an item.

        Bands of one width for all items are counted first. Within those that pass, only diagonals count that lie in a
        window of the item's own edits with enough different q-grams of the item; they are what is given out. An item
        that allows no edit is given out once, as it is searched for exactly.
        """
        hashes = qgram_hashes(_points(text), self.q)
        at = np.flatnonzero(self.table[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return
        slot = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        known = self.hashes[slot] == hashes[at]
        at, slot = at[known], slot[known]
        counts = self.counts[slot]
        posting = np.repeat(self.begins[slot] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        item, at = self.item[posting], np.repeat(at, counts)
        # Items that share too few q-grams with the text as a whole are out.
        likely = np.bincount(item, minlength=len(self.ids))[item] >= self.needed[item]
        posting, item, at = posting[likely], item[likely], at[likely]
        if not len(item):
            return
        exact = self.edits[item] == 0
        for number in np.unique(item[exact]).tolist():
            yield number, 0, 0
        posting, item, at = posting[~exact], item[~exact], at[~exact]
        if not len(item):
            return
        diagonal = at - self.place[posting]
        # Shared q-grams in order of item and diagonal, so that those of a band lie side by side.
        low = int(diagonal.min())
        wide = int(diagonal.max()) - low + 1 + 2 * self.width
        order = np.argsort(item * wide + diagonal - low, kind="stable")
        item, diagonal, places = item[order], diagonal[order], self.place[posting[order]]
        sorted_keys = item * wide + diagonal - low
        band = (diagonal - low) // self.width
        span = int(band.max()) + 2
        keys, shared = np.unique(np.concatenate([item * span + band + 1, item * span + band]), return_counts=True)
        seen = set()
        for key in keys[shared >= self.needed[keys // span]].tolist():
            number, first = key // span, (key % span - 1) * self.width
            a, b = np.searchsorted(sorted_keys, [number * wide + max(first, 0), number * wide + first + 2 * self.width])
            stops = a + np.searchsorted(diagonal[a:b], diagonal[a:b] + self.edits[number], "right")
            enough = [
                (i, j) for i, j in zip(range(a, b), stops.tolist())
                if j - i >= self.needed[number] and len(set(places[i:j].tolist())) >= self.needed[number]]
            if enough:
                found = number, int(diagonal[enough[0][0]]), int(diagonal[enough[-1][1] - 1])
                if found not in seen:
                    seen.add(found)
                    yield found

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """For each item that occurs the best region ``(edits, start, stop)`` of the normalised text, the earliest of equals."""
        best: dict[int, tuple[int, int, int]] = {}
        points = None
        for item, first, last in self.regions(text):
            wanted, edits = self.texts[item], int(self.edits[item])
            if item in best and best[item][0] == 0:
                continue
            exact = text.find(wanted)
            if exact >= 0:
                best[item] = (0, exact, exact + len(wanted))
            if exact >= 0 or not edits:
                continue
            points = _points(text) if points is None else points
            found = align(points, _points(wanted), first - edits, last - first + 1 + 2 * edits, edits)
            if found is not None and found < best.get(item, (edits + 1, 0, 0)):
                best[item] = found
        return best


class Indexes:
    """The items of a block, each in the index of the q that its length asks for. Empty items are left out."""

    def __init__(self, items: list[tuple[int | None, str]], q: int, rate: float):
        by_q: dict[int, list[tuple[int | None, str]]] = {}
        for item, text in items:
            if text:
                by_q.setdefault(budget(len(text), q, rate)[1], []).append((item, text))
        self.parts = [Index.build(part, own, rate) for own, part in sorted(by_q.items())]

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """``(item id, edits, start, stop)`` of the best region of the normalised text for each item that occurs."""
        return [(part.ids[i], *region) for part in self.parts for i, region in part.find(text).items()]

    def occur(self, text: str) -> bool:
        return any(part.find(text) for part in self.parts)


def _last_row(text: np.ndarray, item: np.ndarray, first: int, width: int, most: int) -> np.ndarray | None:
    """Edits to turn the whole item into text that starts and ends on one of ``width`` diagonals from ``first`` on."""
    steps = np.arange(width, dtype=np.int32)
    far = np.int32(most + len(item) + width)
    starts = first + steps
    row = np.where((starts >= 0) & (starts <= len(text)), 0, far).astype(np.int32)
    padded = np.zeros(len(item) + width, np.uint32)  # zero is no character of a normalised text
    a, b = max(0, first), min(len(text), first + len(padded))
    if b > a:
        padded[a - first:b - first] = text[a:b]
    for i in range(len(item)):
        new = row + (padded[i:i + width] != item[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - steps) + steps
        new[(starts + i + 1 > len(text)) | (starts + i + 1 < 0)] = far
        row = new
        if row.min() > most:
            return None
    return row


def align(text: np.ndarray, item: np.ndarray, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """The part of ``text`` on these diagonals that the item turns into with fewest edits, if at most ``most``: edits, start, stop."""
    row = _last_row(text, item, first, width, most)
    if row is None or row.min() > most:
        return None
    edits = int(row.min())
    stop = first + int(row.argmin()) + len(item)
    # Backwards from the stop, which fixes one end: the start is where as many edits suffice.
    before = text[max(0, stop - len(item) - most):stop][::-1]
    table = np.arange(len(before) + 1)
    for i, character in enumerate(item[::-1].tolist()):
        new = np.empty_like(table)
        new[0] = i + 1
        new[1:] = np.minimum(table[:-1] + (before != character), table[1:] + 1)
        table = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    length = int(table.argmin())
    return edits, stop - length, stop


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, characters: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items with normalised texts, in blocks of about ``characters`` and one item at least; one block is held at a time."""
    block, size = [], 0
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), text_or_empty(text_column).alias("text"))
    for row in items.toLocalIterator():
        text = normalised(row.text)
        if block and size + len(text) > characters:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, q: int = Q, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """One row ``(doc_id, item_id, edits, start, stop)`` per row of ``docs`` and item that occurs in it.

    ``edits`` is the least number over all occurrences, at most ``rate`` times the item's normalised length; ``start``
    and ``stop`` are code points of the original text around the best occurrence. An item of fewer than ``1 / rate``
    characters occurs where these stand as they are, within a longer word, too.

    Null and empty texts and items match nothing. Null and repeated ids stay as they are; rows that repeat have rows of their
    own. Empty tables give empty results. Other columns are ignored.
    """
    spark = bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    found: list[DataFrame] = []
    for block in _blocks(benchmark, item_column, item_text_column, block_characters):
        if len(found) == 1:  # with several blocks each pass is written at once
            found[0] = written(found[0], "benchmark-hits")
        hits = texts.mapInArrow(_matcher(spark.sparkContext.broadcast(Indexes(block, q, rate))), HITS_SCHEMA)
        found.append(written(hits, "benchmark-hits") if found else hits)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], HITS_SCHEMA)


def _matcher(index):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = index.value.find
        for rows in batches:
            out = []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                hits = find(normalised(text))
                if hits:
                    places = _places(text)
                    out += ((doc, item, edits, int(places[a]), int(places[b - 1]) + 1) for item, edits, a, b in hits)
            if out:
                yield batch(HITS, *zip(*out))
    return match


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, q: int = Q, text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", block_characters: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark occurs, as ``benchmark_hits`` says.

    Null and empty texts stay, rows that repeat stay as often as they are there, and ids play no part. An empty benchmark
    drops nothing; an empty table gives an empty result.
    """
    spark, names, at = bounded_batches(docs.sparkSession), docs.columns, docs.columns.index(text_column)
    schema = docs.schema
    for block in _blocks(benchmark, item_column, item_text_column, block_characters):
        index = spark.sparkContext.broadcast(Indexes(block, q, rate))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            occur = index.value.occur
            for rows in batches:
                yield rows.filter(pa.array([not occur(normalised(t or "")) for t in rows.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(keep, schema)
    return docs.select(*names)
