"""Groups of spelling variants, by permuterm rotations.

A word that ends in a marker, ``A c B $``, has a rotation for each of its letters that ends in that letter: ``B $ A c``. The
prefix ``B $ A``, which skips ``c``, is shared by all words that have another letter there, and it is itself a rotation
of ``A B``, the word without the letter. So when all rotations are in order of those prefixes, words one edit apart stand
in one range: whole rotations stand for words, and rotations without their last letter for replacements, and for the
longer words of an insertion. A scan over the sorted ranges counts the neighbours of each member and finds its best
one. A range has at most one word for each letter of the alphabet and the shorter one, so no range grows with the
corpus, and pairs are never listed.

Of equal letters in a row only the last one counts as inserted or deleted, as each of them gives the same word; so every
two neighbours meet in one range only.

Words above ``LONG`` letters would make rotations of quadratic size: theirs are named by a hash of ``A`` and one of ``B``
and the words by a hash, and the names are turned into words again where neighbours were found.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, text_or_empty, written

MARKER, HASHED = "$", "\x01"
#: Letters of a prefix that is kept as text; longer ones are hashed.
LONG = 64
#: A task counts so many different words, of so many letters, before it sends them on.
HELD_WORDS, HELD_LETTERS = 1 << 17, 1 << 24

WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
ENTRIES = pa.schema([("key", pa.string()), ("letter", pa.string()), ("n", pa.int64()), ("name", pa.string())])
NEAR = pa.schema([("name", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def word_counts(text: str | None, doc_id: int | None, letters: re.Pattern, least: int, slip: int | None) -> Iterator[tuple[str, int]]:
    """The words of a text with their numbers; of every ``slip``-th one, by a checksum of id and word, a letter is missing."""
    # bytes.lower() changes A-Z only.
    found = Counter(letters.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in found.items():
        if slip is not None:
            checksum = zlib.crc32(word.encode(), start)
            if checksum % slip == 0:
                at = checksum % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
        yield word, n


def _count_words(alphabet: str, least: int, slip: int | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile(f"[{alphabet}]{{{least},}}")
        held: dict[str, int] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for i in range(0, len(names), 1 << 14):
                part = names[i:i + (1 << 14)]
                yield batch(WORDS, part, [held[w] for w in part])

        for rows in batches:
            for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                for word, n in word_counts(text, doc_id, letters, least, slip):
                    if word not in held:
                        size += len(word)
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS or size >= HELD_LETTERS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()
    return count


def count_words(
    docs: DataFrame, min_chars: int = 7, min_count: int = 2, alphabet: str = "a-zÀ-ÿ", slip: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(word, n)``: the maximal runs of ``alphabet`` in all texts, A-Z lower-cased, that have ``min_chars`` code points
    and occur ``min_count`` times. A null text has none.

    With ``slip`` misspellings are made: of each run whose unsigned CRC-32 of ``<id>:<run>`` it divides, the code point
    at that number modulo the length is left out before lengths are judged. A null id is an empty one there.
    """
    bounded_batches(docs.sparkSession, rows=20_000)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    found = rows.mapInArrow(_count_words(alphabet, max(1, min_chars), slip), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _name():
    """What stands for a word: itself, or a hash of a long one."""
    return F.when(F.length("word") <= LONG + 1, F.col("word")).otherwise(F.concat(F.lit(HASHED), F.md5(F.col("word").cast("binary"))))


def name_of(word: str) -> str:
    return word if len(word) <= LONG + 1 else HASHED + hashlib.md5(word.encode()).hexdigest()


def _long_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of words above ``LONG`` letters, for the prefixes of more than ``LONG`` letters."""
    for rows in batches:
        for word, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            name, size = name_of(word), len(word)
            before, after = np.empty(size + 1, np.uint64), np.empty(size + 1, np.uint64)
            head, tail = xxhash.xxh64(seed=1), xxhash.xxh64(seed=2)
            before[0], after[size] = head.intdigest(), tail.intdigest()
            for i in range(size):
                head.update(word[i].encode())
                tail.update(word[size - 1 - i].encode())
                before[i + 1], after[size - 1 - i] = head.intdigest(), tail.intdigest()

            def key(a: int, b: int) -> str:
                return f"{HASHED}{word[b] if b < size else MARKER}{before[a]:016x}{after[b]:016x}"

            out = [(key(p, p), "", n, name) for p in range(size + 1)]
            if size - 1 > LONG:
                out += [(key(p - 1, p), word[p - 1], n, name) for p in range(1, size + 1)]
            for i in range(0, len(out), 1 << 14):
                yield batch(ENTRIES, *zip(*out[i:i + (1 << 14)]))


def rotations(words: DataFrame) -> DataFrame:
    """``(key, letter, n, name)``: every rotation as a key without a letter, and every rotation as its last letter after a key."""
    size = F.length("word")
    turned = words.filter(size <= LONG + 1).select("n", size.alias("size"), F.explode(F.sequence(F.lit(0), size)).alias("p"), "word")
    turned = turned.select("n", "size", "p", F.concat(F.expr("substring(word, p + 1)"), F.lit(MARKER), F.expr("substring(word, 1, p)")).alias("r"))
    whole = F.when(F.col("size") <= LONG, F.struct(F.col("r").alias("key"), F.lit("").alias("letter")))
    skipping = F.when(F.col("p") > 0, F.struct(F.expr("left(r, size)").alias("key"), F.expr("right(r, 1)").alias("letter")))
    short = turned.select("n", F.explode(F.array(whole, skipping)).alias("e")).filter("e is not null")
    short = short.select("e.key", "e.letter", "n", F.lit(None).cast("string").alias("name"))
    long = words.filter(size > LONG).mapInArrow(_long_entries, "key string, letter string, n long, name string")
    return short.unionByName(long)


def _neighbours(key: str, letters: Sequence[str], ns: Sequence[int], names: Sequence[str | None]) -> Iterator[tuple[str, int, int, str]]:
    """``(name, neighbours, n of the best, best)`` of each member of a range; more rows, of no neighbours, for hashed ties."""
    if key[0] == HASHED:
        following, named = key[1], list(names)
    else:
        after, before = key.split(MARKER)
        following, named = key[0], [before + c + after for c in letters]
    # The last of equal letters in a row stands for all as inserted one.
    members = [(c, n, name, bool(c) and c != following) for c, n, name in zip(letters, ns, named)]
    shorter = [m for m in members if not m[0]]
    longer = [m for m in members if m[0]]
    inserted = [m for m in longer if m[3]]
    for member in members:
        if not member[0]:
            near = inserted
        else:
            near = [m for m in longer if m[0] != member[0]]
            if member[3]:
                near += shorter
        if not near:
            continue
        best_n = max(m[1] for m in near)
        ties = sorted(m[2] for m in near if m[1] == best_n)
        if ties[0][0] == HASHED or ties[-1][0] == HASHED:
            yield from ((member[2], 0 if i else len(near), best_n, best) for i, best in enumerate(ties))
        else:
            yield member[2], len(near), best_n, ties[0]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours in the ranges of equal keys of sorted entries; ranges may cross batches."""
    held: pa.Table | None = None
    for rows in batches:
        table = pa.Table.from_batches([rows])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        table = table.combine_chunks()
        keys = table.column("key").chunk(0)
        starts = np.flatnonzero(np.concatenate([[True], pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False).astype(bool)]))
        held = table.slice(int(starts[-1]))
        yield from _near(table, starts)
    if held is not None:
        yield from _near(held, np.array([0, held.num_rows]))


def _near(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Neighbours in all ranges but the one that the last start begins."""
    several = np.flatnonzero(np.diff(starts) > 1)
    if not len(several):
        return
    keys = table.column("key").take(starts[several]).to_pylist()
    inside = np.zeros(table.num_rows + 1, np.int64)
    inside[starts[several]] += 1
    inside[starts[several + 1]] -= 1
    members = table.select(["letter", "n", "name"]).filter(pa.array(np.cumsum(inside[:-1]) > 0))
    letters, ns, names = (members.column(c).to_pylist() for c in ("letter", "n", "name"))
    out, at = [], 0
    for key, size in zip(keys, np.diff(starts)[several].tolist()):
        out += _neighbours(key, letters[at:at + size], ns[at:at + size], names[at:at + size])
        at += size
        if len(out) >= 10_000:
            yield batch(NEAR, *zip(*out))
            out = []
    if out:
        yield batch(NEAR, *zip(*out))


def _spelled(near: DataFrame, words: DataFrame) -> DataFrame:
    """``near`` with words in place of the hashes that stand for long ones."""
    long = words.filter(F.length("word") > LONG + 1).select(_name().alias("hash"), "word")
    hashed = F.col("name").startswith(HASHED) | F.col("best").startswith(HASHED)
    resolved = near.filter(hashed)
    for column in ("name", "best"):
        known = long.select(F.col("hash").alias(column), F.col("word").alias("spelled"))
        resolved = resolved.join(known, column, "left").withColumn(column, F.coalesce("spelled", column)).drop("spelled")
    return near.filter(~hashed).unionByName(resolved)


def spelling_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """``(word, n, n_near, form, form_n)`` of the distinct ``words`` ``(word, n)``.

    Two words are near if one inserted, deleted or replaced code point makes one the other. The ``form`` of a word is
    its near word of the largest ``n``, of several the first in code-point order, if that ``n`` is ``ratio`` times its
    own or more, else null. Words hold letters only: neither ``$`` nor control characters.
    """
    bounded_batches(words.sparkSession, rows=20_000)
    ordered = rotations(words).repartition("key").sortWithinPartitions("key")
    near = ordered.mapInArrow(_scan, "name string, n_near long, best_n long, best string")
    near = _spelled(written(near, "neighbours"), words)
    # Of equal numbers the first word; strings are compared by their bytes, which is the order of code points.
    best = near.groupBy(F.col("name").alias("word")).agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    frequent = -F.col("best.n") >= ratio * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.best")).alias("form"),
                        F.when(frequent, -F.col("best.n")).alias("form_n"))


def with_roots(forms: DataFrame, ratio: int = 10) -> DataFrame:
    """``forms``, stored, with ``root``: the last word that forms lead to, the word itself without one.

    Every step multiplies ``n`` by ``ratio`` at least, so the number of steps has a bound; each round doubles what is known.
    """
    if ratio < 2:
        raise ValueError("ratio below 2: forms would not end")
    roots = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most, least = forms.agg(F.max("n"), F.min("n")).first()
    steps = 1 + math.floor(math.log(max(most or 1, 1) / max(least or 1, 1), ratio) + 1e-9)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    found = forms.join(roots.hint("merge"), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, min_chars: int = 7, min_count: int = 2, ratio: int = 10, alphabet: str = "a-zÀ-ÿ", slip: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs``; see ``count_words``, ``spelling_forms``, ``with_roots``.

    Rows are texts of their own, also where ids or whole rows repeat. Empty tables and texts without words give no rows.
    Other columns of ``docs`` are ignored.
    """
    words = written(count_words(docs, min_chars, min_count, alphabet, slip, id_column, text_column), "words")
    return with_roots(written(spelling_forms(words, ratio), "forms"), ratio)
