"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tests.conftest import rows
from tristrata.llm import spelling as op

SCHEMA = "doc_id long, text string"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def is_near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs: list[tuple[int | None, str | None]], least: int = 7, count: int = 2, slip: int | None = None) -> dict[str, int]:
    found: Counter = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def brute(words: dict[str, int], ratio: int = 10) -> list[tuple]:
    near = {w: [o for o in words if abs(len(o) - len(w)) <= 1 and o != w and is_near(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


def misspelled(rng: random.Random, word: str) -> str:
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abzéÿ÷") + word[i:], word[:i] + rng.choice("abzé") + word[i + 1:]])


def made(seed: int, ratio: int = 10) -> dict[str, int]:
    rng = random.Random(seed)
    bases = ["aaaaaaa", "aabbaabb", "abababab", "straße", "überall", "a" * 63, "ab" * 32, "z" + "a" * 64, "ÿ" * 65 + "é", "long" * 30]
    words = {w: rng.choice([1, 3, 40, 900, 900]) for w in bases}
    for _ in range(400):
        word = misspelled(rng, rng.choice(list(words)))
        if word:
            words[word] = rng.choice([1, 1, 2, 5, 5, 50, 5000])
    return words


@pytest.mark.parametrize("seed, ratio", [(1, 10), (2, 2)])
def test_forms_and_roots_equal_brute_force(spark, seed, ratio):
    words = made(seed)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    assert rows(op.with_roots(op.spelling_forms(df, ratio), ratio), *COLUMNS) == brute(words, ratio)


def test_ranges_cross_batches(spark):
    words = made(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    entries = op.rotations(spark.createDataFrame(list(words.items()), "word string, n long")).coalesce(1).sortWithinPartitions("key")
    found = rows(entries.mapInArrow(op._scan, "name string, n_near long, best_n long, best string"))
    op.bounded_batches(spark, rows=20_000)
    assert found == rows(entries.mapInArrow(op._scan, "name string, n_near long, best_n long, best string")) and found


def test_words_of_documents(spark):
    rng = random.Random(5)
    vocabulary = ["Spelling", "SPELLING", "variant", "groups", "grouped", "Übermut", "übermut", "x×y÷zabc", "naïveté", "don't", "ab"]
    docs: list[tuple[int | None, str | None]] = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(80)]
    docs += [(None, None), (None, ""), (None, docs[0][1]), docs[1], docs[1], (900, "word" * 30_000), (901, "Word" * 30_000 + "s"), (902, "word" * 30_000), (903, "word" * 30_000 + "s")]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    for slip in (None, 3, 31):
        words = brute_words(docs, slip=slip)
        assert dict(rows(op.count_words(df, slip=slip), "word", "n")) == words
        assert rows(op.spelling_variants(df, slip=slip), *COLUMNS) == brute(words)


def test_least_length_and_number(spark):
    docs = [(1, "cat cart cat cat carts"), (2, "cat bat")]
    found = op.spelling_variants(spark.createDataFrame(docs, SCHEMA), min_chars=1, min_count=1, ratio=3)
    assert rows(found, *COLUMNS) == brute(brute_words(docs, 1, 1), 3)


def test_empty_table_and_clashing_columns(spark):
    assert rows(op.spelling_variants(spark.createDataFrame([], SCHEMA))) == []
    docs = [(i, "spelling spelling speling") for i in range(30)]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], SCHEMA + ", word string, n string")
    assert rows(op.spelling_variants(df), *COLUMNS) == brute(brute_words(docs))
