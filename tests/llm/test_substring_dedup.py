"""Removal of repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from tristrata.llm import substring_dedup as op


def brute(docs: list[tuple[int | None, str | None]], size: int) -> list[tuple]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    key = lambda i: (docs[i][0] is not None, docs[i][0] or 0)
    earliest: dict[tuple, tuple] = {}
    for i, w in enumerate(words):
        for s in range(len(w) - size + 1):
            g = tuple(w[s:s + size])
            earliest[g] = min(earliest.get(g, (key(i), s)), (key(i), s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - size + 1):
            if earliest[tuple(w[s:s + size])] < (key(i), s):
                gone.update(range(s, s + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((docs[i][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_words, range_characters, partitions", [(50, 300, 50_000), (1 << 21, 1 << 24, 50_000), (50, 300, 3)])
def test_equals_brute_force(spark, monkeypatch, batch_words, range_characters, partitions):
    monkeypatch.setattr(op, "MAX_PARTITIONS", partitions)
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "é", "x,", "X,"]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 5, 9, 14)]
    docs: list[tuple[int | None, str | None]] = [(90, None), (91, ""), (None, passages[3]), (None, f"q {passages[2]}"), (92, "a " * 500), (93, passages[1])]
    for i in range(60):
        parts = [rng.choice([*passages, f"u{rng.random()}", "a\tb\x0bc", "\n"]) for _ in range(rng.randint(0, 7))]
        docs.append((i, "  ".join(parts)))
    docs += [(3, passages[3] + " " + passages[3]), (5, docs[11][1]), (5, docs[11][1])]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, slot int, payload string").repartition(3)
    result = op.remove_repeated_passages(frame, 4, batch_words=batch_words, range_characters=range_characters)
    found = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in result.collect()), key=str)
    assert found == brute(docs, 4)


def test_groups_are_those_that_occur():
    assert list(op._groups(np.array([2, 2, 5, 9, 9]))) == [(2, 0, 2), (5, 2, 3), (9, 3, 5)]
    assert list(op._groups(np.array([], int))) == []


def test_intervals_are_maximal():
    assert op.merged(np.array([7, 0, 3, 20, 3]), 4) == [(0, 11), (20, 24)]
    assert op.merged(np.array([0, 4, 9]), 4) == [(0, 8), (9, 13)]


def test_rolled_hashes_equal_for_equal_windows_only():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 5000).astype(np.uint64)
    hashes = op.window_hashes(words, 6)
    windows = [tuple(words[i:i + 6]) for i in range(len(hashes))]
    assert len(set(windows)) == len(set(hashes.tolist())) == len(set(zip(windows, hashes.tolist())))


def test_packed_columns_return():
    columns = [np.arange(5, dtype="<u8") << 40, np.array([3, 1], "<u4"), np.array([], "<i8")]
    assert [c.tolist() for c in op._unpacked(op._packed(*columns))] == [c.tolist() for c in columns]


def test_empty_table(spark):
    assert op.remove_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
