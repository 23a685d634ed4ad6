"""Covering tables and fingerprints against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tristrata.llm import components, simhash


def brute_fingerprint(text: str | None, size: int) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_masks_cover_every_small_difference():
    rng = random.Random(3)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 2
        assert all(m.bit_count() == 32 for m in masks)
        for _ in range(2000):
            difference = sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius)))
            assert any(not difference & m for m in masks)


def test_refined_masks_end_at_eight_free_bits():
    for first in simhash.covering_masks(list(range(64)), 4):
        second = first | simhash.covering_masks(simhash._free(first), 4)[0]
        assert len(simhash._free(second)) == 16
        for mask in simhash.covering_masks(simhash._free(second), 4):
            assert len(simhash._free(second | mask)) <= 8


def test_spanning_links_connect_the_same_values():
    rng = random.Random(5)
    values = list({rng.getrandbits(7) for _ in range(60)})
    links = simhash.spanning_links(np.array(values, np.uint64), 1)
    joined = brute_components({v: v for v in values}, 1)
    assert all((int(a) ^ int(b)).bit_count() <= 1 for a, b in links)
    assert len(links) == len(values) - len(set(joined.values()))


@pytest.mark.parametrize("max_bucket", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, max_bucket):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["Äb", "ÉTÉ", "A B"]
    texts: list[str | None] = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A b  c\x0bd", "x " * 3000]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            changed = list(base)
            changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append("  ".join(changed))
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, fps string")
    found = {r.doc_id: r for r in simhash.near_duplicates(docs, max_bucket=max_bucket).collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in found.items()} == prints
    assert {i: r.component_id for i, r in found.items()} == brute_components(prints, 4)


def test_dense_buckets_are_split_without_losing_links(spark):
    rng = random.Random(11)
    near = {sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(300)}
    far = {rng.getrandbits(63) for _ in range(50)}
    values = sorted(near | far)
    frame = spark.createDataFrame([(v, 0) for v in values], "fp long, word int")
    edges = [(r.u, r.v) for r in simhash.linked_fingerprints(frame, 4, max_bucket=8).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {v: roots.get(v, v) for v in values} == brute_components({v: v for v in values}, 4)


def test_empty_table_and_repeated_or_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "lonely text")], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert rows == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (7, 8), (8, 7), (None, 3)]
    roots = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {roots[i] for i in range(1, 41)} == {1}
    assert {roots[i] for i in range(100, 160)} == {100}
    assert len(roots) == 100
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_several_fingerprints_link_by_any_and_rows_keep_their_columns(spark):
    rng = random.Random(13)
    texts: list[str | None] = [None, "", None]
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(80)]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(80)] = f"x{rng.randrange(500)}"
            texts.append(" ".join(changed))
    docs = spark.createDataFrame([(i, t, f"g{i}") for i, t in enumerate(texts)], "doc_id long, text string, gone string")
    prints = {i: simhash.text_fingerprints(t or "", 5, 3, True) for i, t in enumerate(texts)}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in range(a):
            if any(((x ^ y) & (2 ** 64 - 1)).bit_count() <= 4 for x, y in zip(prints[a], prints[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=5, words=3, distinct=True).collect()}
    assert found == {i: find(i) for i in prints}
    kept = simhash.drop_near_duplicates(docs, words=3)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.gone) for r in kept.collect()) == [(i, texts[i], f"g{i}") for i in prints if find(i) == i or i < 3]


def test_rows_go_by_their_own_text_with_repeated_and_null_ids(spark):
    rng = random.Random(17)
    base, other, third = ([f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(3))
    copy = " ".join(base) + " end"
    rows = [(1, " ".join(base)), (2, copy), (2, " ".join(other)), (None, copy), (None, " ".join(third)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
