"""Exact deduplication and the stages of the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_similar import brute_leaders
from tristrata.llm import decontaminate, exact_dedup
from tristrata.llm.tokens import Encoder

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(rows, best):
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    return {t: (best((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("keep, trie_bytes", [("smallest", 32 << 20), ("largest", 32 << 20), ("largest", 500)])
def test_exact_duplicates_equal_brute_force(spark, keep, trie_bytes):
    rng = random.Random(4)
    texts: list[str | None] = [None, "", "a", "A", "Éa", "éa", "ab", "abc", "b" * 40_000, "B" * 40_000, "x y z", "X y Z "]
    rows = [(i, rng.choice(texts)) for i in range(120)] + [(500 + i, f"only {i}") for i in range(40)]
    rows += [(7, "a"), (7, "a"), (None, "abc"), (None, "nobody"), (None, "nobody")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, owner string, n int").repartition(4)
    groups = brute_groups(rows, max if keep == "largest" else min)
    found = exact_dedup.exact_duplicates(docs, keep, trie_bytes=trie_bytes).collect()
    expected = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        owner, size = groups[text]
        expected.append((i, owner, size, i == owner, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    kept = exact_dedup.drop_exact_duplicates(docs, keep, trie_bytes=trie_bytes)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "").translate(LOWER)) for r in kept.collect() if r.doc_id is not None) == sorted(
        (owner, t) for t, (owner, _) in groups.items() if owner is not None)
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["nobody"]


def test_trie_keeps_strings_apart():
    rng = random.Random(5)
    trie, expected = exact_dedup.Trie(False), {}
    for _ in range(3000):
        key, owner = bytes(rng.choices(b"ab", k=rng.randint(0, 9))), rng.randint(0, 99)
        trie.add(key, owner)
        old, times, n = expected.get(key, (owner, 0, 0))
        expected[key] = (min(old, owner), times * (old <= owner) + (owner <= old), n + 1)
    part = dict((k, tuple(v)) for k, *v in trie.take(ord("a")))
    rest = dict((k, tuple(v)) for k, *v in trie.take())
    assert part.keys().isdisjoint(rest) and all(k.startswith(b"a") for k in part) and part | rest == expected
    assert trie.bytes == 0


def test_exact_dedup_of_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(empty).collect() == exact_dedup.drop_exact_duplicates(empty).collect() == []
    with pytest.raises(ValueError):
        exact_dedup.text_groups(empty, "any")


FOLDER = "/root/testdata/sf0.001"


def test_stages_of_the_pipeline_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]

    def step(name: str):
        nonlocal docs
        docs.sparkSession.catalog.clearCache()
        stages[name](spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return docs

    columns = docs.columns
    named = step("language ID")
    assert named.columns == columns
    ids = {r.doc_id for r in named.collect()}
    assert ids <= {i for i, t in rows.items() if any(c.isalpha() for c in t or "")} and len(ids) > 0.98 * len(rows)

    ids = {max(j for j in ids if rows[j].translate(LOWER) == rows[i].translate(LOWER)) for i in ids}
    assert {r.doc_id for r in step("exact dedup").collect()} == ids

    ids = brute_leaders([(i, rows[i]) for i in ids])
    assert {r.doc_id for r in step("SimHash near-dedup").collect()} == ids

    leaked = {i for i in ids if any(b in decontaminate.normalised(rows[i]) for b in bench)}
    clean = {r.doc_id for r in step("benchmark decontamination").collect()}
    assert clean <= ids - leaked and len(clean) >= len(ids - leaked) - 1 and docs.columns == columns

    encode = Encoder(corpus_pipeline.TOKENIZER).encode
    pieces: dict[int, list] = {}
    for p in step("packing").collect():
        pieces.setdefault(p.doc_id, []).append((p.start, p.ids))
    assert {i: [x for _, part in sorted(found) for x in part] for i, found in pieces.items()} == {
        i: [*encode(rows[i]).tolist(), 0] for i in clean}
