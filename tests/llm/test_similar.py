"""Near-duplicates by exact Jaccard similarity against brute force over all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tristrata.llm import simhash, similar
from tristrata.session import work_dir


def brute_leaders(rows, least=0.8):
    """The smallest id of each group of texts that are similar, and of each text without words."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and sets[a] and 10 * len(sets[a] & sets[b]) >= round(10 * least) * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10 ** 6)}"
    return out


@pytest.mark.parametrize("chunks", [{}, {"chunk_texts": 5}, {"chunk_shingles": 700}])
def test_similar_texts_equal_brute_force(spark, chunks):
    rng = random.Random(23)
    texts: list[str | None] = [None, "", " \t", "one", "One", "two words", "Two  words"]
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 200))]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, rng.randint(1, 6))) for _ in range(rng.randint(1, 3))]
    hot = [f"w{rng.randrange(3000)}" for _ in range(150)]
    texts += [" ".join(edited(rng, hot, rng.randint(0, 14))) for _ in range(90)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = similar.drop_similar(docs, **chunks).collect()
    assert {r.doc_id for r in kept} == brute_leaders(rows)
    assert len(kept) == len({r.doc_id for r in kept})


def test_stage_of_the_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == brute_leaders(rows)


def test_fingerprints_pair_what_is_within_the_radius(spark):
    rng = random.Random(31)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 400))]
        texts += [" ".join(base), " ".join(edited(rng, base, 1)), " ".join(edited(rng, base, 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = similar.written(similar.sketches(docs, 5, "doc_id", "text"), "sketches")
    node = {r.doc_id: r.node for r in found.collect()}
    prints = [simhash.text_fingerprints(t, 5, similar.WORDS, distinct=True) for t in texts]

    def connected(links):
        root = {n: n for n in node.values()}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    near = {(node[i], node[j]) for i in range(len(texts)) for j in range(i)
            if any(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in zip(prints[i], prints[j]))}
    pairs = [(r.u, r.v) for r in similar.fingerprint_pairs(found, 0).collect()]
    assert len(near) > 10 and connected(pairs) == connected(near)
    assert len(pairs) == len(set(pairs)) and all(u < v for u, v in pairs)


def test_spanning_links_connect_what_pairs_connect():
    rng = np.random.default_rng(5)
    for n in (2, 40, 600):
        base = rng.integers(0, 1 << 62, 60, np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.25), rng.integers(0, 1 << 62 if n > 40 else 90, 60, np.uint64), base)) for _ in range(n)]
        roots = [int(r) for r in rng.integers(0, 3 * n, n)]
        sides = rng.integers(0, 2, n) if n == 40 else np.full(n, 2)
        compared = [(i, j) for i in range(n) for j in range(i) if (sides[i] != sides[j] or sides[i] == 2) and similar.similar(sets[i], sets[j], 800)]
        same = [(i, j) for i in range(n) for j in range(i) if roots[i] == roots[j]]

        def groups(links):
            least = list(range(n))
            for _ in range(n):
                before = list(least)
                for i, j in links:
                    least[i] = least[j] = min(least[i], least[j])
                if before == least:
                    return least

        links = similar.spanning_links(list(range(n)), roots, sets, sides, 800)
        assert groups([*same, *links]) == groups([*same, *compared])
        assert set(links) <= {(i, j) for a in compared for i, j in (a, a[::-1])} and len(links) < n


def test_rows_of_a_group_grow_with_its_size(spark):
    made = {}
    for n in (400, 800):
        rng = random.Random(n)
        base = [f"w{i}" for i in range(60)]
        docs = spark.createDataFrame([(i, " ".join(edited(rng, base, rng.randint(1, 4)))) for i in range(n)], "doc_id long, text string")
        found = similar.written(similar.sketches(docs, 5, "doc_id", "text"), "sketches")
        active = found.select("node", "size", F.col("node").alias("root"), F.explode("bands").alias("bucket")).distinct()
        made[n] = similar.blocks(active).count()
    assert 0 < made[800] <= 2.2 * made[400]


def test_nulls_repeats_and_clashing_names(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(None, "a b c d e f g h i j k"), (None, "A B C D E F G H I J K"), (3, "p q r s t u v w"), (3, "p q r s t u v w"), (3, "other words of a repeated id"),
            (4, "p q r s t u v w"), (None, "p q r s t u v w"), (5, long), (6, long + " end"), (7, None), (7, None), (8, "")]
    names = ["node", "text_key", "bucket", "gone", "root", "side"]
    docs = spark.createDataFrame([(*r, *range(6)) for r in rows], "doc_id long, text string" + "".join(f", {c} long" for c in names))
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted(
        (i or 0, len(t or "")) for i, t in [rows[0], rows[1], rows[2], rows[3], rows[4], rows[7], rows[9], rows[10], rows[11]])
    assert similar.drop_similar(docs.limit(0)).collect() == []


def test_steps_write_as_many_files_as_their_rows_ask_for(spark):
    """Every file costs a process on some file systems, however few rows it has."""
    rng = random.Random(5)
    hot = [f"w{rng.randrange(3000)}" for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join(edited(rng, hot, rng.randint(0, 14)))) for i in range(90)], "doc_id long, text string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    folder = Path(work_dir(spark))
    before = set(folder.iterdir())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        similar.drop_similar(docs).count()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files: dict[str, list[int]] = {}
    for step in sorted(set(folder.iterdir()) - before):
        files.setdefault(step.name.rsplit("-", 1)[0], []).append(len(list(step.glob("*.parquet"))))
    assert all(n <= 4 for step in ("nodes", "distinct-fingerprints", "edges", "roots") for n in files[step])
    assert "similar" not in files
