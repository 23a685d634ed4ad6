"""The manifest against a plain Merkle tree, and the layout of its blocks."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tristrata.llm import merkle as op

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row: tuple) -> str:
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and for each leaf its place in the run and the run, level by level."""
    paths: list[list[tuple[int, list[str]]]] = [[] for _ in leaves]
    row, shift = leaves, 1
    while len(row) > 1:
        for i, path in enumerate(paths):
            node = i // shift
            path.append((node % 8, row[node // 8 * 8:node // 8 * 8 + 8]))
        row, shift = [H("".join(row[i:i + 8])) for i in range(0, len(row), 8)], shift * 8
    return row[0], paths


def brute(docs: list[tuple], claims: dict[int, str]) -> list[tuple]:
    """``(doc_id, leaf, subroot, root, proof, folded, verified)``; claims by doc_id."""
    langs = sorted({d[2] for d in docs}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, brute_leaf(d))) for lang in langs]
    trees = [brute_tree([brute_leaf(d) for d in g]) for g in groups]
    root, above = brute_tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), upper in zip(groups, trees, above):
        for doc, path in zip(group, paths):
            node, proof = claims.get(doc[0], brute_leaf(doc)), ""
            for at, run in [*path, *upper]:
                proof += "".join(run[:at] + run[at + 1:])
                node = H("".join([*run[:at], node, *run[at + 1:]]))
            out.append((doc[0], brute_leaf(doc), subroot, root, H(proof), node, node == root))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


def made(n: int) -> list[tuple]:
    rng = random.Random(n)
    langs = [None, "", "de", "en", "fr", "é", "zz"]
    return [(i * 3, rng.choice(["web", None]), rng.choices(langs, (1, 1, 5, 80, 9, 2, 0))[0], rng.choice([None, i]), rng.choice([None, "", f"Text ü {i}"])) for i in range(n)]


def proved(spark, docs, path, claims: dict[int, str] | None = None):
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    claim = F.lit(None).cast("string")
    for doc_id, digest in (claims or {}).items():
        claim = F.when(F.col("doc_id") == doc_id, digest).otherwise(claim)
    found = op.write_manifest(df, str(path), claim=claim).prove()
    return rows(found, "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_layout_is_a_bijection_with_bottom_trees_in_one_piece():
    for levels in range(1, 6):
        places = [op.place(levels, d, np.arange(8 ** d)) for d in range(levels)]
        assert sorted(np.concatenate(places)) == list(range(op.complete(levels)))
    # Five levels are a top of two and 64 bottom trees of three.
    bottom = np.concatenate([op.place(5, 2 + d, 5 * 8 ** d + np.arange(8 ** d)) for d in range(3)])
    assert sorted(bottom) == list(range(op.complete(2) + 5 * op.complete(3), op.complete(2) + 6 * op.complete(3)))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513, 4096])
def test_block_equals_plain_tree(n):
    leaves = [H(str(i)) for i in range(n)]
    block = op.Block.build([bytes.fromhex(x) for x in leaves], op.height_of(n))
    root, paths = brute_tree(leaves)
    assert block.root().hex() == root
    for (places, siblings), path, leaf in zip(block.paths(), paths, leaves):
        assert list(zip(places, siblings)) == [(at, "".join(run[:at] + run[at + 1:])) for at, run in path]
        assert op.fold(leaf, places, siblings) == root


@pytest.mark.parametrize("n", [1, 3, 300])
def test_equals_brute_force(spark, tmp_path, n):
    docs = made(n)
    claims = {0: H("other"), 9: H("another")}
    assert proved(spark, docs, tmp_path / "m", claims) == brute(docs, claims)


def test_several_levels_of_blocks_and_many_groups(spark, tmp_path):
    docs = [(i, None, "en" if i < 4800 else f"l{i}", None, str(i)) for i in range(9000)]  # 4,200 groups of a document each
    found = proved(spark, docs, tmp_path / "m")
    assert found == brute(docs, {}) and all(r[-1] for r in found)


def test_repeated_rows_and_keys_and_null_keys(spark, tmp_path):
    docs = [(None, "a", "en", 1, "x"), (None, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (5, "b", "en", 2, "y" * 100_000), (6, None, None, None, None)]
    docs += [(1, "hot", "en", 3, "copies")] * 700
    assert proved(spark, docs, tmp_path / "m") == brute(docs, {})


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert proved(spark, [], tmp_path / "m") == []
    names = ["key", "tree", "i", "total", "claim", "leaf", "part", "number"]
    docs = made(20)
    df = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in names})
    found = op.write_manifest(df, str(tmp_path / "n")).prove()
    assert rows(found, "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == brute(docs, {})


def test_stored_manifest_is_read_again(spark, tmp_path):
    docs = made(40)
    root = op.write_manifest(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "m")).root
    again = op.read_manifest(spark, str(tmp_path / "m"))
    assert again.root == root == brute(docs, {})[0][3] and again.prove().filter("not verified").isEmpty()
