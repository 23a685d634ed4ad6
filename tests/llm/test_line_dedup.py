"""Removal of shared lines against brute force, and the index alone."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tests.conftest import rows
from tristrata.llm import line_dedup as op

SCHEMA = "doc_id long, text string"


def brute(docs: list[tuple[int | None, str | None]], min_documents: int, min_chars: int = 1) -> list[tuple]:
    texts = [(t or "").split("\n") for _, t in docs]
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    found: dict[str, int] = {}
    for lines in texts:
        for k in {key(line) for line in lines}:
            found[k] = found.get(k, 0) + 1
    out = []
    for (doc_id, _), lines in zip(docs, texts):
        kept = [x for x in lines if len(key(x)) < max(1, min_chars) or found[key(x)] < min_documents]
        text = "\n".join(kept)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


def made(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    lines = ["", " ", "ä", " Ä", "Share\tthis ", "share\tTHIS", "é" * 7, " x", "\x0b\x0cpage\r", "page", *(f"own {i}" for i in range(60))]
    docs: list[tuple[int | None, str | None]] = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    docs += [(None, None), (None, ""), (7, docs[3][1]), docs[3], docs[3], (500, "\n"), (501, "page\n" * 5000 + "end"), (502, "x" * 200_000 + "\npage")]
    return docs + [(600 + i, "the same text\nof a third of all rows\npage") for i in range(60)]


@pytest.mark.parametrize("shard_lines", [5, 1 << 17])
def test_equals_brute_force(spark, shard_lines):
    docs = made()
    df = spark.createDataFrame([(t, d) for d, t in docs], "text string, doc_id long").repartition(6)
    assert rows(op.drop_shared_lines(df, 10, shard_lines=shard_lines)) == brute(docs, 10)


def test_least_code_points(spark):
    docs = made(4)
    assert rows(op.drop_shared_lines(spark.createDataFrame(docs, SCHEMA), 3, 4)) == brute(docs, 3, 4)


def test_long_texts_have_several_pieces(spark):
    docs = [(i, "\n".join(f"line {(i * j) % 9001}" for j in range(10_000))) for i in range(12)]
    assert rows(op.drop_shared_lines(spark.createDataFrame(docs, SCHEMA), 10)) == brute(docs, 10)


def test_empty_table_and_clashing_columns(spark):
    assert rows(op.drop_shared_lines(spark.createDataFrame([], SCHEMA))) == []
    names = ["t1", "t2", "drops", "hashes", "shard", "n"]
    docs = [(i, "again\nown %d" % i) for i in range(11)]
    df = spark.createDataFrame([(*r, *range(6)) for r in docs], SCHEMA + "".join(f", {c} long" for c in names))
    assert rows(op.drop_shared_lines(df, 10)) == brute(docs, 10)


def test_stored_index_judges_other_documents(spark, tmp_path):
    op.write_index(spark.createDataFrame([(i, f"known\nfirst {i}") for i in range(10)], SCHEMA), str(tmp_path / "index"))
    new = spark.createDataFrame([(1, "KNOWN\nunknown\nfirst 3"), (2, None)], SCHEMA)
    found = rows(op.drop_shared_lines(new, 10, index=str(tmp_path / "index")), "doc_id", "n_dropped", "kept_text")
    assert found == [(1, 1, "unknown\nfirst 3"), (2, 0, "")]


def test_index_finds_counts_and_turns_others_away():
    rng = np.random.default_rng(1)
    high, low = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    n = rng.integers(1, 70_000, 5000)
    index = op.LineIndex.from_bytes(op.LineIndex.build(high, low, n).to_bytes())
    assert (index.find(high, low) == n).all()
    assert not index.find(high, rng.integers(-(1 << 62), 1 << 62, 5000)).any()
    twice = op.LineIndex.build(high[[0, 1]], low[[0, 0]], n[[0, 1]])
    assert len(twice.counts) == 1 and twice.counts[0] == n[0] + n[1]
    assert op.LineIndex.from_bytes(op.LineIndex.build(*np.empty((3, 0), np.int64)).to_bytes()).find(high, low).sum() == 0
