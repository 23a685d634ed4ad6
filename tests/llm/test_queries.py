"""Registered queries over whole sample tables, against SQL or brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from sample_queries.compare import connect, differences
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substring_dedup import brute
from tristrata.llm import decontaminate, queries
from tristrata.llm.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents() -> list[tuple[int, str]]:
    table = pq.read_table(f"{FOLDER}/documents.parquet", columns=["doc_id", "text"])
    return sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()))


@pytest.fixture(scope="module")
def ids(documents) -> dict[int, list[int]]:
    library = Tokenizer.from_file(queries.TOKENIZER)
    return {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in documents}


def crc(values) -> int:
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(LARGER), LARGER, QUERIES[name], SQL[name]) is None


def test_op1_pieces(spark, documents, ids):
    seen: dict[int, int] = {}
    sequences: dict[int, list] = {}
    for r in QUERIES["op1_pack_cost_balanced"](spark, FOLDER).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {d: len(x) for d, x in ids.items()}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= sum(map(len, ids.values())) / 1024 + 4


def test_op2_store(spark, documents, ids):
    start, expected = 0, []
    for d, _ in documents:
        expected.append((d, start, len(ids[d]), crc(ids[d])))
        start += len(ids[d])
    found = QUERIES["op2_token_store"](spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, found)) == expected


def test_op4_and_op6_on_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{LARGER}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    found = QUERIES["op4_language_ftrl"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in found) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{LARGER}/labels.parquet").to_pylist()}
    scored = QUERIES["op6_toxicity_compression"](spark, LARGER).collect()
    assert sorted(r.doc_id for r in scored) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in scored)
    held = [(r.score, toxic[r.doc_id]) for r in scored if r.held_out and r.doc_id in toxic]
    good, bad = [s for s, t in held if not t], [s for s, t in held if t]
    assert np.mean([b > g for b in bad for g in good]) > 0.85  # some 30 toxic examples to learn from here


def test_op5_components(spark, documents):
    prints = {d: brute_fingerprint(t, 4) for d, t in documents}
    found = QUERIES["op5_simhash_covering"](spark, FOLDER).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == brute_components(prints, 4)


def test_op7_hits(spark, documents):
    bench = [(i, decontaminate.normalised(t)) for i, t in zip(*pq.read_table(f"{FOLDER}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values())]
    whole = {(d, i) for d, t in documents for i, b in bench if b in decontaminate.normalised(t or "")}
    found = QUERIES["op7_decontaminate_qgrams"](spark, FOLDER).collect()
    assert whole == {(r.doc_id, r.item_id) for r in found if r.edits == 0} and whole
    assert len({(r.doc_id, r.item_id) for r in found}) == len(found)


def test_op9_removals(spark, documents):
    found = QUERIES["op9_substring_dedup"](spark, FOLDER).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=str) == [row[:4] for row in brute(documents, 20)]
