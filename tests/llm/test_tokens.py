"""Token ids, the token store and packing against the tokenizer and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tristrata.llm import packing, token_store  # noqa: E402
from tristrata.llm.tokens import Encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Plain words, and some more.\nNext line\n\n  indented \t tab", "don't we'll 123 4²",
    "é ß ɏ 日本 😀  two", "<|endoftext|> inside", "x" * 5000, "word " * 3000, "ends with space ", " \n odd \n runs \n",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(library):
    encoder, rng = Encoder(PATH), random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\xa0", "\x1c", "a", "B", "é", "1", "'s", ".", "<|endoftext|>", "日", "́", "\xad", "²", "\x7f", "×"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_store_round_trip(spark, library, tmp_path):
    rows = [(i * 3 - 7, t) for i, t in enumerate(TEXTS)] + [(None, "no key"), (None, "also none"), (2, TEXTS[4]), (2, "same key")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, shard string").repartition(3)
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, PATH, bucket_keys=4)
    found = token_store.read_documents(spark, path, docs).collect()
    ids = sorted(((r.doc_id, list(r.ids)) for r in found), key=str)
    assert ids == sorted(((i, expected_ids(library, t)) for i, t in rows), key=str)
    position = 0
    for r in sorted(found, key=lambda r: r.start):
        assert (r.start, r.n_tokens) == (position, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        position += r.n_tokens
    keys = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    files, buckets = {m.bucket: m.index_file for m in manifest}, manifest[0].buckets
    assert [len(x) for x in token_store.fetch(path, 5, files, buckets)] == [len(expected_ids(library, TEXTS[4]))]
    assert list(token_store.fetch(path, 999, files, buckets)) == []
    unknown = spark.createDataFrame([(999,), (1000,), (5,)], "doc_id long")
    assert [r.doc_id for r in token_store.read_documents(spark, path, unknown).collect()] == [5]


def test_store_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "none"), PATH)
    assert token_store.read_documents(spark, str(tmp_path / "none"), docs).collect() == []


def test_perfect_hash_is_minimal_and_rejects_other_keys():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000))
    rows = [(int(k), "s", i, i, [1]) for i, k in enumerate(keys)]
    index = token_store.Index.from_bytes(token_store.Index.build(rows).to_bytes())
    assert sorted(index.hashing.slots(keys)) == list(range(len(keys)))
    assert [(k, o) for k, _, o, _, _ in index.find(keys)] == [(k, i) for i, k in enumerate(keys.tolist())]
    assert list(index.find(keys + 1)) == []


@pytest.mark.parametrize("block", [3, 8192])
def test_packing_covers_every_id_once(spark, library, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, offset int").repartition(2)
    pieces = packing.pack(docs, PATH, capacity=64, block=block).collect()
    by_sequence: dict[int, list] = {}
    for p in pieces:
        assert p.length == len(p.ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for found in by_sequence.values():
        end = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end <= 64
    whole: dict[tuple, int] = {}
    for i, t in rows:
        ids = expected_ids(library, t)
        for k, x in enumerate(ids):
            whole[i, k, x, len(ids)] = whole.get((i, k, x, len(ids)), 0) + 1
    for p in pieces:
        for k, x in enumerate(p.ids):
            whole[p.doc_id, p.start + k, x, p.doc_tokens] -= 1
    assert not any(whole.values())
    tokens, sequences, padding = packing.padding(spark.createDataFrame(pieces), 64).first()
    assert tokens == sum(len(expected_ids(library, t)) for _, t in rows)
    if block == 8192:
        assert sequences <= -(-tokens // 64) + 2 and padding < 2 * 64


def test_rests_go_to_the_cheapest_sequence_with_room():
    assert packing.assign([3, 6, 4, 5], 9, 1.0, 1.0) == [(1, 0, 6, 0), (0, 0, 3, 0), (3, 0, 5, 1), (2, 0, 4, 1)]
    # Nothing has room for the last five tokens at once: they are cut.
    assert packing.assign([7, 7, 5], 10, 1.0, 0.0) == [(0, 0, 7, 0), (2, 0, 3, 0), (1, 0, 7, 1), (2, 3, 2, 1)]


def test_all_sequences_but_one_are_full():
    rng = random.Random(9)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    filled: dict[int, int] = {}
    for _, _, n, s in packing.assign(lengths, 1024, 1.0, 1 / 1024):
        filled[s] = filled.get(s, 0) + n
    assert len(filled) == -(-sum(lengths) // 1024)
    assert sorted(filled.values())[1:] == [1024] * (len(filled) - 1)


def test_packing_an_empty_table(spark):
    empty = packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert empty.collect() == []
    assert tuple(packing.padding(empty).first()) == (0, 0, 0)
