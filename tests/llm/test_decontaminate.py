"""q-gram filter and alignment against a plain edit-distance search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tristrata.llm import decontaminate as op


def brute_edits(text: str, item: str) -> int:
    """Fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[k] = rng.choice("abcdefgh")
        elif kind == 1:
            out.insert(k, rng.choice("abcdefgh "))
        else:
            del out[k]
    return "".join(out)


@pytest.mark.parametrize("block_characters", [1 << 20, 150])
def test_hits_equal_brute_force(spark, block_characters):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    items: list[tuple[int | None, str | None]] = [(i, passage(rng.randint(8, 30)).capitalize() + ".") for i in range(8)]
    items += [(20, "shOrt!"), (21, None), (22, ""), (23, "Éte, — BÇ 123 日本 end of it"), (24, items[0][1]), (25, "日本"), (26, "42 km"), (27, "?")]
    # Lengths at which a tenth allows more edits than leave a q-gram of eight characters.
    lengths = [n for n in range(1, 36) for _ in range(2)]
    items += [(100 + k, "".join(rng.choice("hijklmnopqrst") for _ in range(n))) for k, n in enumerate(lengths)]
    docs: list[tuple[int | None, str | None]] = [(900, None), (901, ""), (902, " ,.; "), (903, "short"), (None, f"x {items[2][1]} y"), (904, items[3][1]), (904, items[3][1])]
    for k in range(70):
        _, text = rng.choice(items[:8] + items[11:12])
        inner = edited(rng, text, rng.randint(0, len(text) // 7))
        docs.append((k, passage(rng.randint(0, 25)) + rng.choice([" ", "", "\n--"]) + inner + rng.choice([" ", "!"]) + passage(rng.randint(0, 25))))
    short = items[-len(lengths):]
    docs += [(2000 + k, passage(3) + edited(rng, text, rng.randint(0, len(text) // 8)) + passage(2)) for k, (_, text) in enumerate(short)]
    docs += [(3000, "the answer is 42 km."), (3001, "42  KM"), (3002, "in 日本語")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int").repartition(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = [tuple(r) for r in op.benchmark_hits(frame, bench, block_characters=block_characters).collect()]
    expected = []
    for d, t in docs:
        for i, s in items:
            wanted = op.normalised(s or "")
            if wanted:
                edits = brute_edits(op.normalised(t or ""), wanted)
                if edits <= len(wanted) // 10:
                    expected.append((d, i, edits))
    assert sorted((f[:3] for f in found), key=str) == sorted(expected, key=str)
    assert len(expected) > 30 and any(e for *_, e in expected)
    texts, wanted = dict(docs), dict(items)
    for d, i, edits, start, stop in found:
        part = op.normalised(texts[d][start:stop])
        assert brute_edits(part, op.normalised(wanted[i])) == edits
    kept = op.drop_contaminated(frame, bench, block_characters=block_characters)
    hit = {d for d, *_ in expected}
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in hit)


def test_budget_always_leaves_a_shared_gram():
    for rate in (0, 0.1, 0.3, 0.6):
        for n in range(1, 400):
            edits, q, needed = op.budget(n, 8, rate)
            assert needed >= 1 and 1 <= q <= 8 and edits == int(rate * n)
    assert op.budget(12, 8, 0.1) == (1, 6, 1) and op.budget(5, 8, 0.1) == (0, 5, 1)
    with pytest.raises(ValueError):
        op.budget(10, 8, 1)


def test_time_grows_with_the_hits_of_a_document():
    index = op.Indexes([(1, "abcdefghijkl"), (2, "a")], op.Q, op.EDIT_RATE)
    found = index.find("abcdxfghijkl " * 20_000)
    assert sorted(found) == [(1, 1, 0, 12), (2, 0, 0, 1)]


def test_alignment_at_the_ends_of_the_text():
    p = lambda s: np.array([ord(c) for c in s], np.uint32)
    assert op.align(p("bcdefghij"), p("abcdefghij"), -3, 8, 2) == (1, 0, 9)
    assert op.align(p("xxabcdefghi"), p("abcdefghij"), 0, 6, 2) == (1, 2, 11)
    assert op.align(p("zzzzzzzzzz"), p("abcdefghij"), -3, 8, 2) is None


def test_places_lead_back_to_the_text():
    text = "  Ab,\t—c İx "
    assert op.normalised(text) == "ab c İx"
    assert [text[p] for p in op._places(text)][:2] == ["A", "b"] and len(op._places(text)) == len(op.normalised(text))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words of a benchmark")], "doc_id long, text string")
    assert op.benchmark_hits(docs, one.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert op.benchmark_hits(one, bench).collect() == []
    assert op.drop_contaminated(one, bench).count() == 1
