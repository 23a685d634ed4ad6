"""Language and toxicity models against held-out rows and defined edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tristrata.llm import language, toxicity
from tristrata.llm.common import bounded_sample

SYLLABLES = {
    "aa": ["the", "ing", "er", "on", "sh", "ble", "ou"], "bb": ["que", "ción", "ado", "la", "es", "miento", "rr"],
    "cc": ["sch", "ung", "ein", "über", "keit", "ß", "äu"],
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_languages_are_told_apart_and_scores_are_calibrated(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randint(3, 60)), lang, "x") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    rows += [(1000, None, "aa", "x"), (1001, "", "bb", "x"), (1002, "12 -- 34!", "cc", "x"), (1003, prose(rng, "cc", 5000), None, "x"), (None, "the thing on", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.train(docs, learn="doc_id % 4 <> 2", per_language=150)
    assert model.languages == ["aa", "bb", "cc"]
    assert (model.weights == 0).mean() > 0.9  # the elastic net leaves few weights
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(found) == len(rows)
    held = [(lang, found[i]) for i, _, lang, _ in rows[:600] if i % 4 == 2]
    assert np.mean([lang == r.lang_pred for lang, r in held]) > 0.97
    assert abs(np.mean([r.score for _, r in held]) - np.mean([lang == r.lang_pred for lang, r in held])) < 0.05
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[1003].lang_pred == "cc" and found[None].lang_pred == "aa"
    kept = language.keep_identified(docs, model, 0.3)
    assert kept.columns == docs.columns
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() >= len(rows) - 5


def test_document_frequencies_cover_all_rows(spark):
    texts = ["ab", "ab cd", None, "12", "é", "ab"]
    n, frequencies = language.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    expected = np.zeros(language.DIMENSIONS, np.int64)
    for text in texts:
        expected[np.unique(language.ngram_counts(text or "")[0])] += 1
    assert n == 4 and (frequencies == expected).all()


def test_language_of_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(empty)
    assert language.identify(empty, model).collect() == []
    one = spark.createDataFrame([(1, "word", "aa")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.identify(one, model).collect()] == [(1, "und", 0.0)]
    assert [r.lang_pred for r in language.identify(one, language.train(one)).collect()] == ["aa"]


def test_repeated_rows_neither_fill_nor_empty_the_sample(spark):
    """Equal rows count once, whether their hash is chosen or not."""
    few = spark.range(1000).selectExpr("'aa' as lang", "cast(id as string) as key")
    for copy in range(4):
        many = spark.range(20_000).selectExpr("'aa' as lang", f"'copy {copy}' as key")
        found = bounded_sample(few.union(many), "lang", "key", {"aa": 200}).collect()
        assert 150 < len(found) < 250 and len({r.key for r in found}) == len(found)
    assert bounded_sample(few.union(many), "lang", "key", 5000).count() == 1001
    assert bounded_sample(few.limit(0), "lang", "key", 5).collect() == []


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    letters = [chr(0x4E00 + 7 * i) for i in range(230)]
    rows = [(i, " ".join(c * rng.randint(1, 3) for _ in range(12)), f"l{i % 230:03}") for i, c in enumerate(letters * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(model.languages) == 230
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.95


def test_one_text_of_a_repeated_labelled_id_teaches(spark, monkeypatch):
    docs = spark.range(5000).selectExpr("7L as doc_id", "concat('text ', id) as text").unionByName(
        spark.createDataFrame([(1, "fine words here"), (2, "other fine words")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (1, 0), (2, 0)], "doc_id long, toxic int")
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda toxic, ordinary: taught.append((len(toxic), len(ordinary))))
    toxicity.train(docs, labels)
    assert taught == [(1, 2)]


def test_pieces_are_taken_evenly():
    pieces = [str(i).encode() for i in range(1000)]
    taken = toxicity.evenly(pieces, 300)
    assert len(taken) == 300 and taken == sorted(taken, key=int) and sum(int(p) >= 500 for p in taken) > 100
    assert toxicity.evenly(pieces, 1000) == pieces


def test_temperature_minimises_the_log_loss():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3)) * 2
    p = np.exp(logits / 2.5)
    labels = np.array([rng.choice(3, p=x / x.sum()) for x in p])
    assert abs(language.fit_temperature(logits, labels) - 2.5) < 0.4


def test_toxic_texts_are_found_on_held_out_rows(spark):
    rng = random.Random(3)
    insults = ["wretched", "scoundrel", "dimwit", "vermin"]
    rows, marks = [], []
    for i in range(900):
        words, bad = prose(rng, rng.choice(["aa", "cc"]), rng.randint(20, 150)).split(), i % 4 == 0
        for _ in range(rng.randint(2, 6) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        rows.append((i, " ".join(words), "x"))
        marks.append((i, 1, int(bad)))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, prose(rng, "aa", 20000), "x"), (None, "dimwit vermin wretched", "x")]
    marks += [(None, 1, 1), (2000, 1, None), (0, 1, 0), (1, 0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, learn="doc_id % 3 <> 1")
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())
    held = [(bad, found[i] >= 0.7) for i, _, bad in marks[:900] if i % 3 == 1]
    caught = sum(b and p for b, p in held)
    assert caught / sum(b for b, _ in held) > 0.85 and caught / sum(p for _, p in held) > 0.95
    assert max(found[2000], found[2001]) < 0.5


def test_toxicity_without_examples_of_a_class(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    for toxic, expected in ((1, 1.0), (0, 0.0), (None, 0.0)):
        labels = spark.createDataFrame([(1, 1, toxic)], "doc_id long, quality int, toxic int")
        assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {expected}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, toxicity.Model()).collect() == []


def test_windows_cover_the_whole_text():
    for n in (0, 1, 8, 9, 12, 13, 50):
        words = [f"w{i}" for i in range(n)]
        covered = {w for run in toxicity.windows(" ".join(words)) for w in run.decode().split()}
        assert covered == set(words)


@pytest.mark.parametrize("texts", [["a b c d e f"] * 3 + ["a b c d e f g"] + ["other words in here"]])
def test_near_copies_train_once(texts):
    assert toxicity.without_near_copies(texts) == [texts[0], texts[-1]]


def test_a_toxic_passage_counts_late_in_a_text_without_spaces():
    rng = np.random.default_rng(3)
    def letters(n):
        return "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    passages = [letters(40) for _ in range(4)]
    plain, both = (toxicity._compressor(d.encode()) for d in (letters(2000), "".join(passages) + letters(2000)))
    own = letters(60_000)
    found = {}
    for n in (0, 1, 4):
        text = own
        for k, passage in enumerate(passages[:n]):
            at = 55_000 + 1000 * k
            text = text[:at] + passage + text[at:]
        runs = toxicity.windows(text)
        assert max(map(len, runs)) <= toxicity.WINDOW * (toxicity.WORD_BYTES + 1) + 1
        found[n] = [len(plain.compress(r)) - len(both.compress(r)) for r in runs]
    strong = {n: sum(x >= 8 for x in saved) for n, saved in found.items()}
    assert strong[0] < strong[1] < strong[4]
    assert max(found[1]) >= 20 > max(found[0])
