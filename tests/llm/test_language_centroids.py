from pathlib import Path

import numpy as np
import pytest
from cases import documents, no_documents, rows

from casemesh.llm import language_centroids as L

FOLDER = "/root/testdata/sf0.01"


def slow_counts(text):
    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return None
    plain = " " + " ".join("".join(c if c.isalpha() else " " for c in low).split()) + " "
    counts = np.zeros(L.WIDTH, np.int64)
    for order in L.ORDERS:
        for i in range(len(plain) - order + 1):
            gram = plain[i:i + order]
            if gram == " ":
                continue
            h = order * 0x9E3779B1 & 0xFFFFFFFF
            for c in gram:
                h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
                h ^= h >> 15
            counts[h % L.WIDTH] += 1
    return counts


def test_counts_against_brute_force():
    letters = L.letter_table()
    for r in rows():
        want, got = slow_counts(r[1]), L.ngram_counts(r[1], letters)
        assert (want is None) == (got is None)
        assert want is None or (want == got).all(), r[1][:40]


def test_a_text_counted_in_runs(monkeypatch):
    letters, text = L.letter_table(), "some words, and  more of them; ÉT ÇA"
    whole = L.ngram_counts(text, letters)
    for run in (1, 2, 3, 7, len(text)):
        monkeypatch.setattr(L, "RUN", run)
        assert (L.ngram_counts(text, letters) == whole).all()


def test_tables_of_every_shape(spark):
    docs = documents(spark)
    model = L.fit_languages(docs)
    assert set(model.languages) == {"en", "fr"}
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    got = L.judge_languages(docs, model).collect()
    assert len(got) == len(rows())
    for r in got:
        text = next(x[1] for x in rows() if x[0] == r["doc_id"]) if r["doc_id"] is not None else None
        if r["doc_id"] is not None and not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        assert 0 <= r["score"] <= 1
    nothing = L.fit_languages(no_documents(spark))
    assert {r["lang_pred"] for r in L.judge_languages(docs, nothing).collect()} == {"und"}
    assert L.judge_languages(no_documents(spark), model).collect() == []


def test_a_far_text_is_rejected():
    letters = L.letter_table()
    counts = np.array([L.ngram_counts(t, letters) for t in ("the cat sat on the mat", "a dog and the cat", "le chat est la",
                                                            "un chien et le chat")])
    model = L.build_model(["en", "en", "fr", "fr"], counts, per_language=2)
    assert model.judge(L.ngram_counts("the dog sat", letters))[::2] == ("en", False)
    assert model.judge(L.ngram_counts("ζωή και θάλασσα", letters))[2]


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="supplied tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = L.fit_languages(docs, ~L.held_out())
    said = {r["doc_id"]: r for r in L.judge_languages(docs.where(L.held_out()), model).collect()}
    true = {r["doc_id"]: r for r in docs.where(L.held_out()).collect()}
    known = [i for i in said if true[i]["lang"] and len((true[i]["text"] or "").split()) >= 5]
    assert np.mean([said[i]["lang_pred"] == true[i]["lang"] for i in known]) > 0.98
    assert np.mean([said[i]["rejected"] for i in known]) < 0.005
