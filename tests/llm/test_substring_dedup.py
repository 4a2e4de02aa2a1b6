import random
import re

import pytest
from cases import documents, no_documents, rows, words

from casemesh.llm import substring_dedup as S


def slow(docs, window=20):
    """(doc_id, n_words, removed spans, kept text) of distinct (doc_id, text), by remembering every window."""
    told = sorted(((i is not None, i or 0, S._tie(t, True), t, i) for i, t in set(docs)), key=lambda x: x[:3])
    seen, out = set(), {}
    for _, _, _, text, i in told:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(found)
        for at in range(len(found) - window + 1):
            key = tuple(found[at:at + window])
            if key in seen:
                gone[at:at + window] = [True] * window
            seen.add(key)
        spans = [m.span() for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out[i, text] = (i, len(found), spans, " ".join(w for w, g in zip(found, gone, strict=True) if not g))
    return sorted((out[d] for d in docs), key=repr)


def said(df):
    return sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["removed"]], r["kept_text"]) for r in df.collect()), key=repr)


def passages(seed):
    """Texts that share passages of 15 to 70 words, whole copies, shifted copies and runs of one word."""
    rng = random.Random(seed)
    shared = [words(rng, n) for n in (15, 19, 20, 21, 30, 45, 70)]
    texts = []
    for _ in range(60):
        parts = [words(rng, rng.randint(0, 60))]
        for p in rng.sample(shared, rng.randint(0, 3)):
            cut = p.split(" ")[rng.choice([0, 0, 2]):]
            parts += [" ".join(cut), words(rng, rng.randint(0, 25))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[3], texts[3], texts[3] + " more words", "again " * 90, "again " * 45 + "end", "", None, "  "]
    texts.append(shared[4] + " " + shared[4] + " between " + shared[4])  # inside one text
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "window"), [(1, 20), (2, 20), (3, 7), (4, 1), (5, 2)])
def test_against_every_window(spark, seed, window):
    docs = passages(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert said(S.remove_repeats(df, window=window)) == slow(docs, window)


def test_few_rows_held_and_frequent_anchors(spark, monkeypatch):
    docs = passages(6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(S, "HELD", 50)
    monkeypatch.setattr(S, "OFTEN", 10_000)  # any repeated anchor counts as frequent
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert said(S.remove_repeats(df)) == slow(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_anchor_in_many_contexts(spark):
    rng = random.Random(8)
    core = words(rng, 12)
    docs = [(i, f"{words(rng, 30)} {core} {words(rng, 30)}") for i in range(80)]
    docs += [(i + 80, docs[i][1].split(" ", 15)[-1]) for i in range(0, 80, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert said(S.remove_repeats(df)) == slow(docs)


def test_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()] + [(7, "another text under this id " * 9), (None, "x y " * 30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert said(S.remove_repeats(df)) == slow(docs)
    dotted = documents(spark).selectExpr("*", "score AS `a.b`")
    kept = S.remove_repeats(dotted, ["doc_id", "a.b", "kept", "spans"])
    assert kept.columns == ["doc_id", "a.b", "kept", "spans", "n_words", "removed", "kept_text"]
    assert kept.count() == len(rows())
    assert S.remove_repeats(no_documents(spark)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(2)
    long = words(rng, 60_000)
    docs = [(1, long), (2, "new " + long + " new"), (3, words(rng, 50))]
    assert said(S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == slow(docs)
