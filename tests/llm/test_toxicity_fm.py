from pathlib import Path

import numpy as np
import pytest
from cases import documents, no_documents, rows

from casemesh.llm import toxicity_fm as X

FOLDER = "/root/testdata/sf0.1"


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = X.Machine({}, 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    rows_ = np.array([0, 2, 5])
    z = 0.3 + m.weights[rows_].sum() + sum(m.factors[a] @ m.factors[b] for a in rows_ for b in rows_ if a < b)
    assert m.score(rows_) == pytest.approx(1 / (1 + np.exp(-z)))


def test_pairs_are_learned_where_single_terms_say_nothing():
    """Toxic only if an insult (0) meets a group (1); each alone is clean."""
    rng = np.random.default_rng(3)
    examples, labels = [], []
    for _ in range(1_200):
        a, b = rng.integers(2, size=2)
        examples.append(np.flatnonzero([a, b, *rng.integers(2, size=3)]))
        labels.append(float(a and b))
    machine = X.train(examples, np.array(labels), {i: i for i in range(5)})
    said = [machine.score(e) >= 0.7 for e in examples]
    assert np.mean(np.array(said) == np.array(labels, bool)) > 0.97


def test_terms():
    terms = X.Terms()
    assert terms(None).tolist() == [] and terms("").tolist() == [] and terms("12 ..").tolist() == []
    assert terms("One one, ÉTÉ").tolist() == sorted({X.bucket("one"), X.bucket("été")})
    assert X.Terms({X.bucket("one"): 0})("One two one").tolist() == [0]


def test_tables_of_every_shape(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    machine = X.fit_machine(docs, labels)
    got = X.score_toxicity(docs, machine).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        kind = {r["score"] >= X.THRESHOLD for r in X.score_toxicity(docs, X.fit_machine(docs, some)).collect()}
        assert kind == {some.where("toxic = 1").count() > 0}
    assert X.score_toxicity(no_documents(spark), machine).collect() == []
    X.fit_machine(no_documents(spark), labels)


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="supplied tables are not here")
def test_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    machine = X.fit_machine(docs, labels, ~X.held_out())
    held = X.score_toxicity(docs.where(X.held_out()), machine).join(labels, "doc_id").collect()
    toxic, clean = [r["score"] for r in held if r["toxic"] == 1], [r["score"] for r in held if r["toxic"] == 0]
    assert np.mean([s >= X.THRESHOLD for s in toxic]) > 0.75  # some labels mark texts without any insult
    assert np.mean([s >= X.THRESHOLD for s in clean]) < 0.01
