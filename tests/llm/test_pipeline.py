import zlib

import numpy as np
import public_tokenizers
from cases import documents, no_documents
from test_near_copies import slow_groups
from tokenizers import Tokenizer

import corpus_pipeline
from casemesh.llm import language_centroids, pii_semicrf, toxicity_fm

LABELS = [(i, int(i % 5 == 0)) for i in range(12)]


def folder(spark, tmp_path, docs):
    path = str(tmp_path / "tables")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def slow(spark, docs, path):
    """The stages on plain rows, with the same models."""
    rows = [r.asDict() for r in docs.collect()]
    model = language_centroids.fit_languages(docs, ~language_centroids.held_out())
    letters = language_centroids.letter_table()
    rows = [r for r in rows if not model.judge(language_centroids.ngram_counts(r["text"], letters))[2]]
    left = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    machine = toxicity_fm.fit_machine(left, spark.read.parquet(f"{path}/labels.parquet"), ~toxicity_fm.held_out())
    terms = toxicity_fm.Terms(machine.places)
    rows = [r for r in rows if machine.score(terms(r["text"])) < toxicity_fm.THRESHOLD]
    kept = []
    least, _ = slow_groups(list(enumerate(r["text"] for r in rows)))
    for g in sorted(set(least.values())):
        of = [r for n, r in enumerate(rows) if least[n] == g]
        kept.append(min(of, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"])))
    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in kept], "doc_id long, text string")
    field = pii_semicrf.fit_field(left)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for r in kept:
        base = pii_semicrf.base_spans(r["text"])
        text = pii_semicrf.masked(r["text"], base + field.added(r["text"], base))
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            piece = np.array(ids[at:at + 2048], "<u4")
            out.append((r["doc_id"], at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    return sorted(out, key=repr)


def test_against_plain_rows(spark, tmp_path):
    extra = [(500 + i, f"word number {w} mail a.{i}@b{i}.example.com or +1 (01{i}) 555-772{i} {w}", "en", "s", 1, 0.0, "k", "s", 1, "f", "i")
             for i, w in enumerate(("rain sun", "old river stone", "green leaves fall"))]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema))
    path = folder(spark, tmp_path, docs)
    got = corpus_pipeline.run(spark, path)
    said = sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got.collect()), key=repr)
    assert said == slow(spark, docs, path)


def test_filters_keep_the_columns(spark, tmp_path):
    docs = documents(spark).selectExpr("*", "score AS `a.b`")
    path = folder(spark, tmp_path, documents(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, no_documents(spark))).collect() == []
