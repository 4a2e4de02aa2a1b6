"""From raw documents to packed training sequences: five stages, each one operator of casemesh.llm.

Every stage takes what the one before kept, as written to Parquet and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh.llm import language_centroids, library_ids, near_copies, packing_nnls, pii_semicrf, toxicity_fm
from casemesh.llm.common import own_name, quoted, shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those too far from every language's centroids."""
    model = language_centroids.fit_languages(docs, ~language_centroids.held_out())
    names = (own_name(), own_name(), own_name())
    judged = language_centroids.judge_languages(docs, model, docs.columns, names)
    return judged.where(~F.col(names[2])).select(quoted(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity_fm.fit_machine(docs, labels, ~toxicity_fm.held_out())
    score = own_name()
    scored = toxicity_fm.score_toxicity(docs, machine, docs.columns, score)
    return scored.where(F.col(score) < toxicity_fm.THRESHOLD).select(quoted(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group linked by five-word Jaccard similarities of 0.8 and more."""
    return near_copies.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows the text."""
    clean = pii_semicrf.mask_texts(docs, pii_semicrf.fit_field(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(quoted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 2048 ids; one row for each piece."""
    text = library_ids.tokenizer_text(public_tokenizers.path("word_bpe_49k.json"))
    return packing_nnls.pack(docs, text)


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Fingerprints, learned models and token ids are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read by the next."""
    folder = f"{shared_folder(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
