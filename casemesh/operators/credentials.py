"""Credential documents against the identity an applicant claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions.text import name_similarity, norm, strip_space
from casemesh.operators import detect, spans


def best_name(found: Column, text: Column) -> Column:
    """The longest, then surest, then earliest PERSON span of at least five characters, cut at a line break."""
    people = F.filter(found, lambda s: (s["entity_type"] == "PERSON")
                      & (s["span_end"] - s["span_start"] >= K.MIN_NAME_CHARS))
    best = F.array_max(F.transform(people, lambda s: F.struct(
        (s["span_end"] - s["span_start"]).alias("size"), s["confidence"].alias("confidence"),
        (-s["span_start"]).alias("early"))))
    words = F.substring(text, 1 - best["early"], best["size"])
    return strip_space(F.substring_index(words, "\n", 1))


def match_credentials(docs: DataFrame, apps: DataFrame) -> DataFrame:
    """Per credential document ``(credential_id, application_id, raw_text)``: extracted fields and match status.

    matched needs a similar name and the same identifier; a clear conflict in either is a mismatch; whatever is
    incomplete or in between goes to a person.
    """
    text = F.col("raw_text")
    read = spans.tagged(detect.detect_ids(docs.select("credential_id", "application_id", "raw_text"), "raw_text"))
    named = read.select(
        "credential_id", "application_id", best_name(F.col("spans"), text).alias("candidate_name"),
        F.try_element_at("id_spans", F.lit(1))["value"].alias("candidate_id"),
        F.coalesce(strip_space(text) == "", F.lit(True)).alias("_empty"))
    claims = apps.select("application_id", F.col("name").alias("_name"), F.col("claimed_credential_id").alias("_claimed"))
    joined = named.join(claims, "application_id", "left")
    scored = joined.withColumn("_score", F.when(
        F.col("_name").isNull() | (F.coalesce("candidate_name", F.lit("")) == ""), F.lit(0.0))
        .otherwise(name_similarity(F.col("_name"), F.col("candidate_name"))))
    claimed = F.length(F.coalesce("_claimed", F.lit(""))) > 0
    same_id = F.coalesce(claimed & (norm(F.col("_claimed")) == norm(F.col("candidate_id"))), F.lit(False)) \
        & F.col("candidate_id").isNotNull()
    status = (
        F.when(F.col("_empty") | F.col("candidate_name").isNull() | F.col("candidate_id").isNull(), "needs_review")
        .when((F.col("_score") >= K.NAME_MATCH) & same_id, "matched")
        .when((F.col("_score") < K.NAME_MISMATCH) | (claimed & ~same_id), "mismatch").otherwise("needs_review"))
    return scored.select(
        "credential_id", "application_id", "candidate_name", "candidate_id",
        F.round("_score", 2).alias("name_similarity"), same_id.alias("id_number_exact_match"),
        status.alias("match_status"), F.when(F.col("_empty"), "needs_review").otherwise("ready").alias("status"))
