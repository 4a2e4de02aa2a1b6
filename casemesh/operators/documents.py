"""Documents: fingerprints, duplicates, versions, ledger comparison, routing, field mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators.sequence import number_rows

KEY = ["case_id", "doc_type", "doc_hash"]


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_uploads(new: DataFrame, docs: DataFrame) -> DataFrame:
    """Each upload with the document that already holds its content, or holds it within the batch.

    ``result_doc_id`` is the stored document, else the first upload of the batch with the same content;
    ``is_new`` marks the uploads to insert. The first one per content is found by a partial minimum.
    """
    stored = docs.groupBy(*KEY).agg(F.min("doc_id").alias("_stored"))
    first = new.groupBy(*KEY).agg(F.min("doc_id").alias("_first")).join(stored, KEY, "left")
    chosen = first.select(*KEY, F.coalesce("_stored", "_first").alias("result_doc_id"),
                          F.col("_stored").isNull().alias("_fresh"))
    return new.join(chosen, KEY).withColumn(
        "is_new", F.col("_fresh") & (F.col("result_doc_id") == F.col("doc_id"))).drop("_fresh")


def assign_versions(new: DataFrame, docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Next version numbers per (case, document type), in arrival order after the stored ones."""
    keys = ["case_id", "doc_type"]
    latest = docs.groupBy(*keys).agg(F.max("version").alias("_latest"))
    numbered = number_rows(new.drop("version"), order, keys, "_n").join(latest, keys, "left")
    return numbered.withColumn(
        "version", (F.coalesce("_latest", F.lit(0)) + F.col("_n")).cast("int")).drop("_n", "_latest")


def versions(docs: DataFrame) -> DataFrame:
    """Version history with the latest version of each (case, document type) marked."""
    keys = ["case_id", "doc_type"]
    latest = docs.groupBy(*keys).agg(F.max("version").alias("latest_version"))
    return docs.join(latest, keys).withColumn("is_latest", F.col("version") == F.col("latest_version"))


def retag_candidates(entries: DataFrame, tags: DataFrame, key: str = "entry_id") -> DataFrame:
    """Ready entries without any automatic span, put back to ``processing``."""
    have = tags.filter(F.col("source") == "ai_parser").select(key).distinct()
    return entries.filter(F.col("status") == "ready").join(have, key, "left_anti").withColumn(
        "status", F.lit("processing"))


def verify_hashes(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Recomputed document hash against the ledger: missing, ok or tampered."""
    joined = docs.select("doc_id", "doc_hash").join(ledger, "doc_id", "left")
    verdict = (F.when(F.col("ledger_hash").isNull(), "missing")
               .when(F.col("ledger_hash") == F.col("doc_hash"), "ok").otherwise("tampered"))
    return joined.withColumn("verdict", verdict)


def reconcile(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Both sides compared: what each lacks, what differs, and confirmations that do not match the ledger."""
    joined = docs.select("doc_id", "doc_hash", "chain_status").join(ledger, "doc_id", "full_outer")
    confirmed = F.col("chain_status") == "confirmed"
    state = (
        F.when(F.col("doc_hash").isNull(), "ledger_only")
        .when(F.col("ledger_hash").isNull() & confirmed, "confirmed_but_absent")
        .when(F.col("ledger_hash").isNull(), "not_written")
        .when(F.col("ledger_hash") != F.col("doc_hash"), "hash_differs")
        .when(~confirmed, "written_but_unconfirmed").otherwise("match"))
    return joined.select("doc_id", state.alias("state"))


def ledger_batch(submissions: DataFrame, ledger: DataFrame, order: str = "seq") -> DataFrame:
    """Write-once outcome of every submission ``(doc_id, doc_hash, seq)``: recorded, noop or conflict.

    The first submission of a document without a record wins; later ones are compared with it.
    """
    first = submissions.groupBy("doc_id").agg(
        F.min_by("doc_hash", order).alias("_hash"), F.min(order).alias("_seq"))
    held = first.join(ledger.select("doc_id", "ledger_hash"), "doc_id", "left").select(
        "doc_id", F.coalesce("ledger_hash", "_hash").alias("_holds"),
        F.when(F.col("ledger_hash").isNull(), F.col("_seq")).alias("_recorded_at"))
    joined = submissions.join(held, "doc_id")
    outcome = (
        F.when(F.coalesce(F.col("_recorded_at") == F.col(order), F.lit(False)), "recorded")
        .when(F.col("doc_hash") == F.col("_holds"), "noop").otherwise("conflict"))
    return joined.withColumn("outcome", outcome).drop("_holds", "_recorded_at")


def orphan_mappings(mappings: DataFrame, schemas: DataFrame) -> DataFrame:
    """Recognizer mappings whose field the document schema does not list."""
    fields = F.from_json("sensitivity_fields", "array<struct<field_name:string,sensitivity:string>>")
    listed = schemas.select("doc_type", F.explode(fields["field_name"]).alias("field_name"))
    return mappings.join(listed, ["doc_type", "field_name"], "left_anti")


def map_fields(tags: DataFrame, docs: DataFrame, mappings: DataFrame, schemas: DataFrame) -> DataFrame:
    """Schema field and sensitivity of every span, by the document's type; unmapped spans keep nulls."""
    fields = F.explode(F.from_json("sensitivity_fields", "array<struct<field_name:string,sensitivity:string>>"))
    listed = schemas.select("doc_type", fields.alias("_f")).select("doc_type", "_f.field_name", "_f.sensitivity")
    rules = mappings.join(listed, ["doc_type", "field_name"]).select(
        "doc_type", "entity_type", "field_name", "sensitivity")
    typed = tags.join(docs.select("doc_id", "doc_type"), "doc_id")
    return typed.join(rules, ["doc_type", "entity_type"], "left")


def conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is taken."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_semi")


def accepted(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key is free."""
    return new.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def route(mime: Column) -> Column:
    """Where an upload goes next: typed text to tagging, scans to text recognition, media straight to ready."""
    return (F.when(mime.isin(*K.TYPED_TEXT_TYPES), "tagging").when(mime.isin(*K.MEDIA_TYPES), "ready")
            .when(mime.isin(*K.TEXT_BEARING_TYPES), "text_recognition").otherwise("reject"))
