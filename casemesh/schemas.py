"""Explicit schemas of the model tables; timestamps are UTC, ids are strings or longs."""

from __future__ import annotations

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("entity_type", T.StringType()),
    T.StructField("span_start", T.IntegerType()),
    T.StructField("span_end", T.IntegerType()),
    T.StructField("confidence", T.IntegerType()),
])

BOX = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("box", T.ArrayType(T.IntegerType())),
    T.StructField("lang", T.StringType()),
])


def _table(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


ID = "STRING"


def model_schemas(id_type: str = ID) -> dict[str, T.StructType]:
    """Schema per table; ``id_type`` is STRING for UUID keys or BIGINT for numbered ones."""
    i = id_type
    return {
        "permissions": _table("code STRING, category STRING, description STRING"),
        "roles": _table(f"role_id {i}, code STRING, name STRING, is_system BOOLEAN"),
        "role_permissions": _table(f"role_id {i}, code STRING"),
        "organizations": _table(f"org_id {i}, name STRING, org_type STRING, created_at TIMESTAMP"),
        "users": _table(
            f"user_id {i}, org_id {i}, role STRING, role_id {i}, service_id STRING, "
            "designation STRING, name STRING, email STRING"),
        "api_keys": _table(
            f"key_id {i}, user_id {i}, name STRING, key_prefix STRING, key_hash STRING, "
            "created_at TIMESTAMP, last_used_at TIMESTAMP, expires_at TIMESTAMP, revoked_at TIMESTAMP"),
        "cases": _table(
            f"case_id {i}, case_number STRING, crime_type STRING, court_level STRING, "
            "investigation_status STRING, bail_status STRING, "
            f"org_id {i}, registered_by_user_id {i}, created_at TIMESTAMP"),
        "case_assignments": _table(f"case_id {i}, io_user_id {i}, assigned_at TIMESTAMP"),
        "case_parties": _table(
            f"case_id {i}, user_id {i}, party_role STRING, recorded_by_user_id {i}, created_at TIMESTAMP"),
        "documents": _table(
            f"doc_id {i}, case_id {i}, doc_type STRING, version INT, storage_path STRING, raw_text STRING, "
            "doc_hash STRING, status STRING, chain_status STRING, retention_legal_hold BOOLEAN, "
            f"uploaded_by {i}, created_at TIMESTAMP"),
        "document_sensitivity_tags": _table(
            f"doc_id {i}, entity_type STRING, span_start INT, span_end INT, confidence INT, source STRING"),
        "redaction_policies": _table(
            "role STRING, doc_type STRING, entity_type STRING, action STRING, min_confidence INT"),
        "evidence_requests": _table(
            f"request_id {i}, case_id {i}, requested_org_id {i}, doc_type_expected STRING, notes STRING, "
            f"requested_by_user_id {i}, status STRING, created_at TIMESTAMP, completed_at TIMESTAMP"),
        "bail_records": _table(f"record_id {i}, case_id {i}, stage STRING, created_at TIMESTAMP"),
        "case_diary_entries": _table(
            f"entry_id {i}, case_id {i}, author_user_id {i}, text STRING, status STRING, created_at TIMESTAMP"),
        "case_diary_sensitivity_tags": _table(
            f"entry_id {i}, entity_type STRING, span_start INT, span_end INT, confidence INT, source STRING"),
        "document_schemas": _table("doc_type STRING, tier INT, sensitivity_fields STRING"),
        "recognizer_mappings": _table("doc_type STRING, entity_type STRING, field_name STRING"),
        "stage_requirements": _table(
            "crime_type STRING, requirement_type STRING, requirement_key STRING, mandatory BOOLEAN"),
        "audit_log": _table(
            f"seq BIGINT, case_id {i}, actor_user_id {i}, action STRING, target_type STRING, target_id {i}, "
            "metadata STRING, prev_hash STRING, row_hash STRING, created_at TIMESTAMP"),
        "user_applications": _table(
            f"application_id {i}, name STRING, email STRING, claimed_role STRING, org_id {i}, "
            "designation STRING, claimed_credential_id STRING, status STRING, created_at TIMESTAMP"),
        "credential_documents": _table(
            f"credential_id {i}, application_id {i}, doc_type STRING, raw_text STRING, doc_hash STRING, "
            "status STRING, match_status STRING, created_at TIMESTAMP"),
        "ocr_boxes": T.StructType(
            [T.StructField("doc_id", T.StringType()), T.StructField("page", T.IntegerType())] + list(BOX.fields)),
    }
