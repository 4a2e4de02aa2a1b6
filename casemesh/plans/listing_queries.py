"""Listings, filters, validation, sorts and diffs over the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions import text as X
from casemesh.operators import cases as C
from casemesh.operators import documents as D
from casemesh.operators import listing as L
from casemesh.plans.registry import query

AS_OF = "2024-07-01 00:00:00"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


CASE_COLUMNS = ("case_id, case_number, crime_type, court_level, investigation_status, bail_status, created_at")


@query("case_metadata", f"""
SELECT {CASE_COLUMNS} FROM m_cases
WHERE crime_type = 'theft' AND investigation_status = 'Trial'""")
def _(m):
    return L.case_metadata(m.m_cases, "theft", "Trial")


@query("case_metadata_page", f"""
SELECT {CASE_COLUMNS} FROM m_cases WHERE crime_type = 'Homicide'
ORDER BY created_at, case_id LIMIT 100 OFFSET 40""")
def _(m):
    return L.case_metadata(m.m_cases, "Homicide", limit=100, offset=40)


DOC_COLUMNS = ("doc_id, case_id, doc_type, version, doc_hash, status, chain_status, retention_legal_hold, "
               "uploaded_by, created_at")


@query("review_queue", f"SELECT {DOC_COLUMNS} FROM m_docs WHERE status = 'needs_review'")
def _(m):
    return L.review_queue(m.m_docs)


@query("review_queue_by_officer", f"""
SELECT a.io_user_id, {DOC_COLUMNS.replace("case_id", "d.case_id")} FROM m_docs d
JOIN (SELECT DISTINCT case_id, io_user_id FROM m_assign) a ON a.case_id = d.case_id
WHERE status = 'needs_review'""")
def _(m):
    return L.review_queues(m.m_docs, m.m_assign)


@query("review_queue_of_officer", f"""
SELECT {DOC_COLUMNS} FROM m_docs d WHERE status = 'needs_review' AND EXISTS (
  SELECT 1 FROM m_assign a WHERE a.case_id = d.case_id AND a.io_user_id = 616)""")
def _(m):
    return L.review_queue(m.m_docs, m.m_assign, user_id=616)


@query("review_queue_page", f"""
SELECT {DOC_COLUMNS} FROM m_docs WHERE status = 'needs_review' ORDER BY created_at, doc_id LIMIT 50 OFFSET 10""")
def _(m):
    return L.page(L.review_queue(m.m_docs), ["created_at", "doc_id"], 50, 10)


@query("case_documents", f"SELECT {DOC_COLUMNS} FROM m_docs")
def _(m):
    return L.case_documents(m.m_docs)


@query("visible_diary", """
SELECT 'court' AS reader, * FROM m_diary WHERE status = 'ready'
UNION ALL SELECT 'io' AS reader, * FROM m_diary""")
def _(m):
    court = L.visible_diary(m.m_diary, "court").withColumn("reader", F.lit("court"))
    io = L.visible_diary(m.m_diary, "io").withColumn("reader", F.lit("io"))
    return court.unionByName(io).unionByName(
        L.visible_diary(m.m_diary, "defense").withColumn("reader", F.lit("defense")))


@query("audit_page", """
SELECT * FROM m_audit WHERE action = 'redact_tag_correction' AND target_type = 'document'
ORDER BY seq DESC LIMIT 50 OFFSET 100""")
def _(m):
    return L.audit_page(m.m_audit, "redact_tag_correction", "document", 50, 100)


@query("audit_filtered", "SELECT * FROM m_audit WHERE action = 'fir_registered' AND target_type = 'case'")
def _(m):
    return L.audit_filter(m.m_audit, "fir_registered", "case")


@query("audit_page_after_seq", "SELECT * FROM m_audit WHERE seq < 900 ORDER BY seq DESC LIMIT 100")
def _(m):
    return L.page_after(m.m_audit, "seq", 900, 100)


@query("parser_audit", f"""
SELECT seq, case_id, CASE WHEN target_type = 'document' THEN target_id END AS document_id, action,
  CASE WHEN actor_user_id IS NULL THEN 'system' ELSE 'human' END AS actor_type, actor_user_id,
  json_extract_string(metadata, '$.entity_type') AS entity_type,
  CAST(json_extract_string(metadata, '$.confidence') AS BIGINT) AS confidence,
  CAST(json_extract_string(metadata, '$.span_start') AS BIGINT) AS span_start,
  CAST(json_extract_string(metadata, '$.span_end') AS BIGINT) AS span_end, created_at
FROM m_audit WHERE action IN ({quoted(K.PARSER_ACTIONS)})""")
def _(m):
    return L.parser_audit(m.m_audit)


@query("audit_metadata_fields", """
SELECT seq, json_extract_string(metadata, '$.entity_type') AS entity_type,
  CAST(json_extract_string(metadata, '$.confidence') AS BIGINT) AS confidence FROM m_audit""")
def _(m):
    return m.m_audit.select(
        "seq", F.get_json_object("metadata", "$.entity_type").alias("entity_type"),
        F.get_json_object("metadata", "$.confidence").cast("long").alias("confidence"))


@query("requisition_targets", f"""
SELECT * FROM m_orgs WHERE org_type IN ({quoted(K.REQUISITION_TARGETS)})""")
def _(m):
    return L.requisition_targets(m.m_orgs)


@query("applications_pending", "SELECT * FROM m_apps WHERE status = 'pending_review'")
def _(m):
    return L.applications(m.m_apps, "pending_review")


# Requests for an action by the users of the customer table, one per order.
ASKED = """SELECT o_orderkey AS request_id, u.role AS role, CASE o_orderpriority WHEN '1-URGENT' THEN 'legal_hold'
  WHEN '2-HIGH' THEN 'evidence_request' WHEN '3-MEDIUM' THEN 'bail_arrest' WHEN '5-LOW' THEN 'upload_document'
  ELSE 'judgment' END AS action FROM orders JOIN m_users u ON u.user_id = o_custkey"""
MATRIX_SQL = "(VALUES " + ", ".join(
    f"('{a}', '{r}')" for a, roles in K.ACTION_ROLES.items() for r in roles) + ") AS x(action, role)"


def _asked(m):
    action = (F.when(F.col("o_orderpriority") == "1-URGENT", "legal_hold")
              .when(F.col("o_orderpriority") == "2-HIGH", "evidence_request")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "bail_arrest")
              .when(F.col("o_orderpriority") == "5-LOW", "upload_document").otherwise("judgment"))
    orders = m.table("orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"),
                                      action.alias("action"))
    return orders.join(m.m_users.select("user_id", "role"), "user_id").select("request_id", "role", "action")


@query("actions_permitted", f"""
WITH asked AS ({ASKED}) SELECT * FROM asked a WHERE EXISTS (
  SELECT 1 FROM {MATRIX_SQL} WHERE x.action = a.action AND x.role = a.role)""")
def _(m):
    return L.permitted(_asked(m), L.role_matrix(m.spark))


@query("actions_refused", f"""
WITH asked AS ({ASKED}) SELECT * FROM asked a WHERE NOT EXISTS (
  SELECT 1 FROM {MATRIX_SQL} WHERE x.action = a.action AND x.role = a.role)""")
def _(m):
    return L.not_permitted(_asked(m), L.role_matrix(m.spark))


@query("search_cases", """
SELECT * FROM m_cases WHERE contains(lower(case_number), 'sess') OR contains(lower(crime_type), 'sess')
  OR contains(lower(coalesce(court_level, '')), 'sess')""")
def _(m):
    return L.search(m.m_cases, ["case_number", "crime_type", "court_level"], " SESS ")


@query("search_worklist", """
SELECT * FROM m_cases WHERE contains(lower(concat(case_number, ' ', crime_type, ' ', investigation_status)),
  'accident trial')""")
def _(m):
    return L.search_joined(m.m_cases, ["case_number", "crime_type", "investigation_status"], "Accident Trial")


@query("cases_on_day", "SELECT * FROM m_cases WHERE CAST(created_at AS DATE) = DATE '1997-05-28'")
def _(m):
    return L.on_day(m.m_cases, "1997-05-28")


@query("trial_eligible", f"SELECT * FROM m_cases WHERE investigation_status IN ({quoted(K.TRIAL_STAGES)})")
def _(m):
    return L.trial_eligible(m.m_cases)


@query("pending_requests", "SELECT * FROM m_requests WHERE status <> 'completed'")
def _(m):
    return L.pending_requests(m.m_requests, "newest")


@query("key_status", f"""
SELECT k.*, u.role AS role, u.org_id AS org_id,
  CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN expires_at < TIMESTAMP '{AS_OF}' THEN 'expired'
    WHEN u.user_id IS NULL THEN 'ownerless' ELSE 'active' END AS state,
  (revoked_at IS NULL AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{AS_OF}') AND u.user_id IS NOT NULL)
    AS accepted
FROM m_keys k LEFT JOIN m_users u ON u.user_id = k.user_id""")
def _(m):
    return L.key_status(m.m_keys, m.m_users, AS_OF)


@query("purge_plan", f"""
SELECT {DOC_COLUMNS}, CASE WHEN retention_legal_hold THEN 'blocked' ELSE 'purge' END AS verdict FROM m_docs
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(m):
    return L.purge_plan(m.m_docs, m.labels.filter("toxic = 1").select("doc_id"))


@query("purge_tags_left", """
SELECT * FROM m_tags t WHERE NOT EXISTS (SELECT 1 FROM m_docs d JOIN labels l USING (doc_id)
  WHERE l.toxic = 1 AND NOT d.retention_legal_hold AND d.doc_id = t.doc_id)""")
def _(m):
    return L.purge_tags(m.m_tags, L.purge_plan(m.m_docs, m.labels.filter("toxic = 1").select("doc_id")))


@query("ledger_retry_candidates", """
SELECT doc_id, case_id, chain_status, concat(doc_id, ':v', version) AS idempotency_key
FROM m_docs WHERE chain_status <> 'confirmed'""")
def _(m):
    return L.retry_candidates(m.m_docs)


@query("stuck_documents", f"""
SELECT {DOC_COLUMNS} FROM m_docs WHERE status = 'processing'
  AND created_at < TIMESTAMP '2024-01-04 00:00:00' - INTERVAL '10' MINUTE""")
def _(m):
    return L.stuck(m.m_docs, "2024-01-04 00:00:00")


@query("rule_rows_refused", """
WITH rules AS (SELECT p_partkey AS rule_id, CASE WHEN p_size < 3 THEN ' ' ELSE p_brand END AS role,
    p_type AS doc_type, p_name AS entity_type,
    CASE WHEN p_type = 'PROMO' THEN 'hide' WHEN p_type = 'SMALL' THEN 'flag' ELSE 'mask' END AS action,
    p_size * 3 - 20 AS min_confidence FROM part)
SELECT *, CASE WHEN trim(role) = '' THEN 'empty_key' WHEN action NOT IN ('mask', 'show', 'flag') THEN 'bad_action'
  WHEN min_confidence NOT BETWEEN 0 AND 100 THEN 'bad_min_confidence' END AS reason FROM rules""")
def _(m):
    rules = m.part.selectExpr(
        "p_partkey AS rule_id", "CASE WHEN p_size < 3 THEN ' ' ELSE p_brand END AS role", "p_type AS doc_type",
        "p_name AS entity_type",
        "CASE WHEN p_type = 'PROMO' THEN 'hide' WHEN p_type = 'SMALL' THEN 'flag' ELSE 'mask' END AS action",
        "p_size * 3 - 20 AS min_confidence")
    return L.validate_policies(rules)


SCHEMA_ROWS = """SELECT p_partkey AS schema_id, CASE WHEN p_size = 1 THEN '' ELSE p_name END AS doc_type,
  p_size % 5 AS tier, CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN '[]'
    ELSE concat('[{"field_name":"', p_brand, '","sensitivity":"high"}]') END AS sensitivity_fields FROM part"""


@query("document_schemas_refused", f"""
WITH s AS ({SCHEMA_ROWS})
SELECT *, CASE WHEN trim(doc_type) = '' THEN 'empty_doc_type' WHEN tier NOT IN (1, 2, 3) THEN 'bad_tier'
  WHEN tier = 3 AND sensitivity_fields IS NOT NULL THEN 'tier3_has_fields'
  WHEN tier <> 3 AND (sensitivity_fields IS NULL OR sensitivity_fields = '[]') THEN 'fields_missing' END AS reason
FROM s""")
def _(m):
    part = m.part
    rows = part.selectExpr(
        "p_partkey AS schema_id", "CASE WHEN p_size = 1 THEN '' ELSE p_name END AS doc_type", "p_size % 5 AS tier",
        "CASE p_type WHEN 'PROMO' THEN NULL WHEN 'SMALL' THEN '[]' "
        "ELSE concat('[{\"field_name\":\"', p_brand, '\",\"sensitivity\":\"high\"}]') END AS sensitivity_fields")
    return L.validate_doc_schemas(rows)


@query("rules_ordered", "SELECT * FROM m_stage_requirements")
def _(m):
    return L.ordered_rules(m.m_stage_requirements, "crime_type", "requirement_type", "requirement_key")


@query("top_tag_per_document", """
SELECT doc_id, arg_max(entity_type, k) AS entity_type, arg_max(span_start, k) AS span_start,
  arg_max(span_end, k) AS span_end FROM (SELECT *, (CAST(coalesce(confidence, 0) AS BIGINT) * 1000000 + (span_end - span_start)) * 10000000
    + span_start AS k FROM m_tags) GROUP BY doc_id""")
def _(m):
    tags = m.m_tags
    score = [F.coalesce("confidence", F.lit(0)), F.col("span_end") - F.col("span_start"), F.col("span_start")]
    return L.top_by(tags, ["doc_id"], score).select("doc_id", "entity_type", "span_start", "span_end")


# Two versions of a rule set, both taken from the part table.
OLD_RULES = """SELECT p_brand AS role, p_type AS doc_type, p_name AS entity_type,
  CASE WHEN max(p_size) > 30 THEN 'mask' ELSE 'show' END AS action FROM part
  WHERE p_size > 10 GROUP BY 1, 2, 3"""
NEW_RULES = """SELECT p_brand AS role, p_type AS doc_type, p_name AS entity_type,
  CASE WHEN min(p_size) > 20 THEN 'flag' WHEN min(p_size) > 5 THEN 'show' ELSE 'mask' END AS action FROM part
  WHERE p_size < 40 GROUP BY 1, 2, 3"""


def _rules(m):
    part = m.part.selectExpr("p_brand AS role", "p_type AS doc_type", "p_name AS entity_type", "p_size")
    keys = ["role", "doc_type", "entity_type"]
    old = part.filter("p_size > 10").groupBy(*keys).agg(
        F.when(F.max("p_size") > 30, "mask").otherwise("show").alias("action"))
    new = part.filter("p_size < 40").groupBy(*keys).agg(
        F.when(F.min("p_size") > 20, "flag").when(F.min("p_size") > 5, "show").otherwise("mask").alias("action"))
    return old, new


@query("policy_widening", f"""
WITH o AS ({OLD_RULES}), n AS ({NEW_RULES})
SELECT n.role, n.doc_type, n.entity_type, coalesce(o.action, 'mask') AS old_action, n.action AS new_action
FROM n LEFT JOIN o ON o.role = n.role AND o.doc_type = n.doc_type AND o.entity_type = n.entity_type
WHERE coalesce(o.action, 'mask') = 'mask' AND n.action <> 'mask'""")
def _(m):
    return C.policy_widening(*_rules(m))


@query("rule_set_diff", f"""
WITH o AS ({OLD_RULES}), n AS ({NEW_RULES})
SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)
UNION ALL SELECT *, 'removed' AS change FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""")
def _(m):
    return C.set_diff(*_rules(m))


@query("cases_of_any_party", """
SELECT DISTINCT c.case_id, c.case_number FROM m_cases c JOIN m_parties p ON p.case_id = c.case_id""")
def _(m):
    return m.m_cases.join(m.m_parties.select("case_id"), "case_id", "left_semi").select("case_id", "case_number")


@query("case_prefixes", """
SELECT case_id, CASE WHEN regexp_replace(upper(crime_type), '[^A-Z]', '', 'g') = '' THEN 'CAS'
  ELSE substring(regexp_replace(upper(crime_type), '[^A-Z]', '', 'g'), 1, 3) END AS prefix FROM m_cases""")
def _(m):
    return m.m_cases.select("case_id", X.case_prefix(F.col("crime_type")).alias("prefix"))


@query("case_tokens", "SELECT case_number, sha256(CAST(case_id AS VARCHAR)) AS case_token FROM m_cases")
def _(m):
    return m.m_cases.select("case_number", X.case_token(F.col("case_id")).alias("case_token"))


@query("age_labels", f"""
WITH h AS (SELECT doc_id, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(created_at))
    / 3600000000.0 + 0.5) AS BIGINT)) AS hrs FROM m_docs),
  d AS (SELECT *, hrs // 24 AS days FROM h)
SELECT doc_id, CASE WHEN hrs < 24 THEN concat(hrs, ' hr', CASE WHEN hrs = 1 THEN '' ELSE 's' END)
  WHEN days < 31 THEN concat(days, ' day', CASE WHEN days = 1 THEN '' ELSE 's' END)
  WHEN days % 30 > 0 THEN concat(days // 30, ' mo ', days % 30, 'd')
  ELSE concat(days // 30, ' month', CASE WHEN days // 30 = 1 THEN '' ELSE 's' END) END AS label FROM d""")
def _(m):
    return m.m_docs.select("doc_id", X.age_label(
        F.col("created_at"), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).alias("label"))


# The compared SQL's upper() keeps a sharp s, which upper-cases to SS.
@query("compare_normalised", """
SELECT doc_id, sha256(regexp_replace(upper(replace(regexp_replace(text, '^[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+$',
  '', 'g'), 'ß', 'SS')), '[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+', ' ', 'g')) AS norm_hash FROM documents""")
def _(m):
    return m.documents.select("doc_id", F.sha2(X.norm(F.col("text")), 256).alias("norm_hash"))


@query("object_keys", """
SELECT doc_id, concat(uploaded_by, '/', case_id, '/', doc_id, '/v', version) AS object_key FROM m_docs""")
def _(m):
    from casemesh.sources.tables import object_key
    return m.m_docs.select("doc_id", object_key("uploaded_by", "case_id", "doc_id", "version").alias("object_key"))


@query("content_fingerprints", "SELECT doc_id, sha256(text) AS doc_hash FROM documents")
def _(m):
    return m.documents.select("doc_id", D.fingerprint(F.col("text")).alias("doc_hash"))


@query("applications_upserted", """
SELECT application_id, email, claimed_role FROM m_apps WHERE status = 'approved'
UNION ALL SELECT min(application_id), email, min(claimed_role) FROM m_apps a WHERE status <> 'approved'
  AND NOT EXISTS (SELECT 1 FROM m_apps b WHERE b.status = 'approved' AND b.email = a.email) GROUP BY email""")
def _(m):
    from casemesh.sources.tables import insert_missing
    apps = m.m_apps.select("application_id", "email", "claimed_role", "status")
    old = apps.filter("status = 'approved'").drop("status")
    return insert_missing(old, apps.filter("status <> 'approved'").drop("status"), ["email"])


@query("registry_load", "SELECT * FROM m_cases")
def _(m):
    return m.m_cases
