"""Bulk lifecycle jobs fed with requests taken from the events, documents and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators import lifecycle as L
from casemesh.plans.access_queries import MATRIX, _matrix
from casemesh.plans.listing_queries import quoted
from casemesh.plans.registry import query

COMPLAINTS = ("SELECT doc_id AS case_id, doc_id + 1000000 AS doc_id, CASE lang WHEN 'en' THEN 'Theft' WHEN 'fr' THEN "
              "'4 wheeler theft' ELSE '' END AS crime_type, text, n_chars % 1700 AS user_id, "
              "TIMESTAMP '2024-05-01 08:00:00' AS filed_at FROM documents")


def _complaints(m):
    return m.documents.selectExpr(
        "doc_id AS case_id", "doc_id + 1000000 AS doc_id",
        "CASE lang WHEN 'en' THEN 'Theft' WHEN 'fr' THEN '4 wheeler theft' ELSE '' END AS crime_type", "text",
        "n_chars % 1700 AS user_id", "TIMESTAMP '2024-05-01 08:00:00' AS filed_at")


@query("intake_documents", f"""
WITH c AS ({COMPLAINTS})
SELECT doc_id, case_id, 'FIR' AS doc_type, 1 AS version, concat(coalesce(u.org_id, case_id), '/', case_id, '/', doc_id, '/v1')
  AS storage_path, text AS raw_text, sha256(text) AS doc_hash, 'processing' AS status, 'pending' AS chain_status,
  c.user_id AS uploaded_by, filed_at AS created_at
FROM c JOIN m_users u ON u.user_id = c.user_id AND u.role = 'duty_officer'""")
def _(m):
    return L.intake(_complaints(m), m.m_users).rows


@query("intake_cases", f"""
WITH c AS ({COMPLAINTS})
SELECT case_id, concat(CASE WHEN crime_type = 'Theft' THEN 'THE' WHEN crime_type = '' THEN 'CAS' ELSE 'WHE' END, '-2024-',
  repeat('0', greatest(0, 6 - length(CAST(case_id AS VARCHAR)))) || CAST(case_id AS VARCHAR)) AS case_number, crime_type, 'FIR_Registered' AS investigation_status, u.org_id,
  c.user_id AS registered_by_user_id, filed_at AS created_at
FROM c JOIN m_users u ON u.user_id = c.user_id AND u.role = 'duty_officer'""")
def _(m):
    return L.intake_cases(L.intake(_complaints(m), m.m_users))


ASSIGN = ("SELECT event_id AS seq, (event_id * 7) % 1600 AS case_id, user_id * 11 AS io_user_id, ts AS requested_at "
          "FROM events")


def _assign(m):
    asked = m.events.selectExpr("event_id AS seq", "(event_id * 7) % 1600 AS case_id", "user_id * 11 AS io_user_id",
                                "ts AS requested_at")
    return L.assign(asked, m.m_cases, m.m_users, m.m_assign)


@query("officers_assigned", f"""
WITH r AS ({ASSIGN})
SELECT r.*, CASE WHEN c.case_id IS NULL THEN 'case_not_found' WHEN u.user_id IS NULL THEN 'user_not_found'
  WHEN u.role NOT IN ({quoted(K.ASSIGNMENT_ROLES)}) THEN 'role_not_assignable'
  WHEN EXISTS (SELECT 1 FROM m_assign a WHERE a.case_id = r.case_id AND a.io_user_id = r.io_user_id)
    OR row_number() OVER (PARTITION BY r.case_id, r.io_user_id ORDER BY seq) > 1 THEN 'already_assigned' END AS reason
FROM r LEFT JOIN m_cases c ON c.case_id = r.case_id LEFT JOIN m_users u ON u.user_id = r.io_user_id""")
def _(m):
    return _assign(m).decided


REASSIGN = f"""r AS (SELECT event_id AS seq, event_id % 700 AS case_id, (user_id % 20) * 7 AS new_io_user_id,
    ts AS requested_at FROM events),
 held AS (SELECT case_id, min(io_user_id) AS held FROM m_assign GROUP BY case_id),
 st AS (SELECT r.*, held.held, CASE WHEN c.case_id IS NULL THEN 'case_not_found'
    WHEN c.investigation_status IN ({quoted(K.CONCLUDED_STAGES)}) THEN 'case_concluded'
    WHEN u.user_id IS NULL THEN 'user_not_found' WHEN u.role <> 'io' THEN 'not_an_io'
    WHEN held.held IS NULL THEN 'no_current_assignment' END AS static
  FROM r LEFT JOIN m_cases c ON c.case_id = r.case_id LEFT JOIN m_users u ON u.user_id = r.new_io_user_id
  LEFT JOIN held ON held.case_id = r.case_id),
 sw AS (SELECT *, coalesce(lag(new_io_user_id) OVER (PARTITION BY case_id ORDER BY seq), held) AS prev FROM st
   WHERE static IS NULL),
 decided AS (SELECT seq, case_id, new_io_user_id, requested_at, prev AS previous_io_user_id,
    CASE WHEN prev = new_io_user_id THEN 'same_officer' END AS reason FROM sw
  UNION ALL SELECT seq, case_id, new_io_user_id, requested_at, held, static FROM st WHERE static IS NOT NULL)"""


def _reassign(m):
    asked = m.events.selectExpr("event_id AS seq", "event_id % 700 AS case_id", "(user_id % 20) * 7 AS new_io_user_id",
                                "ts AS requested_at")
    return L.reassign(asked, m.m_cases, m.m_users, m.m_assign)


@query("officers_reassigned", f"WITH {REASSIGN} SELECT * FROM decided")
def _(m):
    return _reassign(m).decided


@query("assignments_after_reassigning", f"""
WITH {REASSIGN}, n AS (SELECT case_id, arg_max(new_io_user_id, seq) AS io_user_id, max(requested_at) AS assigned_at
  FROM decided WHERE reason IS NULL GROUP BY case_id)
SELECT case_id, io_user_id, assigned_at FROM m_assign WHERE case_id NOT IN (SELECT case_id FROM n)
UNION ALL SELECT * FROM n""")
def _(m):
    return _reassign(m).rows


PARTY = """r AS (SELECT event_id AS seq, event_id % 16000 AS case_id,
    CASE WHEN event_type = 'view' THEN NULL ELSE user_id + 3 - user_id % 14 END AS user_id,
    CASE WHEN event_type = 'view' THEN concat('  Customer#', lpad(CAST(user_id AS VARCHAR), 9, '0'), '@Records.example ') END AS email,
    CASE WHEN event_type IN ('click', 'view') THEN 'defense' ELSE 'surety' END AS party_role,
    user_id AS recorded_by_user_id, ts AS recorded_at FROM events WHERE event_type <> 'error'),
 d AS (SELECT r.*, coalesce(u.user_id, v.user_id) AS party_user_id, CASE WHEN c.case_id IS NULL THEN 'case_not_found'
    WHEN coalesce(u.user_id, v.user_id) IS NULL THEN 'user_not_found'
    WHEN party_role = 'defense' AND coalesce(u.role, v.role) <> 'defense' THEN 'not_a_defense_account' END AS reason
  FROM r LEFT JOIN m_cases c ON c.case_id = r.case_id LEFT JOIN m_users u ON u.user_id = r.user_id
  LEFT JOIN m_users v ON r.user_id IS NULL AND lower(v.email) = lower(trim(r.email)))"""


def _party(m):
    mail = F.concat(F.lit("  Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@Records.example "))
    view = F.col("event_type") == "view"
    asked = m.events.filter("event_type <> 'error'").select(
        F.col("event_id").alias("seq"), (F.col("event_id") % 16000).alias("case_id"),
        F.when(~view, F.col("user_id") + 3 - F.col("user_id") % 14).alias("user_id"), F.when(view, mail).alias("email"),
        F.when(F.col("event_type").isin("click", "view"), "defense").otherwise("surety").alias("party_role"),
        F.col("user_id").alias("recorded_by_user_id"), F.col("ts").alias("recorded_at"))
    return L.record_parties(asked, m.m_cases, m.m_users, m.m_parties)


@query("parties_decided", f"WITH {PARTY} SELECT * FROM d")
def _(m):
    return _party(m).decided


@query("parties_recorded", f"""
WITH {PARTY} SELECT case_id, party_user_id AS user_id, party_role, arg_min(recorded_by_user_id, seq) AS recorded_by_user_id,
  arg_min(recorded_at, seq) AS created_at FROM d WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM m_parties p
    WHERE p.case_id = d.case_id AND p.user_id = d.party_user_id AND p.party_role = d.party_role)
GROUP BY case_id, party_user_id, d.party_role""")
def _(m):
    return _party(m).rows


@query("requisitions_created", f"""
WITH r AS (SELECT event_id AS request_id, event_id % 17000 AS case_id, user_id AS requested_org_id, event_type
  AS doc_type_expected, user_id AS requested_by_user_id, ts AS created_at FROM events)
SELECT r.*, CASE WHEN c.case_id IS NULL THEN 'case_not_found' WHEN o.org_id IS NULL THEN 'organization_not_found'
  WHEN o.org_type NOT IN ({quoted(K.REQUISITION_TARGETS)}) THEN 'not_a_requisition_target' END AS reason
FROM r LEFT JOIN m_cases c ON c.case_id = r.case_id LEFT JOIN m_orgs o ON o.org_id = r.requested_org_id""")
def _(m):
    asked = m.events.selectExpr(
        "event_id AS request_id", "event_id % 17000 AS case_id", "user_id AS requested_org_id",
        "event_type AS doc_type_expected", "user_id AS requested_by_user_id", "ts AS created_at")
    return L.create_requests(asked, m.m_cases, m.m_orgs).decided


# One open request per order; answers come from the events.
FULFIL = """rq AS (SELECT o_orderkey AS request_id, o_orderkey % 300 AS case_id, o_custkey % 25 AS requested_org_id,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'FSL Report' END AS doc_type_expected,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'requested' END AS status FROM orders),
 sb AS (SELECT event_id AS seq, event_id + 5000000 AS doc_id, event_id % 400 AS request_id, user_id * 4 AS user_id,
    props AS text, ts AS submitted_at FROM events),
 st AS (SELECT sb.*, rq.case_id, rq.requested_org_id, coalesce(rq.doc_type_expected, 'Evidence') AS doc_type,
    CASE WHEN rq.request_id IS NULL THEN 'request_not_found'
      WHEN u.role IN ('config_admin', 'security_auditor') OR (u.role = 'external_authority'
        AND u.org_id = rq.requested_org_id) THEN CASE WHEN rq.status = 'completed' THEN 'already_fulfilled' END
      WHEN u.role = 'external_authority' THEN 'different_organization' ELSE 'role_not_permitted' END AS static
  FROM sb LEFT JOIN rq ON rq.request_id = sb.request_id LEFT JOIN m_users u ON u.user_id = sb.user_id),
 decided AS (SELECT seq, doc_id, request_id, user_id, text, submitted_at, case_id, requested_org_id, doc_type,
    coalesce(static, CASE WHEN seq > min(seq) FILTER (static IS NULL) OVER (PARTITION BY request_id)
      THEN 'already_fulfilled' END) AS reason FROM st)"""


def _fulfil(m):
    requests = m.orders.selectExpr(
        "o_orderkey AS request_id", "o_orderkey % 300 AS case_id", "o_custkey % 25 AS requested_org_id",
        "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'FSL Report' END AS doc_type_expected",
        "CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'requested' END AS status")
    answers = m.events.selectExpr("event_id AS seq", "event_id + 5000000 AS doc_id", "event_id % 400 AS request_id",
                                  "user_id * 4 AS user_id", "props AS text", "ts AS submitted_at")
    return L.fulfil(answers, requests, m.m_users, m.m_docs)


@query("requisitions_fulfilled", f"WITH {FULFIL} SELECT * FROM decided")
def _(m):
    return _fulfil(m).decided


@query("requisition_documents", f"""
WITH {FULFIL}, v AS (SELECT case_id, doc_type, max(version) AS latest FROM m_docs GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY case_id, doc_type ORDER BY seq) AS rn FROM decided WHERE reason IS NULL)
SELECT doc_id, n.case_id, n.doc_type, CAST(coalesce(latest, 0) + rn AS INT) AS version, concat(requested_org_id, '/', n.case_id,
  '/', doc_id, '/v', coalesce(latest, 0) + rn) AS storage_path, text AS raw_text, sha256(text) AS doc_hash,
  'processing' AS status, 'pending' AS chain_status, user_id AS uploaded_by, submitted_at AS created_at
FROM n LEFT JOIN v ON v.case_id = n.case_id AND v.doc_type = n.doc_type""")
def _(m):
    return _fulfil(m).rows


CORRECT = """SELECT event_id % 1200 AS doc_id, 'PERSON' AS entity_type, CAST(event_id % 90 AS INT) AS span_start,
  CAST(event_id % 90 + 6 AS INT) AS span_end, user_id * 14 AS user_id, ts AS corrected_at FROM events"""


def _correct(m):
    asked = m.events.selectExpr(
        "event_id % 1200 AS doc_id", "'PERSON' AS entity_type", "CAST(event_id % 90 AS INT) AS span_start",
        "CAST(event_id % 90 + 6 AS INT) AS span_end", "user_id * 14 AS user_id", "ts AS corrected_at")
    return L.correct_tags(asked, m.m_docs, m.m_tags, _matrix(m))


@query("tag_corrections", f"""
WITH {MATRIX}, r AS ({CORRECT})
SELECT r.*, d.case_id, CASE WHEN d.doc_id IS NULL THEN 'document_not_found' WHEN NOT EXISTS (SELECT 1 FROM matrix x
    WHERE x."grant" = 'assigned' AND x.case_id = d.case_id AND x.user_id = r.user_id) THEN 'not_assigned' END AS reason
FROM r LEFT JOIN m_docs d ON d.doc_id = r.doc_id""")
def _(m):
    return _correct(m).decided


RELEASE = f"""r AS (SELECT event_id AS seq, event_id % 1100 AS doc_id, u.role AS role, e.user_id AS user_id, ts AS released_at
    FROM events e JOIN m_users u ON u.user_id = e.user_id),
 st AS (SELECT r.*, d.case_id, CASE WHEN r.role NOT IN ({quoted(K.RELEASE_ROLES)}) THEN 'role_not_permitted'
    WHEN d.doc_id IS NULL THEN 'document_not_found' WHEN d.status <> 'needs_review' THEN 'not_in_review'
    WHEN d.raw_text = '' THEN 'no_text' END AS static FROM r LEFT JOIN m_docs d ON d.doc_id = r.doc_id),
 decided AS (SELECT seq, doc_id, role, user_id, released_at, case_id, coalesce(static, CASE WHEN seq > min(seq)
    FILTER (static IS NULL) OVER (PARTITION BY doc_id) THEN 'not_in_review' END) AS reason FROM st)"""


def _release(m):
    asked = m.events.selectExpr("event_id AS seq", "event_id % 1100 AS doc_id", "user_id", "ts AS released_at").join(
        m.m_users.select("user_id", "role"), "user_id").select("seq", "doc_id", "role", "user_id", "released_at")
    return L.release_reviews(asked, m.m_docs, m.m_tags)


@query("reviews_released", f"WITH {RELEASE} SELECT * FROM decided")
def _(m):
    return _release(m).decided


@query("documents_after_release", f"""
WITH {RELEASE} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM decided WHERE reason IS NULL) THEN 'ready'
  ELSE status END AS status FROM m_docs""")
def _(m):
    return _release(m).rows.select("doc_id", "status")


@query("release_audit_rows", f"""
WITH {RELEASE}, t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (source = 'officer_correction') AS c FROM m_tags
  GROUP BY doc_id)
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(user_id AS VARCHAR) AS actor_user_id, 'document_review_released' AS action,
  'document' AS target_type, CAST(d.doc_id AS VARCHAR) AS target_id, concat('{{"officer_corrections":', coalesce(c, 0),
  ',"tag_count":', coalesce(n, 0), '}}') AS metadata, released_at AS created_at
FROM decided d LEFT JOIN t ON t.doc_id = d.doc_id WHERE reason IS NULL""")
def _(m):
    return _release(m).audit


@query("legal_holds_applied", """
SELECT d.doc_id, coalesce(h.hold, d.retention_legal_hold) AS retention_legal_hold FROM m_docs d
LEFT JOIN (SELECT doc_id, arg_max(legal_hold, action_id * 2 + CAST(legal_hold AS INT)) AS hold FROM m_holds
  GROUP BY doc_id) h ON h.doc_id = d.doc_id""")
def _(m):
    return L.apply_holds(m.m_holds, m.m_docs).rows.select("doc_id", "retention_legal_hold")


# Applications of the customer table; their decisions come from the events, two addresses sharing one mailbox.
DECIDE = """ap AS (SELECT c_custkey AS application_id, c_name AS name, concat('p', c_custkey % 60, '@desk.example') AS email,
    'io' AS claimed_role, CAST(c_nationkey AS BIGINT) AS org_id, concat('ID-', c_custkey) AS claimed_credential_id,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'approved' ELSE 'pending_review' END AS status FROM customer),
 us AS (SELECT concat('p', s_suppkey * 9, '@desk.example') AS email FROM supplier),
 dc AS (SELECT event_id AS seq, user_id AS application_id, CASE WHEN event_type IN ('view', 'click') THEN 'reject'
    ELSE 'approve' END AS decision, user_id AS reviewer_user_id, ts AS decided_at FROM events)"""


def _decide(m):
    apps = m.customer.selectExpr(
        "c_custkey AS application_id", "c_name AS name", "concat('p', c_custkey % 60, '@desk.example') AS email",
        "'io' AS claimed_role", "CAST(c_nationkey AS BIGINT) AS org_id", "concat('ID-', c_custkey) AS claimed_credential_id",
        "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'approved' ELSE 'pending_review' END AS status")
    accounts = m.supplier.selectExpr("concat('p', s_suppkey * 9, '@desk.example') AS email")
    decisions = m.events.selectExpr(
        "event_id AS seq", "user_id AS application_id",
        "CASE WHEN event_type IN ('view', 'click') THEN 'reject' ELSE 'approve' END AS decision",
        "user_id AS reviewer_user_id", "ts AS decided_at")
    return L.apply_decisions(decisions, apps, accounts, m.m_roles)


# The compared SQL walks the decisions in order, carrying who is settled and which addresses are gone.
@query("applications_decided", f"""
WITH {DECIDE}, j AS (SELECT dc.*, ap.email, ap.status, EXISTS (SELECT 1 FROM us WHERE us.email = ap.email) AS taken,
    row_number() OVER (ORDER BY dc.seq) AS i FROM dc LEFT JOIN ap ON ap.application_id = dc.application_id),
 live AS (SELECT j.*, CASE WHEN status IS NULL THEN 'application_not_found' WHEN status <> 'pending_review'
    THEN 'already_decided' WHEN decision = 'approve' AND taken THEN 'email_taken' END AS static FROM j),
 f AS (SELECT application_id, email, min(seq) AS first, arg_min(decision, seq) AS kind,
    min(seq) FILTER (decision = 'reject') AS rej FROM live WHERE static IS NULL GROUP BY 1, 2),
 w AS (SELECT email, min(first) AS win FROM f WHERE kind = 'approve' GROUP BY email),
 e AS (SELECT f.application_id, CASE WHEN kind = 'reject' OR first = win THEN first ELSE rej END AS eff
   FROM f LEFT JOIN w USING (email))
SELECT seq, application_id, decision, coalesce(static, CASE WHEN eff IS NULL OR seq < eff THEN 'email_taken'
  WHEN seq > eff THEN 'already_decided' END) AS reason FROM live LEFT JOIN e USING (application_id)""")
def _(m):
    return _decide(m).decided.select("seq", "application_id", "decision", "reason")


ROLE_CHANGES = """r AS (SELECT event_id AS seq, user_id * 11 AS user_id, CASE event_type WHEN 'view' THEN 'io' WHEN 'click'
    THEN 'sho' WHEN 'purchase' THEN NULL WHEN 'signup' THEN 'court' ELSE 'nobody' END AS role_code,
    user_id AS actor_user_id, ts AS changed_at FROM events),
 st AS (SELECT r.*, u.role AS was, CASE WHEN u.user_id IS NULL THEN 'user_not_found' WHEN role_code IS NOT NULL
    AND role_code NOT IN (SELECT code FROM m_roles) THEN 'role_not_found' END AS reason
  FROM r LEFT JOIN m_users u ON u.user_id = r.user_id),
 ok AS (SELECT *, coalesce(role_code, 'unassigned') AS new_role FROM st WHERE reason IS NULL),
 decided AS (SELECT seq, user_id, role_code, actor_user_id, changed_at, coalesce(lag(new_role) OVER (PARTITION BY user_id
    ORDER BY seq), was) AS previous_role, new_role, reason FROM ok
  UNION ALL SELECT seq, user_id, role_code, actor_user_id, changed_at, was, NULL, reason FROM st WHERE reason IS NOT NULL)"""


def _role_changes(m):
    changes = m.events.selectExpr(
        "event_id AS seq", "user_id * 11 AS user_id",
        "CASE event_type WHEN 'view' THEN 'io' WHEN 'click' THEN 'sho' WHEN 'purchase' THEN NULL "
        "WHEN 'signup' THEN 'court' ELSE 'nobody' END AS role_code", "user_id AS actor_user_id", "ts AS changed_at")
    return L.apply_roles(changes, m.m_users, m.m_roles)


@query("role_changes", f"WITH {ROLE_CHANGES} SELECT * FROM decided")
def _(m):
    return _role_changes(m).decided


@query("users_after_role_changes", f"""
WITH {ROLE_CHANGES}, l AS (SELECT user_id, arg_max(new_role, seq) AS new_role FROM decided WHERE reason IS NULL GROUP BY 1)
SELECT u.user_id, coalesce(l.new_role, u.role) AS role, CASE WHEN l.user_id IS NULL THEN u.role_id ELSE
  (SELECT min(role_id) FROM m_roles r WHERE r.code = l.new_role) END AS role_id
FROM m_users u LEFT JOIN l ON l.user_id = u.user_id""")
def _(m):
    return _role_changes(m).rows.select("user_id", "role", "role_id")


@query("organizations_onboarded", """
WITH n AS (SELECT p_partkey AS seq, trim(CASE WHEN p_size = 9 THEN '  ' WHEN p_size = 10 THEN 'Supplier#000000003'
    ELSE concat(' ', p_brand, ' ', p_type) END) AS name, lower(trim(concat(p_type, ' '))) AS org_type,
    p_partkey AS actor_user_id, TIMESTAMP '2024-05-05 00:00:00' AS asked_at FROM part)
SELECT n.*, CASE WHEN name = '' THEN 'empty_name' WHEN EXISTS (SELECT 1 FROM m_orgs o WHERE o.name = n.name)
  OR row_number() OVER (PARTITION BY name ORDER BY seq) > 1 THEN 'name_taken' END AS reason FROM n""")
def _(m):
    new = m.part.selectExpr(
        "p_partkey AS seq", "CASE WHEN p_size = 9 THEN '  ' WHEN p_size = 10 THEN 'Supplier#000000003' "
        "ELSE concat(' ', p_brand, ' ', p_type) END AS name", "concat(p_type, ' ') AS org_type",
        "p_partkey AS actor_user_id", "TIMESTAMP '2024-05-05 00:00:00' AS asked_at")
    return L.onboard_orgs(new, m.m_orgs).decided


@query("diary_entries_added", f"""
WITH {MATRIX}, r AS (SELECT conv_id * 1000 + turn AS entry_id, conv_id AS case_id, CASE role WHEN 'user' THEN conv_id * 14
    WHEN 'assistant' THEN conv_id * 14 + 1 ELSE conv_id END AS user_id, CASE WHEN turn = 3 THEN '  ' ELSE text END AS text,
    TIMESTAMP '2024-05-02 00:00:00' AS written_at FROM conversations)
SELECT r.*, CASE WHEN u.role IS NULL OR u.role NOT IN ('io', 'sho') THEN 'role_not_permitted'
  WHEN c.case_id IS NULL THEN 'case_not_found' WHEN u.role <> 'sho' AND NOT EXISTS (SELECT 1 FROM matrix x WHERE x.can_open
    AND x.case_id = r.case_id AND x.user_id = r.user_id) THEN 'no_case_access' WHEN trim(r.text) = '' THEN 'empty_text' END AS reason
FROM r LEFT JOIN m_users u ON u.user_id = r.user_id LEFT JOIN m_cases c ON c.case_id = r.case_id""")
def _(m):
    entries = m.conversations.selectExpr(
        "conv_id * 1000 + turn AS entry_id", "conv_id AS case_id",
        "CASE role WHEN 'user' THEN conv_id * 14 WHEN 'assistant' THEN conv_id * 14 + 1 ELSE conv_id END AS user_id",
        "CASE WHEN turn = 3 THEN '  ' ELSE text END AS text", "TIMESTAMP '2024-05-02 00:00:00' AS written_at")
    return L.add_diary_entries(entries, m.m_cases, m.m_users, _matrix(m)).decided


@query("applications_submitted", """
SELECT a.*, CASE WHEN o.org_id IS NULL THEN 'organization_not_found' WHEN u.email IS NOT NULL THEN 'email_taken' END AS reason
FROM (SELECT application_id, name, email, claimed_role, org_id * 7 AS org_id, application_id AS submitted_by,
    created_at AS submitted_at FROM m_apps) a
LEFT JOIN m_orgs o ON o.org_id = a.org_id LEFT JOIN (SELECT DISTINCT email FROM m_users) u ON u.email = a.email""")
def _(m):
    apps = m.m_apps.selectExpr("application_id", "name", "email", "claimed_role", "org_id * 7 AS org_id",
                               "application_id AS submitted_by", "created_at AS submitted_at")
    return L.submit_applications(apps, m.m_orgs, m.m_users).decided


@query("keys_revoked", """
WITH r AS (SELECT event_id AS seq, user_id * 11 AS key_id, user_id AS actor_user_id, ts AS revoked_at FROM events)
SELECT r.*, k.key_prefix, CASE WHEN k.key_id IS NULL THEN 'key_not_found' WHEN k.revoked_at IS NOT NULL
  OR row_number() OVER (PARTITION BY r.key_id ORDER BY seq) > 1 THEN 'already_revoked' END AS reason
FROM r LEFT JOIN m_keys k ON k.key_id = r.key_id""")
def _(m):
    asked = m.events.selectExpr("event_id AS seq", "user_id * 11 AS key_id", "user_id AS actor_user_id", "ts AS revoked_at")
    return L.revoke_keys(asked, m.m_keys).decided


ROLE_ROWS = ("p_partkey AS seq", "concat(' ', p_brand, ' ', p_type) AS code", "concat(p_name, ' ') AS name",
             "p_partkey AS actor_user_id", "TIMESTAMP '2024-05-06 00:00:00' AS asked_at")


@query("roles_created", """
WITH n AS (SELECT p_partkey AS seq, replace(lower(concat(p_brand, ' ', p_type)), ' ', '_') AS code, p_name AS name,
    lower(concat(p_type, ':', p_brand)) AS wanted FROM part),
 f AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS rn FROM n)
SELECT f.seq, f.code, f.name, false AS is_system, p.code AS permission_code FROM f
LEFT JOIN m_permissions p ON p.code = f.wanted
WHERE rn = 1 AND f.code NOT IN (SELECT code FROM m_roles)""")
def _(m):
    wanted = F.array(F.lower(F.concat("p_type", F.lit(":"), "p_brand")), F.lit("unknown:permission"))
    new = m.part.withColumn("permission_codes", wanted).selectExpr(*ROLE_ROWS, "permission_codes")
    return L.create_roles(new, m.m_roles, m.m_permissions).rows


@query("roles_deleted", """
WITH r AS (SELECT event_id AS seq, user_id % 20 AS role_id, user_id AS actor_user_id, ts AS asked_at FROM events)
SELECT r.*, k.code, CASE WHEN k.code IS NULL THEN 'role_not_found' WHEN r.role_id < 5 THEN 'system_role'
  WHEN row_number() OVER (PARTITION BY r.role_id ORDER BY seq) > 1 THEN 'role_not_found' END AS reason
FROM r LEFT JOIN m_roles k ON k.role_id = r.role_id""")
def _(m):
    asked = m.events.selectExpr("event_id AS seq", "user_id % 20 AS role_id", "user_id AS actor_user_id", "ts AS asked_at")
    return L.delete_roles(asked, m.m_roles.withColumn("is_system", F.col("role_id") < 5)).decided
