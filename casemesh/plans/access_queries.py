"""Access scoping, joins, the stage gate and reports over the model tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators import access as A
from casemesh.operators import cases as C
from casemesh.operators import documents as D
from casemesh.operators import reports as R
from casemesh.plans.listing_queries import AS_OF, CASE_COLUMNS, quoted
from casemesh.plans.registry import query


@query("cases_assigned", """
SELECT * FROM m_cases c WHERE EXISTS (SELECT 1 FROM m_assign a WHERE a.case_id = c.case_id AND a.io_user_id = 14)""")
def _(m):
    return A.cases_assigned(m.m_cases, m.m_assign, 14)


@query("cases_registered", """
SELECT * FROM m_cases c WHERE EXISTS (SELECT 1 FROM m_audit a WHERE a.case_id = c.case_id
  AND a.actor_user_id = 16 AND a.action = 'fir_registered')""")
def _(m):
    return A.cases_registered(m.m_cases, m.m_audit, 16)


@query("cases_requisitioned", """
SELECT * FROM m_cases c WHERE EXISTS (SELECT 1 FROM m_requests r WHERE r.case_id = c.case_id
  AND r.requested_org_id = 3)""")
def _(m):
    return A.cases_requisitioned(m.m_cases, m.m_requests, 3)


@query("cases_engaged", """
SELECT * FROM m_cases c WHERE EXISTS (SELECT 1 FROM m_parties p WHERE p.case_id = c.case_id
  AND p.user_id = 17 AND p.party_role = 'defense')""")
def _(m):
    return A.cases_engaged(m.m_cases, m.m_parties, 17)


@query("visible_cases_of_authority", """
SELECT * FROM m_cases c WHERE EXISTS (SELECT 1 FROM m_requests r WHERE r.case_id = c.case_id
  AND r.requested_org_id = 5)""")
def _(m):
    user = {"user_id": 4, "role": "external_authority", "org_id": 5}
    return A.filter_visible(m.m_cases, user, m.m_assign, m.m_audit, m.m_requests, m.m_parties)


MATRIX = f"""matrix AS (
  SELECT user_id, CAST(NULL AS BIGINT) AS case_id, 'unrestricted' AS "grant", true AS can_list, true AS can_open
  FROM m_users WHERE role IN ({quoted(K.UNRESTRICTED_CASE_ROLES)})
  UNION ALL SELECT DISTINCT u.user_id, a.case_id, 'assigned', true, true FROM m_users u
    JOIN m_assign a ON a.io_user_id = u.user_id WHERE u.role IN ({quoted(K.ASSIGNMENT_ROLES)})
  UNION ALL SELECT DISTINCT u.user_id, a.case_id, 'registered', true, true FROM m_users u
    JOIN m_audit a ON a.actor_user_id = u.user_id AND a.action = 'fir_registered' WHERE u.role = 'duty_officer'
  UNION ALL SELECT DISTINCT u.user_id, p.case_id, 'engaged', true, true FROM m_users u
    JOIN m_parties p ON p.user_id = u.user_id AND p.party_role = 'defense' WHERE u.role = 'defense'
  UNION ALL SELECT DISTINCT u.user_id, r.case_id, 'requisitioned', true, false FROM m_users u
    JOIN m_requests r ON r.requested_org_id = u.org_id WHERE u.role = 'external_authority')"""


def _matrix(m):
    return A.access_matrix(m.m_users, m.m_assign, m.m_audit, m.m_requests, m.m_parties)


@query("access_matrix", f"WITH {MATRIX} SELECT * FROM matrix")
def _(m):
    return _matrix(m)


# Requests to open a case: the customer of each order, and the officer each order was given to.
OPENINGS = """openings AS (SELECT o_orderkey AS case_id, o_custkey AS user_id, 'customer' AS via FROM orders
  UNION ALL SELECT case_id, io_user_id, 'officer' FROM m_assign
  UNION ALL SELECT case_id, user_id, 'party' FROM m_parties)"""


def _openings(m):
    customers = m.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("user_id"),
                                F.lit("customer").alias("via"))
    officers = m.m_assign.select("case_id", F.col("io_user_id").alias("user_id"), F.lit("officer").alias("via"))
    parties = m.m_parties.select("case_id", "user_id", F.lit("party").alias("via"))
    return customers.unionByName(officers).unionByName(parties)


@query("access_denials", f"""
WITH {MATRIX}, {OPENINGS}
SELECT o.case_id, o.user_id, o.via, u.role, CASE WHEN u.role IS NULL THEN 'unknown_user'
    WHEN u.role = 'duty_officer' THEN 'not_registering_officer'
    WHEN u.role IN ({quoted(K.ASSIGNMENT_ROLES)}) THEN 'not_assigned'
    WHEN u.role = 'defense' THEN 'no_engagement' ELSE 'role_not_permitted' END AS reason
FROM openings o LEFT JOIN m_users u ON u.user_id = o.user_id
WHERE (u.role IS NULL OR u.role NOT IN ({quoted(K.UNRESTRICTED_CASE_ROLES)}))
  AND NOT EXISTS (SELECT 1 FROM matrix x WHERE x.can_open AND x.case_id = o.case_id AND x.user_id = o.user_id)""")
def _(m):
    return A.denials(_openings(m), m.m_users, _matrix(m))


@query("request_access", f"""
WITH tries AS (SELECT DISTINCT request_id, requested_org_id, case_id % 1500 AS user_id FROM m_requests)
SELECT t.request_id, t.user_id, u.role, CASE WHEN u.role IN ({quoted(K.REQUEST_OVERSIGHT_ROLES)}) THEN 'allowed'
  WHEN u.role = 'external_authority' AND u.org_id = t.requested_org_id THEN 'allowed'
  WHEN u.role = 'external_authority' THEN 'different_organization' ELSE 'role_not_permitted' END AS verdict
FROM tries t LEFT JOIN m_users u ON u.user_id = t.user_id""")
def _(m):
    requests = m.m_requests.select("request_id", "requested_org_id", "case_id")
    tries = requests.select("request_id", "requested_org_id", (F.col("case_id") % 1500).alias("user_id")).distinct()
    # request numbers repeat in the supplied rows, so the organisation is part of the key here
    keyed = tries.withColumn("request_id", F.struct("request_id", "requested_org_id")).drop("requested_org_id")
    known = tries.select(F.struct("request_id", "requested_org_id").alias("request_id"), "requested_org_id").distinct()
    return A.request_access(keyed, known, m.m_users).withColumn("request_id", F.col("request_id.request_id"))


INBOX = """SELECT r.*, c.case_number, u.name AS requested_by_name FROM m_requests r
  JOIN m_cases c ON c.case_id = r.case_id LEFT JOIN m_users u ON u.user_id = r.requested_by_user_id"""


@query("requisition_inbox_authority", f"{INBOX} WHERE r.requested_org_id = 3")
def _(m):
    return A.requisition_inbox(m.m_requests, m.m_cases, m.m_users, m.m_assign, "external_authority", org_id=3)


@query("requisition_inbox_officer", f"""{INBOX} WHERE EXISTS (SELECT 1 FROM m_assign a
  WHERE a.case_id = r.case_id AND a.io_user_id = 28)""")
def _(m):
    return A.requisition_inbox(m.m_requests, m.m_cases, m.m_users, m.m_assign, "io", user_id=28)


@query("requisition_inbox_oversight", INBOX)
def _(m):
    return A.requisition_inbox(m.m_requests, m.m_cases, m.m_users, m.m_assign, "court")


@query("requests_with_requester", """
SELECT r.*, u.name AS requested_by_name FROM m_requests r LEFT JOIN m_users u ON u.user_id = r.requested_by_user_id""")
def _(m):
    return A.with_requester(m.m_requests, m.m_users)


@query("audit_with_actor", """
SELECT a.*, u.name AS actor_name, u.email AS actor_email FROM m_audit a
LEFT JOIN m_users u ON u.user_id = a.actor_user_id""")
def _(m):
    return A.audit_with_actor(m.m_audit, m.m_users)


@query("assignable_officers", f"""
SELECT u.user_id, u.name, u.role, u.designation, u.service_id, o.name AS org_name,
  EXISTS (SELECT 1 FROM m_assign a WHERE a.case_id = 7 AND a.io_user_id = u.user_id) AS already_assigned
FROM m_users u JOIN m_orgs o ON o.org_id = u.org_id AND o.org_type = 'police'
WHERE u.role IN ({quoted(K.ASSIGNMENT_ROLES)})""")
def _(m):
    return A.assignable(m.m_users, m.m_orgs, m.m_assign, 7)


@query("login_identities", """
SELECT DISTINCT a.attempt_id, a.identifier, u.user_id FROM m_attempts a
JOIN m_users u ON u.email = a.identifier OR u.service_id = a.identifier""")
def _(m):
    return A.match_identity(m.m_attempts, m.m_users)


@query("party_lookup_by_email", """
SELECT a.attempt_id, a.identifier, u.user_id FROM m_attempts a JOIN m_users u
  ON lower(u.email) = lower(trim(a.identifier))""")
def _(m):
    return A.match_identity(m.m_attempts, m.m_users, ignore_case=True)


@query("user_permissions", """
WITH own AS (SELECT role_id, code FROM m_role_permissions)
SELECT u.user_id, u.role, p.code FROM m_users u JOIN own p ON p.role_id = u.role_id
UNION ALL SELECT u.user_id, u.role, p.code FROM m_users u JOIN m_roles r ON r.code = u.role
  JOIN own p ON p.role_id = r.role_id
WHERE u.role_id IS NULL OR u.role_id NOT IN (SELECT role_id FROM own)""")
def _(m):
    perms = A.user_permissions(m.m_users, m.m_roles, m.m_role_permissions)
    return perms.select("user_id", "role", F.explode("permissions").alias("code"))


@query("keys_with_owner", """
SELECT k.*, u.name AS user_name, u.email AS user_email FROM m_keys k LEFT JOIN m_users u ON u.user_id = k.user_id""")
def _(m):
    return A.keys_with_owner(m.m_keys, m.m_users)


@query("applications_with_documents", """
SELECT a.*, d.credential_id, d.doc_type AS document_type, d.created_at AS document_created_at
FROM m_apps a LEFT JOIN m_cred_docs d ON d.application_id = a.application_id""")
def _(m):
    return A.applications_with_documents(m.m_apps, m.m_cred_docs)


# --- stage gate, ownership, history -----------------------------------------------------------

MISSING = """missing AS (
  SELECT c.case_id, s.requirement_type, s.requirement_key, concat('Document: ', s.requirement_key) AS item
  FROM m_cases c JOIN m_stage_requirements s ON s.crime_type = c.crime_type AND s.mandatory
  WHERE s.requirement_type = 'document' AND NOT EXISTS (SELECT 1 FROM m_docs d WHERE d.case_id = c.case_id
    AND d.doc_type = s.requirement_key)
  UNION ALL
  SELECT c.case_id, s.requirement_type, s.requirement_key, concat('Evidence Request: ', s.requirement_key)
  FROM m_cases c JOIN m_stage_requirements s ON s.crime_type = c.crime_type AND s.mandatory
  WHERE s.requirement_type = 'evidence_request' AND NOT EXISTS (SELECT 1 FROM m_requests r
    WHERE r.case_id = c.case_id AND r.doc_type_expected = s.requirement_key AND r.status = 'completed'))"""


def _gate(m):
    return m.m_cases, m.m_stage_requirements, m.m_docs, m.m_requests


@query("missing_requirements", f"WITH {MISSING} SELECT * FROM missing")
def _(m):
    return C.missing_requirements(*_gate(m))


@query("charge_sheet_gate", f"""
WITH {MISSING}, g AS (SELECT case_id, string_agg(DISTINCT item, '; ' ORDER BY item) AS items, 1 AS some
  FROM missing GROUP BY case_id)
SELECT c.case_id, c.crime_type, c.investigation_status, coalesce(g.items, '') AS missing_items,
  CASE WHEN investigation_status IN ({quoted(K.TRIAL_STAGES)}) THEN 'already_filed'
    WHEN g.some = 1 THEN 'missing' ELSE 'ready' END AS verdict
FROM m_cases c LEFT JOIN g ON g.case_id = c.case_id""")
def _(m):
    return C.charge_sheet_ready(*_gate(m)).withColumn("missing_items", F.array_join("missing_items", "; "))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PATHWAY_VALUES = "(VALUES " + ", ".join(
    f"({i}, {', '.join(str(len(v)) if isinstance(v, tuple) else _quote(v) for v in p)})"
    for i, p in enumerate(K.BAIL_PATHWAYS)) + ") AS t(pos, name, bailable_status, statute, court, sections, steps, terms)"


@query("case_pathways", f"""
WITH hits AS (SELECT c.case_id, t.*, row_number() OVER (PARTITION BY c.case_id ORDER BY t.pos) AS rn
  FROM m_cases c JOIN {PATHWAY_VALUES} ON contains(lower(c.crime_type), lower(t.name))
    OR contains(lower(t.name), lower(c.crime_type))),
 d AS (SELECT * FROM {PATHWAY_VALUES} WHERE pos = {len(K.BAIL_PATHWAYS) - 1})
SELECT c.case_id, c.case_number, c.bail_status AS current_bail_status, coalesce(h.name, c.crime_type) AS crime_type,
  coalesce(h.bailable_status, d.bailable_status) AS bailable_status, coalesce(h.court, d.court) AS jurisdiction_court,
  coalesce(h.steps, d.steps) AS steps, coalesce(h.statute, d.statute) AS primary_statute,
  coalesce(h.sections, d.sections) AS applicable_sections, coalesce(h.terms, d.terms) AS special_conditions
FROM m_cases c LEFT JOIN hits h ON h.case_id = c.case_id AND h.rn = 1, d""")
def _(m):
    p = C.case_pathways(m.m_cases)
    return p.select("case_id", "case_number", "current_bail_status", "pathway.crime_type", "pathway.bailable_status",
                    "pathway.jurisdiction_court", "pathway.primary_statute", "pathway.applicable_sections",
                    "pathway.special_conditions", F.size("pathway.statutory_pathway").alias("steps"))


@query("owner_backfill", """
WITH first AS (SELECT case_id, arg_min(actor_user_id, seq) AS actor FROM m_audit
  WHERE action = 'fir_registered' AND case_id IS NOT NULL AND actor_user_id IS NOT NULL GROUP BY case_id),
 k AS (SELECT f.case_id, f.actor, u.org_id FROM first f JOIN m_users u ON u.user_id = f.actor)
SELECT c.case_id, c.case_number, c.crime_type, c.court_level, c.investigation_status, c.bail_status,
  CASE WHEN c.registered_by_user_id IS NULL AND k.actor IS NOT NULL THEN k.org_id ELSE c.org_id END AS org_id,
  coalesce(c.registered_by_user_id, k.actor) AS registered_by_user_id, c.created_at
FROM m_cases c LEFT JOIN k ON k.case_id = c.case_id""")
def _(m):
    return C.backfill_owner(m.m_cases, m.m_audit, m.m_users)


@query("diary_retag_candidates", """
WITH tags AS (SELECT doc_id AS entry_id FROM m_tags WHERE source = 'ai_parser')
SELECT entry_id, case_id, author_role, text, 'processing' AS status, created_at FROM m_diary e
WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM tags t WHERE t.entry_id = e.entry_id)""")
def _(m):
    tags = m.m_tags.withColumnRenamed("doc_id", "entry_id")
    return D.retag_candidates(m.m_diary, tags)


@query("ledger_verify", """
SELECT d.doc_id, d.doc_hash, l.ledger_hash, CASE WHEN l.ledger_hash IS NULL THEN 'missing'
  WHEN l.ledger_hash = d.doc_hash THEN 'ok' ELSE 'tampered' END AS verdict
FROM m_docs d LEFT JOIN m_ledger l ON l.doc_id = d.doc_id""")
def _(m):
    return D.verify_hashes(m.m_docs, m.m_ledger)


LEDGER_PLUS = "l AS (SELECT * FROM m_ledger UNION ALL SELECT item_id + 10000000000, sha256(text) FROM benchmark)"


@query("ledger_reconcile", f"""
WITH {LEDGER_PLUS}
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_hash IS NULL THEN 'ledger_only'
  WHEN l.ledger_hash IS NULL AND chain_status = 'confirmed' THEN 'confirmed_but_absent'
  WHEN l.ledger_hash IS NULL THEN 'not_written' WHEN l.ledger_hash <> d.doc_hash THEN 'hash_differs'
  WHEN chain_status <> 'confirmed' THEN 'written_but_unconfirmed' ELSE 'match' END AS state
FROM m_docs d FULL OUTER JOIN l ON l.doc_id = d.doc_id""")
def _(m):
    strays = m.benchmark.select((F.col("item_id") + 10000000000).alias("doc_id"),
                                F.sha2("text", 256).alias("ledger_hash"))
    return D.reconcile(m.m_docs, m.m_ledger.unionByName(strays))


SUBMISSIONS = """s AS (SELECT event_id AS seq, user_id AS doc_id, sha256(CAST(event_id % 3 AS VARCHAR)) AS doc_hash
  FROM events)"""


SUBMISSIONS_WRITE_ONCE = f"""
WITH {SUBMISSIONS}, f AS (SELECT doc_id, arg_min(doc_hash, seq) AS h, min(seq) AS q FROM s GROUP BY doc_id)
SELECT s.seq, s.doc_id, s.doc_hash, CASE WHEN l.ledger_hash IS NULL AND s.seq = f.q THEN 'recorded'
  WHEN s.doc_hash = coalesce(l.ledger_hash, f.h) THEN 'noop' ELSE 'conflict' END AS outcome
FROM s JOIN f ON f.doc_id = s.doc_id LEFT JOIN m_ledger l ON l.doc_id = s.doc_id"""


@query("ledger_write_once", SUBMISSIONS_WRITE_ONCE)
def _(m):
    subs = m.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"),
                           F.sha2((F.col("event_id") % 3).cast("string"), 256).alias("doc_hash"))
    return D.ledger_batch(subs, m.m_ledger)


MAPPINGS = "SELECT DISTINCT p_type AS doc_type, p_brand AS entity_type, p_name AS field_name FROM part"
FIELD_LISTS = """SELECT p_type AS doc_type, 1 AS tier, concat('[', string_agg(DISTINCT concat('{"field_name":"', p_name,
  '","sensitivity":"', CASE WHEN p_size > 40 THEN 'high' ELSE 'low' END, '"}'), ','), ']') AS sensitivity_fields
  FROM part WHERE p_size > 25 GROUP BY 1"""


def _mappings(m):
    mappings = m.part.selectExpr("p_type AS doc_type", "p_brand AS entity_type", "p_name AS field_name").distinct()
    fields = F.concat(F.lit('{"field_name":"'), "p_name", F.lit('","sensitivity":"'),
                      F.when(F.col("p_size") > 40, "high").otherwise("low"), F.lit('"}'))
    schemas = m.part.filter("p_size > 25").groupBy(F.col("p_type").alias("doc_type")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_set(fields), ","), F.lit("]")).alias("sensitivity_fields"))
    return mappings, schemas.withColumn("tier", F.lit(1))


@query("mappings_without_field", f"""
WITH mp AS ({MAPPINGS}) SELECT * FROM mp WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_size > 25
  AND p.p_type = mp.doc_type AND p.p_name = mp.field_name)""")
def _(m):
    return D.orphan_mappings(*_mappings(m))


@query("span_fields", """
WITH mp(doc_type, entity_type, field_name) AS (VALUES ('FIR', 'EMAIL_ADDRESS', 'contact_email'),
    ('FIR', 'PHONE_NUMBER', 'contact_phone'), ('Witness Statement', 'EMAIL_ADDRESS', 'witness_email'),
    ('Charge Sheet', 'IP_ADDRESS', 'unlisted')),
  f(doc_type, field_name, sensitivity) AS (VALUES ('FIR', 'contact_email', 'high'), ('FIR', 'contact_phone', 'medium'),
    ('Witness Statement', 'witness_email', 'high'))
SELECT t.*, d.doc_type, f.field_name, f.sensitivity FROM m_tags t JOIN m_docs d USING (doc_id)
LEFT JOIN (mp JOIN f ON f.doc_type = mp.doc_type AND f.field_name = mp.field_name)
  ON mp.doc_type = d.doc_type AND mp.entity_type = t.entity_type""")
def _(m):
    mappings = m.spark.createDataFrame([
        ("FIR", "EMAIL_ADDRESS", "contact_email"), ("FIR", "PHONE_NUMBER", "contact_phone"),
        ("Witness Statement", "EMAIL_ADDRESS", "witness_email"), ("Charge Sheet", "IP_ADDRESS", "unlisted"),
    ], "doc_type STRING, entity_type STRING, field_name STRING")
    schemas = m.spark.createDataFrame([
        ("FIR", 1, '[{"field_name":"contact_email","sensitivity":"high"},'
                   '{"field_name":"contact_phone","sensitivity":"medium"}]'),
        ("Witness Statement", 1, '[{"field_name":"witness_email","sensitivity":"high"}]'),
    ], "doc_type STRING, tier INT, sensitivity_fields STRING")
    return D.map_fields(m.m_tags, m.m_docs, mappings, schemas)


UPLOADS = "up AS (SELECT doc_id, doc_id >> 5 AS case_id, lang AS doc_type, sha256(text) AS doc_hash FROM documents)"


@query("upload_dedup", f"""
WITH {UPLOADS}, held AS (SELECT * FROM up JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
 st AS (SELECT case_id, doc_type, doc_hash, min(doc_id) AS stored FROM held GROUP BY 1, 2, 3),
 fr AS (SELECT case_id, doc_type, doc_hash, min(doc_id) AS first FROM up GROUP BY 1, 2, 3)
SELECT up.*, coalesce(stored, first) AS result_doc_id, stored IS NULL AND first = doc_id AS is_new
FROM up JOIN fr USING (case_id, doc_type, doc_hash) LEFT JOIN st USING (case_id, doc_type, doc_hash)""")
def _(m):
    up = m.documents.select("doc_id", F.shiftright("doc_id", 5).alias("case_id"), F.col("lang").alias("doc_type"),
                            F.sha2("text", 256).alias("doc_hash"))
    held = up.join(m.labels.filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return D.dedup_uploads(up, held)


@query("document_versions_assigned", """
WITH up AS (SELECT doc_id, source AS case_id, lang AS doc_type FROM documents),
 old AS (SELECT up.* FROM up JOIN labels USING (doc_id)),
 st AS (SELECT case_id, doc_type, max(CAST(doc_id % 9 AS INT)) AS latest FROM old GROUP BY 1, 2)
SELECT doc_id, case_id, doc_type, CAST(coalesce(latest, 0) + row_number() OVER (
  PARTITION BY case_id, doc_type ORDER BY doc_id) AS INT) AS version
FROM up LEFT JOIN st USING (case_id, doc_type)""")
def _(m):
    up = m.documents.select("doc_id", F.col("source").alias("case_id"), F.col("lang").alias("doc_type"))
    old = up.join(m.labels.select("doc_id"), "doc_id", "left_semi").withColumn(
        "version", (F.col("doc_id") % 9).cast("int"))
    return D.assign_versions(up, old)


@query("document_version_history", """
SELECT doc_id, case_id, doc_type, version, max(version) OVER (PARTITION BY case_id, doc_type) AS latest_version,
  version = max(version) OVER (PARTITION BY case_id, doc_type) AS is_latest FROM m_docs""")
def _(m):
    return D.versions(m.m_docs.select("doc_id", "case_id", "doc_type", "version"))


@query("key_conflicts", """
SELECT application_id, email FROM m_apps a WHERE EXISTS (SELECT 1 FROM m_users u WHERE u.email = a.email)""")
def _(m):
    return D.conflicts(m.m_apps.select("application_id", "email"), m.m_users, ["email"])


@query("key_accepted", """
SELECT application_id, email FROM m_apps a WHERE NOT EXISTS (SELECT 1 FROM m_users u WHERE u.email = a.email)""")
def _(m):
    return D.accepted(m.m_apps.select("application_id", "email"), m.m_users, ["email"])


@query("upload_routes", """
SELECT doc_id, mime, CASE WHEN mime IN ('text/plain', 'text/csv') THEN 'tagging'
  WHEN mime IN ('video/mp4', 'video/mpeg', 'audio/mpeg', 'audio/wav') THEN 'ready'
  WHEN mime IN ('application/pdf', 'image/jpeg', 'image/png', 'image/tiff', 'image/webp') THEN 'text_recognition'
  ELSE 'reject' END AS route
FROM (SELECT doc_id, CASE n_chars % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'audio/wav' WHEN 2 THEN 'image/png'
  WHEN 3 THEN 'application/zip' ELSE 'application/pdf' END AS mime FROM documents)""")
def _(m):
    docs = m.documents.selectExpr("doc_id", "CASE n_chars % 5 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'audio/wav' "
                                  "WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/zip' ELSE 'application/pdf' END AS mime")
    return docs.withColumn("route", D.route(F.col("mime")))


@query("bail_current_stage", """
SELECT case_id, arg_max(stage, seq) AS stage, max(seq) AS seq, count(*) AS records FROM m_bail_records GROUP BY case_id""")
def _(m):
    return C.current_stage(m.m_bail_records)


LEGAL_STEPS = "(VALUES " + ", ".join(
    f"('{a}', '{b}')" for a, b in sorted({(x[0], x[2]) for x in K.BAIL_MOVES})) + ") AS v(a, b)"


@query("bail_transitions", f"""
WITH r AS (SELECT *, lag(stage) OVER (PARTITION BY case_id ORDER BY seq) AS previous_stage FROM m_bail_records)
SELECT r.*, EXISTS (SELECT 1 FROM {LEGAL_STEPS} WHERE v.a = coalesce(previous_stage, '') AND v.b = stage) AS legal
FROM r""")
def _(m):
    return C.transitions(m.m_bail_records)


# --- aggregates -------------------------------------------------------------------------------

@query("audit_summary", """
WITH t AS (SELECT case_id, count(*) AS total_entries, arg_min(created_at, seq) AS first_entry_at,
  arg_max(created_at, seq) AS last_entry_at FROM m_audit GROUP BY case_id),
 n AS (SELECT case_id, action, count(*) AS n FROM m_audit GROUP BY case_id, action)
SELECT t.*, n.action, n.n FROM t JOIN n USING (case_id)""")
def _(m):
    df = R.audit_summary(m.m_audit)
    return df.select("case_id", "total_entries", "first_entry_at", "last_entry_at",
                     F.explode("action_counts").alias("action", "n"))


@query("public_stats", """
SELECT (SELECT count(*) FROM m_cases) AS total_cases, (SELECT count(*) FROM m_docs) AS total_documents,
  (SELECT count(*) FROM m_audit) AS total_audit_entries""")
def _(m):
    return R.public_stats(m.m_cases, m.m_docs, m.m_audit)


@query("org_user_counts", """
SELECT o.*, count(u.user_id) AS user_count FROM m_orgs o LEFT JOIN m_users u ON u.org_id = o.org_id
GROUP BY o.org_id, o.name, o.org_type""")
def _(m):
    return R.org_user_counts(m.m_orgs, m.m_users)


@query("role_user_counts", """
SELECT r.*, count(DISTINCT u.user_id) AS user_count FROM m_roles r
LEFT JOIN m_users u ON u.role_id = r.role_id OR u.role = r.code GROUP BY r.role_id, r.code""")
def _(m):
    return R.role_user_counts(m.m_roles, m.m_users)


@query("stage_counters", """
SELECT count(*) AS total_cases, count(*) FILTER (investigation_status = 'FIR_Registered') AS fir_registered,
  count(*) FILTER (investigation_status = 'Charge_Sheet_Filed') AS charge_sheet_filed,
  count(*) FILTER (investigation_status IN ('Trial', 'Judgment')) AS in_trial_or_judgment FROM m_cases""")
def _(m):
    return R.stage_counters(m.m_cases)


DAYS = ("greatest(0, CAST(floor((epoch_us(TIMESTAMP '1999-06-01 12:00:00') - epoch_us(created_at)) / 86400000000.0) "
        "AS BIGINT))")


@query("cohort_export_rows", f"""
SELECT sha256(CAST(case_id AS VARCHAR)) AS case_token, case_number, crime_type, investigation_status,
  {DAYS} AS days_active, coalesce(court_level, '') AS court_level, coalesce(bail_status, '') AS bail_status
FROM m_cases""")
def _(m):
    return R.cohort(m.m_cases, "1999-06-01 12:00:00")


@query("cohort_stats", f"""
SELECT count(*) AS cohort_size, round(avg({DAYS}), 1) AS mean_days_active FROM m_cases WHERE crime_type = 'theft'""")
def _(m):
    return R.cohort_stats(m.m_cases.filter("crime_type = 'theft'"), "1999-06-01 12:00:00")


@query("review_backlog", """
WITH b AS (SELECT count(*) AS queue_depth, min(created_at) AS oldest_at FROM m_docs WHERE status = 'needs_review'),
 h AS (SELECT *, greatest(0, CAST(floor((epoch_us(TIMESTAMP '2024-03-20 00:00:00') - epoch_us(oldest_at))
   / 3600000000.0 + 0.5) AS BIGINT)) AS oldest_hours FROM b)
SELECT *, concat((oldest_hours // 24) // 30, ' mo ', (oldest_hours // 24) % 30, 'd') AS oldest_label FROM h""")
def _(m):
    return R.backlog(m.m_docs, "2024-03-20 00:00:00")


@query("tag_summary", """
SELECT d.doc_id, count(t.doc_id) AS tag_count, coalesce(string_agg(DISTINCT t.entity_type, ',' ORDER BY t.entity_type), '')
  AS entity_types, coalesce(min(t.confidence), 100) AS min_confidence
FROM m_docs d LEFT JOIN m_tags t ON t.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(m):
    return R.tag_summary(m.m_docs, m.m_tags).withColumn("entity_types", F.array_join("entity_types", ","))


@query("document_status", """
SELECT d.doc_id, CASE WHEN trim(d.raw_text) = '' OR coalesce(t.low, false) OR d.chain_status = 'failed'
  THEN 'needs_review' ELSE 'ready' END AS status
FROM m_docs d LEFT JOIN (SELECT doc_id, bool_or(confidence < 80) AS low FROM m_tags GROUP BY doc_id) t USING (doc_id)""")
def _(m):
    return R.route_status(m.m_docs, m.m_tags, F.col("chain_status") != "failed", threshold=80)


@query("officer_corrections", """
SELECT doc_id, count(*) AS tag_count, count(*) FILTER (source = 'officer_correction') AS officer_corrections
FROM m_tags GROUP BY doc_id""")
def _(m):
    return R.correction_counts(m.m_tags)


@query("cases_by_day", f"""
SELECT {CASE_COLUMNS}, CAST(created_at AS DATE) AS day,
  count(*) OVER (PARTITION BY CAST(created_at AS DATE)) AS cases_that_day FROM m_cases""")
def _(m):
    cases = m.m_cases.drop("org_id", "registered_by_user_id")
    return R.cases_by_day(cases)


@query("permissions_by_category", "SELECT category, code FROM m_permissions")
def _(m):
    return R.permissions_by_category(m.m_permissions).select("category", F.explode("codes").alias("code"))


@query("crime_types", "SELECT DISTINCT crime_type FROM m_cases WHERE crime_type IS NOT NULL")
def _(m):
    return R.crime_types(m.m_cases)


@query("users_with_org", """
SELECT u.user_id, u.name, u.email, u.service_id, u.designation, u.role, o.name AS org_name
FROM m_users u LEFT JOIN m_orgs o ON o.org_id = u.org_id""")
def _(m):
    return A.users_with_org(m.m_users, m.m_orgs)


@query("roles_with_permissions", """
SELECT r.role_id, r.code, p.code AS permission_code FROM m_roles r JOIN m_role_permissions p ON p.role_id = r.role_id""")
def _(m):
    held = A.roles_with_permissions(m.m_roles, m.m_role_permissions)
    return held.select("role_id", "code", F.explode("permission_codes").alias("permission_code"))
