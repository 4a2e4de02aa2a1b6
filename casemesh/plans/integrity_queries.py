"""Audit log, ledger, state machines and rate limits over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators import anchor as N
from casemesh.operators import audit as U
from casemesh.operators import cases as C
from casemesh.operators import machine, rate
from casemesh.plans.registry import query
from casemesh.session import shared_dir
from casemesh.sources import tables

BITS = 6  # sealed in chains of 64 rows, so that the compared SQL recurses 64 times

CONTENT = """to_json({'action': action, 'actor_user_id': CAST(actor_user_id AS VARCHAR),
  'case_id': CAST(case_id AS VARCHAR), 'created_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f+00:00'),
  'metadata': metadata, 'target_id': CAST(target_id AS VARCHAR), 'target_type': target_type})"""
SEALED = f"""c AS (SELECT *, seq >> {BITS} AS chain, {CONTENT} AS body,
    row_number() OVER (PARTITION BY seq >> {BITS} ORDER BY seq) AS i FROM m_audit),
 s AS (SELECT chain, i, seq, CAST(NULL AS VARCHAR) AS prev_hash, sha256(concat('None|', body)) AS row_hash FROM c WHERE i = 1
   UNION ALL SELECT c.chain, c.i, c.seq, s.row_hash, sha256(concat(s.row_hash, '|', c.body))
   FROM s JOIN c ON c.chain = s.chain AND c.i = s.i + 1)"""


def _sealed(m):
    return U.seal(m.m_audit, BITS)


@query("audit_canonical", f"SELECT seq, CAST({CONTENT} AS VARCHAR) AS body FROM m_audit")
def _(m):
    return m.m_audit.select("seq", U.canonical().alias("body"))


@query("audit_sealed", f"WITH {SEALED} SELECT chain, seq, prev_hash, row_hash FROM s")
def _(m):
    return _sealed(m).select("chain", "seq", "prev_hash", "row_hash")


@query("audit_chain_heads", f"""
WITH {SEALED} SELECT chain, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows,
  arg_max(row_hash, seq) AS head_hash FROM s GROUP BY chain""")
def _(m):
    return U.chain_heads(_sealed(m))


# A log in which the entries of one kind were edited after sealing and those of one case removed.
TAMPERED = f"""{SEALED}, log AS (SELECT a.seq, a.case_id, a.actor_user_id, a.action, a.target_type, a.target_id,
    CASE WHEN a.action = 'login_failed' AND a.target_id < 50 THEN concat(a.metadata, ' ') ELSE a.metadata END AS metadata,
    a.created_at, s.chain, s.prev_hash, s.row_hash
  FROM m_audit a JOIN s USING (seq) WHERE a.case_id <> 11),
 links AS (SELECT seq, case_id, chain, row_hash, sha256(concat(coalesce(prev_hash, 'None'), '|', {CONTENT})) = row_hash
    AND prev_hash IS NOT DISTINCT FROM lag(row_hash) OVER (PARTITION BY chain ORDER BY seq) AS ok FROM log)"""


def _tampered(m):
    edited = (F.col("action") == "login_failed") & (F.col("target_id") < 50)
    log = _sealed(m).filter("case_id <> 11")
    return log.withColumn("metadata", F.when(edited, F.concat("metadata", F.lit(" "))).otherwise(F.col("metadata")))


@query("audit_links_checked", f"WITH {TAMPERED} SELECT chain, seq, case_id, row_hash, ok FROM links")
def _(m):
    return U.check_links(_tampered(m), ["chain"])


@query("audit_chain_verdict", f"""
WITH {TAMPERED} SELECT bool_and(ok) AS chain_intact, min(seq) FILTER (NOT ok) AS first_broken_seq,
  count(*) AS total_rows FROM links""")
def _(m):
    return U.chain_intact(U.check_links(_tampered(m), ["chain"]))


@query("audit_case_chain", f"""
WITH {SEALED}, log AS (SELECT a.*, s.chain, s.prev_hash, s.row_hash FROM m_audit a JOIN s USING (seq)),
 links AS (SELECT seq, case_id, row_hash, sha256(concat(coalesce(prev_hash, 'None'), '|', {CONTENT})) = row_hash
    AND prev_hash IS NOT DISTINCT FROM lag(row_hash) OVER (PARTITION BY chain ORDER BY seq) AS ok FROM log),
 v AS (SELECT bool_and(ok) AS v FROM links)
SELECT case_id, any_value(v.v) AS chain_intact, count(*) AS total_entries,
  CASE WHEN any_value(v.v) THEN arg_max(row_hash, seq) END AS latest_hash FROM links, v GROUP BY case_id""")
def _(m):
    return U.case_chain(U.check_links(_sealed(m), ["chain"]))


@query("audit_anchor_checked", f"""
WITH {TAMPERED}, h AS (SELECT chain, count(*) AS n, arg_max(row_hash, seq) AS head FROM s GROUP BY chain),
 now AS (SELECT chain, count(*) AS n, arg_max(row_hash, seq) AS head FROM log GROUP BY chain)
SELECT chain, CASE WHEN now.n IS NULL THEN 'chain_missing' WHEN h.n <> now.n THEN 'row_count_differs'
  WHEN h.head <> now.head THEN 'head_differs' ELSE 'ok' END AS state FROM h LEFT JOIN now USING (chain)""")
def _(m):
    return U.check_anchor(_tampered(m), U.chain_heads(_sealed(m)))


# A log of which some chains were dropped or sealed anew together with their stored heads.
LEAF = "sha256(concat_ws('|', 'head', chain, first_seq, last_seq, rows, head_hash))"
HEADS = f"""{SEALED}, heads AS (SELECT chain, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS rows,
  arg_max(row_hash, seq) AS head_hash FROM s GROUP BY chain)"""


def _level(number: int) -> str:
    return (f"l{number} AS (SELECT node >> 4 AS node, sha256(concat('node|', string_agg(concat(node, ':', digest), '|' ORDER BY node))) "
            f"AS digest FROM l{number - 1} WHERE (SELECT max(node) FROM l{number - 1}) > 0 GROUP BY 1)")


TREE = f"{HEADS}, l0 AS (SELECT chain AS node, {LEAF} AS digest FROM heads), " + ", ".join(map(_level, range(1, 6)))


def _heads(m):
    """Heads as a job keeps them: stored, apart from the log."""
    path = f"{shared_dir(m.spark)}/heads/{uuid.uuid4().hex}"
    U.chain_heads(_sealed(m)).write.parquet(path)
    return m.spark.read.parquet(path)


@query("audit_hash_tree", f"WITH {TREE} " + " UNION ALL ".join(
    f"SELECT CAST({n} AS INT) AS level, node, digest FROM l{n}" for n in range(6)))
def _(m):
    return N.hash_tree(_heads(m))


@query("audit_anchor_rewritten", f"""
WITH {HEADS} SELECT chain, CASE chain % 5 WHEN 1 THEN 'chain_missing' WHEN 2 THEN 'head_differs' ELSE 'ok' END AS state,
  true AS root_holds FROM heads""")
def _(m):
    """Chains dropped or rewritten with their heads pass ``check_anchor`` and show against the tree."""
    heads = _heads(m)
    tree = N.hash_tree(heads)
    edited = m.m_audit.filter((F.col("seq") / 2 ** BITS).cast("long") % 5 != 1).withColumn("metadata", F.when(
        (F.col("seq") / 2 ** BITS).cast("long") % 5 == 2, F.concat("metadata", F.lit(" "))).otherwise(F.col("metadata")))
    forged = U.chain_heads(U.seal(edited, BITS))
    return N.check_tree(forged, tree, N.root(tree))


@query("audit_heads_proved", f"""
WITH {HEADS} SELECT chain, chain % 3 <> 0 AS proved FROM heads WHERE chain % 2 = 0""")
def _(m):
    """Every second head is proved by its own path; a third of them name another hash."""
    heads = _heads(m)
    tree = N.hash_tree(heads)
    some = heads.filter("chain % 2 = 0")
    told = some.withColumn("head_hash", F.when(F.col("chain") % 3 == 0, F.reverse("head_hash")).otherwise(F.col("head_hash")))
    return N.proved(told, N.prove(tree, some), N.root(tree)).select("chain", "proved")


@query("audit_committed", f"""
WITH {SEALED} SELECT seq, chain, row_hash FROM s WHERE chain % 3 <> 2""")
def _(m):
    """Two of three batches of sealed rows are appended, one of them twice; the third fails before its commit."""
    path, sealed = f"{shared_dir(m.spark)}/committed/{uuid.uuid4().hex}", _sealed(m).select("seq", "chain", "row_hash")
    for name, part in (("a", 0), ("b", 1), ("a", 0)):
        tables.commit_append(sealed.filter(F.col("chain") % 3 == part), path, name)
    sealed.filter("chain % 3 = 2").write.parquet(f"{path}/data/unfinished")
    return tables.read_committed(m.spark, path, sealed.schema)


@query("rules_replaced", "SELECT role, doc_type, entity_type, 'show' AS action, min_confidence FROM m_policies WHERE min_confidence >= 50")
def _(m):
    """A rule set replaced by another, the replacement repeated, and one that fails before its commit."""
    path, rules = f"{shared_dir(m.spark)}/committed/{uuid.uuid4().hex}", m.m_policies
    tables.commit_replacement(rules, path, "first")
    new = rules.filter("min_confidence >= 50").withColumn("action", F.lit("show"))
    for _ in range(2):
        tables.commit_replacement(new, path, "second")
    rules.limit(0).write.parquet(f"{path}/data/unfinished")
    return tables.read_committed(m.spark, path, new.schema)


@query("audit_slice_links", """
SELECT case_id, seq, lag(seq) OVER w AS previous_seq, CASE WHEN lag(seq) OVER w IS NULL THEN seq = 1
  ELSE lag(seq) OVER w = seq - 1 END AS linked FROM m_audit WINDOW w AS (PARTITION BY case_id ORDER BY seq)""")
def _(m):
    return U.slice_links(m.m_audit)


@query("audit_seq_assigned", """
SELECT event_id, event_type, 5000 + row_number() OVER (ORDER BY event_id) AS seq FROM events WHERE event_type <> 'view'""")
def _(m):
    batch = m.events.filter("event_type <> 'view'").select("event_id", "event_type")
    return U.assign_seq(batch, 5000, "event_id")


# --- state machines: one event per step and case -----------------------------------------------

def machine_sql(moves, events: str, first: str) -> str:
    table = "(VALUES " + ", ".join(f"('{a}', '{x}', '{b}')" for a, x, b in moves) + ") AS mv(a, x, b)"
    return f"""ev AS ({events}),
 e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS i FROM ev),
 mv AS (SELECT * FROM {table}), init AS ({first}),
 run AS (SELECT k.case_id, CAST(0 AS BIGINT) AS i, init.state AS state FROM (SELECT DISTINCT case_id FROM e) k
     LEFT JOIN init ON init.case_id = k.case_id
   UNION ALL SELECT e.case_id, e.i, CASE WHEN e.blocked IS NULL THEN coalesce(mv.b, run.state) ELSE run.state END
   FROM run JOIN e ON e.case_id = run.case_id AND e.i = run.i + 1 LEFT JOIN mv ON mv.a = run.state AND mv.x = e.action),
 applied AS (SELECT e.case_id, e.seq, e.action, p.state AS from_state, e.blocked IS NULL AND mv.b IS NOT NULL AS accepted,
     n.state AS to_state, CASE WHEN p.state IS NULL THEN 'case_not_found'
     WHEN e.blocked IS NOT NULL THEN e.blocked WHEN mv.b IS NULL THEN 'illegal_move' END AS reason
   FROM e JOIN run p ON p.case_id = e.case_id AND p.i = e.i - 1 JOIN run n ON n.case_id = e.case_id AND n.i = e.i
   LEFT JOIN mv ON mv.a = p.state AND mv.x = e.action)"""


BAIL = machine_sql(K.BAIL_MOVES, "SELECT case_id, seq, action, CAST(NULL AS VARCHAR) AS blocked FROM m_bail_events",
                   "SELECT case_id, coalesce(bail_status, '') AS state FROM m_cases")


def _bail(m):
    initial = m.m_cases.select("case_id", F.coalesce("bail_status", F.lit("")).alias("state"))
    return machine.apply_bail(m.m_bail_events, initial, bits=12)


@query("bail_events_applied", f"WITH {BAIL} SELECT * FROM applied")
def _(m):
    return _bail(m)


@query("bail_final_states", f"""
WITH {BAIL} SELECT case_id, arg_max(to_state, seq) AS state, count(*) FILTER (accepted) AS accepted_events,
  count(*) FILTER (NOT accepted) AS rejected_events FROM applied GROUP BY case_id""")
def _(m):
    return machine.final_states(_bail(m))


GATE = """unmet AS (
  SELECT DISTINCT c.case_id FROM m_cases c JOIN m_stage_requirements s ON s.crime_type = c.crime_type AND s.mandatory
  WHERE (s.requirement_type = 'document' AND NOT EXISTS (SELECT 1 FROM m_docs d WHERE d.case_id = c.case_id
      AND d.doc_type = s.requirement_key))
    OR (s.requirement_type = 'evidence_request' AND NOT EXISTS (SELECT 1 FROM m_requests r WHERE r.case_id = c.case_id
      AND r.doc_type_expected = s.requirement_key AND r.status = 'completed')))"""
STEPS = """SELECT event_id AS seq, event_id % 5000 AS case_id, CASE WHEN event_type IN ('view', 'click')
    THEN 'file_charge_sheet' WHEN event_type = 'purchase' THEN 'trial_hearing' ELSE 'judgment' END AS action,
  CASE WHEN value > 6 THEN ' Convicted' WHEN value > 4 THEN 'acquitted' ELSE 'dismissed' END AS verdict FROM events"""
CASE_RUN = machine_sql(
    K.CASE_MOVES,
    f"SELECT st.*, CASE WHEN action = 'file_charge_sheet' AND u.case_id IS NOT NULL THEN 'missing_requirements' "
    f"WHEN action = 'judgment' AND lower(trim(verdict)) NOT IN ('acquitted', 'convicted') THEN 'bad_verdict' END AS blocked "
    f"FROM ({STEPS}) st LEFT JOIN unmet u ON u.case_id = st.case_id",
    "SELECT case_id, investigation_status AS state FROM m_cases")


@query("case_events_applied", f"WITH {GATE}, {CASE_RUN} SELECT * FROM applied")
def _(m):
    steps = m.events.selectExpr(
        "event_id AS seq", "event_id % 5000 AS case_id",
        "CASE WHEN event_type IN ('view', 'click') THEN 'file_charge_sheet' WHEN event_type = 'purchase' "
        "THEN 'trial_hearing' ELSE 'judgment' END AS action",
        "CASE WHEN value > 6 THEN ' Convicted' WHEN value > 4 THEN 'acquitted' ELSE 'dismissed' END AS verdict")
    gate = C.charge_sheet_ready(m.m_cases, m.m_stage_requirements, m.m_docs, m.m_requests)
    initial = m.m_cases.select("case_id", F.col("investigation_status").alias("state"))
    return machine.apply_case(steps, initial, gate)


# --- rate limits -------------------------------------------------------------------------------

DAY = 86400


@query("login_window_counts", f"""
SELECT l.account, l.seq, l.ts, l.succeeded, (SELECT count(*) FROM m_logins p WHERE p.account = l.account
  AND p.ts > l.ts - INTERVAL '{DAY}' SECOND AND p.ts <= l.ts) AS in_window FROM m_logins l""")
def _(m):
    return rate.window_counts(m.m_logins, "account", DAY)


LIVE = f"""e AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY account ORDER BY seq) AS i FROM m_logins),
 live AS (SELECT account, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS seq,
     CAST(NULL AS TIMESTAMP) AS ts, false AS allowed, CAST(NULL AS INT) AS retry_after FROM (SELECT DISTINCT account FROM e)
   UNION ALL SELECT account, i, CASE WHEN len(now) >= 3 THEN now WHEN succeeded THEN CAST([] AS BIGINT[])
       ELSE list_append(now, t) END, seq, ts, len(now) < 3,
     CASE WHEN len(now) >= 3 THEN CAST(greatest(1, trunc((now[1] + {DAY}000000 - t) / 1000000.0) + 1) AS INT) END
   FROM (SELECT e.*, list_filter(live.seen, lambda x: x > e.t - {DAY}000000) AS now
     FROM live JOIN e ON e.account = live.account AND e.i = live.i + 1))"""


@query("login_rate_verdicts", f"WITH {LIVE} SELECT account, seq, ts, allowed, retry_after FROM live WHERE i > 0")
def _(m):
    return rate.rate_verdicts(m.m_logins, "account", 3, DAY, clears="succeeded")
