"""Detection, tagging, text quality and redaction over the documents table."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions import patterns as P
from casemesh.functions import text as X
from casemesh.operators import detect, redact, spans
from casemesh.plans.listing_queries import quoted
from casemesh.plans.models import span_sql, spelled_span_sql
from casemesh.plans.registry import query
from casemesh.session import spread

ROLES_SHOWN = ("defense", "duty_officer", "cyber_cell", "court", "records_ncrb_analyst")


# Every eighth document starts with one of these, their words apart by white space beyond ASCII.
PLANTED = "concat(CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate((
    "call +91\u00a098765\u00a043210 or 98765\u200943210. ", "Accused: Mr\u00a0Rajesh\u2003Kumar 12. ", "son\u00a0of: Ram\u202fPrasad 7. ",
    "a stab\u00a0wound, head\u2009injury, éfracture. ", "named\u00a0Sunita\u3000Rao 3. ", "PAN ABCDE1234F, ABCDE 12O4 F, éABCDE1234F; ",
    "id 2345 6789 0123, a.b@c.example, é2345 6789 0123. "))) + " ELSE '' END, text)"
SPELLED = tuple(P.PHONE_AS_PRINTED if r is P.PHONE else r for r in P.LEGAL_RECOGNIZERS)


@query("detected_entities", f"""
WITH documents AS (SELECT doc_id, {PLANTED} AS text FROM documents)
SELECT doc_id, entity_type, span_start, span_end, confidence FROM ({spelled_span_sql(SPELLED)})""")
def _(m):
    docs = spread(m.documents.select("doc_id", "text")).selectExpr("doc_id", f"{PLANTED} AS text")
    return detect.explode_spans(detect.detect_entities(docs, "text", SPELLED), "doc_id")


@query("detected_listed_entities",
       f"SELECT doc_id, entity_type, span_start, span_end, confidence FROM ({span_sql(P.PLAIN_RECOGNIZERS)})")
def _(m):
    found = detect.detect_entities(spread(m.documents.select("doc_id", "text")), "text", P.PLAIN_RECOGNIZERS)
    return detect.explode_spans(found, "doc_id")


@query("detector_slot", f"""
SELECT doc_id, entity_type, span_start, span_end, confidence FROM ({span_sql((P.US_PHONE, P.IP_ADDRESS))})""")
def _(m):
    """A detector of the user's own, here a plain pattern, merged with a registry row."""
    rx = re.compile(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}")

    @F.pandas_udf(detect.SPANS)
    def own(texts: pd.Series) -> pd.Series:
        def found(text: str) -> list[dict]:
            return [{"entity_type": "PHONE_NUMBER", "span_start": hit.start(), "span_end": hit.end(), "confidence": 75}
                    for hit in rx.finditer(text)]
        return texts.map(found)

    listed = detect.detect_entities(spread(m.documents.select("doc_id", "text")), "text", [P.IP_ADDRESS])
    return detect.explode_spans(detect.with_detector(listed, own), "doc_id")


def id_text(engine: str) -> str:
    return "concat('Ref DL-POL-', n_chars, ' bar D/', n_chars % 1000, '/20', 10 + doc_id % 90, ' ', text)"


@query("detected_ids", f"""
WITH documents AS (SELECT doc_id, {id_text('sql')} AS text FROM documents)
SELECT doc_id, entity_type, span_start, span_end, confidence FROM ({span_sql(P.ID_RECOGNIZERS)})""")
def _(m):
    docs = spread(m.documents).selectExpr("doc_id", f"{id_text('spark')} AS text")
    return detect.explode_spans(detect.detect_ids(docs), "doc_id", spans="id_spans").drop("value")


@query("protected_ranges")
def _(m):
    docs = spread(m.documents).selectExpr("doc_id", "concat('P.S. No. ', doc_id, ' u/s 154 Cr.P.C., 379/411 IPC. ', text) AS text")
    return detect.explode_spans(docs.select("doc_id", spans.protected_ranges(F.col("text")).alias("spans")), "doc_id")


CITED = "concat('P.S. No. ', doc_id, ' u/s ', 100 + n_chars % 300, ' Cr.P.C., 379/411 IPC and 303(2) BNS. ', text)"
CITATION = P.CITATION


@query("statute_citations", f"""
WITH documents AS (SELECT doc_id, {CITED} AS text FROM documents)
SELECT doc_id, entity_type, span_start, span_end, confidence FROM ({span_sql((CITATION,))})""")
def _(m):
    docs = spread(m.documents).selectExpr("doc_id", f"{CITED} AS text")
    return detect.explode_spans(detect.detect_entities(docs, "text", [CITATION]), "doc_id")


# Greedy choice by (confidence, length, start, order found), one candidate per step and document.
RESOLVE = """
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, span_end - span_start DESC,
    span_start, found) AS i FROM cand),
k AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(s INT, e INT)[]) AS kept, CAST(NULL AS VARCHAR) AS entity_type,
    CAST(NULL AS INT) AS span_start, CAST(NULL AS INT) AS span_end, CAST(NULL AS INT) AS confidence, false AS keep
  FROM (SELECT DISTINCT doc_id FROM cand)
  UNION ALL
  SELECT doc_id, i, CASE WHEN free THEN list_append(kept, {'s': span_start, 'e': span_end}) ELSE kept END,
    entity_type, span_start, span_end, confidence, free
  FROM (SELECT r.*, k.kept, len(list_filter(k.kept, lambda x: r.span_start < x.e AND x.s < r.span_end)) = 0 AS free
        FROM k JOIN r ON r.doc_id = k.doc_id AND r.i = k.i + 1))"""

ALL_PLAIN = P.PLAIN_RECOGNIZERS + (P.AADHAAR, P.PHONE_AS_PRINTED)
CANDIDATES = "SELECT doc_id, entity_type, span_start, span_end, confidence, found FROM (" + " UNION ALL ".join(
    f"SELECT *, {i * 1000000} + span_start AS found FROM ({span_sql((r,))})" for i, r in enumerate(ALL_PLAIN)) + ")"


@query("overlaps_resolved", f"""
WITH cand AS ({CANDIDATES}), {RESOLVE}
SELECT doc_id, entity_type, span_start, span_end, confidence FROM k WHERE keep""")
def _(m):
    found = detect.detect_entities(spread(m.documents.select("doc_id", "text")), "text", ALL_PLAIN)
    kept = found.select("doc_id", spans.resolve_overlaps(F.col("spans")).alias("spans"))
    return detect.explode_spans(kept, "doc_id")


@query("document_tags")
def _(m):
    return spans.tag_documents(spread(m.m_docs.select("doc_id", "raw_text")))


@query("document_tag_status")
def _(m):
    return spans.tag_status(spread(m.m_docs.select("doc_id", "raw_text"))).withColumn("entity_types", F.array_join("entity_types", ","))


@query("tags_refreshed", """
SELECT * FROM m_tags WHERE source <> 'ai_parser'
UNION ALL SELECT doc_id, entity_type, span_start + 1, span_end, confidence, source FROM m_tags
  WHERE source = 'ai_parser' AND entity_type = 'EMAIL_ADDRESS'""")
def _(m):
    new = m.m_tags.filter("source = 'ai_parser' AND entity_type = 'EMAIL_ADDRESS'").withColumn(
        "span_start", F.col("span_start") + 1)
    return spans.refresh_tags(m.m_tags, new)


SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]"
STATS = rf"""st AS (SELECT doc_id, clean, regexp_replace(clean, '{SPACE}', '', 'g') AS dense,
    CASE WHEN clean = '' THEN [] ELSE string_split_regex(clean, '{SPACE}+') END AS toks
  FROM (SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS clean FROM documents)),
 s AS (SELECT doc_id, length(clean) AS chars, length(dense) AS non_space,
    length(dense) - length(regexp_replace(dense, '[\p{{L}}\p{{N}}]', '', 'g')) AS alnum, len(toks) AS tokens,
    len(list_filter(toks, lambda t: regexp_full_match(t, '[\p{{L}}\p{{N}}]'))) AS single_tokens FROM st)"""


@query("text_statistics", f"""
WITH {STATS} SELECT *, round(alnum / non_space, 6) AS alnum_ratio, round(single_tokens / tokens, 6) AS single_ratio
FROM s""")
def _(m):
    from casemesh.operators.reports import text_statistics
    return text_statistics(spread(m.documents.select("doc_id", "text")), "text")


@query("text_quality", f"""
WITH {STATS} SELECT doc_id, CASE WHEN chars < 30 OR non_space = 0 THEN 'ok'
  WHEN non_space > 40 AND alnum / non_space < 0.5 THEN 'low_alnum'
  WHEN tokens >= 10 AND single_tokens / tokens > 0.45 THEN 'fragmented' ELSE 'ok' END AS verdict FROM s""")
def _(m):
    return spread(m.documents.select("doc_id", "text")).select("doc_id", X.quality_verdict(X.text_stats(F.col("text"))).alias("verdict"))


@query("text_chunks", """
WITH RECURSIVE c AS (
  SELECT doc_id, text, CAST(0 AS BIGINT) AS "offset", CAST(NULL AS VARCHAR) AS chunk, CAST(0 AS BIGINT) AS next FROM documents
  UNION ALL
  SELECT doc_id, text, next, substring(win, 1, keep), next + keep FROM (
    SELECT doc_id, text, next, win, CASE WHEN next + 1000 >= length(text) THEN length(win)
        WHEN line > 1 THEN line WHEN word > 1 THEN word ELSE length(win) END AS keep
    FROM (SELECT doc_id, text, next, win, CASE WHEN contains(win, chr(10)) THEN length(win) - instr(reverse(win), chr(10)) + 1
            ELSE 0 END AS line, CASE WHEN contains(win, ' ') THEN length(win) - instr(reverse(win), ' ') + 1 ELSE 0 END AS word
          FROM (SELECT doc_id, text, next, substring(text, next + 1, 1000) AS win FROM c WHERE next < length(text)))))
SELECT doc_id, CAST("offset" AS INT) AS "offset", CAST(length(chunk) AS INT) AS chars, sha256(chunk) AS hash
FROM c WHERE chunk IS NOT NULL""")
def _(m):
    pieces = m.documents.select("doc_id", F.explode(X.chunk_text(F.col("text"), 1000)).alias("p"))
    return pieces.select("doc_id", "p.offset", F.length("p.chunk").alias("chars"), F.sha2("p.chunk", 256).alias("hash"))


# --- redaction --------------------------------------------------------------------------------

ROLE_VALUES = "(VALUES " + ", ".join(f"('{r}')" for r in ROLES_SHOWN) + ") AS roles(role)"
RULED = f"""wanted AS (SELECT DISTINCT roles.role, d.doc_type, t.entity_type FROM m_tags t JOIN m_docs d USING (doc_id),
    {ROLE_VALUES}),
  hit AS (SELECT w.*, p.action, p.min_confidence, row_number() OVER (PARTITION BY w.role, w.doc_type, w.entity_type
      ORDER BY (p.role = w.role) DESC, (p.doc_type = w.doc_type) DESC, (p.entity_type = w.entity_type) DESC) AS rn
    FROM wanted w LEFT JOIN m_policies p ON p.role IN (w.role, '*') AND p.doc_type IN (w.doc_type, '*')
      AND p.entity_type IN (w.entity_type, '*')),
  ruled AS (SELECT role, doc_type, entity_type, action, min_confidence FROM hit WHERE rn = 1)"""


@query("policy_resolved", f"WITH {RULED} SELECT * FROM ruled")
def _(m):
    wanted = redact.for_roles(m.m_tags.join(m.m_docs.select("doc_id", "doc_type"), "doc_id"), ROLES_SHOWN)
    return redact.resolve_policy(wanted, m.m_policies)


# Masking order, one span per step and document, carrying the cursor.
KEPT = """o AS (SELECT t.doc_id, t.entity_type, t.span_start, t.span_end, coalesce(t.confidence, 0) AS confidence,
    row_number() OVER (PARTITION BY t.doc_id ORDER BY t.span_start, coalesce(t.confidence, 0) DESC, t.span_end,
      t.entity_type) AS i, length(d.raw_text) AS size, d.doc_type FROM m_tags t JOIN m_docs d USING (doc_id)),
  w AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, 0 AS cur, false AS keep, 0 AS prev FROM (SELECT DISTINCT doc_id FROM o)
    UNION ALL SELECT o.doc_id, o.i, CASE WHEN o.span_start >= w.cur AND o.span_start <= size AND o.span_end <= size
        THEN o.span_end ELSE w.cur END,
      o.span_start >= w.cur AND o.span_start <= size AND o.span_end <= size, w.cur
    FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1),
  kept AS (SELECT o.*, w.prev FROM o JOIN w ON w.doc_id = o.doc_id AND w.i = o.i WHERE w.keep),
  did AS (SELECT k.*, r.role, CASE WHEN r.action IN ('show', 'flag') AND k.confidence >= r.min_confidence
      THEN r.action ELSE 'mask' END AS action
    FROM kept k JOIN ruled r ON r.doc_type = k.doc_type AND r.entity_type = k.entity_type)"""


@query("span_decisions", f"""
WITH {RULED}, {KEPT} SELECT doc_id, doc_type, role, entity_type, span_start, span_end, action FROM did""")
def _(m):
    return redact.span_decisions(m.m_docs, m.m_tags, m.m_policies, ROLES_SHOWN)


@query("masked_span_counts", f"""
WITH {RULED}, {KEPT} SELECT role, entity_type, action, count(*) AS spans, count(DISTINCT doc_id) AS documents
FROM did GROUP BY role, entity_type, action""")
def _(m):
    done = redact.span_decisions(m.m_docs, m.m_tags, m.m_policies, ROLES_SHOWN)
    return done.groupBy("role", "entity_type", "action").agg(
        F.count(F.lit(1)).alias("spans"), F.countDistinct("doc_id").alias("documents"))


TEXTS = f"""WITH {RULED}, {KEPT},
 body AS (SELECT did.doc_id, did.role, string_agg(concat(substring(d.raw_text, prev + 1, span_start - prev),
     CASE action WHEN 'mask' THEN concat('[REDACTED:', entity_type, ']')
       WHEN 'flag' THEN concat(substring(d.raw_text, span_start + 1, span_end - span_start), ' [UNCONFIRMED:', entity_type, ']')
       ELSE substring(d.raw_text, span_start + 1, span_end - span_start) END), '' ORDER BY i) AS head,
     max(span_end) AS last FROM did JOIN m_docs d USING (doc_id) GROUP BY did.doc_id, did.role),
 red AS (SELECT d.doc_id, d.doc_type, d.status, d.raw_text, roles.role,
     CASE WHEN b.head IS NULL THEN d.raw_text ELSE concat(b.head, substring(d.raw_text, b.last + 1)) END AS text
   FROM m_docs d CROSS JOIN {ROLE_VALUES} LEFT JOIN body b ON b.doc_id = d.doc_id AND b.role = roles.role)"""


@query("documents_redacted", f"{TEXTS} SELECT doc_id, doc_type, role, text FROM red")
def _(m):
    return redact.redact(m.m_docs, m.m_tags, m.m_policies, ROLES_SHOWN)


FULL = f"role IN ({quoted(K.FULL_TEXT_ROLES)})"


@query("document_views", f"""{TEXTS}
SELECT doc_id, role, status, CASE WHEN {FULL} AND status IN ('ready', 'needs_review') THEN raw_text
  WHEN status = 'ready' THEN text END AS text FROM red""")
def _(m):
    return redact.document_view(m.m_docs, m.m_tags, m.m_policies, ROLES_SHOWN)


@query("policy_preview", f"""{TEXTS}
SELECT doc_id, doc_type, role, {FULL} AS full_text_access, status <> 'ready' AS withheld_pending_review,
  CASE WHEN {FULL} THEN raw_text ELSE text END AS text FROM red""")
def _(m):
    return redact.preview(m.m_docs, m.m_tags, m.m_policies, ROLES_SHOWN)


@query("diary_redacted")
def _(m):
    tags = spans.tag_documents(m.m_diary, "entry_id", "text")
    return redact.redact_diary(m.m_diary, tags, "cyber_cell")
