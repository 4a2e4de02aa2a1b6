"""Model tables (cases, users, audit rows, ...) as projections of the supplied tables.

Every model is declared once and rendered twice: as a DataFrame and as a SQL sub-query, so that a
query and the statement it is compared with start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions import patterns as P
from casemesh.operators import detect
from casemesh.session import spread
from casemesh.sources.tables import load_supplied

ROLES = (
    "io", "sho", "duty_officer", "defense", "external_authority", "court", "prosecutor",
    "records_ncrb_analyst", "config_admin", "security_auditor", "cyber_cell", "women_cell",
    "traffic_police", "counselor",
)
CRIMES = ("Homicide", "Cybercrime (UPI)", "theft", "Public Nuisance", "Road Accident")
DOC_TYPES = (("en", "FIR"), ("fr", "Witness Statement"), ("de", "Medico-Legal Report"), ("es", "Charge Sheet"))


def pick(index: str, values) -> str:
    """SQL CASE giving ``values[index]``; None becomes NULL."""
    arms = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"CASE {index} {arms} END"


def choose(column: str, pairs) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs)
    return f"CASE {column} {arms} END"


CRIME_BY_PRIORITY = choose("o_orderpriority", zip(
    ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), CRIMES))

# name -> (source table, [(column, expression) or (column, spark, duckdb)], condition, distinct)
PROJECTIONS: dict[str, tuple] = {
    "m_orgs": ("supplier", [
        ("org_id", "s_suppkey"), ("name", "s_name"),
        ("org_type", pick("s_suppkey % 10", K.ORG_TYPES)),
    ], None, False),
    "m_users": ("customer", [
        ("user_id", "c_custkey"), ("org_id", "CAST(c_nationkey AS BIGINT)"),
        ("role", pick("c_custkey % 14", ROLES)),
        ("role_id", "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 "
                    "THEN (c_custkey + 1) % 14 ELSE c_custkey % 14 END"),
        ("service_id", "concat('DL-POL-', c_custkey)"), ("designation", "c_mktsegment"),
        ("name", "c_name"), ("email", "lower(concat(c_name, '@records.example'))"),
    ], None, False),
    "m_roles": ("customer", [
        ("role_id", "c_custkey % 14"), ("code", pick("c_custkey % 14", ROLES)),
    ], None, True),
    "m_permissions": ("part", [
        ("code", "concat(lower(p_type), ':', lower(p_brand))"), ("category", "lower(p_type)"),
    ], None, True),
    "m_role_permissions": ("part", [
        ("role_id", "p_partkey % 14"), ("code", "concat(lower(p_type), ':', lower(p_brand))"),
    ], None, True),
    "m_cases": ("orders", [
        ("case_id", "o_orderkey"), ("case_number", "concat('FIR-', o_orderkey)"),
        ("crime_type", CRIME_BY_PRIORITY),
        ("court_level", pick("o_custkey % 3", ("Magistrate", "Sessions", None))),
        ("investigation_status",
         "CASE o_orderstatus WHEN 'F' THEN 'Charge_Sheet_Filed' WHEN 'P' THEN "
         + pick("o_orderkey % 2", ("Trial", "Judgment")) + " ELSE "
         + pick("o_orderkey % 3", ("FIR_Registered", "Evidence_Collection", "Charge_Sheet_Ready")) + " END"),
        ("bail_status", pick("o_custkey % 9", (
            None, "Arrested", "Application_Filed", "Hearing_Scheduled", "Order_Issued",
            "Surety_Registered", "Denied_Final", "Absconded", None))),
        ("org_id", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey % 25 END"),
        ("registered_by_user_id", "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END"),
        ("created_at", "o_orderdate"),
    ], None, False),
    "m_assign": ("orders", [
        ("case_id", "o_orderkey"),
        ("io_user_id", "o_custkey - (o_custkey % 14) + CASE WHEN o_orderstatus = 'P' THEN 10 ELSE 0 END"),
        ("assigned_at", "o_orderdate"),
    ], "o_orderpriority <> '4-NOT SPECIFIED'", False),
    "m_parties": ("orders", [
        ("case_id", "o_orderkey"), ("user_id", "o_custkey - (o_custkey % 14) + 3"),
        ("party_role", choose("o_orderpriority", (
            ("1-URGENT", "defense"), ("2-HIGH", "defense"), ("3-MEDIUM", "witness"), ("5-LOW", "defense")))),
        ("recorded_by_user_id", "o_custkey"),
    ], "o_orderstatus <> 'O'", False),
    "m_bench": ("benchmark", [("item_id", "item_id"), ("text", "text")], None, False),
    "m_docs": ("documents", [
        ("doc_id", "doc_id"), ("case_id", "doc_id >> 2", "doc_id >> 2"),
        ("doc_type", choose("lang", DOC_TYPES)), ("version", "CAST(doc_id % 4 + 1 AS INT)"),
        ("raw_text", "text"), ("doc_hash", "sha2(text, 256)", "sha256(text)"),
        ("status", pick("n_chars % 3", ("ready", "needs_review", "processing"))),
        ("chain_status", pick("n_chars % 4", ("pending", "confirmed", "failed", "confirmed"))),
        ("retention_legal_hold", "n_chars % 5 = 0"), ("uploaded_by", "n_chars % 2000"),
        ("created_at", "timestampadd(MINUTE, CAST(doc_id * 7 % 100003 AS INT), TIMESTAMP '2024-01-01 00:00:00')",
         "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id * 7 % 100003)"),
    ], None, False),
    "m_audit": ("events", [
        ("seq", "event_id + 1"), ("case_id", "user_id"),
        ("actor_user_id", "CASE WHEN event_type = 'view' THEN NULL ELSE user_id END"),
        ("action", choose("event_type", (
            ("view", "document_sensitivity_tagged"), ("click", "redact_tag_correction"),
            ("purchase", "evidence_request_fulfilled"), ("signup", "fir_registered"), ("error", "login_failed")))),
        ("target_type", choose("event_type", (
            ("view", "document"), ("click", "document"), ("purchase", "evidence_request"),
            ("signup", "case"), ("error", "user")))),
        ("target_id", "event_id % 997"),
        ("metadata", "concat('{\"entity_type\":\"', upper(event_type), '\",\"confidence\":', "
                     "CAST(floor(value) AS BIGINT), ',\"span_start\":', event_id % 50, ',\"span_end\":', "
                     "event_id % 50 + 7, '}')"),
        ("created_at", "ts"),
    ], None, False),
    "m_diary": ("conversations", [
        ("entry_id", "conv_id * 1000 + turn"), ("case_id", "conv_id"), ("author_role", "role"),
        ("text", "text"), ("status", pick("turn % 3", ("ready", "ready", "processing"))),
        ("created_at", "timestampadd(MINUTE, CAST(turn AS INT), TIMESTAMP '2024-02-01 00:00:00')",
         "TIMESTAMP '2024-02-01 00:00:00' + to_minutes(turn)"),
    ], None, False),
    "m_keys": ("customer", [
        ("key_id", "c_custkey"),
        ("user_id", "CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 10000000000 ELSE c_custkey END"),
        ("key_prefix", "concat('ck_', c_custkey)"),
        ("expires_at", "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE timestampadd(DAY, "
                       "CAST(floor(c_acctbal / 100) AS INT), TIMESTAMP '2024-06-01 00:00:00') END",
         "CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE TIMESTAMP '2024-06-01 00:00:00' "
         "+ to_days(CAST(floor(c_acctbal / 100) AS INT)) END"),
        ("revoked_at", "CASE WHEN c_nationkey % 6 = 0 THEN TIMESTAMP '2024-05-01 00:00:00' ELSE NULL END"),
    ], None, False),
    "m_apps": ("customer", [
        ("application_id", "c_custkey"), ("name", "c_name"),
        ("email", "CASE WHEN c_custkey % 3 = 0 THEN lower(concat(c_name, '@records.example')) "
                  "ELSE lower(concat(c_name, '@applicants.example')) END"),
        ("claimed_role", pick("c_custkey % 14", ROLES)), ("org_id", "CAST(c_nationkey AS BIGINT)"),
        ("claimed_credential_id", "concat('DL-POL-', c_custkey)"),
        ("status", choose("c_mktsegment", (
            ("MACHINERY", "approved"), ("FURNITURE", "rejected"), ("BUILDING", "pending_review"),
            ("AUTOMOBILE", "pending_review"), ("HOUSEHOLD", "pending_review")))),
        ("created_at", "timestampadd(MINUTE, CAST(c_custkey % 1000003 AS INT), TIMESTAMP '2024-03-01 00:00:00')",
         "TIMESTAMP '2024-03-01 00:00:00' + to_minutes(c_custkey % 1000003)"),
    ], None, False),
    "m_cred_docs": ("orders", [
        ("credential_id", "o_orderkey"), ("application_id", "o_custkey"),
        ("doc_type", choose("o_orderpriority", (
            ("1-URGENT", "police_service_id"), ("2-HIGH", "bar_enrollment_certificate"),
            ("3-MEDIUM", "judicial_appointment_order"), ("5-LOW", "government_employee_id")))),
        ("created_at", "o_orderdate"),
    ], "o_orderstatus = 'O'", False),
    "m_bail_events": ("events", [
        ("case_id", "user_id"), ("seq", "event_id"),
        ("action", choose("event_type", (
            ("view", "arrest"), ("click", "application"), ("purchase", "hearing"),
            ("signup", "surety"))) [:-4] + " ELSE CASE WHEN value > 5 THEN 'order_grant' ELSE 'order_deny' END END"),
        ("created_at", "ts"),
    ], None, False),
    "m_bail_records": ("events", [
        ("case_id", "user_id"), ("seq", "event_id"),
        ("stage", choose("event_type", (
            ("view", "Arrested"), ("click", "Application_Filed"), ("purchase", "Hearing_Scheduled"),
            ("signup", "Order_Issued"), ("error", "Denied_Final")))),
        ("created_at", "ts"),
    ], None, False),
    "m_logins": ("events", [
        ("account", "user_id"), ("seq", "event_id"), ("ts", "ts"),
        ("succeeded", "event_type = 'signup'"),
    ], "event_type IN ('error', 'signup')", False),
    "m_holds": ("lineitem", [
        ("doc_id", "l_partkey"), ("legal_hold", "l_linestatus = 'F'"), ("actor_user_id", "l_suppkey"),
        ("acted_at", "l_shipdate"), ("action_id", "l_orderkey * 8 + l_linenumber"),
    ], None, False),
}


def _tag_sql(entity: str, rx: str, confidence: int, tail_group: bool = False, text: str = "text") -> str:
    kept = f"regexp_extract_all({text}, '{rx}', 1)" if tail_group else "ms"
    return (
        f"SELECT doc_id, '{entity}' AS entity_type, CAST(s + length(ms[i]) - length(ks[i]) AS INT) AS span_start, "
        f"CAST(s + length(ms[i]) AS INT) AS span_end, {confidence} AS confidence, 'ai_parser' AS source FROM ("
        f"SELECT doc_id, ms, ks, i, coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) "
        f"+ coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s FROM ("
        f"SELECT doc_id, ms, ks, ps, unnest(range(1, len(ms) + 1)) AS i FROM ("
        f"SELECT doc_id, ms, {kept} AS ks, ps FROM ("
        f"SELECT doc_id, text, regexp_extract_all({text}, '{rx}') AS ms, string_split_regex({text}, '{rx}') AS ps "
        f"FROM documents)) WHERE len(ms) > 0))"
    )


def span_sql(recognizers) -> str:
    """SQL giving every match of the given recognizers over ``documents`` with code-point offsets."""
    return " UNION ALL ".join(
        _tag_sql(r.entity_type, r.sql_regex or r.regex, r.confidence, r.tail_group) for r in recognizers)


#: What SQL knows as a word character is ASCII; letters beyond it are shown to it as underscores, which are in no name.
FOLDED = "regexp_replace(text, '[À-ÖØ-öø-ÿ]', '_', 'g')"
SQL_SPACE = r"\s\p{Z}\x1c-\x1f\x{85}"


def spelled_span_sql(recognizers) -> str:
    """As ``span_sql`` for texts with white space of every kind. Look-ahead past a name is left out: the texts compared
    have no caption right after one."""
    def spelled(rx: str) -> str:
        rx = rx.replace(r"(?![\p{L}\p{N}_]+\s*[:\-])", "")
        return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", lambda p: p.group(0).replace(
            r"\s", SQL_SPACE if p.group(0).startswith("[") else f"[{SQL_SPACE}]"), rx)

    return " UNION ALL ".join(_tag_sql(r.entity_type, spelled(r.regex), r.confidence, r.tail_group, FOLDED) for r in recognizers)


POLICY_ROWS = (
    ("*", "*", "*", "mask", 0), ("defense", "*", "EMAIL_ADDRESS", "show", 90),
    ("defense", "FIR", "EMAIL_ADDRESS", "flag", 0), ("duty_officer", "FIR", "*", "flag", 80),
    ("*", "*", "IP_ADDRESS", "show", 50), ("*", "Witness Statement", "CREDIT_CARD", "flag", 0),
    ("cyber_cell", "*", "PHONE_NUMBER", "show", 80),
)

# Words of each conversation turn laid out as boxes, twelve to a line; some words have a shorter second reading.
WORDS = r"[^\s\p{Z}]+"
BOX_EXPRS = {
    "page": "CAST(turn * 100 + floor(i / 240.0) + 1 AS INT)",
    "x1": "CAST(40 + (i % 12) * 110 + (i * 17 + turn * 5) % 9 AS INT)",
    "y1": "CAST(50 + floor((i % 240) / 12.0) * 30 + (i * 13) % 7 AS INT)",
    "doubt": "CAST(40 + (i * 29 + doc_id * 7) % 60 AS DOUBLE) / 100",
    "ghost_doubt": "CAST(40 + (i * 31 + doc_id * 3) % 60 AS DOUBLE) / 100",
    "script_doubt": "CAST(15 + (i * 37 + doc_id * 11) % 85 AS DOUBLE) / 100",
}
BOX_SELECT = (
    "doc_id", f"{BOX_EXPRS['page']} AS page", "CAST((i % 240) * 2 AS INT) AS box_no",
    "CASE WHEN i % 5 = 0 THEN concat('(', word, ')') ELSE word END AS text", f"{BOX_EXPRS['doubt']} AS confidence",
    f"{BOX_EXPRS['x1']} AS x1", f"{BOX_EXPRS['y1']} AS y1",
    f"CAST({BOX_EXPRS['x1']} + 9 * length(word) AS INT) AS x2", f"CAST({BOX_EXPRS['y1']} + 20 AS INT) AS y2")
GHOST_SELECT = (
    "doc_id", f"{BOX_EXPRS['page']} AS page", "CAST((i % 240) * 2 + 1 AS INT) AS box_no",
    "substring(word, 1, length(word) - 2) AS text", f"{BOX_EXPRS['ghost_doubt']} AS confidence",
    f"CAST({BOX_EXPRS['x1']} + 4 AS INT) AS x1", f"CAST({BOX_EXPRS['y1']} + 2 AS INT) AS y1",
    f"CAST({BOX_EXPRS['x1']} + 9 * length(word) - 14 AS INT) AS x2", f"CAST({BOX_EXPRS['y1']} + 19 AS INT) AS y2")
LETTERS, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "अबचदएफगहइजकलमनओपकरसतउवयझषज"
SCRIPT_TEXT = f"translate(lower(word), '{LETTERS}', '{SCRIPT}')"
SCRIPT_SELECT = (
    "doc_id", f"{BOX_EXPRS['page']} AS page", "CAST(i % 240 AS INT) AS box_no",
    f"CASE WHEN i % 4 = 0 THEN concat('(', {SCRIPT_TEXT}, '):') ELSE {SCRIPT_TEXT} END AS text",
    f"{BOX_EXPRS['script_doubt']} AS confidence", f"CAST({BOX_EXPRS['x1']} + 1 AS INT) AS x1",
    f"CAST({BOX_EXPRS['y1']} + 1 AS INT) AS y1", f"CAST({BOX_EXPRS['x1']} + 9 * length(word) AS INT) AS x2",
    f"CAST({BOX_EXPRS['y1']} + 21 AS INT) AS y2")
WORD_SQL = (
    "SELECT doc_id, turn, role, ws[i + 1] AS word, i FROM (SELECT doc_id, turn, role, ws, unnest(range(0, len(ws))) AS i "
    f"FROM (SELECT conv_id AS doc_id, turn, role, regexp_extract_all(text, '{WORDS}') AS ws FROM conversations))")

# A registration form per order, whose header fields are known from the order.
COMPLAINANTS = ("Ramesh Kumar", "Priya Menon", "Sunita Rao", "Amit Verma", "Kiran Bedi Shah")
FORM_TEXT = (
    "concat('HARYANA POLICE', chr(10), 'District: ZONE ', o_custkey % 25, ' | P.S.: STN ', o_custkey, ' | Year: ', "
    "year(o_orderdate), chr(10), 'FIR No. ', o_orderkey, '/', year(o_orderdate) % 100 + 100, ' | Date: ', "
    "10 + o_orderkey % 18, '/1', o_orderkey % 3, '/', year(o_orderdate), chr(10), 'Time From: 09:20 hrs', chr(10), "
    "'1 | IPC 1860 | ', 100 + o_custkey % 400, ', ', 501 + o_orderkey % 10, chr(10), "
    "'(b) Information received at P.S. | Time:', chr(10), '1', o_orderkey % 10, ':', 10 + o_custkey % 50, ' nrs', chr(10), "
    "'Type of Information: Written.', chr(10), 'Complainant / Informant : Name: ', "
    + pick("o_custkey % 5", COMPLAINANTS)
    + ", chr(10), 'Address: House ', o_custkey, ' Model Town | x', chr(10), 'Place of Occurrence: NEAR ROAD ', o_orderkey)")
PROJECTIONS["m_forms"] = ("orders", [("doc_id", "o_orderkey"), ("text", FORM_TEXT)], None, False)

# Page markup as uploaded files of several kinds.
BLOB_TEXT = (
    "CASE page_id % 6 WHEN 0 THEN html WHEN 1 THEN concat('%PDF-1.4 ', CASE WHEN page_id % 4 = 1 THEN '/JS (x) ' "
    "ELSE concat('stream', chr(10), '/JS x', chr(10), 'endstream ') END, replace(html, '/', ' ')) "
    "WHEN 2 THEN concat('MZ', html) WHEN 3 THEN concat('#!/bin/sh ', html) WHEN 4 THEN replace(lower(html), 'script', 'p') "
    "ELSE html END")
BLOB_DECLARED = pick("page_id % 6", ("text/plain", "application/pdf", "text/plain", "text/csv", "text/csv", "image/png"))

CUSTOM_SQL = {
    "m_boxes": f"SELECT {', '.join(BOX_SELECT)} FROM ({WORD_SQL}) UNION ALL SELECT {', '.join(GHOST_SELECT)} "
               f"FROM ({WORD_SQL}) WHERE length(word) >= 5 AND i % 3 = 0",
    "m_script_boxes": f"SELECT {', '.join(SCRIPT_SELECT)} FROM ({WORD_SQL}) WHERE role = 'user'",
    "m_blobs": f"SELECT page_id, concat('up/../', url, ' ', page_id, '.pdf') AS name, {BLOB_TEXT} AS body, "
               f"{BLOB_DECLARED} AS declared FROM pages",
    "m_requests":
        "SELECT l_orderkey * 8 + l_linenumber AS request_id, l_orderkey AS case_id, "
        "l_suppkey AS requested_org_id, p_type AS doc_type_expected, concat(l_returnflag, '/', p_brand) AS notes, "
        "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey END AS requested_by_user_id, "
        "CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'requested' END AS status, "
        "l_shipdate AS created_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate + INTERVAL '7' DAY END AS completed_at "
        "FROM lineitem JOIN part ON p_partkey = l_partkey",
    "m_stage_requirements":
        "SELECT " + pick("p_size % 5", CRIMES) + " AS crime_type, "
        "CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'document' ELSE 'evidence_request' END AS requirement_type, "
        "CASE p_type WHEN 'PROMO' THEN 'FIR' WHEN 'SMALL' THEN 'Charge Sheet' ELSE p_type END AS requirement_key, "
        "max(p_retailprice) >= 999 AS mandatory FROM part GROUP BY 1, 2, 3",
    "m_tags":
        "SELECT * FROM (" + span_sql(P.PLAIN_RECOGNIZERS) + ") UNION ALL "
        "SELECT doc_id, 'PERSON', 0, 4, NULL, 'officer_correction' FROM labels WHERE toxic = 1",
    "m_policies":
        "SELECT * FROM (VALUES " + ", ".join(str(r) for r in POLICY_ROWS)
        + ") AS t(role, doc_type, entity_type, action, min_confidence)",
    # What a ledger holds for each document: most agree, some differ, some were never written.
    "m_ledger":
        "SELECT doc_id, CASE WHEN quality = 0 THEN sha256(concat(doc_hash, 'x')) ELSE doc_hash END AS ledger_hash "
        "FROM m_docs JOIN labels USING (doc_id)",
    "m_attempts":
        "SELECT event_id AS attempt_id, CASE WHEN event_type = 'click' THEN concat('DL-POL-', user_id) "
        "WHEN event_type = 'view' THEN upper(concat('customer#', lpad(CAST(user_id AS VARCHAR), 9, '0'), "
        "'@records.example')) "
        "ELSE concat('customer#', lpad(CAST(user_id AS VARCHAR), 9, '0'), '@records.example') END AS identifier "
        "FROM events",
}


class Models:
    """Lazy access to supplied tables and model tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # stored times are UTC; days and ISO texts are cut there
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load_supplied(self.spark, self.sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self._projected(name, self.table(PROJECTIONS[name][0]))
        build = getattr(type(self), f"_build_{name}", None)
        if build:
            return build(self)
        return self.table(name)

    def _projected(self, name: str, df: DataFrame) -> DataFrame:
        _, columns, condition, distinct = PROJECTIONS[name]
        if condition:
            df = df.filter(condition)
        df = df.selectExpr(*(f"{c[1]} AS {c[0]}" for c in columns))
        return df.distinct() if distinct else df

    def spread(self, name: str) -> DataFrame:
        """A projection whose source rows are spread before its columns are made."""
        return self._projected(name, spread(self.table(PROJECTIONS[name][0])))

    def _build_m_requests(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        joined = self.table("lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
        done = F.col("l_linestatus") == "F"
        return joined.select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("request_id"),
            F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("requested_org_id"),
            F.col("p_type").alias("doc_type_expected"),
            F.concat("l_returnflag", F.lit("/"), "p_brand").alias("notes"),
            F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("requested_by_user_id"),
            F.when(done, "completed").otherwise("requested").alias("status"),
            F.col("l_shipdate").alias("created_at"),
            F.when(done, F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")).alias("completed_at"))

    def _build_m_stage_requirements(self) -> DataFrame:
        return self.table("part").selectExpr(
            f"{pick('p_size % 5', CRIMES)} AS crime_type",
            "CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 'document' ELSE 'evidence_request' END AS requirement_type",
            "CASE p_type WHEN 'PROMO' THEN 'FIR' WHEN 'SMALL' THEN 'Charge Sheet' ELSE p_type END AS requirement_key",
            "p_retailprice",
        ).groupBy("crime_type", "requirement_type", "requirement_key").agg(
            (F.max("p_retailprice") >= 999).alias("mandatory"))

    def _build_m_tags(self) -> DataFrame:
        found = detect.explode_spans(
            detect.detect_entities(spread(self.table("documents").select("doc_id", "text")), "text", P.PLAIN_RECOGNIZERS),
            "doc_id").withColumn("source", F.lit("ai_parser"))
        corrections = self.table("labels").filter("toxic = 1").select(
            "doc_id", F.lit("PERSON").alias("entity_type"), F.lit(0).alias("span_start"),
            F.lit(4).alias("span_end"), F.lit(None).cast("int").alias("confidence"),
            F.lit("officer_correction").alias("source"))
        return found.unionByName(corrections)

    def _build_m_policies(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(POLICY_ROWS), "role STRING, doc_type STRING, entity_type STRING, action STRING, min_confidence INT")

    def _build_m_ledger(self) -> DataFrame:
        return self.m_docs.join(self.table("labels"), "doc_id").select(
            "doc_id", F.when(F.col("quality") == 0, F.sha2(F.concat("doc_hash", F.lit("x")), 256))
            .otherwise(F.col("doc_hash")).alias("ledger_hash"))

    def _words(self) -> DataFrame:
        words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
        return spread(self.table("conversations")).select(
            F.col("conv_id").alias("doc_id"), "turn", "role", F.posexplode(words).alias("i", "word"))

    def _build_m_boxes(self) -> DataFrame:
        words = self._words()
        return words.selectExpr(*BOX_SELECT).unionByName(
            words.filter("length(word) >= 5 AND i % 3 = 0").selectExpr(*GHOST_SELECT))

    def _build_m_script_boxes(self) -> DataFrame:
        return self._words().filter("role = 'user'").selectExpr(*SCRIPT_SELECT)

    def _build_m_blobs(self) -> DataFrame:
        return self.table("pages").selectExpr(
            "page_id", "concat('up/../', url, ' ', page_id, '.pdf') AS name",
            f"encode({BLOB_TEXT}, 'UTF-8') AS content", f"{BLOB_DECLARED} AS declared")

    def _build_m_attempts(self) -> DataFrame:
        mail = F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"),
                        F.lit("@records.example"))
        return self.table("events").select(
            F.col("event_id").alias("attempt_id"),
            F.when(F.col("event_type") == "click", F.concat(F.lit("DL-POL-"), "user_id"))
            .when(F.col("event_type") == "view", F.upper(mail)).otherwise(mail).alias("identifier"))


def _model_sql(name: str) -> str:
    if name in CUSTOM_SQL:
        return CUSTOM_SQL[name]
    source, columns, condition, distinct = PROJECTIONS[name]
    listed = ", ".join(f"{c[-1]} AS {c[0]}" for c in columns)
    return (f"SELECT {'DISTINCT ' if distinct else ''}{listed} FROM {source}"
            + (f" WHERE {condition}" if condition else ""))


def with_models(sql: str) -> str:
    """Prefix ``sql`` with the definition of every model table it names."""
    names = list(PROJECTIONS) + list(CUSTOM_SQL)
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in names:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(_model_sql(name))
                if name not in wanted:
                    wanted.append(name)

    visit(sql)
    body = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
    own = body != sql
    if not wanted:
        return f"WITH RECURSIVE {body}" if own else sql
    ctes = ", ".join(f"{name} AS ({_model_sql(name)})" for name in wanted)
    return f"WITH RECURSIVE {ctes}{', ' if own else ' '}{body.strip()}"
