from datetime import datetime

import pytest

from casemesh.operators import access as A
from casemesh.operators import cases as C
from casemesh.operators import documents as D
from casemesh.operators import listing as L
from casemesh.operators import reports as R
from casemesh.sources import tables as T

DAY = datetime(2024, 1, 5)
USERS = [(1, 10, "io"), (2, 10, "sho"), (3, 10, "duty_officer"), (4, 20, "external_authority"), (5, 30, "defense"),
         (6, 10, "records_ncrb_analyst"), (7, None, "external_authority"), (8, 10, "cyber_cell")]


@pytest.fixture()
def world(spark):
    make = spark.createDataFrame
    return {
        "users": make([(u, o, r, None, f"S-{u}", "d", f"name{u}", f"U{u}@Desk.example") for u, o, r in USERS],
                      "user_id BIGINT, org_id BIGINT, role STRING, role_id BIGINT, service_id STRING, designation STRING, "
                      "name STRING, email STRING"),
        "cases": make([(c, f"N-{c}", "Theft") for c in range(100, 106)], "case_id BIGINT, case_number STRING, crime_type STRING"),
        "assignments": make([(100, 1, DAY), (100, 1, DAY), (101, 8, DAY), (102, 5, DAY)],
                            "case_id BIGINT, io_user_id BIGINT, assigned_at TIMESTAMP"),
        "audit": make([(103, 3, "fir_registered", 1), (103, 3, "fir_registered", 2), (104, 3, "viewed", 3), (105, 1, "fir_registered", 4)],
                      "case_id BIGINT, actor_user_id BIGINT, action STRING, seq BIGINT"),
        "requests": make([(1, 104, 20), (2, 104, 20), (3, 105, None), (4, 100, 99)],
                         "request_id BIGINT, case_id BIGINT, requested_org_id BIGINT"),
        "parties": make([(105, 5, "defense"), (104, 5, "witness"), (101, 1, "defense")],
                        "case_id BIGINT, user_id BIGINT, party_role STRING"),
    }


def matrix(w):
    return A.access_matrix(w["users"], w["assignments"], w["audit"], w["requests"], w["parties"])


def test_grants_and_default_deny(world):
    got = {(r.user_id, r.case_id): (r.grant, r.can_open) for r in matrix(world).collect()}
    assert got == {(2, None): ("unrestricted", True), (1, 100): ("assigned", True), (8, 101): ("assigned", True),
                   (3, 103): ("registered", True), (5, 105): ("engaged", True), (4, 104): ("requisitioned", False)}


@pytest.mark.parametrize("user_id,org_id,role", USERS)
def test_case_list_agrees_with_the_matrix(world, user_id, org_id, role):
    w = world
    seen = {r.case_id for r in A.filter_visible(
        w["cases"], {"user_id": user_id, "role": role, "org_id": org_id}, w["assignments"], w["audit"], w["requests"],
        w["parties"]).collect()}
    granted = {r.case_id for r in matrix(w).filter(f"user_id = {user_id}").collect()}
    assert seen == (set(range(100, 106)) if role == "sho" else granted)


def test_denials_name_the_reason(spark, world):
    asked = spark.createDataFrame([(1, 100), (1, 101), (2, 105), (3, 104), (4, 104), (5, 104), (6, 100), (99, 100), (8, 100)],
                                  "user_id BIGINT, case_id BIGINT")
    got = {(r.user_id, r.case_id): r.reason for r in A.denials(asked, world["users"], matrix(world)).collect()}
    assert got == {(1, 101): "not_assigned", (3, 104): "not_registering_officer", (4, 104): "role_not_permitted",
                   (5, 104): "no_engagement", (6, 100): "role_not_permitted", (99, 100): "unknown_user",
                   (8, 100): "not_assigned"}


def test_requests_are_closed_without_an_organisation(spark, world):
    tries = spark.createDataFrame([(1, 4), (1, 7), (3, 7), (4, 4), (1, 1), (9, 4)], "request_id BIGINT, user_id BIGINT")
    got = {(r.request_id, r.user_id): r.verdict for r in A.request_access(tries, world["requests"], world["users"]).collect()}
    assert got == {(1, 4): "allowed", (1, 7): "different_organization", (3, 7): "different_organization",
                   (4, 4): "different_organization", (1, 1): "role_not_permitted", (9, 4): "not_found"}


def test_identity_by_mail_or_service_id(spark, world):
    tries = spark.createDataFrame([(1, "U1@Desk.example"), (2, "u1@desk.example"), (3, "S-5"), (4, " u5@DESK.example ")],
                                  "attempt_id BIGINT, identifier STRING")
    assert sorted((r.attempt_id, r.user_id) for r in A.match_identity(tries, world["users"]).collect()) == [(1, 1), (3, 5)]
    assert sorted((r.attempt_id, r.user_id) for r in A.match_identity(tries, world["users"], True).collect()) == [
        (1, 1), (2, 1), (4, 5)]


def test_backfill_takes_the_first_registration_and_fills_only_gaps(spark, world):
    cases = spark.createDataFrame([(103, None, None), (105, 77, 5), (104, None, None)],
                                  "case_id BIGINT, org_id BIGINT, registered_by_user_id BIGINT")
    got = {r.case_id: (r.org_id, r.registered_by_user_id) for r in C.backfill_owner(cases, world["audit"], world["users"]).collect()}
    assert got == {103: (10, 3), 105: (77, 5), 104: (None, None)}


def test_pages_are_bounded_and_stable(spark):
    df = spark.createDataFrame([(i, DAY) for i in range(30)], "seq BIGINT, created_at TIMESTAMP")
    first = [r.seq for r in L.page_after(df, "seq", None, 10).collect()]
    then = [r.seq for r in L.page_after(df, "seq", first[-1], 10).collect()]
    assert first + then == list(range(29, 9, -1))
    assert [r.seq for r in L.page(df, ["created_at", "seq"], 5, 5).collect()] == [5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        L.page(df, ["seq"], 101)


def test_versions_and_duplicates(spark):
    stored = spark.createDataFrame([(1, 7, "FIR", 2, "h1"), (2, 7, "FIR", 1, "h0")],
                                   "doc_id BIGINT, case_id BIGINT, doc_type STRING, version INT, doc_hash STRING")
    new = spark.createDataFrame([(10, 7, "FIR", "h1"), (11, 7, "FIR", "h2"), (12, 7, "FIR", "h2"), (13, 8, "FIR", "h1")],
                                "doc_id BIGINT, case_id BIGINT, doc_type STRING, doc_hash STRING")
    marked = D.dedup_uploads(new, stored)
    assert {r.doc_id: (r.result_doc_id, r.is_new) for r in marked.collect()} == {
        10: (1, False), 11: (11, True), 12: (11, False), 13: (13, True)}
    numbered = D.assign_versions(marked.filter("is_new").select(*new.columns), stored)
    assert {r.doc_id: r.version for r in numbered.collect()} == {11: 3, 13: 1}


def test_hash_states(spark):
    docs = spark.createDataFrame([(1, "a", "confirmed"), (2, "b", "pending"), (3, "c", "confirmed"), (4, "d", "confirmed")],
                                 "doc_id BIGINT, doc_hash STRING, chain_status STRING")
    ledger = spark.createDataFrame([(1, "a"), (2, "b"), (3, "x"), (9, "z")], "doc_id BIGINT, ledger_hash STRING")
    assert {r.doc_id: r.verdict for r in D.verify_hashes(docs, ledger).collect()} == {
        1: "ok", 2: "ok", 3: "tampered", 4: "missing"}
    assert {r.doc_id: r.state for r in D.reconcile(docs, ledger).collect()} == {
        1: "match", 2: "written_but_unconfirmed", 3: "hash_differs", 4: "confirmed_but_absent", 9: "ledger_only"}


def test_upsert_replace_and_export(spark, tmp_path):
    old = spark.createDataFrame([(1, "a")], "id BIGINT, code STRING")
    new = spark.createDataFrame([(2, "a"), (3, "b"), (4, "b")], "id BIGINT, code STRING")
    merged = T.insert_missing(old, new, ["code"])
    assert sorted((r.id, r.code) for r in merged.collect()) == [(1, "a"), (3, "b")]
    assert T.insert_missing(merged, new, ["code"]).count() == 2
    path = str(tmp_path / "rules")
    T.replace_rules(old, path)
    T.replace_rules(new, path)
    assert spark.read.parquet(path).count() == 3
    log = str(tmp_path / "log")
    T.append_audit(old, log)
    T.append_audit(new, log)
    assert spark.read.parquet(log).count() == 4
    cases = spark.createDataFrame([(5, 'A "q"', "Theft", "Trial", None, None, DAY)],
                                  "case_id BIGINT, case_number STRING, crime_type STRING, investigation_status STRING, "
                                  "court_level STRING, bail_status STRING, created_at TIMESTAMP")
    out = str(tmp_path / "csv")
    T.export_cohort(R.cohort(cases, "2024-01-08 12:00:00"), out)
    text = "".join(r.value for r in spark.read.text(out).collect())
    assert '"days_active"' in text and '"3"' in text and '"5"' not in text
    tables = {"cases": cases}
    cases.write.parquet(str(tmp_path / "db" / "cases"))
    loaded = T.load_tables(spark, str(tmp_path / "db"), {"cases": cases.schema}, tables)
    assert loaded["cases"].count() == 1
    docs = spark.createDataFrame([(1, 2, 3, "x")], "org_id BIGINT, case_id BIGINT, doc_id BIGINT, body STRING")
    T.write_by_case(docs, str(tmp_path / "docs"))
    assert (tmp_path / "docs" / "org_id=1" / "case_id=2").is_dir()
