import random
from datetime import datetime

from casemesh.operators import lifecycle as L

NOW = datetime(2024, 5, 1)


def test_decisions_as_if_taken_one_by_one(spark):
    rnd = random.Random(8)
    apps = [(i, f"n{i}", f"m{rnd.randrange(12)}", "io", 1, f"c{i}", rnd.choice(["pending_review"] * 4 + ["rejected"]))
            for i in range(30)]
    users = [("m0",)]
    decisions = [(s, rnd.randrange(0, 33), rnd.choice(["approve", "approve", "reject"]), 1, NOW) for s in range(120)]
    status, taken, expected = {a[0]: a[6] for a in apps}, {"m0"}, {}
    mail = {a[0]: a[2] for a in apps}
    for seq, app, decision, _, _ in decisions:
        if app not in status:
            expected[seq] = "application_not_found"
        elif status[app] != "pending_review":
            expected[seq] = "already_decided"
        elif decision == "approve" and mail[app] in taken:
            expected[seq] = "email_taken"
        else:
            expected[seq] = None
            status[app] = decision
            if decision == "approve":
                taken.add(mail[app])
    out = L.apply_decisions(
        spark.createDataFrame(decisions, "seq BIGINT, application_id BIGINT, decision STRING, reviewer_user_id BIGINT, decided_at TIMESTAMP"),
        spark.createDataFrame(apps, "application_id BIGINT, name STRING, email STRING, claimed_role STRING, org_id BIGINT, "
                                    "claimed_credential_id STRING, status STRING"),
        spark.createDataFrame(users, "email STRING"),
        spark.createDataFrame([(3, "io")], "role_id BIGINT, code STRING"))
    assert {r.seq: r.reason for r in out.decided.collect()} == expected
    rows = out.rows.collect()
    assert {r.application_id for r in rows} == {a for a, s in status.items() if s == "approve"}
    assert all(r.must_change_password and r.role_id == 3 for r in rows)
    assert out.audit.count() == sum(v is None for v in expected.values())


CASES = "case_id BIGINT, investigation_status STRING"
USERS = "user_id BIGINT, role STRING, org_id BIGINT, email STRING"


def test_reassigning_as_if_one_by_one(spark):
    rnd = random.Random(2)
    cases = [(c, "Judgment" if c == 4 else "Trial") for c in range(6)]
    users = [(u, "io" if u < 4 else "sho", 1, f"u{u}") for u in range(6)]
    held = {0: 0, 1: 1, 4: 2, 5: 3}
    asked = [(s, rnd.randrange(0, 7), rnd.randrange(0, 7), NOW) for s in range(80)]
    expected, now = {}, dict(held)
    for seq, case, officer, _ in asked:
        if case > 5:
            expected[seq] = "case_not_found"
        elif case == 4:
            expected[seq] = "case_concluded"
        elif officer > 5:
            expected[seq] = "user_not_found"
        elif officer >= 4:
            expected[seq] = "not_an_io"
        elif case not in now:
            expected[seq] = "no_current_assignment"
        elif now[case] == officer:
            expected[seq] = "same_officer"
        else:
            expected[seq], now[case] = None, officer
    out = L.reassign(
        spark.createDataFrame(asked, "seq BIGINT, case_id BIGINT, new_io_user_id BIGINT, requested_at TIMESTAMP"),
        spark.createDataFrame(cases, CASES), spark.createDataFrame(users, USERS),
        spark.createDataFrame([(c, u, NOW) for c, u in held.items()], "case_id BIGINT, io_user_id BIGINT, assigned_at TIMESTAMP"))
    assert {r.seq: r.reason for r in out.decided.collect()} == expected
    assert {r.case_id: r.io_user_id for r in out.rows.collect()} == now


def test_first_permitted_answer_fulfils(spark):
    requests = spark.createDataFrame([(1, 9, 20, "FSL", "requested", None), (2, 9, 20, None, "completed", NOW)],
                                     "request_id BIGINT, case_id BIGINT, requested_org_id BIGINT, doc_type_expected STRING, "
                                     "status STRING, completed_at TIMESTAMP")
    users = spark.createDataFrame([(4, "external_authority", 20, "a"), (5, "external_authority", 21, "b"), (6, "io", 20, "c")], USERS)
    docs = spark.createDataFrame([(9, "FSL", 3)], "case_id BIGINT, doc_type STRING, version INT")
    answers = spark.createDataFrame([(1, 101, 1, 5, "x", NOW), (2, 102, 1, 4, "y", NOW), (3, 103, 1, 4, "z", NOW),
                                     (4, 104, 2, 4, "w", NOW), (5, 105, 8, 4, "v", NOW), (6, 106, 1, 6, "u", NOW)],
                                    "seq BIGINT, doc_id BIGINT, request_id BIGINT, user_id BIGINT, text STRING, submitted_at TIMESTAMP")
    out = L.fulfil(answers, requests, users, docs)
    assert {r.seq: r.reason for r in out.decided.collect()} == {
        1: "different_organization", 2: None, 3: "already_fulfilled", 4: "already_fulfilled", 5: "request_not_found",
        6: "role_not_permitted"}
    assert [(r.doc_id, r.version, r.storage_path) for r in out.rows.collect()] == [(102, 4, "20/9/102/v4")]
    assert {r.request_id: r.status for r in L.fulfilled_requests(requests, out).collect()} == {1: "completed", 2: "completed"}


def test_review_release_and_holds(spark):
    docs = spark.createDataFrame([(1, 9, "needs_review", "text", False), (2, 9, "needs_review", "", False), (3, 9, "ready", "t", True)],
                                 "doc_id BIGINT, case_id BIGINT, status STRING, raw_text STRING, retention_legal_hold BOOLEAN")
    tags = spark.createDataFrame([(1, "ai_parser"), (1, "officer_correction")], "doc_id BIGINT, source STRING")
    asked = spark.createDataFrame([(1, 1, "court", 5, NOW), (2, 1, "io", 5, NOW), (3, 1, "sho", 5, NOW), (4, 2, "io", 5, NOW), (5, 3, "io", 5, NOW)],
                                  "seq BIGINT, doc_id BIGINT, role STRING, user_id BIGINT, released_at TIMESTAMP")
    out = L.release_reviews(asked, docs, tags)
    assert {r.seq: r.reason for r in out.decided.collect()} == {
        1: "role_not_permitted", 2: None, 3: "not_in_review", 4: "no_text", 5: "not_in_review"}
    assert {r.doc_id: r.status for r in out.rows.collect()} == {1: "ready", 2: "needs_review", 3: "ready"}
    assert [r.metadata for r in out.audit.collect()] == ['{"officer_corrections":1,"tag_count":2}']
    holds = spark.createDataFrame([(1, 1, True, 5, NOW), (2, 1, False, 5, NOW), (3, 2, True, 5, NOW), (4, 7, True, 5, NOW)],
                                  "action_id BIGINT, doc_id BIGINT, legal_hold BOOLEAN, actor_user_id BIGINT, acted_at TIMESTAMP")
    done = L.apply_holds(holds, docs)
    assert {r.doc_id: r.retention_legal_hold for r in done.rows.collect()} == {1: False, 2: True, 3: True}
    assert [r.action_id for r in done.rejected.collect()] == [4]


def test_jobs_emit_rows_that_can_be_sealed(spark):
    from casemesh.operators import audit
    new = spark.createDataFrame([(1, " Lab ", "FSL ", 5, NOW), (2, "Lab", "fsl", 5, NOW), (3, " ", "x", 5, NOW), (4, "Bank", "bank", 5, NOW)],
                                "seq BIGINT, name STRING, org_type STRING, actor_user_id BIGINT, asked_at TIMESTAMP")
    out = L.onboard_orgs(new, spark.createDataFrame([("Bank",)], "name STRING"))
    assert {r.seq: r.reason for r in out.decided.collect()} == {1: None, 2: "name_taken", 3: "empty_name", 4: "name_taken"}
    assert [(r.name, r.org_type) for r in out.rows.collect()] == [("Lab", "fsl")]
    from pyspark.sql import functions as F
    rows = audit.assign_seq(out.audit.withColumn("arrival", F.col("target_id").cast("long")), 0, "arrival").drop("arrival")
    sealed = audit.seal(rows)
    assert audit.chain_intact(audit.check_links(sealed, ["chain"])).first().chain_intact
