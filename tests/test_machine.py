import random
from datetime import datetime, timedelta

import pytest

from casemesh import constants as K
from casemesh.operators import cases as C
from casemesh.operators import machine, rate

ACTIONS = ("arrest", "application", "hearing", "order_grant", "order_deny", "surety", "nonsense")


def walk(moves, events, state):
    table, out = {(a, x): b for a, x, b in moves}, []
    for seq, action, why in events:
        to = None if why else table.get((state, action))
        out.append((seq, state, to is not None, to or state, None if to else (why or "illegal_move")))
        state = to or state
    return out


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_moves_match_a_plain_walk_however_keys_are_cut(spark, bits):
    rnd = random.Random(bits)
    rows, per = [], {}
    for seq in range(300):
        case = 1 if rnd.random() < 0.5 else rnd.randrange(2, 6)
        event = (seq, rnd.choice(ACTIONS), "no_role" if rnd.random() < 0.1 else None)
        rows.append((case, *event))
        per.setdefault(case, []).append(event)
    events = spark.createDataFrame(rows, "case_id BIGINT, seq BIGINT, action STRING, why STRING")
    initial = spark.createDataFrame([(1, "Absconded"), (2, None), (3, "Order_Issued"), (4, "")],
                                    "case_id BIGINT, state STRING")
    got = {}
    for r in machine.apply_bail(events, initial, blocked="why", bits=bits).orderBy("seq").collect():
        got.setdefault(r.case_id, []).append((r.seq, r.from_state, r.accepted, r.to_state, r.reason))
    first = {1: "Absconded", 3: "Order_Issued"}
    unknown = [(seq, None, False, None, "case_not_found") for seq, *_ in per.pop(5)]
    assert got.pop(5) == unknown
    assert got == {c: walk(K.BAIL_MOVES, e, first.get(c, "")) for c, e in per.items()}


def test_investigation_track_needs_the_gate_and_a_verdict(spark):
    gate = spark.createDataFrame([(1, []), (2, ["Document: FIR"])], "case_id BIGINT, missing_items ARRAY<STRING>")
    events = spark.createDataFrame([
        (1, 1, "file_charge_sheet", None), (1, 2, "judgment", "convicted"), (1, 3, "trial_hearing", None),
        (1, 4, "judgment", "maybe"), (1, 5, "judgment", " Acquitted "), (1, 6, "file_charge_sheet", None),
        (2, 7, "file_charge_sheet", None)], "case_id BIGINT, seq BIGINT, action STRING, verdict STRING")
    initial = spark.createDataFrame([(1, "Evidence_Collection"), (2, None)], "case_id BIGINT, state STRING")
    got = {r.seq: (r.accepted, r.reason) for r in machine.apply_case(events, initial, gate).collect()}
    assert got == {1: (True, None), 2: (False, "illegal_move"), 3: (True, None), 4: (False, "bad_verdict"),
                   5: (True, None), 6: (False, "illegal_move"), 7: (False, "missing_requirements")}


def test_gate_lists_what_is_missing(spark):
    cases = spark.createDataFrame([(1, "Theft", "FIR_Registered"), (2, "Theft", "Trial"), (3, "Other", "FIR_Registered")],
                                  "case_id BIGINT, crime_type STRING, investigation_status STRING")
    rules = spark.createDataFrame([("Theft", "document", "FIR", True), ("Theft", "evidence_request", "FSL", True),
                                   ("Theft", "document", "Memo", False)],
                                  "crime_type STRING, requirement_type STRING, requirement_key STRING, mandatory BOOLEAN")
    docs = spark.createDataFrame([(1, "FIR")], "case_id BIGINT, doc_type STRING")
    requests = spark.createDataFrame([(1, "FSL", "requested")], "case_id BIGINT, doc_type_expected STRING, status STRING")
    got = {r.case_id: (r.verdict, r.missing_items) for r in C.charge_sheet_ready(cases, rules, docs, requests).collect()}
    assert got == {1: ("missing", ["Evidence Request: FSL"]), 3: ("ready", []),
                   2: ("already_filed", ["Document: FIR", "Evidence Request: FSL"])}


def limiter(events, limit, window):
    seen, out = {}, []
    for key, seq, t, wipes in events:
        live = [x for x in seen.get(key, []) if x > t - window]
        if len(live) >= limit:
            out.append((seq, False, max(1, int(live[0] + window - t) + 1)))
        else:
            out.append((seq, True, None))
            live = [] if wipes else [*live, t]
        seen[key] = live
    return out


def login_rows(seed, n=400):
    rnd = random.Random(seed)
    start, t, rows = datetime(2024, 1, 1), 0, []
    for seq in range(n):
        t += rnd.choice([0, 1, 3, 10, 40])
        rows.append((rnd.choice("aaab"), seq, t, rnd.random() < 0.15))
    return rows, [(k, s, start + timedelta(seconds=t), w) for k, s, t, w in rows]


@pytest.mark.parametrize("limit", [1, 3])
def test_only_allowed_events_count(spark, limit):
    plain, rows = login_rows(limit)
    df = spark.createDataFrame(rows, "account STRING, seq BIGINT, ts TIMESTAMP, ok BOOLEAN")
    got = sorted((r.seq, r.allowed, r.retry_after) for r in rate.rate_verdicts(df, "account", limit, 60, clears="ok").collect())
    assert got == limiter(plain, limit, 60)


def test_window_counts(spark):
    plain, rows = login_rows(9)
    df = spark.createDataFrame(rows, "account STRING, seq BIGINT, ts TIMESTAMP, ok BOOLEAN")
    got = {r.seq: r.in_window for r in rate.window_counts(df, "account", 60).collect()}
    assert got == {s: sum(k2 == k and t - 60 < t2 <= t for k2, _, t2, _ in plain) for k, s, t, _ in plain}


def test_pathways(spark):
    kinds = ["cyber identity theft ring", "Theft", "theft of vehicle", "Assault", "Jaywalking"]
    df = spark.createDataFrame([(k,) for k in kinds], "t STRING").select(C.match_pathway(df_col("t")).alias("p"))
    assert [r.p.crime_type for r in df.collect()] == [
        "Theft", "Theft", "Theft", "Sexual Assault", "Jaywalking"]
    assert df.collect()[4].p.bailable_status == "Determined by First Schedule CrPC"


def df_col(name):
    from pyspark.sql import functions as F
    return F.col(name)
