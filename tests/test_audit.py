import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casemesh.operators import audit
from casemesh.operators.sequence import number_rows, previous_row

COLS = ("seq BIGINT, case_id BIGINT, actor_user_id BIGINT, action STRING, target_type STRING, target_id BIGINT, "
        "metadata STRING, created_at TIMESTAMP")


def make_rows(n, seed=1, gaps=True):
    rnd = random.Random(seed)
    seq, rows = 0, []
    for i in range(n):
        seq += rnd.choice([1, 1, 1, 5, 70]) if gaps else 1
        rows.append((seq, 1 if rnd.random() < 0.4 else rnd.randrange(2, 9), rnd.choice([None, 4, 5]), rnd.choice(["a", "b"]),
                     "document", i, json.dumps({"k": i, "é": "थाना"}) if i % 3 else "",
                     datetime(2024, 1, 1) + timedelta(microseconds=rnd.randrange(10**9))))
    return rows


def linear(spark, rows, content):
    """The whole log as one chain, linked by plain Python over Spark's canonical text."""
    df = spark.createDataFrame(rows, COLS)
    body = {r.seq: r.b for r in df.select("seq", content().alias("b")).collect()}
    prev, out = None, []
    for row in rows:
        made = hashlib.sha256(f"{prev}|{body[row[0]]}".encode()).hexdigest()
        out.append(row + (prev, made))
        prev = made
    return out, COLS + ", prev_hash STRING, row_hash STRING"


def verdict(spark, rows, cols, **kw):
    links = audit.check_links(spark.createDataFrame(rows, cols), **kw)
    return audit.chain_intact(links).first(), links


@pytest.mark.parametrize("content", [audit.canonical, audit.canonical_with_blanks])
def test_linear_log_with_gaps_is_intact_and_any_edit_shows(spark, content):
    rows, cols = linear(spark, make_rows(60), content)
    whole, _ = verdict(spark, rows, cols, content=content)
    assert whole.chain_intact and whole.total_rows == 60
    edited = [r[:6] + ('{"k":-1}',) + r[7:] if i == 31 else r for i, r in enumerate(rows)]
    broken, _ = verdict(spark, edited, cols, content=content)
    assert not broken.chain_intact and broken.first_broken_seq == rows[31][0]
    removed, _ = verdict(spark, rows[:20] + rows[21:], cols, content=content)
    assert removed.first_broken_seq == rows[21][0]
    headless, _ = verdict(spark, rows[1:], cols, content=content)
    assert headless.first_broken_seq == rows[1][0]


def test_hashes_of_a_log_written_elsewhere_are_reproduced(spark):
    row = (1, 7, None, "x", None, None, '{"b": 1, "a": "थाना"}', datetime(2024, 3, 1, 10, 0, 0, 250))
    body = json.dumps({
        "case_id": "7", "actor_user_id": None, "action": "x", "target_type": None, "target_id": None,
        "metadata": {"a": "थाना", "b": 1}, "created_at": "2024-03-01T10:00:00.000250+00:00"}, sort_keys=True)
    df = spark.createDataFrame([row], COLS)
    assert df.select(audit.canonical_with_blanks().alias("b")).first().b == body
    assert df.select(audit.link_hash(F.lit(None), F.lit(body)).alias("h")).first().h == hashlib.sha256(
        f"None|{body}".encode()).hexdigest()


def test_case_verdicts(spark):
    rows, cols = linear(spark, make_rows(50, seed=4), audit.canonical)
    _, links = verdict(spark, rows, cols)
    got = {r.case_id: r for r in audit.case_chain(links).collect()}
    for case in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == case]
        assert (got[case].chain_intact, got[case].total_entries, got[case].latest_hash) == (True, len(mine), mine[-1][-1])
    _, links = verdict(spark, rows[:10] + rows[12:], cols)
    assert all(r.latest_hash is None and not r.chain_intact for r in audit.case_chain(links).collect())


def test_sealed_in_chains_and_anchored(spark):
    rows = make_rows(90, seed=6, gaps=False)
    df = spark.createDataFrame(rows, COLS)
    sealed = audit.seal(df, bits=4)
    assert audit.chain_intact(audit.check_links(sealed, ["chain"])).first().chain_intact
    heads = audit.chain_heads(sealed)
    assert {r.state for r in audit.check_anchor(sealed, heads).collect()} == {"ok"}
    cut = sealed.filter("seq < 88")
    assert audit.chain_intact(audit.check_links(cut, ["chain"])).first().chain_intact
    assert {r.chain: r.state for r in audit.check_anchor(cut, heads).collect() if r.state != "ok"} == {5: "row_count_differs"}


def test_canonical_is_ordered_and_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None, None, "x", None, 3, "{}", datetime(2024, 1, 2, 3, 4, 5))], COLS)
    assert df.select(audit.canonical().alias("b")).first().b == (
        '{"action":"x","actor_user_id":null,"case_id":null,"created_at":"2024-01-02T03:04:05.000000+00:00",'
        '"metadata":"{}","target_id":"3","target_type":null}')


@pytest.mark.parametrize("bits", [2, 5, 16])
def test_previous_row_and_numbers_with_a_hot_key(spark, bits):
    rnd = random.Random(bits)
    order = sorted(rnd.sample(range(5000), 400))
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", None]), o, o * 10) for o in order]
    df = spark.createDataFrame(rows, "k STRING, o BIGINT, v BIGINT")
    last, count, expected = {}, {}, {}
    for k, o, v in rows:
        count[k] = count.get(k, 0) + 1
        expected[o] = (last.get(k), count[k])
        last[k] = v
    near = {r.o: r.previous_v for r in previous_row(df, "o", ["v"], ["k"], bits).collect()}
    numbers = {r.o: r.row_number for r in number_rows(df, "o", ["k"], bits=bits).collect()}
    assert {o: (near[o], numbers[o]) for o in near} == expected
    whole = {r.o: r.previous_v for r in previous_row(df, "o", ["v"], [], bits).collect()}
    assert whole == {o: (order[i - 1] * 10 if i else None) for i, o in enumerate(order)}


def test_slices_tell_gaps_from_neighbours(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (5, 2)], "seq BIGINT, case_id BIGINT")
    got = {r.seq: r.linked for r in audit.slice_links(df).collect()}
    assert got == {1: True, 2: True, 4: False, 3: False, 5: False}


def test_assigned_numbers_continue(spark):
    df = spark.createDataFrame([(10,), (30,), (20,)], "arrival BIGINT")
    assert sorted((r.arrival, r.seq) for r in audit.assign_seq(df, 7, "arrival").collect()) == [(10, 8), (20, 9), (30, 10)]
