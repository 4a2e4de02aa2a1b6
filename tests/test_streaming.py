import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators import audit
from casemesh.streaming import jobs as J


@pytest.fixture()
def stream(spark, tmp_path):
    """Batches as files, one micro-batch each."""
    def make(schema, *batches):
        folder = tmp_path / f"in{random.randrange(10**9)}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return make


@pytest.fixture()
def run(spark, tmp_path):
    def go(df):
        J.use_keyed_state(spark)
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(out).collect()
    return go


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_ledger_is_write_once_across_batches(spark, stream, run):
    df = stream("seq BIGINT, doc_id BIGINT, doc_hash STRING", [(1, 7, "a"), (2, 8, "b"), (3, 7, "a")], [(4, 7, "x"), (5, 9, "h"), (6, 8, "b")])
    held = spark.createDataFrame([(9, "h")], "doc_id BIGINT, ledger_hash STRING")
    assert {r.seq: r.outcome for r in run(J.ledger_stream(df, held))} == {
        1: "recorded", 2: "recorded", 3: "noop", 4: "conflict", 5: "noop", 6: "noop"}


def test_investigation_track_with_static_gate(spark, stream, run):
    df = stream("case_id BIGINT, seq BIGINT, action STRING", [(1, 1, "file_charge_sheet"), (2, 2, "file_charge_sheet")],
                [(1, 3, "trial_hearing"), (1, 4, "trial_hearing"), (1, 5, "judgment")])
    gate = spark.createDataFrame([(2, ["Document: FIR"])], "case_id BIGINT, missing_items ARRAY<STRING>")
    got = {r.seq: (r.accepted, r.reason) for r in run(J.case_stream(df, gate))}
    assert got == {1: (True, None), 2: (False, "missing_requirements"), 3: (True, None), 4: (False, "illegal_move"), 5: (True, None)}


def test_rate_limit_stream_equals_batch(spark, stream, run):
    from casemesh.operators.rate import rate_verdicts
    rnd, t, rows = random.Random(1), 0, []
    for seq in range(120):
        t += rnd.choice([0, 2, 20, 70])
        rows.append((rnd.choice(["a", "b"]), seq, datetime(2024, 1, 1) + timedelta(seconds=t), rnd.random() < 0.2))
    schema = "account STRING, seq BIGINT, ts TIMESTAMP, ok BOOLEAN"
    streamed = run(J.rate_stream(stream(schema, rows[:50], rows[50:90], rows[90:]), "account", 2, 60, clears="ok"))
    batch = rate_verdicts(spark.createDataFrame(rows, schema), "account", 2, 60, clears="ok").collect()
    assert sorted((r.seq, r.allowed, r.retry_after) for r in streamed) == sorted((r.seq, r.allowed, r.retry_after) for r in batch)


def test_stuck_documents_alert_once(spark, stream, tmp_path):
    J.use_keyed_state(spark)
    df = stream("seq BIGINT, doc_id BIGINT, status STRING", [(1, 7, "processing"), (2, 8, "processing"), (3, 8, "ready")])
    query = J.stuck_stream(df, after_ms=100).writeStream.format("memory").queryName("stuck").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            if spark.sql("SELECT * FROM stuck").count():
                break
            query.awaitTermination(0.5)
        assert [r.doc_id for r in spark.sql("SELECT * FROM stuck").collect()] == [7]
    finally:
        query.stop()


def test_redeliveries_count_once(spark, stream, run):
    df = stream("idempotency_key STRING, at TIMESTAMP", [("1:v1", datetime(2024, 1, 1)), ("1:v1", datetime(2024, 1, 1))],
                [("1:v1", datetime(2024, 1, 1, 0, 1)), ("2:v1", datetime(2024, 1, 1, 0, 2))])
    kept = run(J.once_per_delivery(df, event_time="at", horizon="1 hour"))
    assert sorted(r.idempotency_key for r in kept) == ["1:v1", "2:v1"]


def test_two_tracks_and_diary(spark, stream, tmp_path):
    docs = stream("doc_id BIGINT, version INT, raw_text STRING", [(1, 1, "mail a@b.example")], [(2, 1, "none")])
    finish(J.ingest_stream(docs, str(tmp_path / "o"), str(tmp_path / "c")))
    assert sorted(r.idempotency_key for r in spark.read.parquet(str(tmp_path / "o/hash_track")).collect()) == ["1:v1", "2:v1"]
    assert [(r.doc_id, r.entity_type) for r in spark.read.parquet(str(tmp_path / "o/tag_track")).collect()] == [(1, "EMAIL_ADDRESS")]
    entries = stream("entry_id BIGINT, text STRING, status STRING", [(1, "mail a@b.example", "processing")])
    finish(J.diary_stream(entries, str(tmp_path / "d"), str(tmp_path / "dc")))
    row = spark.read.parquet(str(tmp_path / "d")).first()
    assert row.status == "ready" and row.spans[0].entity_type == "EMAIL_ADDRESS"


def test_pages_flow_into_tags(spark, stream, tmp_path):
    schema = "doc_id BIGINT, page INT, box_no INT, text STRING, confidence DOUBLE, x1 INT, y1 INT, x2 INT, y2 INT"
    boxes = stream(schema, [(1, 1, 0, "write to", 0.9, 0, 0, 90, 20), (1, 1, 1, "a@b.example", 0.9, 100, 0, 200, 20)])
    finish(J.layout_stream(boxes, str(tmp_path / "pages"), str(tmp_path / "c1")))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    pages = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "pages"))
    finish(J.page_tag_stream(pages, str(tmp_path / "tags"), str(tmp_path / "c2")))
    tag = spark.read.parquet(str(tmp_path / "tags")).first()
    assert (tag.doc_id, tag.page, tag.entity_type, tag.span_start, tag.span_end) == (1, 1, "EMAIL_ADDRESS", 9, 20)


def test_sealing_continues_over_batches(spark, stream, tmp_path):
    schema = ("event_id BIGINT, case_id BIGINT, actor_user_id BIGINT, action STRING, target_type STRING, target_id BIGINT, "
              "metadata STRING, created_at TIMESTAMP")
    rows = [(i, i % 3, 5, "x", "t", i, "{}", datetime(2024, 1, 1)) for i in range(40)]
    events = stream(schema, rows[:9], rows[9:25], rows[25:])
    out = str(tmp_path / "sealed")
    finish(J.seal_stream(events, out, str(tmp_path / "c"), bits=3))
    log = spark.read.parquet(f"{out}/log").drop("batch")
    assert sorted(r.seq for r in log.collect()) == list(range(1, 41))
    assert audit.chain_intact(audit.check_links(log, ["chain"])).first().chain_intact
    again = audit.seal(log.select(*[c for c in log.columns if c not in ("chain", "prev_hash", "row_hash")]), bits=3)
    assert {r.seq: r.row_hash for r in log.collect()} == {r.seq: r.row_hash for r in again.collect()}


def test_offline_actions_replay_in_device_order(spark):
    good = F.sha2("payload", 256)
    df = spark.createDataFrame([("d1", 5, "a"), ("d1", 2, "b"), ("d1", 2, "b"), ("d2", 1, "c")],
                               "device STRING, local_seq BIGINT, payload STRING").withColumn(
        "payload_hash", F.when(F.col("payload") == "c", "bad").otherwise(good))
    got = {(r.device, r.local_seq): (r.position, r.verdict) for r in J.replay(df).collect()}
    assert got == {("d1", 2): (1, "accepted"), ("d1", 5): (2, "accepted"), ("d2", 1): (1, "tampered")}
    assert K.STUCK_MINUTES == 10


PAGES = ("doc_id BIGINT, page INT, box_no INT, text STRING, confidence DOUBLE, x1 INT, y1 INT, x2 INT, y2 INT, page_boxes INT, "
         "at TIMESTAMP")


def box(page, number, of, minute, text="word"):
    return (1, page, number, text, 0.9, 100 * number, 0, 100 * number + 60, 20, of, datetime(2024, 1, 1, 0, minute))


def test_a_page_over_several_batches_is_written_once(spark, stream, tmp_path):
    J.use_keyed_state(spark)
    blank = (1, 3, *[None] * 7, 0, datetime(2024, 1, 1))
    boxes = stream(PAGES, [box(1, 0, 3, 0, "one"), box(2, 0, 2, 0, "early"), blank],
                   [box(1, 1, 3, 1, "two"), box(1, 0, 3, 1, "one")], [box(1, 2, 3, 2, "three")],
                   [box(4, 0, 1, 58, "later")], [box(5, 0, 1, 59, "last")], [box(1, 1, 3, 59, "two"), box(2, 1, 2, 59, "too late")])
    finish(J.layout_stream(boxes, str(tmp_path / "pages"), str(tmp_path / "c")))
    got = [(r.page, r.text, r.complete) for r in spark.read.parquet(str(tmp_path / "pages")).collect()]
    assert sorted(got) == [(1, "one two three", True), (2, "early", False), (3, "", True), (4, "later", True), (5, "last", True)]


def test_late_rows_are_judged_in_event_order(spark, stream, run):
    at = lambda minute: datetime(2024, 1, 1, minute // 60, minute % 60)
    rows = [("a", n, at(m), False) for n, m in enumerate((0, 10, 20, 30, 100, 110))] + [("z", 99, at(600), False)]
    order = [rows[3], rows[0], rows[5]], [rows[1], rows[4]], [rows[2], rows[6]]
    got = run(J.ordered_rate_stream(stream("k STRING, seq BIGINT, ts TIMESTAMP, ok BOOLEAN", *order), "k", 2, 3600, lateness="2 hours"))
    assert {r.seq: r.allowed for r in got if r.key == "a"} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_replay_goes_on_over_batches(spark, stream, run):
    good = lambda p: __import__("hashlib").sha256(p.encode()).hexdigest()
    act = lambda n, p, minute, h=None: ("d", n, p, h or good(p), datetime(2024, 1, 1, 0, minute))
    df = stream("device STRING, local_seq BIGINT, payload STRING, payload_hash STRING, received_at TIMESTAMP",
                [act(2, "b", 0), act(5, "e", 0)], [act(5, "e", 1), act(6, "f", 1, "bad"), act(2, "other", 1), act(3, "c", 1)], [act(9, "i", 2)])
    got = {(r.local_seq, r.verdict): r.position for r in run(J.continued_replay(df))}
    assert got == {(2, "accepted"): 1, (5, "accepted"): 2, (6, "tampered"): 3, (2, "conflict"): None, (3, "late"): None, (9, "accepted"): 4}
