"""Streams run to the end of the supplied tables; their stored results are compared like any other query's."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from casemesh.plans.access_queries import SUBMISSIONS_WRITE_ONCE
from casemesh.plans.integrity_queries import BAIL, LIVE
from casemesh.plans.layout_queries import LISTED, ROWS
from casemesh.plans.registry import query
from casemesh.session import cut_lineage, shared_dir
from casemesh.sources.tables import SUPPLIED
from casemesh.streaming import jobs as J


def _stream(m, name: str):
    """One supplied table as a stream of its files."""
    return m.spark.readStream.schema(SUPPLIED[name]).parquet(f"{m.sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _folder(m) -> str:
    return f"{shared_dir(m.spark)}/streams/{uuid.uuid4().hex}"


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _store(m, df):
    """Run a keyed-state stream into files and read them back."""
    J.use_keyed_state(m.spark)
    base = _folder(m)
    _run(df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state"))
    return m.spark.read.schema(df.schema).parquet(f"{base}/out")


def _in_parts(m, df, part, start) -> None:
    """Run ``start(stream)`` once for each value of ``part``, with that part's rows as new files of the stream."""
    path = f"{_folder(m)}/in"
    dealt = cut_lineage(df.withColumn("_part", part.cast("int")))  # made once, not once a part
    for number in range(PARTS):
        dealt.filter(F.col("_part") == number).drop("_part").write.mode("append").parquet(path)
        _run(start(m.spark.readStream.schema(df.schema).parquet(path)))


def _store_parts(m, df, part, make):
    """As ``_store`` for a stream whose rows come in parts."""
    J.use_keyed_state(m.spark)
    base = _folder(m)
    schemas = []

    def start(stream):
        made = make(stream)
        schemas.append(made.schema)
        return made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")

    _in_parts(m, df, part, start)
    return m.spark.read.schema(schemas[0]).parquet(f"{base}/out")


PARTS = 3
#: The part an event comes in: by its day, but up to a day sooner or later than its turn.
COMES = (f"CASE WHEN event_id IS NULL THEN {PARTS - 1} ELSE least({PARTS - 1}, greatest(0, floor("
         "(unix_seconds(ts) / 3600 - 473352 + (event_id * 37) % 48 - 24) / 240))) END")
LATENESS = "49 hours"


def _tick(rows):
    """One row far behind all others in event time, of key -1, so that the watermark passes them all."""
    last = rows.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    rest = [F.lit(-1 if f.name in ("account", "doc_id", "seq") else None).cast(f.dataType).alias(f.name)
            for f in rows.schema if f.name != "ts"]
    return last.select("ts", *rest).select(rows.columns)


@query("ledger_stream", SUBMISSIONS_WRITE_ONCE)
def _(m):
    subs = _stream(m, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"),
        F.sha2((F.col("event_id") % 3).cast("string"), 256).alias("doc_hash"))
    return _store(m, J.ledger_stream(subs, m.m_ledger))


@query("bail_stream", f"WITH {BAIL} SELECT * FROM applied")
def _(m):
    action = ("CASE event_type WHEN 'view' THEN 'arrest' WHEN 'click' THEN 'application' WHEN 'purchase' THEN 'hearing' "
              "WHEN 'signup' THEN 'surety' ELSE CASE WHEN value > 5 THEN 'order_grant' ELSE 'order_deny' END END")
    events = _stream(m, "events").selectExpr("user_id AS case_id", "event_id AS seq", f"{action} AS action")
    initial = m.m_cases.select("case_id", F.coalesce("bail_status", F.lit("")).alias("state"))
    return _store(m, J.bail_stream(events, initial))


@query("upload_hash_stream", """
SELECT doc_id, 1 AS version, sha256(text) AS doc_hash, concat(doc_id, ':v1') AS idempotency_key FROM documents""")
def _(m):
    uploads = _stream(m, "documents").select("doc_id", F.lit(1).alias("version"), F.col("text").alias("raw_text"))
    base = _folder(m)
    _run(J.ingest_stream(uploads, f"{base}/out", f"{base}/state"))
    return m.spark.read.parquet(f"{base}/out/hash_track").drop("batch")


@query("diary_stream")
def _(m):
    entries = _stream(m, "conversations").selectExpr("conv_id * 1000 + turn AS entry_id", "conv_id AS case_id", "text")
    base = _folder(m)
    _run(J.diary_stream(entries, f"{base}/out", f"{base}/state"))
    return m.spark.read.parquet(f"{base}/out").select("entry_id", "status", F.size("spans").alias("spans"))


@query("audit_seal_stream", """
WITH c AS (SELECT event_id + 1 AS seq, (event_id + 1) >> 6 AS chain, to_json({'action': event_type, 'actor_user_id':
    CAST(user_id AS VARCHAR), 'case_id': CAST(user_id AS VARCHAR), 'created_at': strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'),
    'metadata': props, 'target_id': CAST(event_id AS VARCHAR), 'target_type': 'event'}) AS body,
  row_number() OVER (PARTITION BY (event_id + 1) >> 6 ORDER BY event_id) AS i FROM events),
 s AS (SELECT chain, i, seq, sha256(concat('None|', body)) AS row_hash FROM c WHERE i = 1
   UNION ALL SELECT c.chain, c.i, c.seq, sha256(concat(s.row_hash, '|', c.body)) FROM s JOIN c ON c.chain = s.chain AND c.i = s.i + 1)
SELECT seq, row_hash FROM s""")
def _(m):
    rows = _stream(m, "events").select(
        "event_id", F.col("event_type").alias("action"), F.col("user_id").alias("actor_user_id"),
        F.col("user_id").alias("case_id"), F.col("ts").alias("created_at"), F.col("props").alias("metadata"),
        F.col("event_id").alias("target_id"), F.lit("event").alias("target_type"))
    base = _folder(m)
    _run(J.seal_stream(rows, f"{base}/out", f"{base}/state", bits=6))
    return m.spark.read.parquet(f"{base}/out/log").select("seq", "row_hash")


@query("offline_replay", """
SELECT user_id AS device, event_id AS local_seq, props AS payload, CASE WHEN event_type = 'error' THEN sha256('?') ELSE
  sha256(props) END AS payload_hash, ts AS device_at, CASE WHEN event_type = 'error' THEN 'tampered' ELSE 'accepted' END AS verdict,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position, 'offline_sync' AS source FROM events""")
def _(m):
    error = F.col("event_type") == "error"
    actions = m.events.select(
        F.col("user_id").alias("device"), F.col("event_id").alias("local_seq"), F.col("props").alias("payload"),
        F.when(error, F.sha2(F.lit("?"), 256)).otherwise(F.sha2("props", 256)).alias("payload_hash"),
        F.col("ts").alias("device_at"))
    return J.replay(actions.unionByName(actions))


# --- streams in event order, their rows up to two days out of order over three batches ----------------

@query("login_rate_stream", f"""
WITH {LIVE} SELECT account AS key, seq, allowed, retry_after FROM live WHERE i > 0""")
def _(m):
    logins = m.m_logins.withColumn("event_id", F.col("seq"))
    rows = logins.unionByName(_tick(logins))
    kept = _store_parts(m, rows, F.expr(COMES), lambda s: J.ordered_rate_stream(
        s, "account", 3, 86400, clears="succeeded", lateness=LATENESS))
    return kept.filter("key >= 0")


@query("stuck_stream", """
SELECT user_id AS doc_id, epoch_us(ts) // 1000 + 21600000 AS due_ms FROM (SELECT user_id, ts, event_type,
  lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
WHERE event_type IN ('view', 'purchase') AND (next IS NULL OR epoch_us(next) // 1000 > epoch_us(ts) // 1000 + 21600000)""")
def _(m):
    """Documents six hours in processing without another change of status."""
    status = F.when(F.col("event_type").isin("view", "purchase"), "processing").otherwise("ready")
    changes = m.events.select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))
    rows = changes.unionByName(_tick(changes))
    kept = _store_parts(m, rows, F.expr(COMES),
                        lambda s: J.stuck_in_event_time(s, 21_600_000, lateness=LATENESS))
    return kept.filter("doc_id >= 0")


@query("deliveries_once", """
SELECT concat(user_id, ':', event_type) AS idempotency_key, count(*) AS deliveries, 1 AS kept FROM events
WHERE event_id % 10 < 3 GROUP BY 1""")
def _(m):
    """Every delivery arrives three times, in three batches; keys are forgotten once the horizon has passed."""
    key = F.concat("user_id", F.lit(":"), "event_type", F.lit(":"), "event_id")
    events = m.events.filter("event_id % 10 < 3").select("ts", key.alias("idempotency_key"))
    again = events.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    once = _store_parts(m, again, F.col("part"), lambda s: J.once_per_delivery(s, event_time="ts", horizon="60 days"))
    counted = once.groupBy("idempotency_key").agg(F.count("*").alias("n"))
    short = F.regexp_extract("idempotency_key", "^(.*):[^:]*$", 1)
    return counted.groupBy(short.alias("idempotency_key")).agg(
        F.count("*").alias("deliveries"), F.max("n").cast("int").alias("kept"))


@query("page_stream", f"""
WITH {ROWS}, {LISTED}
SELECT doc_id, page, coalesce(text, '') AS text, CAST(coalesce(row_count, 0) AS BIGINT) AS row_count,
  CAST(coalesce(token_count, 0) AS BIGINT) AS token_count, true AS complete FROM listed LEFT JOIN pg USING (doc_id, page)""")
def _(m):
    """Every page's boxes come in three batches; a blank page is announced without any."""
    boxes = m.m_boxes
    counted = boxes.filter("doc_id IS NOT NULL AND page IS NOT NULL").withColumn(  # counted in passing: words are not laid out twice
        "page_boxes", F.count("*").over(Window.partitionBy("doc_id", "page")).cast("int"))
    blank = boxes.filter("doc_id % 4 = 0").select("doc_id", F.lit(99).alias("page"), F.lit(0).alias("page_boxes")).distinct()
    rows = counted.unionByName(blank, allowMissingColumns=True).withColumn("part", F.coalesce(F.col("box_no") % PARTS, F.lit(0)))
    rows = rows.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("part")))
    base = _folder(m)
    J.use_keyed_state(m.spark)
    _in_parts(m, rows, F.col("part"), lambda s: J.layout_stream(s, f"{base}/out", f"{base}/state"))
    return m.spark.read.parquet(f"{base}/out").select("doc_id", "page", "text", "row_count", "token_count", "complete")


@query("replay_stream", """
WITH a AS (SELECT user_id AS device, event_id AS local_seq, sha256(props) AS good, event_type FROM events)
SELECT device, local_seq, CASE WHEN event_type = 'error' THEN sha256('?') ELSE good END AS payload_hash,
  CASE WHEN event_type = 'error' THEN 'tampered' ELSE 'accepted' END AS verdict,
  row_number() OVER (PARTITION BY device ORDER BY local_seq) AS position FROM a
UNION ALL SELECT device, local_seq, sha256(concat('other ', local_seq)), 'conflict', NULL FROM a WHERE local_seq % 9 = 0""")
def _(m):
    """Three batches by number; the later ones deliver the earlier again, some under another fingerprint."""
    error = F.col("event_type") == "error"
    first = m.events.select(
        F.col("user_id").alias("device"), F.col("event_id").alias("local_seq"), F.col("props").alias("payload"),
        F.when(error, F.sha2(F.lit("?"), 256)).otherwise(F.sha2("props", 256)).alias("payload_hash"),
        F.col("ts").alias("received_at"), F.expr(f"least({PARTS - 1}, floor(day(ts) / 11))").alias("part"))
    later = F.col("received_at") + F.expr("INTERVAL 60 DAYS")
    again = first.withColumn("received_at", later).withColumn("part", F.explode(F.sequence(F.col("part"), F.lit(PARTS - 1))))
    other = first.filter("local_seq % 9 = 0").withColumn("received_at", later).withColumn("part", F.lit(PARTS - 1)).withColumn(
        "payload_hash", F.sha2(F.concat(F.lit("other "), "local_seq"), 256))
    return _store_parts(m, first.unionByName(again).unionByName(other), F.col("part"), lambda s: J.continued_replay(
        s, lateness="100 days"))


@query("replay_conflicts", """
SELECT user_id AS device, event_id AS local_seq, sha256(concat('other ', event_id)) AS payload_hash FROM events WHERE event_id % 9 = 0""")
def _(m):
    first = m.events.select(F.col("user_id").alias("device"), F.col("event_id").alias("local_seq"), F.col("props").alias("payload"),
                            F.sha2("props", 256).alias("payload_hash"), F.col("ts").alias("received_at"))
    other = first.filter("local_seq % 9 = 0").withColumn("payload_hash", F.sha2(F.concat(F.lit("other "), "local_seq"), 256))
    return J.replay_conflicts(first.unionByName(first).unionByName(
        other.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 DAY"))))
