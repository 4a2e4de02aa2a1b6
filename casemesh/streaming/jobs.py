"""Streaming forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from casemesh import constants as K
from casemesh.functions import patterns as P
from casemesh.operators import audit, layout, spans
from casemesh.operators.listing import idempotency_key
from casemesh.operators.machine import gate_events
from casemesh.operators.sequence import number_rows
from casemesh.streaming.processors import (Machine, OrderedLimit, Replay, SlidingLimit, StuckAlert, StuckInEventTime,
                                            WaitingPages, WriteOnce, pages_together)

#: How long a page's boxes are waited for after the last that came.
PAGE_PATIENCE_MS = 10 * 60_000
#: Keys of the state that holds waiting pages, each for its share of them. A stream's state stays bound to this number.
PAGE_BUCKETS = 1 << 10
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the RocksDB store; call before starting such a query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def once_per_delivery(stream: DataFrame, key: str = "idempotency_key", event_time: str | None = None,
                      horizon: str | None = None) -> DataFrame:
    """Drop redelivered rows by key; with a horizon the keys of the past are forgotten."""
    if horizon is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def ledger_stream(submissions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Outcome of every ``(seq, doc_id, doc_hash)``: recorded, noop or conflict; ``ledger`` is what is held already."""
    kt = submissions.schema["doc_id"].dataType.simpleString()
    known = _with_known(submissions, "doc_id", None if ledger is None else ledger.select("doc_id", F.col("ledger_hash").alias("known")))
    return _keyed(known.select("doc_id", "seq", "doc_hash", "known"), "doc_id").transformWithStateInPandas(
        statefulProcessor=WriteOnce(), outputStructType=f"seq BIGINT, doc_id {kt}, doc_hash STRING, outcome STRING",
        outputMode="Append", timeMode="None")


def _with_known(stream: DataFrame, key: str, known: DataFrame | None) -> DataFrame:
    """``stream`` with what is ``known`` (key, known) of each row's key, null if nothing.

    A static table is joined to every batch by Spark; as initial state it would go through Python key by key, those that
    the stream never names too. Of several rows with one key the least value counts.
    """
    if known is None:
        return stream.withColumn("known", F.lit(None).cast("string"))
    one = known.groupBy(F.col(key).alias("_key")).agg(F.min("known").alias("known"))
    return stream.join(one, stream[key].eqNullSafe(one["_key"]), "left").drop("_key")


def _keyed(rows: DataFrame, key: str) -> GroupedData:
    """``rows`` by ``key`` and whether it is null: Spark's Python state takes a null key for another one."""
    filled = F.coalesce(F.col(key), F.lit(0).cast(rows.schema[key].dataType))
    return rows.withColumn("_none", F.col(key).isNull()).withColumn(key, filled).groupBy(key, "_none")


def machine_stream(events: DataFrame, moves, first: str, initial: DataFrame | None = None) -> DataFrame:
    """State machine over ``(case_id, seq, action[, blocked])``.

    ``initial`` holds ``(case_id, state)`` of all cases: events of others are refused. Without it every case starts
    in ``first``.
    """
    kt = events.schema["case_id"].dataType.simpleString()
    if "blocked" not in events.columns:
        events = events.withColumn("blocked", F.lit(None).cast("string"))
    known = None if initial is None else initial.select("case_id", F.coalesce("state", F.lit(first)).alias("known"))
    begun = _with_known(events, "case_id", known)
    return _keyed(begun.select("case_id", "seq", "action", "blocked", "known"), "case_id").transformWithStateInPandas(
        statefulProcessor=Machine(moves, first if known is None else None),
        outputStructType=f"case_id {kt}, seq BIGINT, action STRING, from_state STRING, accepted BOOLEAN, "
                         "to_state STRING, reason STRING",
        outputMode="Append", timeMode="None")


def bail_stream(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    return machine_stream(events, K.BAIL_MOVES, K.BAIL_STATES[0], initial)


def case_stream(events: DataFrame, gate: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Investigation events, refused while the (static) stage gate is not met."""
    return machine_stream(gate_events(events, gate), K.CASE_MOVES, K.CASE_STATES[0], initial)


def rate_stream(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", clears: str | None = None,
                lateness: str = "10 minutes") -> DataFrame:
    """Verdict per event ``(key, seq, allowed, retry_after)``."""
    kt = events.schema[key].dataType.simpleString()
    slim = events.withWatermark(ts, lateness).select(
        F.col(key).alias("key"), "seq", ts, F.unix_micros(ts).alias("t"),
        (F.col(clears) if clears else F.lit(False)).alias("clears"))
    return slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SlidingLimit(limit, seconds),
        outputStructType=f"key {kt}, seq BIGINT, allowed BOOLEAN, retry_after INT", outputMode="Append",
        timeMode="EventTime")


def ordered_rate_stream(events: DataFrame, key: str, limit: int, seconds: int, ts: str = "ts", clears: str | None = None,
                        lateness: str = "10 minutes") -> DataFrame:
    """``rate_stream`` with rows judged in the order of event time, whatever batch they came in.

    A verdict comes out when the watermark, ``lateness`` behind the latest row, has passed its event; it is then the
    verdict of ``rate.rate_verdicts`` over all rows.
    """
    kt = events.schema[key].dataType.simpleString()
    slim = events.withWatermark(ts, lateness).select(
        F.col(key).alias("key"), "seq", ts, F.unix_millis(ts).alias("at_ms"), F.unix_micros(ts).alias("t"),
        (F.col(clears) if clears else F.lit(False)).alias("clears"))
    return slim.groupBy("key").transformWithStateInPandas(
        statefulProcessor=OrderedLimit(limit, seconds),
        outputStructType=f"key {kt}, seq BIGINT, allowed BOOLEAN, retry_after INT", outputMode="Append", timeMode="EventTime")


def stuck_in_event_time(status_changes: DataFrame, after_ms: int = K.STUCK_MINUTES * 60_000, ts: str = "ts",
                        lateness: str = "10 minutes") -> DataFrame:
    """Alerts ``(doc_id, due_ms)`` for documents in processing for longer than ``after_ms`` of event time, in event order."""
    kt = status_changes.schema["doc_id"].dataType.simpleString()
    slim = status_changes.withWatermark(ts, lateness).select("doc_id", "seq", ts, F.unix_millis(ts).alias("at_ms"), "status")
    return slim.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=StuckInEventTime(after_ms), outputStructType=f"doc_id {kt}, due_ms BIGINT", outputMode="Append",
        timeMode="EventTime")


def stuck_stream(status_changes: DataFrame, after_ms: int = K.STUCK_MINUTES * 60_000) -> DataFrame:
    """Alerts for documents that stay in processing: input ``(seq, doc_id, status)``."""
    kt = status_changes.schema["doc_id"].dataType.simpleString()
    return status_changes.select("doc_id", "seq", "status").groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=StuckAlert(after_ms), outputStructType=f"doc_id {kt}, due_ms BIGINT", outputMode="Append",
        timeMode="ProcessingTime")


# --- micro-batch jobs: every write is named by its batch, so a repeated batch overwrites itself --------

def _put(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _job(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def ingest_stream(uploads: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Two tracks from one stream of documents: hashes for the ledger, typed texts for tagging."""

    def write(batch: DataFrame, number: int) -> None:
        key = idempotency_key(F.col("doc_id"), F.col("version"))
        hashes = batch.select("doc_id", "version", F.sha2("raw_text", 256).alias("doc_hash"),
                              key.alias("idempotency_key"))
        _put(hashes, f"{out}/hash_track", number)
        _put(spans.tag_documents(batch), f"{out}/tag_track", number)

    return _job(uploads, checkpoint, write)


def whole_pages(boxes: DataFrame, patience_ms: int = PAGE_PATIENCE_MS, at: str = "at") -> DataFrame:
    """Box rows of pages that are there as a whole, or will not be: all boxes of a page come out in one batch, once.

    Input: box rows with ``page_boxes``, how many boxes their page has, and the event time ``at``. A page that lacks boxes
    when the watermark is ``patience_ms`` past its last one comes out with ``complete`` false.
    """
    kind = boxes.schema["doc_id"].dataType
    none = F.when(F.col("doc_id").isNull(), 1).otherwise(0) + F.when(F.col("page").isNull(), 2).otherwise(0)
    slim = boxes.withWatermark(at, "0 seconds").select(
        F.pmod(F.xxhash64("doc_id", "page"), F.lit(PAGE_BUCKETS)).cast("int").alias("bucket"), none.alias("none"),
        F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.coalesce("page", F.lit(0)).cast("int").alias("page"),
        *WaitingPages.COLUMNS, "page_boxes", at, F.unix_millis(at).alias("at_ms"))
    return slim.groupBy("bucket").applyInPandasWithState(
        pages_together(patience_ms), f"doc_id {kind.simpleString()}, page INT, {WaitingPages.BOX}, complete BOOLEAN",
        WaitingPages.STATE, "append", "EventTimeTimeout")


def layout_stream(boxes: DataFrame, out: str, checkpoint: str, patience_ms: int = PAGE_PATIENCE_MS,
                  at: str = "at") -> DataStreamWriter:
    """Box rows to page texts.

    With ``page_boxes`` and an event time, as ``whole_pages`` takes them, each page is written once with ``complete``,
    however many batches its boxes came in, and a page announced without any box gets an empty text. Without
    ``page_boxes`` all boxes of a page have to come in one batch.
    """
    counted = "page_boxes" in boxes.columns

    def write(batch: DataFrame, number: int) -> None:
        if not counted:
            _put(layout.reconstruct(batch), out, number)
            return
        # the batch comes out of keyed state, which must be run once: it is stored before it is used twice
        _put(batch, f"{out}-boxes", number)
        whole = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}-boxes/batch={number}")
        listed = whole.groupBy("doc_id", "page").agg(F.bool_and("complete").alias("complete"))
        pages = layout.reconstruct(whole.filter("box_no IS NOT NULL"), listed=listed)
        _put(pages.join(listed, ["doc_id", "page"]), out, number)

    return _job(whole_pages(boxes, patience_ms, at) if counted else boxes, checkpoint, write)


def page_tag_stream(pages: DataFrame, out: str, checkpoint: str,
                    recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS) -> DataStreamWriter:
    """Page texts, as ``layout_stream`` writes them, to spans per page."""
    recognizers = tuple(recognizers)

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.select(F.struct("doc_id", "page").alias("key"), "text")
        tags = spans.tag_documents(keyed, "key", "text", recognizers)
        _put(tags.select("key.*", *(c for c in tags.columns if c != "key")), out, number)

    return _job(pages, checkpoint, write)


def diary_stream(entries: DataFrame, out: str, checkpoint: str,
                 recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS) -> DataStreamWriter:
    """Diary entries with their spans; an entry turns ``ready`` in the same write that stores its spans."""
    recognizers = tuple(recognizers)

    def write(batch: DataFrame, number: int) -> None:
        done = spans.tagged(batch, "text", recognizers).withColumn("status", F.lit("ready"))
        _put(done, out, number)

    return _job(entries, checkpoint, write)


TIP = "chain BIGINT, last_seq BIGINT, head_hash STRING"


def seal_stream(events: DataFrame, out: str, checkpoint: str, order: str = "event_id", bits: int = audit.SEAL_BITS,
                content: Callable[[], Column] = audit.canonical) -> DataStreamWriter:
    """Append events to the sealed log under ``out/log``, continuing after the last sealed row.

    Batches run one after another, so numbering is serial across batches and parallel within one. A chain left
    open by the batch before is continued from its head; ``out/heads`` keeps the heads each batch made, ``out/tip`` where
    the log ended after it, so a batch reads one row of what came before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        heads, last, tip = None, 0, None
        if number > 0:  # the batch before has left where the log ends, also if it was empty
            tip = spark.read.schema(TIP).parquet(f"{out}/tip/batch={number - 1}").first()
        if tip is not None:
            last = tip["last_seq"]
            heads = spark.createDataFrame([(tip["chain"], tip["head_hash"])], "chain BIGINT, head_hash STRING")
        sealed = audit.seal(audit.assign_seq(batch, last, order), bits, heads, content)
        _put(sealed, f"{out}/log", number)
        stored = spark.read.parquet(f"{out}/log/batch={number}")
        _put(audit.chain_heads(stored), f"{out}/heads", number)
        ends = spark.read.parquet(f"{out}/heads/batch={number}").select(F.struct("chain", "last_seq", "head_hash").alias("h"))
        kept = spark.createDataFrame([] if tip is None else [tuple(tip)], TIP).select(F.struct("*").alias("h"))
        latest = ends.unionByName(kept).agg(F.max_by("h", "h.last_seq").alias("h")).filter("h IS NOT NULL")
        _put(latest.select("h.*"), f"{out}/tip", number)

    return _job(events, checkpoint, write)


def replay(actions: DataFrame) -> DataFrame:
    """Actions recorded offline ``(device, local_seq, payload, payload_hash, device_at, received_at)``.

    Redelivered actions are taken once; each gets its place in its device's order and whether its payload still
    has the fingerprint taken on the device. Batch frames only.
    """
    # of several deliveries under one number the earliest counts, by its fingerprint if they came together
    place = ["device", "local_seq"]
    leading = [c for c in ("received_at", "payload_hash") if c in actions.columns]
    rest = [c for c in actions.columns if c not in (*place, *leading)]
    first = F.min(F.struct(*leading, *rest)).alias("first")
    once = actions.groupBy(*place).agg(first).select(*place, "first.*").select(*actions.columns)
    checked = once.withColumn("verdict", F.when(
        F.sha2("payload", 256) == F.col("payload_hash"), "accepted").otherwise("tampered"))
    return number_rows(checked, "local_seq", ["device"], "position").withColumn("source", F.lit("offline_sync"))


def replay_conflicts(actions: DataFrame) -> DataFrame:
    """Deliveries ``(device, local_seq, payload_hash)`` whose payload is not the one that counts under their number."""
    leading = [c for c in ("received_at", "payload_hash") if c in actions.columns]
    counts = actions.groupBy("device", "local_seq").agg(F.min(F.struct(*leading))["payload_hash"].alias("counts"))
    other = actions.select("device", "local_seq", "payload_hash").distinct()
    return other.join(counts, ["device", "local_seq"]).filter("payload_hash <> counts").drop("counts")


def continued_replay(actions: DataFrame, keep_ms: int = 30 * 86_400_000, lateness: str = "1 day") -> DataFrame:
    """``replay`` over a stream: positions go on from batch to batch, redeliveries are taken once, conflicts are listed.

    Output ``(device, local_seq, payload_hash, verdict, position)``, the verdict accepted, tampered, conflict or late.
    Fingerprints are kept until ``keep_ms`` after their delivery, by ``received_at``.
    """
    kt = actions.schema["device"].dataType.simpleString()
    slim = actions.withWatermark("received_at", lateness).select(
        "device", "local_seq", "payload_hash", "received_at", F.unix_millis("received_at").alias("received_ms"),
        F.sha2("payload", 256).eqNullSafe(F.col("payload_hash")).alias("whole"))
    return slim.groupBy("device").transformWithStateInPandas(
        statefulProcessor=Replay(keep_ms),
        outputStructType=f"device {kt}, local_seq BIGINT, payload_hash STRING, verdict STRING, position BIGINT",
        outputMode="Append", timeMode="EventTime")


def replay_stream(actions: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """Offline batches as they arrive; positions are per device and batch, ``local_seq`` orders across batches."""

    def write(batch: DataFrame, number: int) -> None:
        _put(replay(batch), out, number)

    return _job(actions.dropDuplicates(["device", "local_seq"]), checkpoint, write)
