"""What a query costs: even tasks, cheap looks at the start of a match, few calls of keyed state."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from casemesh.functions import patterns as P
from casemesh.operators import detect, spans
from casemesh.plans.models import Models
from casemesh.session import spread
from casemesh.streaming import jobs as J
from casemesh.streaming.processors import OrderedLimit, PageBoxes, Replay, StuckInEventTime, WaitingPages



@pytest.fixture()
def one_row_group(spark, tmp_path):
    """A folder with a table of one file and one row group that a scan splits into many tasks, all but one without rows."""
    def make(df, name):
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return str(tmp_path)
    yield make
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_rows_of_one_row_group_are_spread(spark, one_row_group):
    folder = one_row_group(spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")), "t")
    read = spark.read.parquet(f"{folder}/t.parquet")
    assert read.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert read.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n).count() == 1
    sizes = spread(read).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 4000 and max(sizes) <= 2 * 4000 / spark.sparkContext.defaultParallelism
    assert spread(read).exceptAll(read).count() == 0


def test_words_of_boxes_and_forms_are_spread(spark, one_row_group):
    turns = spark.range(600).selectExpr("id AS conv_id", "id % 3 AS turn", "'user' AS role", "sha2(cast(id AS string), 512) AS text")
    folder = one_row_group(turns, "conversations")
    boxes = Models(spark, folder).m_boxes.select("doc_id").rdd
    assert boxes.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n).count() > 1
    orders = spark.range(3000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice",
                                          "timestamp '2020-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    one_row_group(orders, "orders")
    m = Models(spark, folder)
    forms = m.spread("m_forms")
    assert forms.select("doc_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(lambda n: n).count() > 1
    assert forms.exceptAll(m.m_forms).count() == m.m_forms.exceptAll(forms).count() == 0


HARD = ["", "x", "call +91 9876543210 or 98765 43210, 123-456-7890. é9876543210 ९८७६५४३२१०", "2345 6789 0123 é2345 6789 0123",
        "ABCDE1234F, ABCDE 12O4 F, éABCDE1234F abcde1234f", "A GUNSHOT  wound, Trauma, blunt force trauma, post-mortem, Rigor Mortis tRAUMATIC shock",
        "Mr. Rajesh Kumar 1; VICTIM: Sunita Rao 2; sub-inspector Amit 3; Witness Om 4; hc Lal 5; Officer Das",
        "named Ram Lal Das, alias Om Prakash, identified as Jo Bo, Son of Sita Devi, w/o Om Lal, D/O Ram Rao",
        "name: ram lal, informant - om das, Complainant/ Shri Jo Bo, suspect. ab cde fgh, VICTIM: abc def",
        "wife of Sh. Ram Lal, s/o LT. om prakash das", "10.0.0.1 1234 5678 9012 3456 (123) 456-7890", "AB-CD-12 ABC/123/2020",
        "u/s 154 Cr.P.C., 379/411 IPC; Section 3 BNS, Sec. 4 I.P.C, sec5 b.n.s.s., 302(2) & 4A pocso, N.D.P.S. PMLA m.c.o.c.a IT  Act 66",
        "U/S 5 bsa धारा 302 भा.दं.सं. अधिनियम 4 IPC संहिता IPC ६६ ipc crpc BSA B.S.A. it act", "P.S. F.I.R. No. S.No. g.d. no District xDistrict थाना जिला समय",
        "प्र.सू.रि. दिनांक वर्ष अधिनियम धाराएँ धाराएं FIR No fir no. P. S. p.s"]
KNOWN = (*P.DEFAULT_RECOGNIZERS, *P.ID_RECOGNIZERS, P.PHONE_AS_PRINTED, P.CITATION, P.CAPTION)


def test_a_look_at_the_start_changes_no_match(spark):
    texts = spark.createDataFrame([(t,) for t in [*HARD, " | ".join(HARD), "".join(HARD)]], "text STRING")
    with_start = [r for r in KNOWN if r.starts]
    assert {r.entity_type for r in KNOWN} - {r.entity_type for r in with_start} == {"EMAIL_ADDRESS"}
    for r in with_start:
        whole = replace(r, starts=None)
        row = texts.select(detect.match_spans(F.col("text"), r).alias("a"), detect.match_spans(F.col("text"), whole).alias("b")).collect()
        assert [x.a for x in row] == [x.b for x in row]
        assert any(x.a for x in row), r


def test_ranges_are_found_once_a_text(spark):
    """Protected ranges do not depend on a span; they were looked for again for each."""
    docs = spark.createDataFrame([(1, "Mr Ram Lal, Mr Om Das, u/s 4 IPC")], "doc_id BIGINT, raw_text STRING")
    plan = spans.tagged(docs)._jdf.queryExecution().analyzed().toString()
    patterns = plan.count("named_struct(kind, CAPTION") + plan.count("struct(kind, CAPTION") - plan.count("named_struct(kind, CAPTION")
    assert patterns == 1


class Cell:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.rows, self.held = calls, None, [], {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return getattr(self, f"_{name}")(*args)
        return call

    def _get(self):
        return iter(list(self.rows)) if self.value is None and self.listed else self.value

    def _exists(self):
        return self.value is not None or bool(self.rows)

    def _update(self, value):
        self.value = value

    def _clear(self):
        self.value, self.rows = None, []

    def _put(self, rows):
        self.rows = list(rows)

    def _appendList(self, rows):
        self.rows += rows


class Handle:
    def __init__(self):
        self.calls = []

    def _cell(self, listed):
        cell = Cell(self.calls)
        cell.listed = listed
        return cell

    def getValueState(self, name, schema):
        return self._cell(False)

    def getListState(self, name, schema):
        return self._cell(True)

    def registerTimer(self, at):
        self.calls.append("registerTimer")

    def deleteTimer(self, at):
        self.calls.append("deleteTimer")


class Times:
    def getCurrentWatermarkInMs(self):
        return 10_000


def test_a_device_costs_few_state_calls_a_batch():
    processor, handle = Replay(1000), Handle()
    processor.init(handle)
    rows = pd.DataFrame({"device": 1, "local_seq": range(500), "payload_hash": [f"h{n}" for n in range(500)], "received_ms": 5, "whole": True})
    out = pd.concat(list(processor.handleInputRows((1,), iter([rows]), None)))
    assert out["verdict"].tolist() == ["accepted"] * 500 and out["position"].tolist() == list(range(1, 501))
    assert len(handle.calls) < 10
    again = rows.assign(payload_hash=["x", *rows["payload_hash"][1:]])
    assert [tuple(r)[1:4] for o in processor.handleInputRows((1,), iter([again]), None) for r in o.itertuples(index=False)] == [(0, "x", "conflict")]


@pytest.mark.parametrize("processor, more", [(StuckInEventTime(1000), {"status": "processing"}), (OrderedLimit(1, 1), {"t": 5, "clears": False})])
def test_waiting_rows_give_no_empty_frames(processor, more):
    handle = Handle()
    processor.init(handle)
    rows = pd.DataFrame({"seq": [2, 1], "at_ms": [20_000, 19_000], **more})
    assert list(processor.handleInputRows((1,), iter([rows]), Times())) == []
    assert list(processor.handleExpiredTimer((1,), Times(), None)) == []
    assert [r[0] for r in processor.waiting.get()] == [2, 1]


def test_an_unfinished_page_gives_no_empty_frame():
    processor, handle = PageBoxes(1000), Handle()
    processor.init(handle)
    box = {"confidence": 0.5, "x1": 1, "y1": 2, "x2": 3, "y2": 4, "page_boxes": 2, "at_ms": 7}
    assert list(processor.handleInputRows((1, 1), iter([pd.DataFrame([{"box_no": 1, "text": "b", **box}])]), None)) == []
    out = list(processor.handleInputRows((1, 1), iter([pd.DataFrame([{"box_no": 0, "text": None, **box}])]), None))
    assert [tuple(r)[2:4] for r in out[0].itertuples(index=False)] == [(0, None), (1, "b")] and out[0]["complete"].tolist() == [True, True]
    assert list(processor.handleInputRows((1, 1), iter([pd.DataFrame([{"box_no": 1, "text": "b", **box}])]), None)) == []


def test_only_keys_of_the_stream_are_held(spark, tmp_path):
    """Cases that the stream never names stay out of the keyed state, where each cost a call of Python."""
    J.use_keyed_state(spark)
    schema = "case_id BIGINT, seq BIGINT, action STRING"
    spark.createDataFrame([(1, 1, "arrest"), (2, 2, "application"), (None, 3, "arrest"), (5000, 4, "arrest")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    initial = spark.range(2000).selectExpr("id AS case_id", "CASE WHEN id = 2 THEN 'Arrested' ELSE '' END AS state")
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    made = J.bail_stream(events, initial.unionByName(initial))
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    assert held < 10
    got = {r.seq: (r.from_state, r.reason) for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()}
    assert got[2] == ("Arrested", None) and got[3][1] == "case_not_found" and got[4][1] == "case_not_found"


def test_waiting_pages_share_keys_of_state(spark, tmp_path):
    """A key a page cost several calls of Python's state for each page and a row of state for each box."""
    J.use_keyed_state(spark)
    boxes = spark.range(3 * J.PAGE_BUCKETS).selectExpr(
        "id AS doc_id", "CAST(IF(id % 5 = 0, NULL, 1) AS INT) AS page", "1 AS box_no", "'w' AS text", "0.5D AS confidence", "1 AS x1", "2 AS y1",
        "3 AS x2", "4 AS y2", "2 AS page_boxes", "timestamp '2024-01-01' AS at")

    def run(number):
        later = F.col("at") + F.expr(f"INTERVAL {1 - number} MINUTES")
        boxes.withColumn("box_no", F.lit(number)).withColumn("at", later).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(boxes.schema).parquet(str(tmp_path / "in"))
        query = J.whole_pages(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])

    assert run(1) <= J.PAGE_BUCKETS
    assert run(0) <= J.PAGE_BUCKETS
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.filter("complete").groupBy("doc_id", "page").agg(F.sum("box_no").alias("n"), F.count("*").alias("c")).filter(
        "n = 1 AND c = 2 AND (page IS NULL) = (doc_id % 5 = 0)").count() == 3 * J.PAGE_BUCKETS


def test_pages_held_together_come_out_as_those_held_alone():
    """Over several batches, with boxes that come again or never and nothing for some pages."""
    columns = ["doc_id", "page", *WaitingPages.COLUMNS, "page_boxes", "at_ms"]

    def row(page, number, of, at, text="w", x1=1):
        return (None if page == 3 else 7, page, number, text, 0.5, x1, 2, 3, 4, of, at)
    batches = [[row(1, 0, 3, 5), row(2, 1, 2, 6), row(3, None, 0, 5), row(4, 0, 1, 5, None, None), row(5, 2, 9, 5), row(5, 2, 9, 5, "b")],
               [row(1, 1, 3, 7), row(1, 0, 3, 7), row(4, 0, 1, 7), row(5, 1, 9, 8, x1=None)], [row(1, 2, 3, 900), row(2, 0, 2, 901)],
               [row(5, 3, 9, 1500), row(2, 0, 2, 1500)]]

    def run(keys):
        state, out = {}, []
        for number, batch in enumerate(batches):
            for key in keys:
                rows = [r for r in batch if key is None or r[1] == key]
                waiting = WaitingPages(1000, state.get(key))
                frames = (waiting.take(pd.DataFrame(rows, columns=columns)) if rows else []) + waiting.expire(1008 if number == 2 else 0)
                state[key] = waiting.stored() if waiting.pages else None
                out += [(number, *("-" if pd.isna(v) else v for v in r)) for f in frames for r in f.itertuples(index=False)]
        return sorted(out, key=repr)
    together = run([None])
    assert together == run([1, 2, 3, 4, 5])
    assert [(r[0], r[2], r[3], r[-1]) for r in together] == [
        (0, 3, "-", True), (0, 4, 0, True), (2, 1, 0, True), (2, 1, 1, True), (2, 1, 2, True), (2, 2, 0, True), (2, 2, 1, True)]
