"""Cases in which rows, digits or bytes used to get lost."""

from pyspark.sql import functions as F

from casemesh.operators import layout
from casemesh.operators.lifecycle import intake_cases
from casemesh.sources.blobs import sniff_mime
from casemesh.streaming.jobs import replay


class Accepted:
    def __init__(self, accepted):
        self.accepted = accepted


def test_case_numbers_keep_all_digits(spark):
    rows = spark.createDataFrame([(7, "theft"), (1000001, "theft"), (1000002, "theft")], "case_id long, crime_type string").select(
        "*", F.lit("2024-05-01").cast("timestamp").alias("filed_at"), F.lit(1).alias("org_id"), F.lit(2).alias("user_id"))
    numbers = {r["case_id"]: r["case_number"].split("-")[-1] for r in intake_cases(Accepted(rows)).collect()}
    assert numbers == {7: "000007", 1000001: "1000001", 1000002: "1000002"}


def test_a_late_nul_makes_a_text_unknown(spark):
    rows = spark.createDataFrame([(b"a" * 9000 + b"\0",), (b"a" * 9001,)], "content binary")
    got = [r[0] for r in rows.select(sniff_mime(F.col("content"), F.lit("text/plain"))).collect()]
    assert got == ["application/octet-stream", "text/plain"]


def test_pages_without_a_usable_box_stay(spark):
    boxes = spark.createDataFrame([("d", p, 1, t, 0.9, 10.0, 10.0, 90.0, 20.0) for p, t in ((1, "one"), (3, "three"))],
                                  "doc_id string, page int, box_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    listed = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, page int")
    pages = layout.reconstruct(boxes, listed=listed)
    assert {r["page"]: (r["text"], r["row_count"]) for r in pages.collect()} == {1: ("one", 1), 2: ("", 0), 3: ("three", 1)}
    assert layout.assemble_document(pages).first()["page_count"] == 3


def test_of_conflicting_deliveries_the_earliest_counts(spark):
    rows = [("d", 1, p, "h", "2024-01-01 00:00:00", at) for p, at in
            (("late", "2024-01-03 00:00:00"), ("early", "2024-01-02 00:00:00"), ("early", "2024-01-02 00:00:00"))]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "device string, local_seq long, payload string, payload_hash string, device_at string, received_at string")
        assert [r["payload"] for r in replay(df).collect()] == ["early"]
