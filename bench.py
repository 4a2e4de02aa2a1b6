"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query runs once cold, then its median over the
warm runs counts. ``audit_verify_*`` checks the hash links of a log with one row per line item, written before.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from casemesh.operators import audit
from casemesh.plans import load_all
from casemesh.plans.models import Models
from casemesh.plans.registry import QUERIES
from casemesh.session import get_session, shared_dir

HEADLINES = (
    "masked_span_counts", "document_tags", "document_tag_status", "documents_redacted", "policy_resolved",
    "access_matrix", "access_denials", "missing_requirements", "charge_sheet_gate", "requisition_inbox_oversight",
    "audit_with_actor", "audit_summary", "audit_slice_links", "bail_transitions", "bail_events_applied",
    "login_rate_verdicts", "document_versions_assigned", "upload_dedup", "role_user_counts", "cases_by_day",
    "ledger_write_once", "officers_reassigned", "boxes_suppressed", "layout_lines", "form_fields",
)
WARM_RUNS = 3


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def sealed_log(models: Models, path: str, bits: int) -> int:
    """A log over the line items, written once: in chains of 65,536 rows, as ``seal`` stores it, or as one chain."""
    rows = models.lineitem.select(
        F.monotonically_increasing_id().alias("arrival"), F.col("l_returnflag").alias("action"),
        F.col("l_partkey").alias("actor_user_id"), F.col("l_orderkey").alias("case_id"),
        F.col("l_shipdate").alias("created_at"), F.concat(F.lit('{"q":'), "l_quantity", F.lit("}")).alias("metadata"),
        F.col("l_suppkey").alias("target_id"), F.lit("item").alias("target_type"))
    numbered = audit.assign_seq(rows, 0, "arrival")
    audit.seal(numbered, bits).repartitionByRange("seq").write.mode("overwrite").parquet(path)
    return models.spark.read.parquet(path).count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("casemesh-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "20g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    times: dict[str, float] = {}
    for name in HEADLINES:
        run(QUERIES[name](spark, sf_dir))
        warm = []
        for _ in range(WARM_RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            warm.append(time.perf_counter() - start)
        times[name] = round(statistics.median(warm), 3)
    models = Models(spark, sf_dir)
    for name, bits, chain in (("audit_verify", audit.SEAL_BITS, ["chain"]), ("audit_verify_linear", 40, [])):
        path = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
        rows = sealed_log(models, path, bits)
        warm = []
        for _ in range(WARM_RUNS + 1):
            start = time.perf_counter()
            verdict = audit.chain_intact(audit.check_links(spark.read.parquet(path), chain)).first()
            warm.append(time.perf_counter() - start)
        assert verdict["chain_intact"] and verdict["total_rows"] == rows
        times[name] = round(statistics.median(warm[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "audit_verify_rows": rows,
        "audit_verify_rows_per_sec": round(rows / times["audit_verify"]),
        "audit_verify_linear_rows_per_sec": round(rows / times["audit_verify_linear"])}))
    spark.stop()


if __name__ == "__main__":
    main()
