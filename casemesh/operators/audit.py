"""Hash-linked audit log: canonical rows, sealing, link checks, verdicts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.operators.ordered import ordered_scan
from casemesh.operators.sequence import number_rows, previous_row
from casemesh.session import cut_lineage

FIELDS = ("action", "actor_user_id", "case_id", "created_at", "metadata", "target_id", "target_type")
SEAL_BITS = 16


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def canonical() -> Column:
    """Canonical JSON of an audit row: fields in alphabetical order, nulls kept, UTC time, ids as text."""
    values = [utc_iso(F.col(f)) if f == "created_at" else F.col(f).cast("string") for f in FIELDS]
    return F.to_json(F.struct(*(v.alias(f) for v, f in zip(values, FIELDS))), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def _dumped(rows: pd.DataFrame) -> pd.Series:
    def one(row) -> str:
        content = row._asdict()
        content["metadata"] = json.loads(content["metadata"]) if content["metadata"] else {}
        return json.dumps(content, sort_keys=True)

    return pd.Series([one(r) for r in rows.astype(object).where(rows.notna(), None).itertuples(index=False)])


def canonical_with_blanks() -> Column:
    """Canonical form of logs written by a JSON encoder with blanks and \\u escapes, metadata nested.

    Use it to check such a log as it is; new logs use ``canonical``, which needs no Python.
    """
    micros = F.date_format("created_at", "SSSSSS")
    time = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
    values = [time if f == "created_at" else F.col(f).cast("string") for f in FIELDS]
    return _dumped(F.struct(*(v.alias(f) for v, f in zip(values, FIELDS))))


def link_hash(previous: Column, content: Column) -> Column:
    """Hash of a row given its predecessor's; the first link uses the word None."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("None")), F.lit("|"), content), 256)


def assign_seq(batch: DataFrame, last_seq: int, order: str) -> DataFrame:
    """Number a batch after ``last_seq`` in the order of a unique numeric column."""
    numbered = number_rows(batch, order, [], "_n", bits=20)
    return numbered.withColumn("seq", (F.col("_n") + F.lit(last_seq)).cast("long")).drop("_n")


def seal(rows: DataFrame, bits: int = SEAL_BITS, heads: DataFrame | None = None,
         content: Callable[[], Column] = canonical) -> DataFrame:
    """Append ``chain``, ``prev_hash`` and ``row_hash``.

    A hash link needs the one before it, so one chain is serial by nature. Rows are therefore sealed in chains
    of at most ``2**bits`` consecutive ``seq`` values, all chains at once; ``chain_heads`` ties them together.
    ``heads`` gives the last hash of chains that are already partly written, as ``(chain, head_hash)``.
    """
    slim = rows.select(F.shiftright("seq", bits).alias("chain"), "seq", content().alias("body"))
    if heads is None:
        slim = slim.withColumn("head", F.lit(None).cast("string"))
    else:
        slim = slim.join(heads.select("chain", F.col("head_hash").alias("head")), "chain", "left")

    def first(row):
        return row.head if isinstance(row.head, str) else None

    def step(prev, row):
        made = hashlib.sha256(f"{prev}|{row.body}".encode()).hexdigest()
        return made, [(row.chain, row.seq, prev, made)]

    links = ordered_scan(slim, ["chain"], ["seq"], first, step,
                         "chain BIGINT, seq BIGINT, prev_hash STRING, row_hash STRING")
    return rows.join(links, "seq")


def chain_heads(sealed: DataFrame) -> DataFrame:
    """Per chain: first and last ``seq``, row count, last hash. Keep these apart from the log.

    A log shortened at its end still links up; comparing it with stored heads is what shows the loss.
    """
    return sealed.groupBy("chain").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("rows"),
        F.max_by("row_hash", "seq").alias("head_hash"))


def check_anchor(log: DataFrame, heads: DataFrame) -> DataFrame:
    """Stored chain heads against the log as it is now."""
    now = chain_heads(log).select("chain", F.col("rows").alias("_rows"), F.col("head_hash").alias("_head"))
    joined = heads.join(now, "chain", "full_outer")
    state = (
        F.when(F.col("_rows").isNull(), "chain_missing").when(F.col("rows").isNull(), "chain_unknown")
        .when(F.col("rows") != F.col("_rows"), "row_count_differs")
        .when(F.col("head_hash") != F.col("_head"), "head_differs").otherwise("ok"))
    return joined.select("chain", state.alias("state"))


def check_links(log: DataFrame, chain: Sequence[str] = (), content: Callable[[], Column] = canonical) -> DataFrame:
    """Per row ``ok``: its hash follows from its content, and ``prev_hash`` is the preceding row's hash.

    Without ``chain`` the log is one chain ordered by ``seq``; gaps in ``seq`` are allowed, as the predecessor
    is the previous existing row. Only hashes travel between tasks, never the rows' other columns.
    """
    slim = log.select(*chain, "seq", "case_id", "prev_hash", "row_hash", content().alias("_content"))
    own = slim.withColumn("_own", link_hash(F.col("prev_hash"), F.col("_content")) == F.col("row_hash"))
    linked = previous_row(own.drop("_content"), "seq", ["row_hash"], list(chain))
    follows = F.col("prev_hash").eqNullSafe(F.col("previous_row_hash"))
    return linked.select(*chain, "seq", "case_id", "row_hash",
                         (F.coalesce("_own", F.lit(False)) & follows).alias("ok"))


def chain_intact(links: DataFrame) -> DataFrame:
    """One row: whether every link holds, the first broken ``seq`` and the number of rows."""
    return links.agg(
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("chain_intact"),
        F.min(F.when(~F.col("ok"), F.col("seq"))).alias("first_broken_seq"), F.count(F.lit(1)).alias("total_rows"))


def case_chain(links: DataFrame) -> DataFrame:
    """Per case: the verdict over the whole log, its number of entries and its latest hash (null when broken).

    The links are checked once, into one stored row per case; the verdict is read off those rows.
    """
    per_case = cut_lineage(links.groupBy("case_id").agg(
        F.bool_and("ok").alias("_ok"), F.count(F.lit(1)).alias("total_entries"),
        F.max_by("row_hash", "seq").alias("_latest")))
    verdict = per_case.agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("v")).scalar()
    judged = per_case.filter(F.col("case_id").isNotNull()).withColumn("chain_intact", verdict)
    return judged.select("case_id", "chain_intact", "total_entries",
                         F.when(F.col("chain_intact"), F.col("_latest")).alias("latest_hash"))


def slice_links(audit: DataFrame) -> DataFrame:
    """Within a case's slice of the log: whether each row directly follows the one shown before it."""
    near = previous_row(audit.select("case_id", "seq"), "seq", ["seq"], ["case_id"])
    linked = F.when(F.col("previous_seq").isNull(), F.col("seq") == 1).otherwise(
        F.col("previous_seq") == F.col("seq") - 1)
    return near.withColumn("linked", linked)


def audit_events(rows: DataFrame, action: str | Column, target_type: str, target_id: str, actor: str | None,
                 at: Column, case_id: str | None = "case_id", metadata: Column | None = None) -> DataFrame:
    """Rows in audit shape for what a bulk job did; ``assign_seq`` and ``seal`` come next."""
    null = F.lit(None).cast("string")
    return rows.select(
        (F.col(case_id).cast("string") if case_id else null).alias("case_id"),
        (F.col(actor).cast("string") if actor else null).alias("actor_user_id"),
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        F.lit(target_type).alias("target_type"), F.col(target_id).cast("string").alias("target_id"),
        (metadata if metadata is not None else F.lit("{}")).alias("metadata"), at.alias("created_at"))
