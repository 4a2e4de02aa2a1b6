"""Stage gate, statutory pathway, backfill and state history of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.operators.sequence import previous_row


def missing_requirements(cases: DataFrame, requirements: DataFrame, docs: DataFrame,
                         requests: DataFrame) -> DataFrame:
    """``(case_id, requirement_type, requirement_key, item)`` for every mandatory item a case lacks."""
    needed = cases.select("case_id", "crime_type").join(
        requirements.filter("mandatory").select("crime_type", "requirement_type", "requirement_key"), "crime_type")
    # Distinct before the join: what a case has many times over is one row by the time it is shuffled.
    present_docs = docs.select("case_id", F.col("doc_type").alias("requirement_key")).distinct()
    done = requests.filter(F.col("status") == "completed").select(
        "case_id", F.col("doc_type_expected").alias("requirement_key")).distinct()

    def lacking(kind: str, present: DataFrame, label: str) -> DataFrame:
        gap = needed.filter(F.col("requirement_type") == kind).join(
            present, ["case_id", "requirement_key"], "left_anti")
        return gap.select("case_id", "requirement_type", "requirement_key",
                          F.concat(F.lit(f"{label}: "), "requirement_key").alias("item"))

    return lacking("document", present_docs, "Document").unionByName(
        lacking("evidence_request", done, "Evidence Request"))


def charge_sheet_ready(cases: DataFrame, requirements: DataFrame, docs: DataFrame,
                       requests: DataFrame) -> DataFrame:
    """Verdict per case: already filed, missing items (listed), or ready.

    The list holds at most the mandatory requirements of one crime type.
    """
    gaps = missing_requirements(cases, requirements, docs, requests).groupBy("case_id").agg(
        F.array_sort(F.collect_set("item")).alias("missing_items"))
    filed = F.col("investigation_status").isin(*K.TRIAL_STAGES)
    joined = cases.select("case_id", "crime_type", "investigation_status").join(gaps, "case_id", "left")
    return joined.select(
        "case_id", "crime_type", "investigation_status",
        F.coalesce("missing_items", F.array().cast("array<string>")).alias("missing_items"),
        F.when(filed, "already_filed").when(F.col("missing_items").isNotNull(), "missing").otherwise("ready")
        .alias("verdict"))


def match_pathway(crime_type: Column, pathways=K.BAIL_PATHWAYS) -> Column:
    """Struct of the first pathway whose name holds, or is held by, the crime type; else the last one.

    The table is a constant of the program, so it becomes one CASE expression and needs no join.
    """
    asked = F.lower(crime_type)

    def row(name: Column, entry) -> Column:
        values = (F.array(*(F.lit(x) for x in v)) if isinstance(v, tuple) else F.lit(v) for v in entry[1:])
        return F.struct(name.alias("crime_type"), *(v.alias(f) for v, f in zip(values, K.PATHWAY_FIELDS[1:])))

    chosen = row(crime_type, pathways[-1])
    for entry in reversed(pathways):
        name = entry[0].lower()
        chosen = F.when(asked.contains(name) | F.lit(name).contains(asked), row(F.lit(entry[0]), entry)) \
            .otherwise(chosen)
    return chosen


def case_pathways(cases: DataFrame) -> DataFrame:
    return cases.select("case_id", "case_number", F.col("bail_status").alias("current_bail_status"),
                        match_pathway(F.col("crime_type")).alias("pathway"))


def backfill_owner(cases: DataFrame, audit: DataFrame, users: DataFrame) -> DataFrame:
    """Fill registering officer and organisation from the earliest registration row, only where missing."""
    first = (
        audit.filter((F.col("action") == K.REGISTRATION_ACTION) & F.col("case_id").isNotNull()
                     & F.col("actor_user_id").isNotNull())
        .groupBy("case_id").agg(F.min_by("actor_user_id", "seq").alias("_actor")))
    owners = users.select(F.col("user_id").alias("_actor"), F.col("org_id").alias("_org"))
    known = first.join(owners, "_actor")
    fill = F.col("registered_by_user_id").isNull() & F.col("_actor").isNotNull()
    return (
        cases.join(known, "case_id", "left")
        .withColumn("org_id", F.when(fill, F.col("_org")).otherwise(F.col("org_id")))
        .withColumn("registered_by_user_id", F.coalesce("registered_by_user_id", "_actor"))
        .select(*cases.columns))


def current_stage(records: DataFrame, order: str = "seq") -> DataFrame:
    """Latest stage per case."""
    return records.groupBy("case_id").agg(
        F.max_by("stage", order).alias("stage"), F.max(order).alias(order),
        F.count(F.lit(1)).alias("records"))


def transitions(records: DataFrame, moves=K.BAIL_MOVES, order: str = "seq") -> DataFrame:
    """Each stage record with the stage before it and whether that step is allowed."""
    allowed = F.lit(False)
    for before, after in sorted({(m[0], m[2]) for m in moves}):
        allowed = allowed | ((F.col("_from") == before) & (F.col("stage") == after))
    df = previous_row(records, order, ["stage"], ["case_id"])
    return (
        df.withColumn("_from", F.coalesce("previous_stage", F.lit("")))
        .withColumn("legal", allowed).drop("_from"))


def set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows added and removed between two versions, repeated rows counted."""
    added = new.exceptAll(old.select(*new.columns)).withColumn("change", F.lit("added"))
    removed = old.select(*new.columns).exceptAll(new).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def policy_widening(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rules that show or flag what was masked before, with both actions."""
    keys = ["role", "doc_type", "entity_type"]
    before = old.select(*keys, F.col("action").alias("_old"))
    was = F.coalesce("_old", F.lit("mask"))
    return (
        new.join(before, keys, "left").filter((was == "mask") & (F.col("action") != "mask"))
        .select(*keys, was.alias("old_action"), F.col("action").alias("new_action")))
