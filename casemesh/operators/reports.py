"""Aggregates for dashboards, registers and cohort reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions.text import age_label, case_token, strip_space, text_stats


def audit_summary(audit: DataFrame) -> DataFrame:
    """Per case: a map of action counts, total, first and last time in ``seq`` order."""
    per_action = audit.groupBy("case_id", "action").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("created_at", "seq").alias("first"), F.min("seq").alias("lo"),
        F.max_by("created_at", "seq").alias("last"), F.max("seq").alias("hi"))
    return per_action.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("action_counts"),
        F.sum("n").alias("total_entries"), F.min_by("first", "lo").alias("first_entry_at"),
        F.max_by("last", "hi").alias("last_entry_at"))


def public_stats(cases: DataFrame, docs: DataFrame, audit: DataFrame) -> DataFrame:
    """Three row counts in one row; each table is counted where it lies, then three numbers are summed."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))

    counts = counted(cases, "c").unionByName(counted(docs, "d")).unionByName(counted(audit, "a"))
    return counts.agg(*(F.sum(F.when(F.col("what") == k, F.col("n"))).alias(name) for k, name in (
        ("c", "total_cases"), ("d", "total_documents"), ("a", "total_audit_entries"))))


def org_user_counts(orgs: DataFrame, users: DataFrame) -> DataFrame:
    members = users.groupBy("org_id").agg(F.count(F.lit(1)).alias("_n"))
    return orgs.join(members, "org_id", "left").select(
        *orgs.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("user_count"))


def role_user_counts(roles: DataFrame, users: DataFrame) -> DataFrame:
    """Users holding a role by id or by code, each counted once.

    Users are first reduced to counts per (role id, role code), so only those pairs are joined.
    """
    pairs = users.groupBy("role_id", F.col("role").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    ids = roles.select(F.col("role_id").alias("_rid"), F.col("code").alias("_rcode"))
    by_id = pairs.join(ids, F.col("role_id") == F.col("_rid")).select("_rid", "n")
    by_code = pairs.join(ids, (F.col("code") == F.col("_rcode")) & ~F.col("role_id").eqNullSafe(F.col("_rid"))) \
        .select("_rid", "n")
    counted = by_id.unionByName(by_code).groupBy("_rid").agg(F.sum("n").alias("_n"))
    return roles.join(counted, F.col("role_id") == F.col("_rid"), "left").select(
        *roles.columns, F.coalesce("_n", F.lit(0)).cast("long").alias("user_count"))


def stage_counters(cases: DataFrame) -> DataFrame:
    status = F.col("investigation_status")
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(status == "FIR_Registered").alias("fir_registered"),
        F.count_if(status == "Charge_Sheet_Filed").alias("charge_sheet_filed"),
        F.count_if(status.isin("Trial", "Judgment")).alias("in_trial_or_judgment"))


def days_active(created_at: Column, as_of: Column) -> Column:
    micros = F.unix_micros(as_of) - F.unix_micros(created_at)
    return F.greatest(F.lit(0).cast("long"), F.floor(micros / 86_400_000_000).cast("long"))


def _at(as_of: datetime | str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def cohort(cases: DataFrame, as_of: datetime | str) -> DataFrame:
    """De-identified cohort rows as exported."""
    return cases.select(
        case_token(F.col("case_id")).alias("case_token"), "case_number", "crime_type", "investigation_status",
        days_active(F.col("created_at"), _at(as_of)).alias("days_active"),
        F.coalesce("court_level", F.lit("")).alias("court_level"),
        F.coalesce("bail_status", F.lit("")).alias("bail_status"))


def cohort_stats(cases: DataFrame, as_of: datetime | str) -> DataFrame:
    """Cohort size and mean days active to one decimal; an empty cohort gives 0.0."""
    days = days_active(F.col("created_at"), _at(as_of))
    return cases.agg(F.count(F.lit(1)).alias("cohort_size"),
                     F.coalesce(F.round(F.avg(days), 1), F.lit(0.0)).alias("mean_days_active"))


def backlog(docs: DataFrame, as_of: datetime | str, status: str = "needs_review") -> DataFrame:
    """Queue depth, oldest entry and its age."""
    waiting = docs.filter(F.col("status") == status)
    counted = waiting.agg(F.count(F.lit(1)).alias("queue_depth"), F.min("created_at").alias("oldest_at"))
    age = F.unix_micros(_at(as_of)) - F.unix_micros("oldest_at")
    return counted.select(
        "queue_depth", "oldest_at",
        F.greatest(F.lit(0).cast("long"), F.floor(age / 3_600_000_000 + 0.5).cast("long")).alias("oldest_hours"),
        age_label(F.col("oldest_at"), _at(as_of)).alias("oldest_label"))


def tag_summary(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """Per document: tag count, sorted distinct types, lowest confidence (100 without tags)."""
    per_doc = tags.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set("entity_type")).alias("_types"),
        F.min("confidence").alias("_low"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("_n", F.lit(0)).cast("long").alias("tag_count"),
        F.coalesce("_types", F.array().cast("array<string>")).alias("entity_types"),
        F.coalesce("_low", F.lit(100)).alias("min_confidence"))


def route_status(docs: DataFrame, tags: DataFrame, quality_ok: Column | None = None,
                 threshold: int = K.REVIEW_THRESHOLD) -> DataFrame:
    """ready or needs_review per document, from its tags, its quality and whether it has any text."""
    low = tags.groupBy("doc_id").agg(F.bool_or(F.col("confidence") < threshold).alias("_low"))
    ok = F.lit(True) if quality_ok is None else quality_ok
    empty = strip_space(F.coalesce("raw_text", F.lit(""))) == ""
    review = empty | F.coalesce("_low", F.lit(False)) | ~ok
    rated = docs.join(low, "doc_id", "left")
    return rated.select("doc_id", F.when(review, "needs_review").otherwise("ready").alias("status"))


def correction_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("tag_count"),
        F.count_if(F.col("source") == "officer_correction").alias("officer_corrections"))


def cases_by_day(cases: DataFrame) -> DataFrame:
    """Cases with their registration day and that day's count, newest day first.

    The worklist is one sorted table; a busy day is never gathered into one array.
    """
    dated = cases.withColumn("day", F.to_date("created_at"))
    sizes = dated.groupBy("day").agg(F.count(F.lit(1)).alias("cases_that_day"))
    return dated.join(sizes, "day").orderBy(F.col("day").desc(), "created_at", "case_id")


def permissions_by_category(permissions: DataFrame) -> DataFrame:
    """Permission codes per category (a configuration table, one short list per category)."""
    return permissions.groupBy("category").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def crime_types(cases: DataFrame) -> DataFrame:
    return cases.select("crime_type").filter(F.col("crime_type").isNotNull()).distinct().orderBy("crime_type")


def _share(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` to six decimals; of nothing it is not a number, of an unknown it is unknown."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(F.round(part / whole, 6))


def text_statistics(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """Sizes of each text and their ratios. A blank text has no ratio (NaN), an unknown text no sizes either (null)."""
    known = F.when(F.col(text).isNotNull(), text_stats(F.col(text)))
    return docs.select("doc_id", known.alias("_s")).select("doc_id", "_s.*").withColumn(
        "alnum_ratio", _share(F.col("alnum"), F.col("non_space"))).withColumn(
        "single_ratio", _share(F.col("single_tokens"), F.col("tokens")))
