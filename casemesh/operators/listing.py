"""Projections, filters, pages and sorts over the model tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """One page of a total order; ``order`` must end in a unique column."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be within 1..{most} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, order: str, after, limit: int) -> DataFrame:
    """Next page of a descending unique order, continuing below the last value seen."""
    below = df if after is None else df.filter(F.col(order) < after)
    return below.orderBy(F.col(order).desc()).limit(limit)


def case_metadata(cases: DataFrame, crime_type: str | None = None, status: str | None = None,
                  limit: int | None = None, offset: int = 0) -> DataFrame:
    """De-identified case rows; without ``limit`` the whole cohort."""
    df = cases.select("case_id", "case_number", "crime_type", "court_level", "investigation_status",
                      "bail_status", "created_at")
    if crime_type:
        df = df.filter(F.col("crime_type") == crime_type)
    if status:
        df = df.filter(F.col("investigation_status") == status)
    return df if limit is None else page(df, ["created_at", "case_id"], limit, offset, most=500)


def without_text(docs: DataFrame) -> DataFrame:
    return docs.drop("raw_text", "text")


def review_queue(docs: DataFrame, assignments: DataFrame | None = None, status: str = "needs_review",
                 user_id=None) -> DataFrame:
    """Documents in ``status``, oldest first, without text; for an officer only those of assigned cases."""
    df = without_text(docs).filter(F.col("status") == status)
    if user_id is not None:
        mine = assignments.filter(F.col("io_user_id") == user_id).select("case_id")
        df = df.join(mine, "case_id", "left_semi")
    return df.orderBy("created_at", "doc_id")


def review_queues(docs: DataFrame, assignments: DataFrame, status: str = "needs_review") -> DataFrame:
    """Every officer's queue at once: one row per waiting document and officer on its case."""
    officers = assignments.select("case_id", "io_user_id").distinct()
    return without_text(docs).filter(F.col("status") == status).join(officers, "case_id")


def case_documents(docs: DataFrame, case_id=None) -> DataFrame:
    """Every document version of a case (or of all cases), newest first, metadata only."""
    df = without_text(docs)
    df = df if case_id is None else df.filter(F.col("case_id") == case_id)
    return df.orderBy(F.col("created_at").desc(), F.col("doc_id").desc())


def visible_diary(entries: DataFrame, role: str) -> DataFrame:
    """Diary rows a role may list: all for the investigating side, none for the defence, else tagged ones."""
    if role == K.DEFENSE_ROLE:
        return entries.filter(F.lit(False))
    return entries if role in K.DIARY_FULL_ROLES else entries.filter(F.col("status") == "ready")


def audit_filter(audit: DataFrame, action: str | None = None, target_type: str | None = None,
                 case_id=None) -> DataFrame:
    df = audit
    for name, value in (("action", action), ("target_type", target_type), ("case_id", case_id)):
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def audit_page(audit: DataFrame, action: str | None = None, target_type: str | None = None,
               limit: int = 50, offset: int = 0, case_id=None) -> DataFrame:
    """Newest audit rows first; ``seq`` decides, never the clock."""
    return page(audit_filter(audit, action, target_type, case_id), [F.col("seq").desc()], limit, offset)


def parser_audit(audit: DataFrame, actions: Sequence[str] = K.PARSER_ACTIONS) -> DataFrame:
    """Tagging decisions and corrections with the fields of their metadata."""
    meta = F.from_json("metadata", "entity_type STRING, confidence BIGINT, span_start BIGINT, span_end BIGINT")
    return (
        audit.filter(F.col("action").isin(*actions)).withColumn("_m", meta)
        .select(
            "seq", "case_id", F.when(F.col("target_type") == "document", F.col("target_id")).alias("document_id"),
            "action", F.when(F.col("actor_user_id").isNull(), "system").otherwise("human").alias("actor_type"),
            "actor_user_id", "_m.*", "created_at"))


def requisition_targets(orgs: DataFrame) -> DataFrame:
    return orgs.filter(F.col("org_type").isin(*K.REQUISITION_TARGETS)).orderBy("org_type", "name", "org_id")


def applications(apps: DataFrame, status: str | None = None) -> DataFrame:
    df = apps if status is None else apps.filter(F.col("status") == status)
    return df.orderBy(F.col("created_at").desc(), F.col("application_id").desc())


def role_matrix(spark, matrix: dict[str, Sequence[str]] = K.ACTION_ROLES) -> DataFrame:
    return spark.createDataFrame([(a, r) for a, roles in matrix.items() for r in roles],
                                 "action STRING, role STRING")


def _on_list(matrix: DataFrame) -> Column:
    """Whether a row's role is allowed its action; the matrix, a hand-written list, is read as one scalar map."""
    allowed = matrix.dropna(subset=["action", "role"]).groupBy("action").agg(F.collect_set("role").alias("roles"))
    by_action = allowed.agg(F.map_from_entries(F.collect_list(F.struct("action", "roles")))).scalar()
    return F.coalesce(F.array_contains(F.try_element_at(by_action, F.col("action")), F.col("role")), F.lit(False))


def permitted(actions: DataFrame, matrix: DataFrame) -> DataFrame:
    """Action rows whose role is on the allow list."""
    return actions.filter(_on_list(matrix))


def not_permitted(actions: DataFrame, matrix: DataFrame) -> DataFrame:
    return actions.filter(~_on_list(matrix))


def search(df: DataFrame, columns: Sequence[str], q: str) -> DataFrame:
    """Rows where any of ``columns`` holds ``q``, ignoring case; an empty query keeps all."""
    wanted = q.strip().lower()
    if not wanted:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return df.filter(hit)


def search_joined(df: DataFrame, columns: Sequence[str], q: str) -> DataFrame:
    """As ``search``, over the columns joined by blanks, so a query may run across two of them."""
    wanted = q.strip().lower()
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    return df.filter(text.contains(wanted)) if wanted else df


def on_day(df: DataFrame, day: str, ts: str = "created_at") -> DataFrame:
    """Rows of one calendar day, as a range so that it reaches the scan."""
    start = F.to_timestamp(F.lit(day))
    return df.filter((F.col(ts) >= start) & (F.col(ts) < start + F.expr("INTERVAL 1 DAY")))


def trial_eligible(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("investigation_status").isin(*K.TRIAL_STAGES))


def pending_requests(requests: DataFrame, order: str = "oldest") -> DataFrame:
    """Requests not completed, oldest or newest first."""
    by = [F.col(c).asc() if order == "oldest" else F.col(c).desc() for c in ("created_at", "request_id")]
    return requests.filter(F.col("status") != "completed").orderBy(*by)


def key_status(keys: DataFrame, users: DataFrame, now: datetime | str) -> DataFrame:
    """State of each key: revoked, expired, ownerless or active; only active ones are accepted."""
    owner = users.select(F.col("user_id").alias("_owner"), "role", "org_id")
    state = (
        F.when(F.col("revoked_at").isNotNull(), "revoked")
        .when(F.col("expires_at") < F.to_timestamp(F.lit(now)), "expired")
        .when(F.col("_owner").isNull(), "ownerless").otherwise("active"))
    joined = keys.join(owner, F.col("user_id") == F.col("_owner"), "left")
    return joined.select(*keys.columns, "role", "org_id", state.alias("state")) \
        .withColumn("accepted", F.col("state") == "active")


def purge_plan(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The requested documents with ``purge`` or, under legal hold, ``blocked``."""
    wanted = without_text(docs).join(ids, "doc_id", "left_semi")
    held = F.coalesce(F.col("retention_legal_hold"), F.lit(False))
    return wanted.withColumn("verdict", F.when(held, "blocked").otherwise("purge"))


def purge_tags(tags: DataFrame, plan: DataFrame) -> DataFrame:
    """Tags left after the purge."""
    return tags.join(plan.filter(F.col("verdict") == "purge").select("doc_id"), "doc_id", "left_anti")


def idempotency_key(doc_id: Column, version: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit(":v"), version.cast("string"))


def retry_candidates(docs: DataFrame) -> DataFrame:
    """Documents whose ledger write is not confirmed, with the key the first attempt used."""
    return docs.filter(F.col("chain_status") != "confirmed").select(
        "doc_id", "case_id", "chain_status",
        idempotency_key(F.col("doc_id"), F.col("version")).alias("idempotency_key"))


def stuck(docs: DataFrame, now: datetime | str, minutes: int = K.STUCK_MINUTES) -> DataFrame:
    """Documents still in ``processing`` after ``minutes``."""
    limit = F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    return without_text(docs).filter((F.col("status") == "processing") & (F.col("created_at") < limit))


def ordered_rules(rules: DataFrame, *keys: str) -> DataFrame:
    return rules.orderBy(*keys)


def top_by(df: DataFrame, keys: Sequence[str], score: Sequence[Column]) -> DataFrame:
    """The row of each key with the largest composite score; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*(s.alias(f"s{i}") for i, s in enumerate(score))))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Name of the first failing check, or null."""
    reason = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        reason = F.when(failed, name).otherwise(reason)
    return reason


def validate_policies(rules: DataFrame) -> DataFrame:
    """Redaction rules with the ``reason`` they are refused for, or null."""
    blank = F.lit(False)
    for c in ("role", "doc_type", "entity_type"):
        blank = blank | (F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0)
    return rules.withColumn("reason", first_reason(
        (blank, "empty_key"),
        (~F.coalesce(F.col("action").isin("mask", "show", "flag"), F.lit(False)), "bad_action"),
        (~F.coalesce(F.col("min_confidence").between(0, 100), F.lit(False)), "bad_min_confidence")))


def validate_doc_schemas(schemas: DataFrame) -> DataFrame:
    """Document schemas with the ``reason`` they are refused for: tier 3 has no field list, the others need one."""
    fields = F.from_json("sensitivity_fields", "array<struct<field_name:string,sensitivity:string>>")
    n = F.coalesce(F.size(fields), F.lit(0))
    return schemas.withColumn("reason", first_reason(
        (F.length(F.trim(F.coalesce(F.col("doc_type"), F.lit("")))) == 0, "empty_doc_type"),
        (~F.coalesce(F.col("tier").isin(1, 2, 3), F.lit(False)), "bad_tier"),
        ((F.col("tier") == 3) & F.col("sensitivity_fields").isNotNull(), "tier3_has_fields"),
        ((F.col("tier") != 3) & (n <= 0), "fields_missing")))
