"""Bulk lifecycle jobs: a table of requests against state tables.

Every job gives an ``Outcome``: each request with the ``reason`` it was refused for (null when accepted), the new
or changed rows, and the audit rows to append. Requests of one batch are decided in ``seq`` order, as if they
had come one after another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions.text import case_prefix, strip_space
from casemesh.operators.audit import audit_events
from casemesh.operators.documents import assign_versions
from casemesh.operators.listing import first_reason
from casemesh.operators.access import request_verdict
from casemesh.operators.sequence import previous_row
from casemesh.session import cut_lineage
from casemesh.sources.tables import object_key


@dataclass
class Outcome:
    decided: DataFrame
    rows: DataFrame
    audit: DataFrame

    @property
    def accepted(self) -> DataFrame:
        return self.decided.filter(F.col("reason").isNull())

    @property
    def rejected(self) -> DataFrame:
        return self.decided.filter(F.col("reason").isNotNull())


def _flag(df: DataFrame, key: str, flag: str, *more: str) -> DataFrame:
    return df.select(key, *more, F.lit(True).alias(flag))


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def intake(complaints: DataFrame, users: DataFrame) -> Outcome:
    """Register typed complaints ``(case_id, doc_id, crime_type, text, user_id, filed_at)``.

    ``rows`` is the document table; use ``intake_cases`` for the case rows.
    """
    who = users.select("user_id", "role", "org_id")
    decided = complaints.join(who, "user_id", "left").withColumn(
        "reason", F.when(~F.col("role").eqNullSafe(F.lit(K.REGISTRATION_ROLE)), "role_not_permitted"))
    good = decided.filter("reason IS NULL").withColumn("version", F.lit(1))
    docs = good.select(
        "doc_id", "case_id", F.lit("FIR").alias("doc_type"), "version",
        object_key(F.coalesce("org_id", "case_id"), F.col("case_id"), F.col("doc_id"), F.col("version"))
        .alias("storage_path"),
        F.col("text").alias("raw_text"), F.sha2("text", 256).alias("doc_hash"), F.lit("processing").alias("status"),
        F.lit("pending").alias("chain_status"), F.col("user_id").alias("uploaded_by"),
        F.col("filed_at").alias("created_at"))
    audit = audit_events(good, K.REGISTRATION_ACTION, "case", "case_id", "user_id", F.col("filed_at"), metadata=_meta(
        crime_type=F.col("crime_type"), doc_hash=F.sha2("text", 256), document_id=F.col("doc_id").cast("string")))
    return Outcome(decided, docs, audit)


def intake_cases(outcome: Outcome) -> DataFrame:
    """The case rows of an intake; the number is prefix, year and the case id."""
    plain = F.col("case_id").cast("string")  # padded only where shorter: lpad would cut a longer id
    number = F.concat_ws("-", case_prefix(F.col("crime_type")), F.year("filed_at").cast("string"),
                         F.when(F.length(plain) < 6, F.lpad(plain, 6, "0")).otherwise(plain))
    return outcome.accepted.select(
        "case_id", number.alias("case_number"), "crime_type", F.lit("FIR_Registered").alias("investigation_status"),
        "org_id", F.col("user_id").alias("registered_by_user_id"), F.col("filed_at").alias("created_at"))


def assign(requests: DataFrame, cases: DataFrame, users: DataFrame, assignments: DataFrame) -> Outcome:
    """Put officers on cases: requests ``(seq, case_id, io_user_id, requested_at)``."""
    pair = ["case_id", "io_user_id"]
    officers = users.select(F.col("user_id").alias("io_user_id"), F.col("role").alias("_role"))
    joined = (
        requests.join(_flag(cases, "case_id", "_case"), "case_id", "left")
        .join(officers, "io_user_id", "left")
        .join(assignments.select(*pair).distinct().withColumn("_held", F.lit(True)), pair, "left")
        .join(requests.groupBy(*pair).agg(F.min("seq").alias("_first")), pair))
    decided = joined.withColumn("reason", first_reason(
        (F.col("_case").isNull(), "case_not_found"), (F.col("_role").isNull(), "user_not_found"),
        (~F.col("_role").isin(*K.ASSIGNMENT_ROLES), "role_not_assignable"),
        (F.col("_held").isNotNull() | (F.col("seq") > F.col("_first")), "already_assigned"),
    )).select(*requests.columns, "reason")
    good = decided.filter("reason IS NULL")
    rows = good.select(*pair, F.col("requested_at").alias("assigned_at"))
    audit = audit_events(good, "io_assigned", "case_assignment", "io_user_id", None, F.col("requested_at"))
    return Outcome(decided, rows, audit)


def reassign(requests: DataFrame, cases: DataFrame, users: DataFrame, assignments: DataFrame) -> Outcome:
    """Swap the officer of a case: requests ``(seq, case_id, new_io_user_id, requested_at)``.

    ``rows`` is the whole assignment table afterwards.
    """
    officers = users.select(F.col("user_id").alias("new_io_user_id"), F.col("role").alias("_role"))
    held = assignments.groupBy("case_id").agg(F.min_by("io_user_id", F.struct("assigned_at", "io_user_id")).alias("_held"))
    joined = (
        requests.join(cases.select("case_id", F.col("investigation_status").alias("_stage")), "case_id", "left")
        .join(officers, "new_io_user_id", "left").join(held, "case_id", "left"))
    checked = cut_lineage(joined.withColumn("_static", first_reason(
        (F.col("_stage").isNull(), "case_not_found"), (F.col("_stage").isin(*K.CONCLUDED_STAGES), "case_concluded"),
        (F.col("_role").isNull(), "user_not_found"), (F.col("_role") != "io", "not_an_io"),
        (F.col("_held").isNull(), "no_current_assignment"))))
    # After any well-formed request the case is with the officer it names, swapped or not.
    formed = previous_row(checked.filter("_static IS NULL"), "seq", ["new_io_user_id"], ["case_id"])
    swapped = formed.withColumn("previous_io_user_id", F.coalesce("previous_new_io_user_id", "_held")).withColumn(
        "reason", F.when(F.col("previous_io_user_id") == F.col("new_io_user_id"), "same_officer"))
    columns = [*requests.columns, "previous_io_user_id", "reason"]
    decided = swapped.select(*columns).unionByName(checked.filter("_static IS NOT NULL").select(
        *requests.columns, F.col("_held").alias("previous_io_user_id"), F.col("_static").alias("reason")))
    good = decided.filter("reason IS NULL")
    newest = good.groupBy("case_id").agg(F.max_by(F.struct("new_io_user_id", "requested_at"), "seq").alias("_n"))
    rows = assignments.select("case_id", "io_user_id", "assigned_at").join(newest, "case_id", "left_anti").unionByName(
        newest.select("case_id", F.col("_n.new_io_user_id").alias("io_user_id"),
                      F.col("_n.requested_at").alias("assigned_at")))
    audit = audit_events(good, "io_reassigned", "case_assignment", "new_io_user_id", None, F.col("requested_at"),
                         metadata=_meta(previous_io_id=F.col("previous_io_user_id").cast("string"),
                                        new_io_id=F.col("new_io_user_id").cast("string")))
    return Outcome(decided, rows, audit)


def record_parties(requests: DataFrame, cases: DataFrame, users: DataFrame, parties: DataFrame) -> Outcome:
    """Record engagements ``(seq, case_id, user_id, email, party_role, recorded_by_user_id, recorded_at)``.

    The person is named by id, else by e-mail. Recording an engagement again is accepted and adds nothing.
    """
    key = ["case_id", "party_user_id", "party_role"]
    by_id = users.select("user_id", F.col("user_id").alias("_by_id"), F.col("role").alias("_id_role"))
    by_mail = users.groupBy(F.lower("email").alias("_mail")).agg(
        F.min(F.struct("user_id", "role")).alias("_m"))
    joined = (
        requests.join(_flag(cases, "case_id", "_case"), "case_id", "left").join(by_id, "user_id", "left")
        .withColumn("_mail", F.when(F.col("user_id").isNull(), F.lower(strip_space(F.col("email")))))
        .join(by_mail, "_mail", "left")
        .withColumn("party_user_id", F.coalesce("_by_id", F.when(F.col("user_id").isNull(), F.col("_m.user_id"))))
        .withColumn("_role", F.coalesce("_id_role", F.when(F.col("user_id").isNull(), F.col("_m.role")))))
    decided = joined.withColumn("reason", first_reason(
        (F.col("_case").isNull(), "case_not_found"), (F.col("party_user_id").isNull(), "user_not_found"),
        ((F.col("party_role") == "defense") & (F.col("_role") != K.DEFENSE_ROLE), "not_a_defense_account"),
    )).select(*requests.columns, "party_user_id", "reason")
    known = parties.select("case_id", F.col("user_id").alias("party_user_id"), "party_role")
    fresh = decided.filter("reason IS NULL").join(known, key, "left_anti")
    once = fresh.groupBy(*key).agg(F.min_by(F.struct("recorded_by_user_id", "recorded_at"), "seq").alias("_r"))
    rows = once.select("case_id", F.col("party_user_id").alias("user_id"), "party_role",
                       F.col("_r.recorded_by_user_id").alias("recorded_by_user_id"),
                       F.col("_r.recorded_at").alias("created_at"))
    audit = audit_events(rows, "case_party_recorded", "case_party", "user_id", "recorded_by_user_id",
                         F.col("created_at"), metadata=_meta(party_role=F.col("party_role"),
                                                             party_user_id=F.col("user_id").cast("string")))
    return Outcome(decided, rows, audit)


def create_requests(requests: DataFrame, cases: DataFrame, orgs: DataFrame) -> Outcome:
    """Raise requisitions ``(request_id, case_id, requested_org_id, doc_type_expected, requested_by_user_id, created_at)``."""
    targets = orgs.select(F.col("org_id").alias("requested_org_id"), F.col("org_type").alias("_type"))
    joined = requests.join(_flag(cases, "case_id", "_case"), "case_id", "left").join(targets, "requested_org_id", "left")
    decided = joined.withColumn("reason", first_reason(
        (F.col("_case").isNull(), "case_not_found"), (F.col("_type").isNull(), "organization_not_found"),
        (~F.col("_type").isin(*K.REQUISITION_TARGETS), "not_a_requisition_target"),
    )).select(*requests.columns, "reason")
    good = decided.filter("reason IS NULL")
    rows = good.drop("reason").withColumn("status", F.lit("requested"))
    audit = audit_events(good, "evidence_requested", "evidence_request", "request_id", "requested_by_user_id",
                         F.col("created_at"), metadata=_meta(
                             requested_org_id=F.col("requested_org_id").cast("string"),
                             doc_type_expected=F.col("doc_type_expected")))
    return Outcome(decided, rows, audit)


def fulfil(submissions: DataFrame, requests: DataFrame, users: DataFrame, docs: DataFrame) -> Outcome:
    """Answer requisitions ``(seq, doc_id, request_id, user_id, text, submitted_at)``.

    The first permitted submission of an open request is accepted; ``rows`` are the new document versions.
    """
    what = requests.select("request_id", "case_id", "requested_org_id", "doc_type_expected",
                           F.col("status").alias("_status"))
    who = users.select("user_id", F.col("role").alias("_role"), F.col("org_id").alias("_org"))
    joined = submissions.join(what, "request_id", "left").join(who, "user_id", "left")
    verdict = request_verdict(F.col("_role"), F.col("_org"), F.col("requested_org_id"))
    checked = joined.withColumn("_static", first_reason(
        (F.col("case_id").isNull(), "request_not_found"), (verdict == "different_organization", "different_organization"),
        (verdict == "role_not_permitted", "role_not_permitted"), (F.col("_status") == "completed", "already_fulfilled")))
    first = checked.filter("_static IS NULL").groupBy("request_id").agg(F.min("seq").alias("_first"))
    decided = cut_lineage(checked.join(first, "request_id", "left").withColumn("reason", F.coalesce(
        "_static", F.when(F.col("seq") > F.col("_first"), "already_fulfilled"))).select(
        *submissions.columns, "case_id", "requested_org_id",
        F.coalesce("doc_type_expected", F.lit("Evidence")).alias("doc_type"), "reason"))
    good = decided.filter("reason IS NULL")
    numbered = assign_versions(good, docs, "seq")
    rows = numbered.select(
        "doc_id", "case_id", "doc_type", "version",
        object_key("requested_org_id", "case_id", "doc_id", "version").alias("storage_path"),
        F.col("text").alias("raw_text"), F.sha2("text", 256).alias("doc_hash"), F.lit("processing").alias("status"),
        F.lit("pending").alias("chain_status"), F.col("user_id").alias("uploaded_by"),
        F.col("submitted_at").alias("created_at"))
    audit = audit_events(good, "evidence_request_fulfilled", "evidence_request", "request_id", "user_id",
                         F.col("submitted_at"), metadata=_meta(document_id=F.col("doc_id").cast("string"),
                                                               doc_type=F.col("doc_type")))
    return Outcome(decided, rows, audit)


def fulfilled_requests(requests: DataFrame, outcome: Outcome) -> DataFrame:
    """The request table after ``fulfil``."""
    done = outcome.accepted.select("request_id", F.col("submitted_at").alias("_at"))
    return requests.join(done, "request_id", "left").withColumn(
        "status", F.when(F.col("_at").isNotNull(), "completed").otherwise(F.col("status"))).withColumn(
        "completed_at", F.coalesce("_at", "completed_at")).drop("_at")


def correct_tags(corrections: DataFrame, docs: DataFrame, tags: DataFrame, grants: DataFrame) -> Outcome:
    """Officers' spans ``(doc_id, entity_type, span_start, span_end, user_id, corrected_at)``.

    ``grants`` is the access matrix; only an assigned officer may correct. ``rows`` is the tag table afterwards.
    """
    opened = grants.filter((F.col("grant") == "assigned")).select("case_id", "user_id", F.lit(True).alias("_may"))
    joined = corrections.join(docs.select("doc_id", "case_id"), "doc_id", "left").join(
        opened, ["case_id", "user_id"], "left")
    decided = joined.withColumn("reason", first_reason(
        (F.col("case_id").isNull(), "document_not_found"), (F.col("_may").isNull(), "not_assigned"))).drop("_may")
    good = decided.filter("reason IS NULL")
    new = good.select("doc_id", "entity_type", "span_start", "span_end", F.lit(None).cast("int").alias("confidence"),
                      F.lit("officer_correction").alias("source"))
    audit = audit_events(good, "redact_tag_correction", "document", "doc_id", "user_id", F.col("corrected_at"),
                         metadata=_meta(entity_type=F.col("entity_type"), span_start=F.col("span_start"),
                                        span_end=F.col("span_end")))
    return Outcome(decided, tags.unionByName(new), audit)


def release_reviews(requests: DataFrame, docs: DataFrame, tags: DataFrame) -> Outcome:
    """Release documents from review ``(seq, doc_id, role, user_id, released_at)``.

    Only a document awaiting review, with text, is released; ``rows`` is the document table afterwards.
    """
    state = docs.select("doc_id", "case_id", F.col("status").alias("_status"),
                        (F.length(F.coalesce("raw_text", F.lit(""))) == 0).alias("_blank"))
    checked = requests.join(state, "doc_id", "left").withColumn("_static", first_reason(
        (~F.col("role").isin(*K.RELEASE_ROLES), "role_not_permitted"), (F.col("_status").isNull(), "document_not_found"),
        (F.col("_status") != "needs_review", "not_in_review"), (F.col("_blank"), "no_text")))
    first = checked.filter("_static IS NULL").groupBy("doc_id").agg(F.min("seq").alias("_first"))
    decided = checked.join(first, "doc_id", "left").withColumn("reason", F.coalesce(
        "_static", F.when(F.col("seq") > F.col("_first"), "not_in_review"))).select(
        *requests.columns, "case_id", "reason")
    good = decided.filter("reason IS NULL")
    rows = docs.join(good.select("doc_id", F.lit(True).alias("_go")), "doc_id", "left").withColumn(
        "status", F.when(F.col("_go"), "ready").otherwise(F.col("status"))).drop("_go")
    counts = tags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"),
                                        F.count_if(F.col("source") == "officer_correction").alias("_c"))
    counted = good.join(counts, "doc_id", "left")
    audit = audit_events(counted, "document_review_released", "document", "doc_id", "user_id", F.col("released_at"),
                         metadata=_meta(tag_count=F.coalesce("_n", F.lit(0)),
                                        officer_corrections=F.coalesce("_c", F.lit(0))))
    return Outcome(decided, rows, audit)


def apply_holds(actions: DataFrame, docs: DataFrame, order: str = "action_id") -> Outcome:
    """Set or clear legal holds ``(action_id, doc_id, legal_hold, actor_user_id, acted_at)``; the last one counts."""
    decided = actions.join(_flag(docs, "doc_id", "_doc", "case_id"), "doc_id", "left").withColumn(
        "reason", F.when(F.col("_doc").isNull(), "document_not_found")).drop("_doc")
    good = decided.filter("reason IS NULL")
    last = good.groupBy("doc_id").agg(F.max_by("legal_hold", F.struct(order, "legal_hold")).alias("_hold"))
    rows = docs.join(last, "doc_id", "left").withColumn(
        "retention_legal_hold", F.coalesce("_hold", "retention_legal_hold")).drop("_hold")
    name = F.when(F.col("legal_hold"), "document_legal_hold_placed").otherwise("document_legal_hold_released")
    audit = audit_events(good, name, "document", "doc_id", "actor_user_id", F.col("acted_at"),
                         metadata=_meta(legal_hold=F.col("legal_hold")))
    return Outcome(decided, rows, audit)


def apply_decisions(decisions: DataFrame, apps: DataFrame, users: DataFrame, roles: DataFrame) -> Outcome:
    """Approve or reject applications ``(seq, application_id, decision, reviewer_user_id, decided_at)``.

    An approval needs a free e-mail address, among the accounts and among earlier approvals of the batch; the
    first effective decision ends an application. ``rows`` are the new accounts, without any secret.
    """
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    known = apps.select("application_id", "email", "name", "claimed_role", "org_id", "claimed_credential_id",
                        F.col("status").alias("_status")).join(taken, "email", "left")
    checked = decisions.join(known, "application_id", "left").withColumn("_static", first_reason(
        (F.col("_status").isNull(), "application_not_found"),
        (F.col("_status") != "pending_review", "already_decided"),
        ((F.col("decision") == "approve") & F.col("_taken").isNotNull(), "email_taken")))
    open_ = checked.filter("_static IS NULL")
    # Earliest open decision and earliest open rejection of each application; only an approval can still lose
    # its address to an earlier approval, and then the application waits for its next rejection.
    firsts = open_.groupBy("application_id", "email").agg(
        F.min("seq").alias("_first"), F.min_by("decision", "seq").alias("_kind"),
        F.min(F.when(F.col("decision") == "reject", F.col("seq"))).alias("_reject"))
    winners = firsts.filter("_kind = 'approve'").groupBy("email").agg(F.min("_first").alias("_winner"))
    settled = firsts.join(winners, "email", "left").select(
        "application_id",
        F.when((F.col("_kind") == "reject") | (F.col("_first") == F.col("_winner")), F.col("_first"))
        .otherwise(F.col("_reject")).alias("_effective"))
    decided = checked.join(settled, "application_id", "left").withColumn("reason", F.coalesce("_static", F.when(
        F.col("_effective").isNull() | (F.col("seq") < F.col("_effective")), "email_taken")
        .when(F.col("seq") > F.col("_effective"), "already_decided"))).select(
        *decisions.columns, "name", "email", "claimed_role", "org_id", "claimed_credential_id", "reason")
    good = decided.filter("reason IS NULL")
    codes = roles.groupBy(F.col("code").alias("claimed_role")).agg(F.min("role_id").alias("role_id"))
    rows = good.filter("decision = 'approve'").join(codes, "claimed_role", "left").select(
        "application_id", "org_id", F.col("claimed_role").alias("role"), "role_id",
        F.col("claimed_credential_id").alias("service_id"), "name", "email",
        F.lit(True).alias("must_change_password"))
    name = F.when(F.col("decision") == "approve", "user_application_approved").otherwise("user_application_rejected")
    audit = audit_events(good, name, "user_application", "application_id", "reviewer_user_id", F.col("decided_at"),
                         case_id=None, metadata=_meta(role=F.col("claimed_role")))
    return Outcome(decided, rows, audit)


def apply_roles(changes: DataFrame, users: DataFrame, roles: DataFrame) -> Outcome:
    """Assign or (null code) remove roles ``(seq, user_id, role_code, actor_user_id, changed_at)``.

    ``decided`` carries previous and new role; ``rows`` is the user table afterwards.
    """
    people = users.select("user_id", F.col("role").alias("_role"), F.lit(True).alias("_user"))
    codes = roles.groupBy(F.col("code").alias("role_code")).agg(F.min("role_id").alias("_rid"))
    checked = cut_lineage(changes.join(people, "user_id", "left").join(codes, "role_code", "left").withColumn(
        "_static", first_reason((F.col("_user").isNull(), "user_not_found"),
                                (F.col("role_code").isNotNull() & F.col("_rid").isNull(), "role_not_found"))))
    good = checked.filter("_static IS NULL").withColumn("new_role", F.coalesce("role_code", F.lit("unassigned")))
    traced = previous_row(good, "seq", ["new_role"], ["user_id"]).withColumn(
        "previous_role", F.coalesce("previous_new_role", "_role"))
    columns = [*changes.columns, "previous_role", "new_role", "reason"]
    nothing = F.lit(None).cast("string")
    decided = traced.withColumn("reason", nothing).select(*columns).unionByName(
        checked.filter("_static IS NOT NULL").withColumn("previous_role", F.col("_role")).withColumn("new_role", nothing)
        .withColumn("reason", F.col("_static")).select(*columns))
    last = good.groupBy("user_id").agg(F.max_by(F.struct("new_role", "_rid"), "seq").alias("_l"))
    rows = users.join(last, "user_id", "left").withColumn(
        "role_id", F.when(F.col("_l").isNotNull(), F.col("_l._rid")).otherwise(F.col("role_id"))).withColumn(
        "role", F.coalesce("_l.new_role", "role")).drop("_l")
    name = F.when(F.col("role_code").isNull(), "role_removed").otherwise("role_assigned")
    audit = audit_events(traced, name, "user", "user_id", "actor_user_id", F.col("changed_at"), case_id=None,
                         metadata=_meta(previous_role=F.col("previous_role"), new_role=F.col("new_role")))
    return Outcome(decided, rows, audit)


def onboard_orgs(new: DataFrame, orgs: DataFrame) -> Outcome:
    """Register organisations ``(seq, name, org_type, actor_user_id, asked_at)``: trimmed, unique by name."""
    clean = new.withColumn("name", strip_space(F.coalesce("name", F.lit("")))).withColumn(
        "org_type", F.lower(strip_space(F.col("org_type"))))
    first = clean.groupBy("name").agg(F.min("seq").alias("_first"))
    held = orgs.select("name").distinct().withColumn("_held", F.lit(True))
    decided = clean.join(first, "name").join(held, "name", "left").withColumn("reason", first_reason(
        (F.length("name") == 0, "empty_name"),
        (F.col("_held").isNotNull() | (F.col("seq") > F.col("_first")), "name_taken"))).select(*new.columns, "reason")
    good = decided.filter("reason IS NULL")
    audit = audit_events(good, "organization_onboarded", "organization", "seq", "actor_user_id", F.col("asked_at"),
                         case_id=None, metadata=_meta(org_name=F.col("name"), org_type=F.col("org_type")))
    return Outcome(decided, good.select("seq", "name", "org_type"), audit)


def add_diary_entries(entries: DataFrame, cases: DataFrame, users: DataFrame, grants: DataFrame) -> Outcome:
    """Append diary entries ``(entry_id, case_id, user_id, text, written_at)``; they start in processing.

    Only the case's officer and the station head write the diary; ``grants`` is the access matrix.
    """
    may = grants.filter(F.col("can_open") & F.col("case_id").isNotNull()).select(
        "case_id", "user_id", F.lit(True).alias("_may"))
    joined = (
        entries.join(users.select("user_id", F.col("role").alias("_role")), "user_id", "left")
        .join(_flag(cases, "case_id", "_case"), "case_id", "left").join(may, ["case_id", "user_id"], "left"))
    open_to = F.col("_role").isin(*K.UNRESTRICTED_CASE_ROLES) | F.col("_may").isNotNull()
    decided = joined.withColumn("reason", first_reason(
        (~F.coalesce(F.col("_role").isin(*K.DIARY_FULL_ROLES), F.lit(False)), "role_not_permitted"),
        (F.col("_case").isNull(), "case_not_found"), (~open_to, "no_case_access"),
        (strip_space(F.coalesce("text", F.lit(""))) == "", "empty_text"))).select(*entries.columns, "reason")
    good = decided.filter("reason IS NULL")
    rows = good.select("entry_id", "case_id", F.col("user_id").alias("author_user_id"), "text",
                       F.lit("processing").alias("status"), F.col("written_at").alias("created_at"))
    audit = audit_events(good, "case_diary_entry_added", "case_diary_entry", "entry_id", "user_id", F.col("written_at"),
                         metadata=_meta(length=F.length("text"), status=F.lit("processing")))
    return Outcome(decided, rows, audit)


def submit_applications(applications: DataFrame, orgs: DataFrame, users: DataFrame) -> Outcome:
    """File account applications ``(application_id, name, email, claimed_role, org_id, submitted_by, submitted_at)``."""
    taken = users.select("email").distinct().withColumn("_taken", F.lit(True))
    joined = applications.join(_flag(orgs, "org_id", "_org"), "org_id", "left").join(taken, "email", "left")
    decided = joined.withColumn("reason", first_reason(
        (F.col("_org").isNull(), "organization_not_found"), (F.col("_taken").isNotNull(), "email_taken"),
    )).select(*applications.columns, "reason")
    good = decided.filter("reason IS NULL")
    rows = good.drop("reason").withColumn("status", F.lit("pending_review"))
    audit = audit_events(good, "user_application_created", "user_application", "application_id", "submitted_by",
                         F.col("submitted_at"), case_id=None,
                         metadata=_meta(claimed_role=F.col("claimed_role"), org_id=F.col("org_id").cast("string")))
    return Outcome(decided, rows, audit)


def revoke_keys(requests: DataFrame, keys: DataFrame) -> Outcome:
    """Revoke keys ``(seq, key_id, actor_user_id, revoked_at)``; ``rows`` is the key table afterwards."""
    held = keys.select("key_id", "key_prefix", F.col("revoked_at").alias("_was"), F.lit(True).alias("_key"))
    first = requests.groupBy("key_id").agg(F.min("seq").alias("_first"))
    decided = requests.join(held, "key_id", "left").join(first, "key_id").withColumn("reason", first_reason(
        (F.col("_key").isNull(), "key_not_found"),
        (F.col("_was").isNotNull() | (F.col("seq") > F.col("_first")), "already_revoked"),
    )).select(*requests.columns, "key_prefix", "reason")
    good = decided.filter("reason IS NULL")
    ended = good.select("key_id", F.col("revoked_at").alias("_ended"))
    rows = keys.join(ended, "key_id", "left").withColumn("revoked_at", F.coalesce("revoked_at", "_ended")).drop("_ended")
    audit = audit_events(good, "api_key_revoked", "api_key", "key_id", "actor_user_id", F.col("revoked_at"), case_id=None,
                         metadata=_meta(key_prefix=F.col("key_prefix")))
    return Outcome(decided, rows.select(*keys.columns), audit)


def create_roles(new: DataFrame, roles: DataFrame, permissions: DataFrame) -> Outcome:
    """Create custom roles ``(seq, code, name, permission_codes, actor_user_id, asked_at)``.

    The code is trimmed, lower-cased and written with underscores; permissions the system does not know are left
    out. ``rows`` is one row per new role and granted permission (null when it has none).
    """
    clean = new.withColumn("code", F.replace(F.lower(strip_space(F.col("code"))), F.lit(" "), F.lit("_"))).withColumn(
        "name", strip_space(F.col("name")))
    held = roles.select("code").distinct().withColumn("_held", F.lit(True))
    first = clean.groupBy("code").agg(F.min("seq").alias("_first"))
    decided = clean.join(first, "code").join(held, "code", "left").withColumn("reason", F.when(
        F.col("_held").isNotNull() | (F.col("seq") > F.col("_first")), "code_taken")).select(*new.columns, "reason")
    good = decided.filter("reason IS NULL")
    asked = good.select("seq", F.explode("permission_codes").alias("permission_code"))
    granted = asked.join(permissions.select(F.col("code").alias("permission_code")), "permission_code", "left_semi")
    rows = good.select("seq", "code", "name", F.lit(False).alias("is_system")).join(granted, "seq", "left")
    audit = audit_events(good, "role_created", "role", "seq", "actor_user_id", F.col("asked_at"), case_id=None,
                         metadata=_meta(role_code=F.col("code"), role_name=F.col("name")))
    return Outcome(decided, rows, audit)


def delete_roles(requests: DataFrame, roles: DataFrame) -> Outcome:
    """Delete custom roles ``(seq, role_id, actor_user_id, asked_at)``; ``rows`` is the role table afterwards."""
    held = roles.select("role_id", "code", "is_system")
    first = requests.groupBy("role_id").agg(F.min("seq").alias("_first"))
    decided = requests.join(held, "role_id", "left").join(first, "role_id").withColumn("reason", first_reason(
        (F.col("code").isNull(), "role_not_found"), (F.col("is_system"), "system_role"),
        (F.col("seq") > F.col("_first"), "role_not_found"))).select(*requests.columns, "code", "reason")
    good = decided.filter("reason IS NULL")
    rows = roles.join(good.select("role_id"), "role_id", "left_anti")
    audit = audit_events(good, "role_deleted", "role", "role_id", "actor_user_id", F.col("asked_at"), case_id=None,
                         metadata=_meta(role_code=F.col("code")))
    return Outcome(decided, rows, audit)
