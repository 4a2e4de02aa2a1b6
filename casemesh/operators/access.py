"""Who may list and open which case, request or identity; every missing link is a denial."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K


def cases_assigned(cases: DataFrame, assignments: DataFrame, user_id) -> DataFrame:
    return cases.join(assignments.filter(F.col("io_user_id") == user_id).select("case_id"), "case_id", "left_semi")


def _registrations(audit: DataFrame) -> DataFrame:
    return audit.filter((F.col("action") == K.REGISTRATION_ACTION) & F.col("case_id").isNotNull())


def cases_registered(cases: DataFrame, audit: DataFrame, user_id) -> DataFrame:
    mine = _registrations(audit).filter(F.col("actor_user_id") == user_id).select("case_id")
    return cases.join(mine, "case_id", "left_semi")


def cases_requisitioned(cases: DataFrame, requests: DataFrame, org_id) -> DataFrame:
    """Cases an organisation holds a requisition on; without an organisation there are none."""
    if org_id is None:
        return cases.filter(F.lit(False))
    return cases.join(requests.filter(F.col("requested_org_id") == org_id).select("case_id"), "case_id", "left_semi")


def cases_engaged(cases: DataFrame, parties: DataFrame, user_id) -> DataFrame:
    mine = parties.filter((F.col("user_id") == user_id) & (F.col("party_role") == "defense")).select("case_id")
    return cases.join(mine, "case_id", "left_semi")


def access_matrix(users: DataFrame, assignments: DataFrame, audit: DataFrame, requests: DataFrame,
                  parties: DataFrame) -> DataFrame:
    """Grants as ``(user_id, case_id, grant, can_list, can_open)``.

    An unrestricted user has one row with a null ``case_id`` that stands for every case, instead of one row
    per case. Roles without a rule have no row.
    """
    holders = users.select("user_id", "org_id", "role")

    def of(*roles: str) -> DataFrame:
        return holders.filter(F.col("role").isin(*roles))

    def grant(df: DataFrame, name: str, can_open: bool) -> DataFrame:
        pairs = df.select("user_id", "case_id").distinct()
        return pairs.select("user_id", "case_id", F.lit(name).alias("grant"),
                            F.lit(True).alias("can_list"), F.lit(can_open).alias("can_open"))

    everywhere = of(*K.UNRESTRICTED_CASE_ROLES).select(
        "user_id", F.lit(None).cast(assignments.schema["case_id"].dataType).alias("case_id"),
        F.lit("unrestricted").alias("grant"), F.lit(True).alias("can_list"), F.lit(True).alias("can_open"))
    assigned = assignments.select("case_id", F.col("io_user_id").alias("user_id"))
    registered = _registrations(audit).select("case_id", F.col("actor_user_id").alias("user_id"))
    engaged = parties.filter(F.col("party_role") == "defense").select("case_id", "user_id")
    by_org = requests.select("case_id", F.col("requested_org_id").alias("org_id")).distinct()
    return (
        everywhere
        .unionByName(grant(assigned.join(of(*K.ASSIGNMENT_ROLES), "user_id", "left_semi"), "assigned", True))
        .unionByName(grant(registered.join(of(K.REGISTRATION_ROLE), "user_id", "left_semi"), "registered", True))
        .unionByName(grant(engaged.join(of(K.DEFENSE_ROLE), "user_id", "left_semi"), "engaged", True))
        .unionByName(grant(by_org.join(of(K.AUTHORITY_ROLE), "org_id"), "requisitioned", False)))


def filter_visible(cases: DataFrame, user: dict, assignments: DataFrame, audit: DataFrame, requests: DataFrame,
                   parties: DataFrame) -> DataFrame:
    """The case list of one user, given as ``{"user_id", "role", "org_id"}``."""
    role = user.get("role")
    if role in K.UNRESTRICTED_CASE_ROLES:
        return cases
    if role in K.ASSIGNMENT_ROLES:
        return cases_assigned(cases, assignments, user["user_id"])
    if role == K.REGISTRATION_ROLE:
        return cases_registered(cases, audit, user["user_id"])
    if role == K.AUTHORITY_ROLE:
        return cases_requisitioned(cases, requests, user.get("org_id"))
    if role == K.DEFENSE_ROLE:
        return cases_engaged(cases, parties, user["user_id"])
    return cases.filter(F.lit(False))


def denials(asked: DataFrame, users: DataFrame, matrix: DataFrame) -> DataFrame:
    """Case-opening requests ``(user_id, case_id, ...)`` that no grant covers, with the reason."""
    roles = users.select("user_id", "role")
    known = asked.join(roles, "user_id", "left")
    bound = known.filter(~F.coalesce(F.col("role").isin(*K.UNRESTRICTED_CASE_ROLES), F.lit(False)))
    opened = matrix.filter(F.col("can_open") & F.col("case_id").isNotNull()).select("user_id", "case_id")
    reason = (
        F.when(F.col("role").isNull(), "unknown_user")
        .when(F.col("role") == K.REGISTRATION_ROLE, "not_registering_officer")
        .when(F.col("role").isin(*K.ASSIGNMENT_ROLES), "not_assigned")
        .when(F.col("role") == K.DEFENSE_ROLE, "no_engagement").otherwise("role_not_permitted"))
    return bound.join(opened, ["user_id", "case_id"], "left_anti").withColumn("reason", reason)


def request_verdict(role: Column, user_org: Column, requested_org: Column) -> Column:
    """Whether a role may touch a requisition; a missing organisation on either side is a denial."""
    same = F.coalesce(user_org == requested_org, F.lit(False))
    return (
        F.when(role.isin(*K.REQUEST_OVERSIGHT_ROLES), "allowed")
        .when((role == K.AUTHORITY_ROLE) & same, "allowed")
        .when(role == K.AUTHORITY_ROLE, "different_organization").otherwise("role_not_permitted"))


def request_access(attempts: DataFrame, requests: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts ``(request_id, user_id, ...)`` with a ``verdict``."""
    who = users.select("user_id", "role", F.col("org_id").alias("_user_org"))
    what = requests.select("request_id", "requested_org_id", F.lit(True).alias("_known"))
    joined = attempts.join(what, "request_id", "left").join(who, "user_id", "left")
    verdict = F.when(F.col("_known").isNull(), "not_found").otherwise(
        request_verdict(F.col("role"), F.col("_user_org"), F.col("requested_org_id")))
    return joined.withColumn("verdict", verdict).drop("_user_org", "requested_org_id", "_known")


def with_requester(requests: DataFrame, users: DataFrame) -> DataFrame:
    names = users.select(F.col("user_id").alias("requested_by_user_id"), F.col("name").alias("requested_by_name"))
    return requests.join(names, "requested_by_user_id", "left")


def requisition_inbox(requests: DataFrame, cases: DataFrame, users: DataFrame, assignments: DataFrame,
                      role: str, user_id=None, org_id=None) -> DataFrame:
    """The requisitions a role may browse, with case number and requester, oldest first."""
    if role == K.AUTHORITY_ROLE:
        scoped = requests.filter(F.col("requested_org_id") == org_id) if org_id is not None \
            else requests.filter(F.lit(False))
    elif role in K.INBOX_OVERSIGHT_ROLES:
        scoped = requests
    elif role == "io":
        mine = assignments.filter(F.col("io_user_id") == user_id).select("case_id")
        scoped = requests.join(mine, "case_id", "left_semi")
    else:
        scoped = requests.filter(F.lit(False))
    numbered = scoped.join(cases.select("case_id", "case_number"), "case_id")
    return with_requester(numbered, users).orderBy("created_at", "request_id")


def audit_with_actor(audit: DataFrame, users: DataFrame) -> DataFrame:
    actors = users.select(F.col("user_id").alias("actor_user_id"), F.col("name").alias("actor_name"),
                          F.col("email").alias("actor_email"))
    return audit.join(actors, "actor_user_id", "left")


def assignable(users: DataFrame, orgs: DataFrame, assignments: DataFrame, case_id) -> DataFrame:
    """Officers of police organisations who can be put on a case, flagged when they already are."""
    police = orgs.filter(F.col("org_type") == "police").select("org_id", F.col("name").alias("org_name"))
    on_case = assignments.filter(F.col("case_id") == case_id).select(
        F.col("io_user_id").alias("user_id")).distinct().withColumn("_on", F.lit(True))
    officers = users.filter(F.col("role").isin(*K.ASSIGNMENT_ROLES)).join(police, "org_id")
    return (
        officers.join(on_case, "user_id", "left")
        .select("user_id", "name", "role", "designation", "service_id", "org_name",
                F.coalesce("_on", F.lit(False)).alias("already_assigned"))
        .orderBy("name", "user_id"))


def match_identity(attempts: DataFrame, users: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Users an identifier names, by e-mail or by service id.

    Two equi joins and a de-duplication instead of one join on OR. ``ignore_case`` is the look-up rule for
    recorded parties; sign-in compares exactly.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    ident = fold(F.trim(F.col("identifier")) if ignore_case else F.col("identifier"))
    asked = attempts.withColumn("_i", ident)
    by_mail = asked.join(users.select(fold(F.col("email")).alias("_i"), "user_id"), "_i")
    found = by_mail.select("attempt_id", "identifier", "user_id")
    if not ignore_case:
        by_service = asked.join(users.select(F.col("service_id").alias("_i"), "user_id"), "_i")
        found = found.unionByName(by_service.select("attempt_id", "identifier", "user_id")).distinct()
    return found


def user_permissions(users: DataFrame, roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """``(user_id, permissions)``: those of the user's role row, or of the role named by code if it has none."""
    codes = role_permissions.groupBy("role_id").agg(F.array_sort(F.collect_set("code")).alias("_perms"))
    by_id = codes.select("role_id", F.col("_perms").alias("_own"))
    by_code = roles.join(codes, "role_id").groupBy(F.col("code").alias("role")).agg(F.min("_perms").alias("_by_code"))
    joined = users.select("user_id", "role", "role_id").join(by_id, "role_id", "left").join(by_code, "role", "left")
    nothing = F.array().cast("array<string>")
    return joined.select("user_id", "role", F.coalesce("_own", "_by_code", nothing).alias("permissions"))


def keys_with_owner(keys: DataFrame, users: DataFrame) -> DataFrame:
    owners = users.select("user_id", F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    return keys.join(owners, "user_id", "left")


def applications_with_documents(apps: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per application and credential document, in upload order; applications without any keep one row.

    Kept flat: an application with very many documents is not gathered into one array. An inner join and the
    rest apart, because a skewed side can be split in an inner join only.
    """
    files = docs.select("application_id", "credential_id", F.col("doc_type").alias("document_type"),
                        F.col("created_at").alias("document_created_at"))
    without = apps.join(files.select("application_id").distinct(), "application_id", "left_anti")
    both = apps.join(files, "application_id").unionByName(without, allowMissingColumns=True)
    return both.orderBy(
        F.col("created_at").desc(), "application_id", "document_created_at", "credential_id")


def users_with_org(users: DataFrame, orgs: DataFrame, org_id=None) -> DataFrame:
    """User summaries with the name of their organisation, of one organisation or of all."""
    df = users if org_id is None else users.filter(F.col("org_id") == org_id)
    names = orgs.select("org_id", F.col("name").alias("org_name"))
    return df.join(names, "org_id", "left").select(
        "user_id", "name", "email", "service_id", "designation", "role", "org_name")


def roles_with_permissions(roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Each role with the sorted codes it holds."""
    codes = role_permissions.groupBy("role_id").agg(F.array_sort(F.collect_set("code")).alias("permission_codes"))
    return roles.join(codes, "role_id", "left").withColumn(
        "permission_codes", F.coalesce("permission_codes", F.array().cast("array<string>")))
