"""Credential matching over documents and claims made from the customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from casemesh.functions import text as X
from casemesh.operators import credentials as C
from casemesh.operators import spans
from casemesh.plans.models import COMPLAINANTS, pick
from casemesh.plans.registry import query
from casemesh.session import spread

NAME = pick("c_custkey % 5", COMPLAINANTS)
# The printed identifier agrees, differs or is missing; every tenth scan is empty.
CREDENTIAL_TEXT = (
    f"CASE WHEN c_custkey % 10 = 9 THEN ' ' ELSE concat('GOVERNMENT OF THE STATE', chr(10), 'Name: Inspector ', {NAME}, "
    "chr(10), 'Service ID: ', CASE WHEN c_nationkey < 15 THEN concat('DL-POL-', 1000 + c_custkey % 9000) "
    "WHEN c_nationkey < 20 THEN 'MH-POL-0007' ELSE 'illegible' END, chr(10), 'Rank: Inspector') END")


def _pair(m):
    docs = spread(m.customer).selectExpr("c_custkey AS credential_id", "c_custkey AS application_id",
                                 f"{CREDENTIAL_TEXT} AS raw_text")
    apps = m.customer.selectExpr("c_custkey AS application_id", f"{NAME} AS name",
                                 "concat('dl-pol-', 1000 + c_custkey % 9000) AS claimed_credential_id")
    return docs, apps


@query("credentials_matched", f"""
SELECT c_custkey AS credential_id, c_custkey AS application_id,
  CASE WHEN c_custkey % 10 <> 9 THEN {NAME} END AS candidate_name,
  CASE WHEN c_custkey % 10 = 9 OR c_nationkey >= 20 THEN NULL WHEN c_nationkey < 15
    THEN concat('DL-POL-', 1000 + c_custkey % 9000) ELSE 'MH-POL-0007' END AS candidate_id,
  CASE WHEN c_custkey % 10 = 9 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS name_similarity,
  c_custkey % 10 <> 9 AND c_nationkey < 15 AS id_number_exact_match,
  CASE WHEN c_custkey % 10 = 9 OR c_nationkey >= 20 THEN 'needs_review' WHEN c_nationkey < 15 THEN 'matched'
    ELSE 'mismatch' END AS match_status,
  CASE WHEN c_custkey % 10 = 9 THEN 'needs_review' ELSE 'ready' END AS status FROM customer""")
def _(m):
    return C.match_credentials(*_pair(m))


@query("best_names", f"""
SELECT c_custkey AS credential_id, CASE WHEN c_custkey % 10 <> 9 THEN {NAME} END AS name FROM customer""")
def _(m):
    docs, _apps = _pair(m)
    found = spans.tagged(docs)
    return found.select("credential_id", C.best_name(F.col("spans"), F.col("raw_text")).alias("name"))


@query("name_similarities")
def _(m):
    pairs = m.customer.select("c_custkey", "c_name", F.concat(F.col("c_mktsegment"), F.col("c_name")).alias("other"))
    return pairs.select("c_custkey", X.name_similarity(F.col("c_name"), F.col("other")).alias("similarity"))


@query("levenshtein_ratios", """
SELECT p_partkey, CASE WHEN greatest(length(p_name), length(p_brand)) = 0 THEN 0.0 ELSE round(1 - levenshtein(upper(p_name),
  upper(p_brand)) / greatest(length(p_name), length(p_brand)), 9) END AS similarity FROM part""")
def _(m):
    return m.part.select("p_partkey", F.round(X.levenshtein_ratio(F.col("p_name"), F.col("p_brand")), 9).alias("similarity"))
