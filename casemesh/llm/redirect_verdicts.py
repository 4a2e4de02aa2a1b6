"""Page verdicts from host and path rules, carried to aliases over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh.llm.common import stored
from casemesh.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block


#: Query parameters that name a referrer, not another page.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"
LINK = r"(?is)<link\b[^>]*>"
META = r"(?is)<meta\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), upper, lower)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that fits, as host and path strung together: the longest, the first of equally long ones; else null."""
    said = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        said = F.when(fits, F.lit(rule.host + rule.path)).otherwise(said)
    return said


def plain_address(url: Column) -> Column:
    """One spelling for an address: host and path without scheme, fragment, referrer parameters, ``.html`` and a last
    slash; other parameters stay. Null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(=|$)")), "&")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html?$", ""), r"/+$", "")
    whole = F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(host_of(url) != "", whole)


def _attribute(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&"))


def _resolved(link: Column, url: Column) -> Column:
    """An address as a page names it, against the page's own."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (F.when(F.trim(link) == "", F.lit(None).cast("string"))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("#"), F.lit(None).cast("string"))
            .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses, as written, of the canonical links and page redirects (``refresh``) in ``html``."""
    links = F.transform(F.filter(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(0)),
                                 lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)canonical(\s|$)")),
                        lambda t: _attribute(t, "href"))
    metas = F.transform(F.filter(F.regexp_extract_all(F.col("html"), F.lit(META), F.lit(0)),
                                 lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
                        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))
    named = (pages.where("url is not null and html is not null").select("url", "html")
             .where(F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))
             .select("url", F.explode(F.concat(links, metas)).alias("link")))
    return named.select(F.col("url").alias("source"), _resolved(F.col("link"), F.col("url")).alias("target"))


def judge_pages(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow"
                ) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url, html).

    A page that a rule fits has that rule's verdict. Any other takes it from its equivalents: addresses in one
    component of the graph whose links are spellings of one address, canonical links and redirects, those in the pages
    and those of ``redirects`` (source, target: urls). If a rule allows one of them the page is allowed; else if a
    rule blocks one it is blocked; else ``default``. Null urls and urls without ``://`` have empty host and path, fit
    no rule and stand alone; null html has no links. A target that is no page passes verdicts on, and counts for the
    rule that its own address fits. Repeated rows are judged each; an empty table gives an empty result.
    """
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = seen.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).withColumn(
        "node", plain_address(F.col("url"))).drop("url")
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = edges.select(*[x for c in ("source", "target") for x in (
        plain_address(F.col(c)).alias(c), rule_column(host_of(F.col(c)), path_of(F.col(c)), rules).alias(f"{c}_rule"))])
    edges = stored(edges.where("source is not null and target is not null").distinct(), "page-links")
    component = connected_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    verdict = {r.host + r.path: r.verdict for r in reversed(rules)}
    allowed = [r for r, v in verdict.items() if v == "allow"]
    ruled = [seen.select("node", "rule")] + [edges.select(F.col(c).alias("node"), F.col(f"{c}_rule").alias("rule"))
                                             for c in ("source", "target")]
    marks = (ruled[0].unionByName(ruled[1]).unionByName(ruled[2]).where("rule is not null and node is not null")
             .groupBy("node").agg(F.max(F.col("rule").isin(allowed)).alias("allowed")))
    # plain spellings that no link reaches are components of their own and need no join with the others
    said = (marks.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
            .groupBy("component").agg(F.max("allowed").alias("allowed")))
    spread = (component.join(said, "component").select("node", "allowed")
              .unionByName(marks.join(component, "node", "left_anti").select("node", "allowed")))
    by_rule = F.lit(None).cast("string")
    for name, v in verdict.items():
        by_rule = F.when(F.col("rule") == name, F.lit(v)).otherwise(by_rule)
    open_pages = seen.where("rule is null").join(spread, "node", "left").withColumn(
        "verdict", F.when(F.col("allowed"), F.lit("allow")).when(~F.col("allowed"), F.lit("block")).otherwise(F.lit(default)))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return seen.where("rule is not null").withColumn("verdict", by_rule).select(*columns).unionByName(
        open_pages.select(*columns))
