"""Policy resolution and redaction of text by role."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K

KEYS = ("role", "doc_type", "entity_type")


def resolve_policy(wanted: DataFrame, policies: DataFrame) -> DataFrame:
    """The governing rule of each ``(role, doc_type, entity_type)``; null action when none matches.

    Each wanted key is looked up under its eight exact/wildcard spellings by an equi join; the most exact wins,
    role before document type before entity type.
    """
    spellings = F.array(*(
        F.struct(*(F.lit("*").alias(k) if wild else F.col(k).alias(k) for k, wild in zip(KEYS, combo)),
                 F.lit(rank).alias("rank"))
        for rank, combo in enumerate([(r, d, e) for r in (True, False) for d in (True, False) for e in (True, False)])))
    asked = wanted.select(*KEYS).distinct().withColumn("_s", F.explode(spellings))
    rules = policies.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "action", "min_confidence")
    condition = [F.col(f"_s.{k}") == F.col(f"_{k}") for k in KEYS]
    hits = asked.join(rules, condition, "left")
    best = F.max_by(F.struct("action", "min_confidence"),
                    F.when(F.col("action").isNotNull(), F.col("_s.rank")).otherwise(-1))
    return hits.groupBy(*KEYS).agg(best.alias("_r")).select(*KEYS, "_r.*")


def _rule_map(policies: DataFrame) -> Column:
    """The whole policy as one scalar: role -> document type -> entity type -> rule.

    A policy is written by hand, so it holds at most one rule for each of a few roles, types and entities.
    """
    named = policies.dropna(subset=list(KEYS)).groupBy(*KEYS).agg(F.min(F.struct("action", "min_confidence")).alias("rule"))

    def folded(df: DataFrame, keys: Sequence[str], entry: str, value: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(entry, value))).alias("rule"))

    by_type = folded(named, KEYS[:2], KEYS[2], "rule")
    return folded(folded(by_type, KEYS[:1], KEYS[1], "rule"), (), KEYS[0], "rule").scalar()


def with_rules(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Append ``_rules``: the rule maps for (role, type), (role, *), (*, type), (*, *), in that order.

    Rules are looked up in a scalar, so rows are not shuffled by their few roles and types.
    """
    every, anyone = _rule_map(policies), F.lit("*")
    return df.withColumn("_rules", F.array(*(
        F.try_element_at(F.try_element_at(every, role), doc_type)
        for role in (F.col("role"), anyone) for doc_type in (F.col("doc_type"), anyone))))


def decide(rules: Column, entity: Column, confidence: Column) -> Column:
    """mask, show or flag for one span; a missing rule or a confidence under the rule's floor masks."""
    rule = F.coalesce(*(F.try_element_at(rules[i], key) for i in range(4) for key in (entity, F.lit("*"))))
    sure = F.coalesce(confidence, F.lit(0)) >= rule["min_confidence"]
    return F.when(rule["action"].isin("show", "flag") & sure, rule["action"]).otherwise("mask")


def applicable_spans(spans: Column, size: Column) -> Column:
    """Spans in masking order, without overlapping ones and those beyond a text of ``size`` characters.

    Ordered by start, then confidence (highest first), then end; the first of overlapping spans stays.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["span_start"].alias("at"), (-F.coalesce(s["confidence"], F.lit(0))).alias("rank"),
        s["span_end"].alias("to"), s["entity_type"].alias("entity_type"), s["confidence"].alias("confidence"))))

    def step(acc: Column, s: Column) -> Column:
        fits = (s["at"] >= acc["cursor"]) & (s["at"] <= size) & (s["to"] <= size)
        return F.struct(
            F.when(fits, s["to"]).otherwise(acc["cursor"]).alias("cursor"),
            F.when(fits, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    none = F.filter(ordered, lambda s: F.lit(False))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("cursor"), none.alias("kept")), step, lambda a: a["kept"])


def mask_text(text: Column, spans: Column, rules: Column | None = None) -> Column:
    """``text`` with every span masked, shown or flagged; without rules all are masked.

    ``spans`` are those of ``applicable_spans``.
    """

    def framed(frame: tuple[str, str], name: Column) -> Column:
        return F.concat(F.lit(frame[0]), name, F.lit(frame[1]))

    def piece(acc: Column, s: Column) -> Column:
        original = F.substring(text, s["at"] + 1, s["to"] - s["at"])
        action = F.lit("mask") if rules is None else decide(rules, s["entity_type"], s["confidence"])
        shown = (
            F.when(action == "show", original)
            .when(action == "flag", F.concat(original, framed(K.UNCONFIRMED, s["entity_type"])))
            .otherwise(framed(K.MASKED, s["entity_type"])))
        gap = F.substring(text, acc["cursor"] + 1, s["at"] - acc["cursor"])
        return F.struct(s["to"].alias("cursor"), F.concat(acc["out"], F.array(gap, shown)).alias("out"))

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, piece)
    rest = F.substring(text, done["cursor"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(done["out"], ""), rest)).otherwise(text)


def collect_spans(docs: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the array of their tags; a document has at most as many as its text has room for."""
    grouped = tags.groupBy(key).agg(
        F.collect_list(F.struct("entity_type", "span_start", "span_end", "confidence")).alias("spans"))
    empty = F.array().cast("array<struct<entity_type:string,span_start:int,span_end:int,confidence:int>>")
    return docs.join(grouped, key, "left").withColumn("spans", F.coalesce("spans", empty))


def resolve_spans(ready: DataFrame, text: str) -> DataFrame:
    """``spans`` reduced to the applicable ones, once for each text and before it is read by many roles."""
    return ready.withColumn("spans", applicable_spans(F.col("spans"), F.length(text)))


def for_roles(docs: DataFrame, roles: Sequence[str]) -> DataFrame:
    return docs.withColumn("role", F.explode(F.array(*(F.lit(r) for r in roles))))


def redact(docs: DataFrame, tags: DataFrame, policies: DataFrame, roles: Sequence[str]) -> DataFrame:
    """``(doc_id, doc_type, role, text)``: the masked copy of each document for each role."""
    ready = resolve_spans(collect_spans(docs.select("doc_id", "doc_type", "raw_text"), tags), "raw_text")
    ruled = with_rules(for_roles(ready, roles), policies)
    return ruled.select("doc_id", "doc_type", "role",
                        mask_text(F.col("raw_text"), F.col("spans"), F.col("_rules")).alias("text"))


def document_view(docs: DataFrame, tags: DataFrame, policies: DataFrame, roles: Sequence[str]) -> DataFrame:
    """What each role reads: full text, the masked copy, or nothing while tagging or review is pending."""
    ready = resolve_spans(collect_spans(docs.select("doc_id", "doc_type", "status", "raw_text"), tags), "raw_text")
    ruled = with_rules(for_roles(ready, roles), policies)
    full = F.col("role").isin(*K.FULL_TEXT_ROLES)
    masked = mask_text(F.col("raw_text"), F.col("spans"), F.col("_rules"))
    text = (
        F.when(full & F.col("status").isin("ready", "needs_review"), F.col("raw_text"))
        .when(F.col("status") == "ready", masked))
    return ruled.select("doc_id", "role", "status", text.alias("text"))


def preview(docs: DataFrame, tags: DataFrame, policies: DataFrame, roles: Sequence[str]) -> DataFrame:
    """The same documents through a policy for many roles, whatever their status."""
    ready = resolve_spans(collect_spans(docs.select("doc_id", "doc_type", "status", "raw_text"), tags), "raw_text")
    ruled = with_rules(for_roles(ready, roles), policies)
    full = F.col("role").isin(*K.FULL_TEXT_ROLES)
    masked = mask_text(F.col("raw_text"), F.col("spans"), F.col("_rules"))
    return ruled.select(
        "doc_id", "doc_type", "role", full.alias("full_text_access"),
        (F.col("status") != "ready").alias("withheld_pending_review"),
        F.when(full, F.col("raw_text")).otherwise(masked).alias("text"))


def redact_diary(entries: DataFrame, tags: DataFrame, role: str) -> DataFrame:
    """Diary entries as a role reads them: full text for full-text roles, else every span masked."""
    from casemesh.operators.listing import visible_diary

    visible = visible_diary(entries, role)
    if role in K.FULL_TEXT_ROLES:
        return visible
    ready = resolve_spans(collect_spans(visible, tags, "entry_id"), "text")
    return ready.withColumn("text", mask_text(F.col("text"), F.col("spans"))).drop("spans")


def span_decisions(docs: DataFrame, tags: DataFrame, policies: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per role and applicable span with the action taken; the text is read only for its length."""
    ready = collect_spans(docs.select("doc_id", "doc_type", F.length("raw_text").alias("size")), tags)
    kept = ready.select("doc_id", "doc_type", F.explode(applicable_spans(F.col("spans"), F.col("size"))).alias("_s"))
    ruled = with_rules(for_roles(kept, roles), policies)
    return ruled.select(
        "doc_id", "doc_type", "role", F.col("_s.entity_type").alias("entity_type"),
        F.col("_s.at").alias("span_start"), F.col("_s.to").alias("span_end"),
        decide(F.col("_rules"), F.col("_s.entity_type"), F.col("_s.confidence")).alias("action"))
