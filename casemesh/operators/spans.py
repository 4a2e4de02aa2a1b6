"""From raw spans to tags: protect citations, score, resolve overlaps, write tag rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemesh import constants as K
from casemesh.functions import patterns as P
from casemesh.functions.text import bind, quality_reason, quality_verdict, strip_class, strip_space, text_stats
from casemesh.operators import detect
from casemesh.operators.detect import SPANS


def _cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def protected_ranges(text: Column) -> Column:
    """Statute citations and form captions, as ``array<span>``; these are never masked."""
    return detect.match_spans(text, P.CITATION, P.CAPTION)


def trim_spans(spans: Column, ranges: Column, text: Column) -> Column:
    """Cut protected ranges out of every span; drop what keeps fewer than three useful characters."""

    def against(span: Column) -> Column:
        def one(acc: Column, r: Column) -> Column:
            start, end = acc["s"], acc["e"]
            covered = (r["span_start"] <= start) & (end <= r["span_end"])
            touching = (r["span_start"] < end) & (start < r["span_end"])
            keep_head = touching & (start < r["span_start"])
            return F.struct(
                F.when(acc["gone"] | covered, F.lit(0)).when(touching & ~keep_head, F.greatest(start, r["span_end"]))
                .otherwise(start).alias("s"),
                F.when(acc["gone"] | covered, F.lit(0)).when(keep_head, F.least(end, r["span_start"]))
                .otherwise(end).alias("e"),
                (acc["gone"] | covered).alias("gone"))

        start = F.struct(span["span_start"].alias("s"), span["span_end"].alias("e"), F.lit(False).alias("gone"))
        return F.aggregate(ranges, start, one)

    moved = F.transform(spans, lambda s: F.struct(s.alias("span"), against(s).alias("to")))
    useful = F.filter(moved, lambda m: (m["to"]["e"] > m["to"]["s"]) & (
        F.length(strip_class(_cut(text, m["to"]["s"], m["to"]["e"]), P.TRIM_CHARS)) >= 3))
    trimmed = F.transform(useful, lambda m: F.struct(
        m["span"]["entity_type"].alias("entity_type"), m["to"]["s"].alias("span_start"),
        m["to"]["e"].alias("span_end"), m["span"]["confidence"].alias("confidence")))
    return F.when(F.size(ranges) == 0, spans).otherwise(trimmed.cast(SPANS))


def score_of(entity: Column, start: Column, end: Column, confidence: Column, text: Column) -> Column:
    """Confidence adjusted by what the matched text looks like; identifiers keep their own."""

    def worth(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    def adjusted(fragment: Column, words: Column) -> Column:
        before = _cut(text, F.greatest(F.lit(0), start - 24), start)
        score = (
            confidence
            + worth(fragment.rlike(r"\p{L}") & ~fragment.rlike(rf"[\p{{L}}&&[^{P.DEVANAGARI}]]"), P.SCORE_DEVANAGARI)
            + worth(F.exists(words, lambda w: w.rlike(r"^\p{ASCII}+$") & ~w.rlike("[aeiouAEIOU]")), P.SCORE_NO_VOWEL)
            + worth(F.exists(words, lambda w: w.rlike(P.CONSONANT_RUN)), P.SCORE_CONSONANTS)
            + worth(fragment.rlike(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"), P.SCORE_DIGIT)
            + worth(F.length(fragment) < 4, P.SCORE_SHORT)
            + worth((entity == "PERSON") & before.rlike(P.HONORIFIC_BEFORE), P.SCORE_HONORIFIC)
            + worth(fragment.contains(" ") & (F.length(fragment) > 7), P.SCORE_MULTIWORD))
        return F.greatest(F.lit(P.SCORE_MIN), F.least(F.lit(P.SCORE_MAX), score))

    def of(fragment: Column) -> Column:
        bare = F.transform(F.split(fragment, f"{P.SPACE}+"), lambda w: strip_class(w, P.WORD_TRIM))
        words = F.filter(bare, lambda w: (F.length(w) >= 2) & w.rlike(r"\p{L}"))
        return bind(words, lambda w: adjusted(fragment, w))

    scored = bind(strip_space(_cut(text, start, end)), of)
    return F.when(entity.isin(*P.SCORED_TYPES), scored).otherwise(confidence).cast("int")


def score_spans(spans: Column, text: Column) -> Column:
    return F.transform(spans, lambda s: s.withField("confidence", score_of(
        s["entity_type"], s["span_start"], s["span_end"], F.coalesce(s["confidence"], F.lit(50)), text))).cast(SPANS)


def resolve_overlaps(spans: Column) -> Column:
    """Keep the stronger of overlapping spans: by confidence, then length, then start; return text order."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct(
        (-s["confidence"]).alias("rank"), (s["span_start"] - s["span_end"]).alias("shorter"),
        s["span_start"].alias("start"), i.alias("found"), s.alias("span"))))

    def keep(kept: Column, cand: Column) -> Column:
        span = cand["span"]
        taken = F.exists(kept, lambda k: (span["span_start"] < k["span_end"]) & (k["span_start"] < span["span_end"]))
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(span)))

    survivors = F.aggregate(ranked, F.array().cast(SPANS), keep)
    ordered = F.array_sort(F.transform(survivors, lambda s: F.struct(s["span_start"].alias("at"), s.alias("span"))))
    return F.when(F.size(spans) <= 1, spans).otherwise(F.transform(ordered, lambda o: o["span"])).cast(SPANS)


def tagged(docs: DataFrame, text: str = "raw_text", recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS,
           raw_spans: str | None = None) -> DataFrame:
    """``docs`` with the final ``spans``; pass ``raw_spans`` when a detector has added its own already."""
    found = docs if raw_spans else detect.detect_entities(docs, text, recognizers, "_raw")
    raw = F.col(raw_spans or "_raw")
    t = F.col(text)
    any_found = F.size(raw) > 0
    trimmed = found.withColumn("_raw", F.when(
        any_found, bind(protected_ranges(t), lambda ranges: trim_spans(raw, ranges, t))).otherwise(raw))
    scored = trimmed.withColumn("_raw", F.when(any_found, score_spans(F.col("_raw"), t)).otherwise(F.col("_raw")))
    return scored.withColumn("spans", resolve_overlaps(F.col("_raw"))).drop("_raw")


def tag_documents(docs: DataFrame, key: str = "doc_id", text: str = "raw_text",
                  recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS) -> DataFrame:
    """The tags table: offsets, type and confidence of every final span, never the text."""
    spans = tagged(docs.select(key, text), text, recognizers).select(key, "spans")
    return detect.explode_spans(spans, key).withColumn("source", F.lit("ai_parser"))


def tag_status(docs: DataFrame, key: str = "doc_id", text: str = "raw_text",
               recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS) -> DataFrame:
    """Per document what tagging decides and records: status, counts, types, lowest confidence, quality.

    An empty text goes to review; so does a span under the threshold or a text that fails the quality check.
    """
    t = F.col(text)
    stats = F.col("_stats")
    df = tagged(docs.select(key, text), text, recognizers).withColumn("_stats", text_stats(t))
    low = F.exists("spans", lambda s: s["confidence"] < K.REVIEW_THRESHOLD)
    bad = quality_verdict(stats) != "ok"
    empty = F.coalesce(strip_space(t) == "", F.lit(True))
    return df.select(
        key,
        F.when(empty | low | bad, "needs_review").otherwise("ready").alias("status"),
        F.size("spans").cast("long").alias("tag_count"),
        F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["entity_type"]))).alias("entity_types"),
        F.coalesce(F.array_min(F.transform("spans", lambda s: s["confidence"])), F.lit(100)).alias("min_confidence"),
        (~bad).alias("ocr_quality_ok"), quality_reason(stats).alias("ocr_quality_reason"))


def refresh_tags(old: DataFrame, new: DataFrame, retagged: DataFrame | None = None,
                 key: str = "doc_id") -> DataFrame:
    """Replace the automatic tags of the re-tagged documents (all, unless ``retagged`` lists their keys).

    Officers' tags stay; a re-tagged document with no new span loses its old automatic ones.
    """
    automatic = F.coalesce(F.col("source"), F.lit("")) == "ai_parser"
    kept = old.filter(~automatic).unionByName(new)
    if retagged is None:
        return kept
    return kept.unionByName(old.filter(automatic).join(retagged.select(key).distinct(), key, "left_anti"))
