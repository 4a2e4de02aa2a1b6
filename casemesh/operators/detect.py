"""Span detection: every match of every recognizer, with code-point offsets, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh.functions import patterns as P
from casemesh.schemas import SPAN

SPANS = T.ArrayType(SPAN)


def _no_spans() -> Column:
    return F.array().cast(SPANS)


def _pieces(text: Column, recognizer: P.Recognizer) -> Column:
    """What one recognizer finds: the matches, the text between them and the part of each match to keep."""
    regex = F.lit(recognizer.java)
    hits = F.regexp_extract_all(text, regex, F.lit(0))
    kept = F.regexp_extract_all(text, regex, F.lit(1)) if recognizer.tail_group else hits
    found = F.struct(
        F.lit(recognizer.entity_type).alias("kind"), F.lit(recognizer.confidence).alias("confidence"),
        F.arrays_zip(F.split(text, recognizer.java, -1).alias("gap"), hits.alias("hit"), kept.alias("kept")).alias("parts"))
    present = text.rlike(recognizer.java)
    return F.when(text.contains(recognizer.needs) & present if recognizer.needs else present, found)


def _located(piece: Column) -> Column:
    """Spans of one recognizer's pieces: gaps and matches alternate, so a running sum of both places each match."""

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part["gap"]) + F.length(part["hit"])
        span = F.struct(
            piece["kind"].alias("entity_type"), (end - F.length(part["kept"])).alias("span_start"),
            end.alias("span_end"), piece["confidence"].alias("confidence"))
        return F.struct(
            end.alias("pos"),
            F.when(part["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(piece["parts"], F.struct(F.lit(0).alias("pos"), _no_spans().alias("out")), step,
                       lambda acc: acc["out"])


def match_spans(text: Column, *recognizers: P.Recognizer) -> Column:
    """``array<span>`` of all matches of the recognizers, in their order."""
    pieces = F.array(*(_pieces(text, r) for r in recognizers))
    spans = F.transform(F.filter(pieces, lambda p: p.isNotNull()), _located)
    return F.coalesce(F.flatten(spans), _no_spans()).cast(SPANS)


def detect_entities(
    df: DataFrame, text: str = "text", recognizers: Iterable[P.Recognizer] = P.DEFAULT_RECOGNIZERS,
    out: str = "spans",
) -> DataFrame:
    """Append the raw spans of all recognizers, in registry order."""
    return df.withColumn(out, match_spans(F.col(text), *recognizers))


def detect_ids(df: DataFrame, text: str = "text", out: str = "id_spans") -> DataFrame:
    """Service ids and enrolment numbers, with the matched value."""
    spans = match_spans(F.col(text), *P.ID_RECOGNIZERS)
    return df.withColumn(out, F.transform(spans, lambda s: s.withField(
        "value", F.substring(F.col(text), s["span_start"] + 1, s["span_end"] - s["span_start"]))))


def with_detector(
    df: DataFrame, detector: Callable[[Column], Column], text: str = "text", out: str = "spans",
) -> DataFrame:
    """Merge spans of a user-supplied detector (an Arrow ``pandas_udf`` giving ``array<span>``) into ``out``."""
    extra = detector(F.col(text)).cast(SPANS)
    return df.withColumn(out, F.concat(F.coalesce(extra, _no_spans()), F.col(out)) if out in df.columns else extra)


def explode_spans(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row per span; the text itself is not carried.

    The outer form is used because the optimizer derives a size filter from the plain one, which would run the
    whole detection a second time.
    """
    rows = df.select(*keep, F.explode_outer(spans).alias("_s")).filter(F.col("_s").isNotNull())
    return rows.select(*keep, "_s.*")
