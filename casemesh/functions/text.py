"""Text column functions: trimming, quality, scripts, normalising, similarity, chunking."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemesh import constants as K
from casemesh.functions import patterns as P


def strip_class(col: Column, char_class: str) -> Column:
    """Remove leading and trailing characters of a regex class."""
    return F.regexp_replace(col, f"^{char_class}+|{char_class}+$", "")


def strip_space(col: Column) -> Column:
    return strip_class(col, P.SPACE)


def norm(col: Column) -> Column:
    """Compare-normalise: trim, upper-case, collapse white space; null gives ''."""
    return F.regexp_replace(F.upper(strip_space(F.coalesce(col, F.lit("")))), f"{P.SPACE}+", " ")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def not_blank(value: Column) -> Column:
    """The value, or null when it is ''."""
    return bind(value, lambda v: F.when(F.length(v) > 0, v))


def count_matches(col: Column, regex: str) -> Column:
    """Characters of ``col`` in a one-character class."""
    return F.length(col) - F.length(F.regexp_replace(col, f"{regex}+", ""))


def text_stats(text: Column) -> Column:
    """Struct of the sizes the quality gate looks at."""

    def measured(clean: Column, dense: Column, tokens: Column) -> Column:
        single = F.size(F.filter(tokens, lambda t: (F.length(t) == 1) & t.rlike(r"[\p{L}\p{N}]")))
        return F.struct(
            F.length(clean).cast("long").alias("chars"), F.length(dense).cast("long").alias("non_space"),
            count_matches(dense, r"[\p{L}\p{N}]").cast("long").alias("alnum"),
            F.size(tokens).cast("long").alias("tokens"), single.cast("long").alias("single_tokens"))

    def of(clean: Column) -> Column:
        tokens = F.when(F.length(clean) > 0, F.split(clean, f"{P.SPACE}+")).otherwise(F.array().cast("array<string>"))
        return bind(tokens, lambda t: bind(F.array_join(t, ""), lambda dense: measured(clean, dense, t)))

    return bind(strip_space(F.coalesce(text, F.lit(""))), of)


def quality_verdict(stats: Column) -> Column:
    """'ok', 'low_alnum' or 'fragmented' from ``text_stats``."""
    alnum_ratio = stats["alnum"] / stats["non_space"]
    single_ratio = stats["single_tokens"] / stats["tokens"]
    return (
        F.when((stats["chars"] < 30) | (stats["non_space"] == 0), "ok")
        .when((stats["non_space"] > 40) & (alnum_ratio < 0.5), "low_alnum")
        .when((stats["tokens"] >= 10) & (single_ratio > 0.45), "fragmented")
        .otherwise("ok"))


def quality_reason(stats: Column) -> Column:
    """The sentence recorded with a failed quality check; null when the text passes."""
    verdict = quality_verdict(stats)

    def told(frame: tuple[str, str], part: Column, whole: Column) -> Column:
        return F.concat(F.lit(frame[0]), F.format_string("%.1f%%", part * 100.0 / whole), F.lit(frame[1]))

    return (F.when(verdict == "low_alnum", told(K.LOW_ALNUM_REASON, stats["alnum"], stats["non_space"]))
            .when(verdict == "fragmented", told(K.FRAGMENTED_REASON, stats["single_tokens"], stats["tokens"])))


# --- scripts ---------------------------------------------------------------------------------

def has_devanagari(col: Column) -> Column:
    return col.rlike(f"[{P.DEVANAGARI}]")


def has_devanagari_letters(col: Column) -> Column:
    """Letters or signs, not numerals alone."""
    return col.rlike(f"[{P.DEVANAGARI}&&[^०-९]]")


def fold_digits(col: Column) -> Column:
    return F.translate(col, P.DEVANAGARI_DIGITS, P.ASCII_DIGITS)


def strip_script(col: Column) -> Column:
    """Drop whole words holding a Devanagari letter, and words of punctuation only."""
    words = F.split(strip_space(col), f"{P.SPACE}+")
    return F.array_join(F.filter(words, lambda w: ~w.rlike(f"[{P.DEVANAGARI_LETTER}]")
                                 & (F.length(strip_class(w, P.WORD_TRIM)) > 0)), " ")


def is_script_word(col: Column) -> Column:
    """At least two Devanagari letters, making up 60 % of the letters and digits."""
    letters = count_matches(col, f"[{P.DEVANAGARI_LETTER}]")
    counted = count_matches(col, rf"[\p{{L}}\p{{N}}{P.DEVANAGARI_LETTER}]")
    return (letters >= 2) & (letters / counted >= 0.6)


# --- Arrow helpers where no built-in fits -----------------------------------------------------

@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
                     dtype="float64")


def name_similarity(claimed: Column, extracted: Column) -> Column:
    """Similarity in 0..1 of two names after ``norm``. Equal and empty names are settled without comparing."""
    a, b = norm(claimed), norm(extracted)
    empty, open_ = (a == "") | (b == ""), (a != "") & (b != "") & (a != b)
    return (F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0))
            .otherwise(_sequence_ratio(F.when(open_, a), F.when(open_, b))))


def levenshtein_ratio(claimed: Column, extracted: Column) -> Column:
    """Cheap JVM-side similarity, for ranking before ``name_similarity``."""
    a, b = norm(claimed), norm(extracted)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def chunk_text(text: Column, max_chars: int = K.CHUNK_CHARS) -> Column:
    """Pieces of at most ``max_chars`` that join back exactly: ``array<struct<offset,chunk>>``.

    A piece ends after the last line break in its window, else after the last space, else at the limit. One pattern says
    so: its alternatives are tried in that order, the rest of the text first, and each takes as much as it can. Null and
    empty texts have no pieces.
    """
    most = max_chars - 1
    ends = "" if most < 1 else rf".{{1,{most}}}\n|.{{1,{most}}} |"
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{max_chars}}}\z|{ends}.{{{max_chars}}}"), F.lit(0))
    kind = "array<struct<offset:int,chunk:string>>"

    def place(acc: Column, piece: Column) -> Column:
        here = F.struct(acc["at"].alias("offset"), piece.alias("chunk"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return F.coalesce(F.aggregate(pieces, start, place, lambda acc: acc["out"]), F.array().cast(kind))


def case_prefix(crime_type: Column) -> Column:
    """First three letters of the crime type, upper-cased, or CAS."""
    letters = F.substring(F.regexp_replace(F.upper(crime_type), r"[^\p{L}]", ""), 1, 3)
    return F.when(F.length(letters) > 0, letters).otherwise("CAS")


def case_token(case_id: Column) -> Column:
    """Stable one-way token of a case id."""
    return F.sha2(case_id.cast("string"), 256)


def age_label(created_at: Column, as_of: Column) -> Column:
    """Age in words: hours within the first day, then days, then months and days."""
    seconds = F.unix_micros(as_of) / 1e6 - F.unix_micros(created_at) / 1e6
    hours = F.greatest(F.lit(0), F.floor(seconds / 3600 + 0.5)).cast("long")
    days = F.floor(hours / 24)
    months, rest = F.floor(days / 30), days % 30

    def units(n: Column, word: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))

    return (
        F.when(hours < 24, units(hours, "hr")).when(days < 31, units(days, "day"))
        .when(rest > 0, F.concat(months.cast("string"), F.lit(" mo "), rest.cast("string"), F.lit("d")))
        .otherwise(units(months, "month")))


def sanitize_name(name: Column) -> Column:
    """Base name with everything but word characters, dots and dashes replaced; at most 255 characters."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), "([^/]*)$", 1)
    clean = F.substring(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), 1, 255)
    return F.when(F.length(clean) > 0, clean).otherwise("unnamed_upload")
