"""Header fields of a registration form's text, one expression per field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casemesh.functions import patterns as P
from casemesh.functions.text import bind, fold_digits, not_blank, strip_class, strip_space


def _found(text: Column, regex: str, group: int = 1) -> Column:
    """First match of a group, or null; ``$`` means the end of the text."""
    return not_blank(F.regexp_extract(text, f"(?d){regex}", group))


def _value(text: Column, regex: str) -> Column:
    return not_blank(strip_class(_found(text, regex), P.VALUE_TRIM))


def _long(value: Column) -> Column:
    return bind(value, lambda v: F.when(F.length(v) > 3, v))


def form_template(text: Column) -> Column:
    upper = F.upper(text)
    chosen = F.lit(P.DEFAULT_TEMPLATE)
    for name, folded, printed in reversed(P.TEMPLATES):
        hit = F.lit(False)
        for marker in folded:
            hit = hit | upper.contains(marker)
        for marker in printed:
            hit = hit | text.contains(marker)
        chosen = F.when(hit, name).otherwise(chosen)
    return chosen


def _time(line: Column, regex: str) -> Column:
    hour = F.regexp_extract(line, f"(?d){regex}", 1)
    unit = F.regexp_extract(line, f"(?d){regex}", 2)
    return not_blank(strip_space(F.replace(F.concat(hour, unit), F.lit("nrs"), F.lit("hrs"))))


def _scoped_time(lines: Column, at: Column) -> Column:
    """First time in the three lines from position ``at``, unless a later section starts before it."""
    block = F.transform(F.slice(lines, at, 3), lambda x, i: F.struct(
        ((i > 0) & x.rlike(P.AFTER_REGISTRATION)).alias("ends"), _time(x, P.TIME_VALUE).alias("time")))

    def step(acc: Column, line: Column) -> Column:
        over = acc["over"] | line["ends"]
        return F.struct((over | line["time"].isNotNull()).alias("over"),
                        F.when(over, acc["time"]).otherwise(line["time"]).alias("time"))

    nothing = F.struct(F.lit(False).alias("over"), F.lit(None).cast("string").alias("time"))
    return F.aggregate(block, nothing, step, lambda acc: acc["time"])


def _labelled_time(lines: Column) -> Column:
    """First labelled time on a line that is not about the occurrence."""
    other = F.filter(lines, lambda x: ~x.rlike(P.OCCURRENCE_TIME))
    times = F.filter(F.transform(other, lambda x: _time(x, P.LABELLED_TIME)), lambda x: x.isNotNull())
    return F.try_element_at(times, F.lit(1))


def registration_time(text: Column) -> Column:
    """Time on the registration row or the two lines under it, up to the next section; without such a row, the
    first labelled time on a line that is not about the occurrence."""

    def of(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(P.REGISTRATION_ROW)), True).cast("int")
        return bind(at, lambda p: F.when(p > 0, _scoped_time(lines, F.greatest(p, F.lit(1))))
                    .otherwise(_labelled_time(lines)))

    return bind(F.split(fold_digits(text), "\n", -1), of)


def statute_sections(text: Column) -> Column:
    """``array<string>`` of section numbers named after an Act on the same line, Acts' years left out."""

    def year(number: Column) -> Column:
        digits = F.regexp_extract(number, "^[0-9]+", 0)
        return (F.length(digits) == 4) & digits.cast("int").between(*P.ACT_YEARS)

    def named(lines: Column, label: str, act: str) -> Column:
        after = F.transform(lines, lambda x: F.regexp_extract(x, f"(?d){act}(.*)$", 1))
        numbers = F.flatten(F.transform(after, lambda x: F.regexp_extract_all(x, F.lit(P.SECTION_NUMBER), F.lit(0))))
        return F.transform(F.filter(numbers, lambda n: ~year(n)), lambda n: F.concat(F.lit(f"{label} "), n))

    def of(folded: Column) -> Column:
        by_act = bind(F.split(folded, "\n", -1), lambda lines: F.concat(*(named(lines, *act) for act in P.ACTS)))
        headed = F.regexp_extract_all(folded, F.lit(P.HEADED_SECTION), F.lit(1))
        return bind(by_act, lambda found: F.when(F.size(found) > 0, found).otherwise(headed))

    return F.array_distinct(bind(fold_digits(text), of))


def fir_fields(text: Column) -> Column:
    """Struct of the twelve header fields; absent ones are null, sections an empty list."""
    return bind(fold_digits(text), lambda folded: _fields(text, folded))


def _fields(text: Column, folded: Column) -> Column:
    number = strip_space(_found(folded, P.FIR_NUMBER))
    year = F.coalesce(_found(folded, P.YEAR), F.when(number.contains("/"), F.substring_index(number, "/", -1)))
    caption = F.regexp_replace(_value(text, P.COMPLAINANT), P.COMPLAINANT_CAPTION, "")
    place = F.coalesce(_found(text, P.PLACE_HINDI), _found(text, P.PLACE_ENGLISH))
    place = strip_space(F.regexp_replace(strip_class(place, P.VALUE_TRIM), P.PLACE_CAPTION, ""))
    incident = F.coalesce(_found(text, P.INCIDENT_HINDI), _found(text, P.INCIDENT_PROPERTY))
    return F.struct(
        number.alias("fir_number"), _value(text, P.DISTRICT).alias("district"),
        _value(text, P.POLICE_STATION).alias("police_station"), year.alias("year"),
        strip_space(_found(folded, P.DATE)).alias("registration_date"),
        registration_time(text).alias("registration_time"),
        strip_class(_found(text, P.INFORMATION_TYPE), r"[ !:,\-|.]").alias("type_of_information"),
        statute_sections(text).alias("ipc_sections"), _long(strip_space(caption)).alias("complainant"),
        strip_class(_found(text, P.ADDRESS), P.VALUE_TRIM).alias("address"),
        _long(place).alias("place_of_occurrence"),
        _long(strip_class(incident, P.VALUE_TRIM)).alias("incident_description"))
