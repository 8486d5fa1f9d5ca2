"""Scalar rules of the data model: roles, titles, identifiers, age bands and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract, plain_digits, strip, to_int

#: A speaker marker at a line's start: label, then text.
MARKER = r"(?dU)^[\[【]([^\]】]+)[\]】][:：]?\s*(.*)$"


def role_of(label: Column) -> Column:
    """doctor, caregiver, patient or other, the first rule that holds."""
    return (
        F.when(label.startswith("D") | label.contains("医生"), "doctor")
        .when(label.contains("家属") | label.contains("家长"), "caregiver")
        .when(label.startswith("P") | label.contains("患者"), "patient")
        .otherwise("other")
    )


def speaker_note(label: Column) -> Column:
    """What the label's first full-width parentheses hold; null without both or when empty."""
    inner = F.substring_index(F.substring(label, F.instr(label, "（") + 1, F.length(label)), "）", 1)
    return F.when(label.contains("（") & label.contains("）"), F.nullif(inner, F.lit("")))


def title(stem: Column) -> Column:
    """struct<ids, name, gender, age> of a file stem: ids joined by full-width commas, a name, maybe gender and age.

    Null where the stem doesn't begin with an id and something more.
    """
    head = r"(?dU)^(\d+(?:，\d+)*)\s*(.+)$"
    tail = strip(F.regexp_extract(stem, head, 2))
    aged, gendered = r"(?dU)^(.+?)\s+(男|女)\s+(\d+)\s*岁?$", r"(?dU)^(.+?)\s+(男|女)\s*$"
    either = lambda group: F.coalesce(extract(tail, aged, group), extract(tail, gendered, group))
    ids = F.transform(F.split(F.regexp_extract(stem, head, 1), "，"), to_int)
    found = F.struct(ids.alias("ids"), F.coalesce(strip(either(1)), tail).alias("name"), either(2).alias("gender"), to_int(F.regexp_extract(tail, aged, 3)).alias("age"))
    return F.when(F.coalesce(stem.rlike(head), F.lit(False)), found)


def prefix_ids(stem: Column) -> Column:
    """The ids that a stem begins with, in the audit's wider form: three separators, spaces around. Empty if none."""
    run = r"(?U)^\s*(\d+(?:\s*[，,、]\s*\d+)*)"
    parts = F.split(F.regexp_replace(F.regexp_extract(stem, run, 1), r"(?U)\s", ""), "[，,、]")
    return F.filter(F.transform(F.filter(parts, lambda x: x != ""), to_int), lambda x: x.isNotNull())


def age_in_stem(stem: Column) -> Column:
    """The one to three digits before the first 岁."""
    return to_int(F.regexp_extract(stem, r"(?U)(\d{1,3})\s*岁", 1))


def patient_id(number: Column) -> Column:
    return F.format_string("P-%06d", number)


def visit_id(number: Column, visit_no: Column) -> Column:
    return F.format_string("V-%06d-%d", number, visit_no)


def numeric_suffix(identifier: Column) -> Column:
    """The number after the last hyphen, 0 if there is none: the sort key of patients."""
    return F.coalesce(plain_digits(F.element_at(F.split(identifier, "-"), -1)).try_cast("long"), F.lit(0))


def banded(value: Column, bands: tuple[tuple[int, str], ...], beyond: str) -> Column:
    """The name of the first band whose upper bound the value doesn't pass."""
    out = F.when(value <= bands[0][0], bands[0][1])
    for most, name in bands[1:]:
        out = out.when(value <= most, name)
    return out.when(value.isNotNull(), beyond)


#: Upper bounds and names of the bands; fixed values.
AGE_BANDS = ((12, "0-12"), (17, "13-17"), (44, "18-44"), (59, "45-59"))
GAD7_BANDS = ((4, "minimal"), (9, "mild"), (14, "moderate"))
PHQ9_BANDS = ((4, "minimal"), (9, "mild"), (14, "moderate"), (19, "moderately_severe"))


def age_band(age: Column) -> Column:
    return F.coalesce(banded(age, AGE_BANDS, "60+"), F.lit("unknown"))


def gad7_severity(total: Column) -> Column:
    """Null for a null total."""
    return banded(total, GAD7_BANDS, "severe")


def phq9_severity(total: Column) -> Column:
    """Null for a null total."""
    return banded(total, PHQ9_BANDS, "severe")
