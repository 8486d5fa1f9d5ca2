"""Summary statistics of a dataset: demographics, visits and turns, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clinical
from .dataset import converted


STATS = ("count", "mean", "median", "min", "max")


def _placed(counts: DataFrame, *figure: str) -> DataFrame:
    """counts (figure columns, value, n) with the places from and to that each value takes among all of its figure, and total, their number."""
    of = Window.partitionBy(*figure) if figure else Window.partitionBy(F.lit(0))
    return counts.withColumns({"to": F.sum("n").over(of.orderBy("value")), "total": F.sum("n").over(of)}).withColumn("from", F.col("to") - F.col("n") + 1)


def _figures(some: Column | None = None) -> Column:
    """struct<count, mean, median, min, max> of the values in _placed rows, of those for which some holds."""
    here = F.col("value").isNotNull() if some is None else some & F.col("value").isNotNull()
    of = lambda c: F.when(here, c)
    middle = lambda at: F.max(of(F.when((F.col("from") <= at) & (at <= F.col("to")), F.col("value"))))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    n, value = F.coalesce(F.sum(of(F.col("n"))), F.lit(0)), F.col("value")
    parts = n, F.round(F.sum(of(value * F.col("n"))) / F.nullif(n, F.lit(0)), 2), F.round((middle(low) + middle(high)) / 2, 2), F.min(of(value)), F.max(of(value))
    return F.struct(*[c.alias(name) for c, name in zip(parts, STATS)])


def safe_stats(df: DataFrame, value: str | Column) -> DataFrame:
    """One row: count, mean and median to two places, min and max; 0 and nulls without a value.

    Halves are rounded away from zero. The median is exact, and comes from how often each value occurs: counts are
    merged in all tasks, and one then sees each distinct value once. The values are whole numbers of something.
    """
    c = F.col(value) if isinstance(value, str) else value
    counts = df.select(c.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    return _placed(counts).agg(_figures().alias("s")).select("s.*")


def distribution(df: DataFrame, value: Column, missing: str | None = None) -> DataFrame:
    """key and n: rows by value. Nulls count as missing, or not at all."""
    key = F.coalesce(value, F.lit(missing)) if missing else value
    return df.select(key.cast("string").alias("key")).where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"))


def patients_flat(patients: DataFrame) -> DataFrame:
    return patients.select("patient_id", "gender", "age", F.size(F.coalesce("keywords", F.array())).alias("n_keywords"), F.size(F.coalesce("scales", F.array())).alias("n_scales"), F.size(F.coalesce("visits", F.array())).alias("n_visits"))


def visits_flat(patients: DataFrame) -> DataFrame:
    v = patients.select("patient_id", F.explode("visits").alias("v"))
    return v.select("patient_id", "v.visit_id", F.size(F.coalesce("v.dialogue.turns", F.array())).alias("n_turns"))


def turns_flat(patients: DataFrame) -> DataFrame:
    v = patients.select("patient_id", F.explode("visits").alias("v")).select("patient_id", "v.visit_id", F.explode("v.dialogue.turns").alias("t"))
    return v.select("patient_id", "visit_id", "t.role", "t.text")


def scales_flat(patients: DataFrame) -> DataFrame:
    s = patients.select("patient_id", F.explode("scales").alias("s"))
    return s.select("patient_id", F.col("s.GAD-7.total").alias("gad7_total"), F.col("s.PHQ-9.total").alias("phq9_total"))


def tallied(patients: DataFrame) -> DataFrame:
    """figure, key, value, n: how often each key or value of each of the summary's figures occurs, from one pass over patients.

    A patient's row becomes a row for each figure that it, its visits, turns and scale records have; these are counted
    before they are shuffled. What remains is a row for each value: an age, a number of turns, a role.
    """
    some = lambda c: F.size(F.coalesce(c, F.array())) > 0
    key = lambda figure, c: F.struct(F.lit(figure).alias("figure"), c.cast("string").alias("key"), F.lit(None).cast("long").alias("value"))
    number = lambda figure, c: F.struct(F.lit(figure).alias("figure"), F.lit(None).cast("string").alias("key"), c.cast("long").alias("value"))
    visits, scales = F.coalesce("visits", F.array()), F.coalesce("scales", F.array())
    turns = lambda v: F.coalesce(v["dialogue"]["turns"], F.array())
    own = F.array(
        key("patients", F.lit("")), key("keywords", F.when(some("keywords"), "")), key("scales", F.when(some("scales"), "")),
        key("gender", F.coalesce(F.nullif("gender", F.lit("")), F.lit("unknown"))), number("age", F.col("age")), key("age_band", clinical.age_band(F.col("age"))), number("visits", F.size(visits)),
    )
    roles = F.transform(F.flatten(F.transform(visits, turns)), lambda t: key("role", F.coalesce(t["role"], F.lit("other"))))
    gad7, phq9 = (lambda s: s["GAD-7"]["total"]), (lambda s: s["PHQ-9"]["total"])
    of_scales = (lambda s: number("gad7", gad7(s))), (lambda s: key("gad7_severity", clinical.gad7_severity(gad7(s)))), (lambda s: number("phq9", phq9(s))), (lambda s: key("phq9_severity", clinical.phq9_severity(phq9(s))))
    rows = F.concat(own, F.transform(visits, lambda v: number("turns", F.size(turns(v)))), roles, *[F.transform(scales, f) for f in of_scales])
    flat = converted(patients).select(F.inline(rows)).where("key IS NOT NULL OR value IS NOT NULL")
    return flat.groupBy("figure", "key", "value").agg(F.count("*").alias("n"))


def summary(patients: DataFrame) -> DataFrame:
    """One row of nested statistics; failed files are no patients. All figures come from one pass over patients, see tallied."""
    return figures(tallied(patients))


def figures(tallies: DataFrame) -> DataFrame:
    """The summary of tallied rows, those of several builds or batches as well: what each has adds up."""
    tallies = tallies.groupBy("figure", "key", "value").agg(F.sum("n").alias("n"))
    is_a = lambda figure: F.col("figure") == figure
    many = lambda figure: F.coalesce(F.sum(F.when(is_a(figure), F.col("n"))), F.lit(0))
    by_key = lambda figure: F.map_from_entries(F.sort_array(F.collect_list(F.when(is_a(figure), F.struct("key", "n")))))  # noqa: E731  a row for each key
    return _placed(tallies, "figure").agg(
        F.struct(many("patients").alias("patient_count"), many("keywords").alias("patients_with_keywords"), many("scales").alias("patients_with_scales")).alias("base"),
        F.struct(by_key("gender").alias("gender_distribution"), F.struct(_figures(is_a("age")).alias("age_stats"), by_key("age_band").alias("age_buckets")).alias("age_distribution")).alias("demographics"),
        F.struct(_figures(is_a("visits")).alias("visits_per_patient"), _figures(is_a("turns")).alias("turns_per_visit"), by_key("role").alias("turn_role_distribution")).alias("visits_and_dialogue"),
        F.struct(_figures(is_a("gad7")).alias("gad7_total"), by_key("gad7_severity").alias("gad7_severity_distribution"), _figures(is_a("phq9")).alias("phq9_total"), by_key("phq9_severity").alias("phq9_severity_distribution")).alias("scales"),
    )


#: What each statistic is taken of, by the path of its group in the summary.
_MEASURED = {
    "demographics.age_distribution.age_stats": "valid ages", "visits_and_dialogue.visits_per_patient": "visits of a patient",
    "visits_and_dialogue.turns_per_visit": "turns of a visit", "scales.gad7_total": "valid GAD-7 totals", "scales.phq9_total": "valid PHQ-9 totals",
}
_COUNTED = {
    "base.patient_count": "patients", "base.patients_with_keywords": "patients with a keyword", "base.patients_with_scales": "patients with a scale record",
    "demographics.gender_distribution": "patients by gender, unknown where missing", "demographics.age_distribution.age_buckets": "patients by age band, unknown where missing",
    "visits_and_dialogue.turn_role_distribution": "turns by role", "scales.gad7_severity_distribution": "GAD-7 totals by severity", "scales.phq9_severity_distribution": "PHQ-9 totals by severity",
}
DEFINITIONS = _COUNTED | {f"{path}.{stat}": f"{stat} of {what}" for path, what in _MEASURED.items() for stat in ("count", "mean", "median", "min", "max")}


def explained(summary: DataFrame) -> DataFrame:
    """metric, definition, value and counts: each of a summary's 33 figures with its meaning. A distribution has its counts as key=n, joined by commas, any other figure a value."""
    rows = []
    for metric, definition in sorted(DEFINITIONS.items()):
        spread = metric in _COUNTED and not metric.startswith("base.")
        found = F.col(metric)
        counts = F.array_join(F.transform(F.array_sort(F.map_entries(found)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",") if spread else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(metric).alias("metric"), F.lit(definition).alias("definition"), (F.lit(None) if spread else found).cast("double").alias("value"), counts.alias("counts")))
    return summary.select(F.inline(F.array(*rows)))


def role_profile(turns: DataFrame, key: str) -> DataFrame:
    """role, n_turns, n_patients, n_chars, last_turn and median_chars of turns (key, turn, role, text): what each role says."""
    n = F.length("text")
    return turns.groupBy("role").agg(
        F.count("*").alias("n_turns"), F.count_distinct(key).alias("n_patients"), F.sum(n).cast("long").alias("n_chars"), F.max("turn").alias("last_turn"), F.round(F.median(n), 2).alias("median_chars")
    )
