"""Questionnaire scores: a wide sheet to scale records, and their lookup by a file's ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_digits

#: The sheet's id column and what the items' columns begin with after their number; fixed values.
ID_COLUMN, ITEM_PHRASE = "序号", "在过去2个星期"
SCALES = {"GAD-7": ("G", 7), "PHQ-9": ("P", 9)}


#: A patient's scale records.
RECORDS = "array<struct<respondent_role:string,`GAD-7`:struct<items:array<int>,total:int>,`PHQ-9`:struct<items:array<int>,total:int>>>"


class NoIdColumn(KeyError):
    """The sheet has no column of ids."""


def item_columns(columns: list[str], letter: str, n: int) -> list[str]:
    """The first column for each item, by prefix; KeyError for one that is missing."""
    found = [next((c for c in columns if c.startswith(f"{letter}{i}. {ITEM_PHRASE}")), None) for i in range(1, n + 1)]
    if None in found:
        raise KeyError(f"no column for item {letter}{found.index(None) + 1}")
    return found


def _whole(c: Column) -> Column:
    """A number cut to an int; null for anything else."""
    number = plain_digits(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 2147483648.0), number.cast("int"))


def item_sum(items: Column) -> Column:
    """The sum of an array of items; null if one of them is."""
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def scale_rows(sheet: DataFrame, id_column: str = ID_COLUMN) -> DataFrame:
    """row_no, respondent_id, respondent_role, gad7_items, gad7_total, phq9_items, phq9_total, error of each sheet row.

    The columns are resolved once, on the driver. row_no rises in the sheet's order. A row with an item that is no
    number has the error bad_item and null totals.
    """
    if id_column not in sheet.columns:
        raise NoIdColumn(id_column)
    by_name = lambda name: F.col("`" + name.replace("`", "``") + "`")
    cols = {}
    for (scale, (letter, n)), name in zip(SCALES.items(), ("gad7", "phq9")):
        items = F.array(*[_whole(by_name(c)) for c in item_columns(sheet.columns, letter, n)])
        cols |= {f"{name}_items": items, f"{name}_total": item_sum(items)}
    rows = sheet.select(F.monotonically_increasing_id().alias("row_no"), _whole(by_name(id_column)).alias("respondent_id"), F.lit("self").alias("respondent_role"), *[c.alias(n) for n, c in cols.items()])
    bad = F.col("gad7_total").isNull() | F.col("phq9_total").isNull()
    return rows.withColumn("error", F.when(bad, "bad_item"))


def lookup(files: DataFrame, scales: DataFrame, key: str = "file_id", ids: str = "ids") -> DataFrame:
    """key, scales (records in sheet order, empty if none) and scale_error of every file; an id that a file repeats counts once.

    Both sides meet by id; a file whose ids match a bad row has the error bad_item and no records.
    """
    wanted = files.select(F.col(key).alias("k"), F.explode(F.array_distinct(ids)).alias("respondent_id"))
    record = F.struct("row_no", F.struct("respondent_role", F.struct(F.col("gad7_items").alias("items"), F.col("gad7_total").alias("total")).alias("GAD-7"), F.struct(F.col("phq9_items").alias("items"), F.col("phq9_total").alias("total")).alias("PHQ-9")).alias("record"))
    found = wanted.join(scales, "respondent_id").groupBy("k").agg(F.sort_array(F.collect_list(record)).alias("x"), F.max("error").alias("scale_error"))
    found = found.select("k", F.when(F.col("scale_error").isNull(), F.transform("x", lambda x: x["record"])).alias("scales"), "scale_error")
    kind = found.schema["scales"].dataType
    joined = files.select(F.col(key).alias("k")).join(found, "k", "left")
    return joined.select(F.col("k").alias(key), F.coalesce("scales", F.array().cast(kind)).alias("scales"), "scale_error")
