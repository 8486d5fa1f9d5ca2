"""The whole build, from folders of dialogues and a score sheet to patients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical
from ..operators import dataset, dialogue, scales
from ..sources import files


def build(text_rows: DataFrame, sheet: DataFrame | None) -> DataFrame:
    """Patients of files (file_id, path, stem, text, error) and a wide score sheet. Faults are rows with an error.

    Errors: bad_title, bad_utf8, bad_item, no_id_column where the sheet lacks its ids, no_column where it lacks an item. The sheet's rows meet the
    files by id; Spark broadcasts them while their measured size allows, and shuffles both beyond.
    """
    titled = text_rows.withColumn("meta", clinical.title(F.col("stem")))
    titled = titled.withColumn("error", F.coalesce("error", F.when(F.col("meta").isNull(), "bad_title")))
    parsed = dialogue.parse(titled)
    try:
        rows = scales.scale_rows(sheet) if sheet is not None else None
        fault = None
    except scales.NoIdColumn:
        rows, fault = None, "no_id_column"
    except KeyError:
        rows, fault = None, "no_column"
    if rows is None:
        found = parsed.withColumns({"scales": F.array().cast(scales.RECORDS), "scale_error": F.lit(fault).cast("string")})
    else:
        found = parsed.join(scales.lookup(titled.select("file_id", F.col("meta.ids").alias("ids")), rows), "file_id", "left")
    return dataset.assemble(found.withColumn("error", F.coalesce("error", "scale_error")))


def build_folder(spark: SparkSession, folders: str | list[str], sheet_path: str | None = None) -> DataFrame:
    return build(files.text_files(spark, folders), files.sheet(spark, sheet_path) if sheet_path else None)
