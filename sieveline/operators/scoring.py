"""Scores: a weighted sum with a cap, bands of severity, reasons, exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Weights of findings; any other code weighs DEFAULT_WEIGHT.
WEIGHTS = {
    "exe_in_zip": 40, "zip_vba_project": 35, "zip_double_extension": 25, "zip_long_name": 10, "zip_nul_byte": 25, "pdf_token": 20, "double_extension": 15, "pe_header": 50,
    "office_macro_extension": 30, "office_macro_container": 45, "image_trailing_data": 15, "url_suspicious": 10, "url": 5,
    "pdf_auto_actions": 40, "pdf_javascript": 35, "pdf_embedded_files": 20, "pdf_external_links": 10, "office_vba_project": 45, "office_auto_actions_hint": 15,
    "zip_susp_executable": 40, "zip_nested_archive": 20, "png_appended_data": 15, "jpeg_appended_data": 15, "image_large_exif": 10,
}
DEFAULT_WEIGHT, CAP = 5, 100
# Lowest score of each band, and what it means as an exit code.
BANDS = ((80, "High"), (50, "Suspicious"), (20, "Caution"), (0, "Safe"))
EXIT_CODES = {"Safe": 0, "Caution": 1, "Suspicious": 1, "High": 2}
EXIT_ERROR = 3


def weight(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.lit(DEFAULT_WEIGHT))


def score(issues: Column) -> Column:
    return F.least(F.aggregate(issues, F.lit(0), lambda total, i: total + weight(i["code"])), F.lit(CAP))


def severity(points: Column) -> Column:
    out = F.lit("Unknown")
    for low, label in reversed(BANDS):
        out = F.when(points >= low, label).otherwise(out)
    return out


def reasons(issues: Column) -> Column:
    return F.transform(issues, lambda i: F.concat(i["code"], F.lit(": +"), weight(i["code"]).cast("string")))


def weight_table(spark: SparkSession) -> DataFrame:
    """The weights as a table, for joins by code (24 rows, so it can always be broadcast)."""
    return spark.createDataFrame(list(WEIGHTS.items()), "code string, weight int")


def exit_code(results: DataFrame) -> DataFrame:
    """One row: the highest exit code, 0 without rows; an error outranks all severities."""
    code = F.lit(0)
    for label, value in EXIT_CODES.items():
        code = F.when(F.col("severity") == label, value).otherwise(code)
    code = F.greatest(code, F.when(F.coalesce(F.col("error"), F.lit("")) != "", EXIT_ERROR).otherwise(0))
    return results.agg(F.coalesce(F.max(code), F.lit(0)).alias("exit_code"))
