"""Run statistics, per-file progress and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheaf.functions.paths import level
from sheaf.functions.reports import said_by_code
from sheaf.operators.contents import EXCLUDED, TOO_LARGE, UNREADABLE


def run_columns(blocked: bool = False) -> list[Column]:
    """The counters. A file in blocks counts at its first, which every file has."""
    file = F.col("block_no") == 0 if blocked else F.lit(True)

    def files(*statuses: str) -> Column:
        return F.count_if(file & F.col("status").isin(*statuses))

    return [
        F.count_if(file).alias("total_files"),
        (F.count_if(file) - files(EXCLUDED)).alias("processed_files"),
        files(EXCLUDED, TOO_LARGE).alias("skipped_files"),
        F.coalesce(F.sum("input_bytes"), F.lit(0)).alias("processed_bytes"),
        F.coalesce(F.sum("body_bytes"), F.lit(0)).alias("filtered_bytes"),
    ]


def run_stats(processed: DataFrame) -> DataFrame:
    """One row of counters over processed rows, of whole files or of blocks."""
    return processed.agg(*run_columns("block_no" in processed.columns))


def observed(processed: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The same counters, collected while another action (the sink) runs."""
    observation = Observation(name)
    counters = run_columns("block_no" in processed.columns)
    return processed.observe(observation, *counters), observation


def progress_by_file(processed: DataFrame) -> DataFrame:
    """Accepted bytes per file; block rows are summed."""
    if "block_no" in processed.columns:
        return processed.groupBy("path").agg(F.sum("input_bytes").alias("progress_bytes"))
    return processed.select("path", F.col("input_bytes").alias("progress_bytes"))


def listing_diagnostics(
    entries: DataFrame, max_depth: int | None = None, max_path_bytes: int | None = None
) -> DataFrame:
    """``(path, code, message)`` for entries that the listing's limits leave out."""
    code = F.lit(None).cast("string")
    if max_depth is not None:
        code = F.when(level(F.col("path")) >= max_depth, F.lit("depth_exceeded"))
    if max_path_bytes is not None:
        long = F.octet_length("path") >= max_path_bytes
        code = F.when(long, F.lit("path_too_long")).otherwise(code)
    found = entries.select("path", code.alias("code")).where("code is not null")
    return found.select("path", "code", said_by_code(F.col("code"), F.col("path")))


def content_diagnostics(processed: DataFrame) -> DataFrame:
    """The same for files whose content could not be taken; a reason found while reading is the
    code."""
    rows = processed.where(F.col("status").isin(TOO_LARGE, UNREADABLE))
    code = F.coalesce("code", "status") if "code" in processed.columns else F.col("status")
    found = rows.select("path", code.alias("code"))
    return found.select("path", "code", said_by_code(F.col("code"), F.col("path")))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("count"))
