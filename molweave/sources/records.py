"""Shared reading of record-oriented text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molweave.session import materialise


def read_records(
    spark: SparkSession, path: str | list[str], separator: str | None = None
) -> DataFrame:
    """Text records with their place: ``src_file``, ``block_start``, ``rec_id``, ``value``.

    Files stay splittable: a record belongs to the split in which it starts, whatever the separator.
    ``rec_id`` grows within a split, and splits are named by file and offset, so the three columns
    together give file order without a sort.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("rec_id"),
        "value",
    )


ORDER = ("src_file", "block_start", "rec_id")


def file_order(df: DataFrame, column: str = "ord") -> DataFrame:
    """Add a dense number in file order (by file name, then position), starting at 0.

    Only one row per input split goes through a window; the records themselves are not sorted. They are
    written once, so that splits and records come from the same read of the files: a second one may be
    cut into other splits.
    """
    df = materialise(df, "records")
    # record numbers are consecutive inside a split as long as no rows were filtered in between
    splits = df.groupBy("src_file", "block_start").agg(
        F.min("rec_id").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.orderBy("src_file", "block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "src_file",
        "block_start",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        df.join(splits, ["src_file", "block_start"])
        .withColumn(column, F.col("rec_id") + F.col("_shift"))
        .drop("_shift")
    )


def with_place(df: DataFrame, column: str = "ord") -> DataFrame:
    """Add the place in the files as an orderable value. Costs nothing, where :func:`file_order` reads
    the files once more for a dense number."""
    return df.withColumn(column, F.struct(*ORDER))


def first_records(df: DataFrame, limit: int) -> DataFrame:
    """At most the first ``limit`` records in file order."""
    return df.orderBy(*ORDER).limit(limit)


def skip_records(df: DataFrame, skipped: int) -> DataFrame:
    """All but the first ``skipped`` records in file order."""
    return file_order(df, "_ord").where(F.col("_ord") >= skipped).drop("_ord")
