"""Docking logs: one small text per ligand, parsed row by row, so batch and stream share the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.text import lenient_double, path_parts

LOG_SUFFIX = "_out"


# fixed patterns of the log format; words are separated by blanks only
_AFTER_HEADER = r"(?s)(?:^|\n)mode[^\n]*\n(.*)"
# a line whose first word starts with a digit but that has not exactly four words, and all after it
_FROM_BAD_ROW = r"(?s)(?:^|\n) *[0-9][^ \n]*(?:(?: +[^ \n]+){4}[^\n]*|(?: +[^ \n]+){0,2} *(?=\n|$)).*"
_ROW = r"(?m)^ *[0-9][^ \n]* +([^ \n]+) +([^ \n]+) +([^ \n]+) *$"
_DONE = r"(?m)^ *(?![0-9 \n])[^\n]*done"


def parse_logs(df: DataFrame, text: str = "value") -> DataFrame:
    """Add ``modes``, ``finished`` and ``ok`` to rows that hold one log text each.

    The table begins after the first line starting with ``mode``. A line whose first word starts with
    a digit is a result row and must have four words; the first one that has not ends the reading and
    puts the log in error, rows before it are kept. ``done`` on any other line marks a finished run.
    """
    column = lambda i: F.regexp_extract_all("_read", F.lit(_ROW), F.lit(i))
    modes = F.transform(
        "_energy",
        lambda energy, i: F.struct(
            (i + 1).alias("mode"),
            lenient_double(energy).alias("energy"),
            lenient_double(F.get("_lower", i)).alias("rmsd_lb"),
            lenient_double(F.get("_upper", i)).alias("rmsd_ub"),
        ),
    )
    # one step per column, so that no pattern is searched twice
    return (
        df.withColumn("_table", F.regexp_extract(F.replace(text, F.lit("\r\n"), F.lit("\n")), _AFTER_HEADER, 1))
        .withColumn("_read", F.regexp_replace("_table", _FROM_BAD_ROW, ""))
        .withColumns({"_energy": column(1), "_lower": column(2), "_upper": column(3)})
        .withColumns(
            {
                "modes": modes,
                "finished": F.col("_read").rlike(_DONE),
                "ok": (F.col("_read") == F.col("_table")) & (F.size("_energy") > 0),
            }
        )
        .drop("_table", "_read", "_energy", "_lower", "_upper")
    )


def ligand_of_path(path: Column) -> Column:
    return F.regexp_replace(path_parts(path)["stem"], LOG_SUFFIX + "$", "")


def read_docking_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``ligand, modes, finished, ok`` for a folder of logs, one ligand per file."""
    files = (
        spark.read.text(path, wholetext=True)
        .select(ligand_of_path(F.col("_metadata.file_path")).alias("ligand"), "value")
    )
    return parse_logs(files).drop("value")


def mode_rows(logs: DataFrame) -> DataFrame:
    """One row per ligand and mode."""
    # the outer form spares a filter that would parse every log once more
    return logs.select("ligand", F.inline_outer("modes")).where("mode is not null")
