"""PDBQT files with many models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.text import lines
from molweave.sources.records import read_records

NAME_MARK = "REMARK  Name = "
END_MARK = "ENDMDL"
#: what a record without lines consists of: the rest of the end mark's line, MODEL lines, a last line break
BLANK = r"(?s)\A(?:[ ]*(?:\n|\z)|ENDMDL[^\n]*(?:\n|\z))?(?:MODEL[^\n]*(?:\n|\z))*\z"


def _model_lines(value: Column) -> Column:
    """Lines of one record without ``MODEL`` lines and without the rest of the ``ENDMDL`` line."""
    every = F.filter(
        lines(value),
        lambda line, i: ~line.startswith("MODEL") & ~((i == 0) & (F.trim(line) == "")) & ~((i == 0) & line.startswith(END_MARK)),
    )

    def cut(kept: Column) -> Column:
        # a final line break leaves one empty piece, which is no line
        last_empty = F.get(kept, F.size(kept) - 1) == ""
        return F.when((F.size(kept) > 0) & last_empty, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    # a one-element transform binds the lines, which are cut once however often they are used
    return F.transform(F.array(every), cut)[0]


def models_in(records: DataFrame) -> DataFrame:
    """``records`` whose ``value`` is the text between two end marks, with ``ligand`` and ``lines`` instead. Empty models go."""
    records = records.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    named = F.filter("lines", lambda line: line.startswith(NAME_MARK) & (F.length(line) > len(NAME_MARK)))
    name = F.substring(F.try_element_at(named, F.lit(-1)), len(NAME_MARK) + 1, 2147483647)
    # a text with anything but blank lines and MODEL lines has lines; asking the text keeps the split out of the filter
    full = records.where(~F.col("value").rlike(BLANK)).withColumn("lines", _model_lines(F.col("value")))
    return full.withColumn("ligand", F.coalesce(name, F.lit(""))).drop("value")


def read_pdbqt(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per model: place columns, ``ligand`` and ``lines``. Empty models are dropped."""
    # a file may begin with the end mark, whose line is no line of a model either
    models = models_in(read_records(spark, path, "\n" + END_MARK))
    return models.select("src_file", "block_start", F.monotonically_increasing_id().alias("rec_id"), "ligand", "lines")
