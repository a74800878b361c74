"""XYZ files: a count line, a title line, then one atom per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.chem import element_of_type, vdw_radius
from molweave.functions.text import lines, words


def parse_xyz(files: DataFrame, text: str = "value") -> DataFrame:
    """Atoms of rows that hold one XYZ text each. Residue is ``LIG``, serial and charge are 0."""
    keep = [c for c in files.columns if c != text]
    kind = F.get("t", F.lit(0))
    coordinates = {c: F.get("t", F.lit(i)).try_cast("double") for i, c in enumerate("xyz", 1)}
    return (
        files.select(*keep, F.posexplode(lines(F.col(text))).alias("line_no", "line"))
        .where(F.col("line_no") >= 2)
        .withColumn("t", words(F.col("line")))
        .select(
            *keep,
            "line_no",
            F.lit(0).alias("serial"),
            kind.alias("atom_name"),
            *(value.alias(c) for c, value in coordinates.items()),
            kind.alias("sybyl_type"),
            F.lit(0).alias("resnum"),
            F.lit("LIG").alias("resname"),
            F.lit(0.0).alias("charge"),
            element_of_type(kind).alias("element"),
            vdw_radius(element_of_type(kind)).alias("radius"),
        )
        .dropna(subset=["x", "y", "z"])
    )


def read_xyz(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Atoms of XYZ files, one molecule per file."""
    files = spark.read.text(path, wholetext=True)
    return parse_xyz(files.select(F.col("_metadata.file_path").alias("src_file"), "value"))
