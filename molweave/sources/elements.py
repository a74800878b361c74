"""Chemical elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.constants import ELEMENTS_TSV
from molweave.functions.text import ascii_lower, lenient_double, lenient_int


def element_lines(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(ELEMENTS_TSV.splitlines()))
    return spark.createDataFrame(rows, "ord long, line string")


def _parsed(lines: DataFrame) -> DataFrame:
    t = F.split("line", "\t")
    return lines.select(
        "ord",
        t[0].alias("name"),
        ascii_lower(t[1]).alias("symbol"),
        lenient_int(t[2]).alias("z"),
        lenient_double(t[3]).alias("mass"),
    )


def load_elements(spark: SparkSession, lines: DataFrame | None = None) -> DataFrame:
    """``name, symbol, z, mass`` keyed by lower-case symbol; the first entry of a symbol is kept.

    ``lines`` (``ord, line``) replaces the built-in table of 109 elements.
    """
    parsed = _parsed(element_lines(spark) if lines is None else lines)
    first = parsed.groupBy("symbol").agg(F.min(F.struct("ord", "name", "z", "mass")).alias("e"))
    return first.select("e.name", "symbol", "e.z", "e.mass")


def repeated_elements(lines: DataFrame) -> DataFrame:
    """Symbols that occur more than once."""
    counts = _parsed(lines).groupBy("symbol").agg(F.count("*").alias("entries"))
    return counts.where("entries > 1")
