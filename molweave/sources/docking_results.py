"""Docking result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.text import decimal_comma, words
from molweave.operators.ranking import last_by_name
from molweave.sources.records import read_records

SCHEMA = "ligand string, energy double"
LIGAND_HEADERS = ("Ligand", "Name")
ENERGY_HEADER = "1_Energy"


def read_docking_results(spark: SparkSession, path: str) -> DataFrame:
    """``ligand, energy``; a table without the needed header gives no rows, the last duplicate wins.

    ``Name`` is accepted for ``Ligand``: it is what the docking summary itself writes.
    """
    text = read_records(spark, path)
    head = text.select("value").head(1)
    header = head[0]["value"].split() if head else []
    ligand = next((h for h in LIGAND_HEADERS if h in header), None)
    if ligand is None or ENERGY_HEADER not in header:
        return spark.createDataFrame([], SCHEMA)
    rows = (
        text.where(F.col("value") != head[0]["value"])
        .withColumn("t", words(F.col("value")))
        .select(
            F.get("t", F.lit(header.index(ligand))).alias("ligand"),
            decimal_comma(F.get("t", F.lit(header.index(ENERGY_HEADER)))).alias("energy"),
            F.struct("src_file", "block_start", "rec_id").alias("ord"),
        )
        .where(F.col("ligand") != "")
    )
    return last_by_name(rows, "ligand").select("ligand", "energy")
