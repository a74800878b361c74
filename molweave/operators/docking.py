"""Docking output tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.constants import SUMMARY_MODES
from molweave.operators.ranking import first_per_group


def docking_summary(
    logs: DataFrame, modes: int = SUMMARY_MODES, keep: Sequence[str] = ()
) -> DataFrame:
    """One wide row per ligand: the best energy, then energy and both RMSD of the further modes.

    The modes of a ligand are one array in one row, so the table is a projection without a shuffle; a
    missing mode is null.
    """
    mode = lambda i: F.get("modes", F.lit(i - 1))
    columns = [F.col("ligand").alias("Name"), mode(1)["energy"].alias("1_Energy")]
    for i in range(2, modes + 1):
        columns += [
            mode(i)["energy"].alias(f"{i}_Energy"),
            mode(i)["rmsd_lb"].alias(f"{i}_RMSDLB"),
            mode(i)["rmsd_ub"].alias(f"{i}_RMSDRB"),
        ]
    return logs.select(*columns, *keep)


def first_pose(models: DataFrame, by: str = "ligand", order: str = "model_no") -> DataFrame:
    """Only the first model of every ligand."""
    return first_per_group(models, [by], [F.asc(order)], 1).drop("rank")
