"""Atom tables that lie in space as they are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.geometry import AXES, Box

#: cells per axis are 2 to this power
CURVE_BITS = 16
#: bytes of a row group, the smallest part that a reader can leave out
GROUP_BYTES = 8 << 20


def curve_key(low: dict[str, float], high: dict[str, float], bits: int = CURVE_BITS) -> Column:
    """Place of ``x, y, z`` along a space-filling curve through the cells of a box: the axes' cell numbers, bit by bit in turn."""
    cells = []
    for axis in AXES:
        width = (high[axis] - low[axis]) or 1.0
        cell = F.floor((F.col(axis) - low[axis]) / width * (1 << bits))
        cells.append(F.greatest(F.lit(0), F.least(cell, F.lit((1 << bits) - 1))).cast("bigint"))
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for k, cell in enumerate(cells):
            one = F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("bigint"))
            key = key.bitwiseOR(F.shiftleft(one, 3 * bit + k))
    return key


def write_atom_table(atoms: DataFrame, path: str, group_bytes: int = GROUP_BYTES) -> None:
    """Store atoms along the curve, so that every row group holds a small part of space.

    The smallest and largest coordinates of a row group are part of the file, and a box filter reads only the groups
    that can hold atoms of the box. Atoms without a coordinate come first.
    """
    ends = atoms.agg(*(f(c).cast("double").alias(f"{n}{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max)))).first()
    low, high = ({c: ends[f"{n}{c}"] or 0.0 for c in AXES} for n in ("min", "max"))
    key = curve_key(low, high)
    n = int(atoms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = atoms.withColumn("_key", key).repartitionByRange(n, "_key").sortWithinPartitions("_key").drop("_key")
    placed.write.option("parquet.block.size", group_bytes).parquet(path)


def read_box(spark: SparkSession, path: str, box: Box) -> DataFrame:
    """Atoms of a stored table inside a box; the filter reaches the scan and leaves row groups out."""
    return spark.read.parquet(path).where(box.contains())
