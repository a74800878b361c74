"""Boxes, distances and grid lines as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from molweave.constants import BOX_CENTRE, BOX_SIZE

AXES = ("x", "y", "z")


@dataclass(frozen=True)
class Box:
    """Axis-aligned box given by centre and size."""

    centre: tuple[float, float, float] = BOX_CENTRE
    size: tuple[float, float, float] = BOX_SIZE

    def low(self, axis: str) -> float:
        i = AXES.index(axis)
        return self.centre[i] - self.size[i] / 2

    def high(self, axis: str) -> float:
        i = AXES.index(axis)
        return self.centre[i] + self.size[i] / 2

    def contains(self, x: str = "x", y: str = "y", z: str = "z") -> Column:
        """Inclusive on both ends; plain range predicates, so they reach the parquet scan."""
        inside = F.lit(True)
        for axis, column in zip(AXES, (x, y, z)):
            inside = inside & F.col(column).between(self.low(axis), self.high(axis))
        return inside


def distance(a: str | None, b: str | None) -> Column:
    """Euclidean distance of two points given as aliases with x, y, z."""
    squares = [F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in AXES]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def surface_gap(a: str, b: str) -> Column:
    """Distance between two atom surfaces."""
    return distance(a, b) - F.col(f"{a}.radius") - F.col(f"{b}.radius")


def crosses_line(first: str, second: str, at_first: Column, at_second: Column) -> Column:
    """Does the axis-parallel line at (``at_first``, ``at_second``) pass the atom's square shadow?"""
    radius = F.col("radius")
    return at_first.between(F.col(first) - radius, F.col(first) + radius) & at_second.between(
        F.col(second) - radius, F.col(second) + radius
    )


def to_distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity
