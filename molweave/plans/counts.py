"""Counts along a run, taken by the passes that run anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from molweave.constants import MIN_BOX_ATOMS


class RunCounts:
    """Numbers that are observed while tables are written; nothing is read again for them."""

    def __init__(self):
        self._watched: list[Observation] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        """``df``, whose next complete pass leaves ``counts`` behind."""
        seen = Observation()
        self._watched.append(seen)
        return df.observe(seen, *(value.alias(name) for name, value in counts.items()))

    def values(self) -> dict[str, int]:
        """All counts. Every watched table must have been written."""
        found: dict[str, int] = {}
        for seen in self._watched:
            found |= seen.get
        if "box_atoms" in found:
            found["too_few"] = found["box_atoms"] < MIN_BOX_ATOMS
        return found

    def table(self, spark: SparkSession) -> DataFrame:
        """One row of all counts."""
        found = self.values()
        kind = lambda v: "boolean" if isinstance(v, bool) else "bigint"
        return spark.createDataFrame([tuple(found.values())], ", ".join(f"{n} {kind(v)}" for n, v in found.items()))
