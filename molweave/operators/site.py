"""Binding-site atoms: cavity sweep, selection and bit numbering.

The sweep follows axis-parallel grid lines through the box. For each axis and each outer coordinate
there are four walks (two inner axes, forwards and backwards). A walk visits its lines in order and on
each line the atoms whose square shadow the line passes, in sort order. Two atoms met one after the
other with a gap of at least the cavity size between them gain 1 each; an atom without a predecessor
loses the corner penalty; after every line the atom met last loses it too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from molweave.constants import CAVITY_GAPS, CORNER_PENALTY, GRID_STEP, SITE_PERCENT
from molweave.functions.geometry import AXES, Box
from molweave.operators.contacts import box_atoms
from molweave.operators.ranking import exact_rank
from molweave.session import materialise

# per swept axis: (walked axis, axis the lines run along), each walked forwards and backwards
WALKS = {
    "x": (("y", "z"), ("z", "y")),
    "y": (("z", "x"), ("x", "z")),
    "z": (("x", "y"), ("y", "x")),
}
# sort order of the atoms per swept axis; the later sorts keep the order of the earlier ones on ties
SORTS = {"x": ("z",), "y": ("x", "z"), "z": ("y", "x", "z")}
MODES = ("reference", "clean")


def grid(low: float, high: float, step: float, forward: bool = True) -> list[float]:
    """Grid coordinates by repeated addition, as the rounding of the sum is part of the rule."""
    values, at = [], low if forward else high
    while (at < high) if forward else (at > low):
        values.append(at)
        at = at + step if forward else at - step
    return values


def _steps(start: Column, step: float, value: Column, reach: Column) -> Column:
    """Grid numbers that can lie within ``reach`` of ``value``, one to spare on both sides."""
    first = F.floor((value - reach - start) / step).cast("int") - 1
    last = F.ceil((value + reach - start) / step).cast("int") + 1
    return F.sequence(first, last)


def _hits(atoms: DataFrame, box: Box, step: float) -> DataFrame:
    """Atoms on the lines they cross: ``axis, sub, outer, line, lines, here``.

    Each atom is put on the few grid numbers around it and the exact test decides, instead of testing
    every atom against every line. Grid coordinates come from arrays of repeated sums.
    """
    outer_grids = [grid(box.low(a), box.high(a), step) for a in AXES]
    walk_grids = [grid(box.low(a), box.high(a), step, forward) for a in AXES for forward in (True, False)]
    walks = []
    for number, axis in enumerate(AXES):
        place = [*SORTS[axis], *[None] * (3 - len(SORTS[axis]))]
        for pair, (inner, _along) in enumerate(WALKS[axis]):
            for turned, forward in enumerate((True, False)):
                start = box.low(inner) if forward else -box.high(inner)
                walks.append(
                    F.struct(
                        F.lit(number).alias("axis"),
                        F.lit(pair * 2 + turned).alias("sub"),
                        F.lit(AXES.index(inner) * 2 + turned).alias("walk"),
                        F.col(axis).alias("outer_at"),
                        F.lit(box.low(axis)).alias("outer_start"),
                        F.col(inner).alias("inner_at"),
                        F.lit(1.0 if forward else -1.0).alias("way"),
                        F.lit(start).alias("inner_start"),
                        F.struct(
                            *((F.col(c) if c else F.lit(0.0)).alias(f"k{i}") for i, c in enumerate(place)),
                            F.col("atom_id").alias("k3"),
                        ).alias("place"),
                    )
                )
    outer_grid, walk_grid = F.get(F.lit(outer_grids), F.col("w.axis")), F.get(F.lit(walk_grids), F.col("w.walk"))
    reach = F.col("radius")
    near = lambda at, line: line.between(at - reach, at + reach)
    return (
        atoms.select("*", F.explode(F.array(*walks)).alias("w"))
        .withColumn("outer", F.explode(_steps(F.col("w.outer_start"), step, F.col("w.outer_at"), reach)))
        .where((F.col("outer") >= 0) & near(F.col("w.outer_at"), F.get(outer_grid, F.col("outer"))))
        .withColumn(
            "line",
            F.explode(_steps(F.col("w.inner_start"), step, F.col("w.inner_at") * F.col("w.way"), reach)),
        )
        .where((F.col("line") >= 0) & near(F.col("w.inner_at"), F.get(walk_grid, F.col("line"))))
        .select(
            "w.axis",
            "w.sub",
            "outer",
            "line",
            F.size(walk_grid).alias("lines"),
            F.struct(*AXES, "radius", "atom_id", "w.place").alias("here"),
        )
    )


def _gap(here: str, there: str) -> Column:
    squares = [F.pow(F.col(f"{here}.{c}") - F.col(f"{there}.{c}"), F.lit(2.0)) for c in AXES]
    between = F.sqrt(squares[0] + squares[1] + squares[2])
    return between - F.col(f"{here}.radius") - F.col(f"{there}.radius")


def _meeting(gaps: Sequence[float]) -> Column:
    """Changes when ``here`` is met after ``before``: the corner penalty or a gain for both."""
    change = lambda atom, points: F.struct(atom.alias("atom_id"), points.alias("change"))
    one, penalty = F.lit(1), F.lit(-CORNER_PENALTY)
    gap = F.get(F.lit([float(g) for g in gaps]), F.col("axis"))
    here, before = F.col("here.atom_id"), F.col("before.atom_id")
    return (
        F.when(before.isNull(), F.array(change(here, penalty)))
        .when(_gap("here", "before") >= gap, F.array(change(here, one), change(before, one)))
        .otherwise(F.array().cast("array<struct<atom_id: bigint, change: int>>"))
    )


def _changes(
    atoms: DataFrame, box: Box, step: float, gaps: Sequence[float], mode: str, ends: Row
) -> DataFrame:
    """Score changes ``atom_id, change`` of all sweeps."""
    reference = mode == "reference"
    line_keys = ["axis", "sub", "outer", "line"]
    on_line = Window.partitionBy(*line_keys).orderBy("here.place")
    walked = _hits(atoms, box, step).withColumns(
        {"before": F.lag("here").over(on_line), "after": F.lead("here").over(on_line)}
    )
    # first and last atom of every line; the rows already sit together
    per_line = (
        walked.where("before is null or after is null")
        .groupBy(*line_keys, "lines")
        .agg(
            F.max(F.when(F.col("before").isNull(), F.col("here"))).alias("here"),
            F.max(F.when(F.col("after").isNull(), F.col("here"))).alias("last"),
        )
    )
    walk = Window.partitionBy("axis", "sub", "outer").orderBy("line")
    no_one = F.when(F.lit(False), F.col("last"))
    per_line = per_line.withColumns(
        {
            "before": F.lag("last").over(walk) if reference else no_one,
            "next_line": F.lead("line").over(walk),
            "earlier_line": F.lag("line").over(walk),
        }
    )
    met = walked.where("before is not null").select("axis", "here", "before").unionByName(
        per_line.select("axis", "here", "before")
    )
    if reference:
        # on the x and z sweeps the atom that is first in sort order does not count as a predecessor
        ignored = F.get(F.array(F.lit(ends["first_x"]), F.lit(None), F.lit(ends["first_z"])), F.col("axis"))
        counts = ignored.isNull() | (F.col("before.atom_id") != ignored)
        met = met.withColumn("before", F.when(counts, F.col("before")))
    changes = met.select(F.inline(_meeting(gaps)))
    # the last atom met pays once for its line and, in reference mode, for the empty lines after it
    stays = F.coalesce("next_line", "lines") - F.col("line") if reference else F.lit(1)
    paid = per_line.select(F.col("last.atom_id").alias("atom_id"), (-CORNER_PENALTY * stays).alias("change"))
    changes = changes.unionByName(paid)
    if reference:
        # lines before the first hit of a walk charge the atom that is last in sort order: charge it
        # for every line, then give back the lines from each walk's first hit on
        last = [F.lit(ends[f"last_{a}"]) for a in AXES]
        total = [
            len(grid(box.low(a), box.high(a), step))
            * sum(len(grid(box.low(i), box.high(i), step, f)) for i, _ in WALKS[a] for f in (True, False))
            for a in AXES
        ]
        charged = atoms.sparkSession.range(1).select(
            F.inline(
                F.array(
                    *(
                        F.struct(a.alias("atom_id"), F.lit(-CORNER_PENALTY * t).alias("change"))
                        for a, t in zip(last, total)
                    )
                )
            )
        )
        given_back = per_line.where("earlier_line is null").select(
            F.get(F.array(*last), F.col("axis")).alias("atom_id"),
            (CORNER_PENALTY * (F.col("lines") - F.col("line"))).alias("change"),
        )
        changes = changes.unionByName(charged).unionByName(given_back)
    return changes


def sweep_scores(
    atoms: DataFrame,
    box: Box,
    step: float = GRID_STEP,
    gaps: Sequence[float] = CAVITY_GAPS,
    mode: str = "reference",
) -> DataFrame:
    """Atoms in the box with their cavity score.

    ``atoms`` needs ``atom_id`` (file order), ``x, y, z, radius``. ``mode="reference"`` keeps the rules
    of the original sweep: the predecessor carries over from line to line, empty lines charge the last
    atom met, and on the x and z sweeps the first atom in sort order is no predecessor. In
    ``mode="clean"`` every line stands for itself.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    inside = materialise(box_atoms(atoms, box), "box")
    place = {axis: F.struct(*SORTS[axis], "atom_id") for axis in AXES}
    ends = inside.agg(
        *(F.min(place[a])["atom_id"].alias(f"first_{a}") for a in AXES),
        *(F.max(place[a])["atom_id"].alias(f"last_{a}") for a in AXES),
    ).first()
    if ends["first_x"] is None:
        return inside.withColumn("score", F.lit(0).cast("long"))
    slim = inside.select("atom_id", *AXES, "radius")
    changes = _changes(slim, box, step, gaps, mode, ends)
    total = changes.groupBy("atom_id").agg(F.sum("change").alias("score"))
    return inside.join(total, "atom_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0)).cast("long")
    )


def select_site(scored: DataFrame, percent: int = SITE_PERCENT) -> DataFrame:
    """The top ``percent`` of the box atoms by score, numbered by (x, y, z) as fingerprint bits."""
    by_score = [F.desc("score"), *(F.asc(c) for c in SORTS["z"]), F.asc("atom_id")]
    ranked = exact_rank(scored, [], by_score)
    keep = percent * scored.count() // 100
    return number_bits(ranked.where(F.col("rank") <= keep).drop("rank"))


def number_bits(site: DataFrame) -> DataFrame:
    """Bit numbers from 0 in (x, y, z) order, then file order."""
    ranked = exact_rank(site, [], [*(F.asc(c) for c in AXES), F.asc("atom_id")], "_rank")
    return ranked.withColumn("bit", (F.col("_rank") - 1).cast("int")).drop("_rank")
