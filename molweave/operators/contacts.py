"""Contacts between molecules and the atoms of a binding site."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from molweave.constants import CONTACT_CUTOFF, MIN_BOX_ATOMS
from molweave.functions.geometry import AXES, Box, distance
from molweave.operators.blocks import small_side
from molweave.operators.fingerprints import pack_bits, pack_lists
from molweave.session import materialise

# up to this many site atoms are sent to every task; their bytes are bounded too (see :func:`small_side`)
SITE_BROADCAST_ROWS = 1 << 20
SPREAD = 64
#: pairs of atoms that a task measures at a time
STEP_PAIRS = 1 << 21


def box_atoms(atoms: DataFrame, box: Box) -> DataFrame:
    return atoms.where(box.contains())


def box_quality(atoms: DataFrame, box: Box) -> DataFrame:
    """Atom counts of a box and whether there are too few for a useful site."""
    counts = atoms.agg(
        F.count("*").alias("protein_atoms"), F.count_if(box.contains()).alias("box_atoms")
    )
    return counts.withColumn("too_few", F.col("box_atoms") < MIN_BOX_ATOMS)


def bounds(atoms: DataFrame, by: tuple[str, ...] = ("mol_id",)) -> DataFrame:
    """Smallest and largest coordinates per molecule."""
    ends = [f(c).alias(f"{n}{c}") for c in AXES for n, f in (("min", F.min), ("max", F.max))]
    return atoms.groupBy(*by).agg(*ends)


def _cells(cutoff: float) -> list:
    # a hair wider than the cutoff, so that rounding cannot put a contact two cells away
    size = cutoff * (1 + 1e-9)
    return [F.floor(F.col(c) / size).alias(f"cell_{c}") for c in AXES]


class _Grid:
    """Site atoms in the order of their cubes; a place meets those of its own cube and of the 26 around it."""

    def __init__(self, places: np.ndarray, size: float):
        # a hair wider than asked for, as in :func:`_cells`
        self.size = size * (1 + 1e-9)
        cells = np.floor(places / self.size)
        self.known = [np.unique(c) for c in cells.T]
        key = self._key(*(np.searchsorted(k, c) for k, c in zip(self.known, cells.T, strict=True)))
        self.order = np.argsort(key, kind="stable")
        self.keys, self.places = key[self.order], places[self.order]

    def _key(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        return (x * len(self.known[1]) + y) * len(self.known[2]) + z

    def _runs(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end of nine runs of site atoms for every place."""
        x, y, z = np.floor(places / self.size).T
        low, high = np.searchsorted(self.known[2], z - 1), np.searchsorted(self.known[2], z + 1, "right")
        runs = []
        for near_x in (x - 1, x, x + 1):
            at_x, end_x = (np.searchsorted(self.known[0], near_x, side) for side in ("left", "right"))
            for near_y in (y - 1, y, y + 1):
                at_y, end_y = (np.searchsorted(self.known[1], near_y, side) for side in ("left", "right"))
                first = np.searchsorted(self.keys, self._key(at_x, at_y, low))
                end = np.searchsorted(self.keys, self._key(at_x, at_y, high))
                runs.append((first, np.where((end_x > at_x) & (end_y > at_y), end, first)))
        return np.stack([r[0] for r in runs], axis=1), np.stack([r[1] for r in runs], axis=1)

    def meetings(self, places: np.ndarray):
        """(place, site atom, distance) of all that meet, in steps; all of one place are in one step."""
        first, end = self._runs(places)
        counts = end - first
        upto = np.append(0, np.cumsum(counts.sum(axis=1)))
        at = 0
        while at < len(places):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP_PAIRS, "right")) - 1)
            here = counts[at:to].ravel()
            if here.any():
                place = np.repeat(np.arange(at, to), counts[at:to].sum(axis=1))
                mine = np.repeat(first[at:to].ravel() - np.cumsum(here) + here, here) + np.arange(here.sum())
                gaps = [places[place, k] - self.places[mine, k] for k in range(3)]
                yield place, self.order[mine], np.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
            at = to


def _sent_site(site: DataFrame, rows: int) -> pa.Table | None:
    """Site atoms with a place, for the tasks; None if they are too many."""
    finite = reduce(Column.__and__, (F.abs(c) < float("inf") for c in AXES))
    return small_side(site.where(finite).select("bit", *(F.col(c).cast("double").alias(c) for c in AXES)), rows)


def _xyz(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Places as rows; what is null is nowhere."""
    return np.stack([table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[c].to_numpy() for c in AXES], axis=1).astype(np.float64)


def _plain(column: pa.Array) -> list[pa.Array]:
    """A key column as columns of plain values: a struct as its fields, a list as text."""
    if pa.types.is_struct(column.type):
        return [column.is_null(), *(part for field in column.flatten() for part in _plain(field))]
    return [pa.array(list(map(repr, column.to_pylist())), pa.string())] if pa.types.is_nested(column.type) else [column]


def _molecules(batch: pa.RecordBatch, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every molecule of a batch, and the molecule of every row."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for column in (part for c in by for part in _plain(batch.column(c))):
        found = column.dictionary_encode(null_encoding="encode")
        code = code * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return first, code


def _touched(atoms: DataFrame, site: DataFrame, cutoff: float, by: tuple[str, ...], rows: int) -> DataFrame | None:
    """``by columns, parts`` of every molecule that has atoms: lists of the bits it touches, one per batch of its atoms.

    Atoms are measured against the site where they are, and a batch hands on one row per molecule. None if the site is
    too large to be sent.
    """
    table = _sent_site(site, rows)
    if table is None:
        return None
    shared = atoms.sparkSession.sparkContext.broadcast((table["bit"].combine_chunks(), _xyz(table)))

    def run(batches):
        bits, places = shared.value
        grid, width = _Grid(places, cutoff), max(1, len(bits))
        for batch in batches:
            first, code = _molecules(batch, by)
            found = [np.zeros(0, dtype=np.int64)]
            for atom, at, gap in grid.meetings(_xyz(batch)):
                near = gap < cutoff
                found.append(np.unique(code[atom[near]] * width + at[near]))
            keys = np.unique(np.concatenate(found))
            ends = np.searchsorted(keys, np.arange(len(first) + 1) * width)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bits.take(pa.array(keys % width)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(first)) for c in by), lists], names=[*by, "bits"])

    source = atoms.select(*by, *(F.col(c).cast("double").alias(c) for c in AXES))
    schema = StructType([*(source.schema[c] for c in by), StructField("bits", ArrayType(site.schema["bit"].dataType))])
    return source.mapInArrow(run, schema).groupBy(*by).agg(F.collect_list("bits").alias("parts"))


def contact_pairs(
    atoms: DataFrame,
    site: DataFrame,
    cutoff: float = CONTACT_CUTOFF,
    keep: tuple[str, ...] = ("mol_id",),
    broadcast_rows: int = SITE_BROADCAST_ROWS,
    with_free: bool = False,
    once: bool = False,
) -> DataFrame:
    """Atom pairs closer than ``cutoff`` as ``keep columns, bit`` (a bit repeats per touching atom, unless ``once``).

    ``with_free`` also keeps the atoms that touch nothing, with a null bit.

    Space is cut into cubes of the cutoff's size; a site atom is listed in its own cube and the 26
    around it, which makes the distance join an equi-join on the cube. The site is small and is sent to
    every task. If it is not, its rows are repeated over ``SPREAD`` salts instead, because docked
    molecules all sit in the same few cubes. Where a bit is wanted ``once``, a small site is met by batches of atoms, so
    that one row per molecule is shuffled and no row per pair.
    """
    if once:
        touched = None if with_free else _touched(atoms, site, cutoff, keep, broadcast_rows)
        if touched is None:
            return contact_pairs(atoms, site, cutoff, keep, broadcast_rows, with_free).distinct()
        whole = F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.flatten("parts"))
        return touched.select(*keep, F.explode(F.array_distinct(whole)).alias("bit"))
    cells = [f"cell_{c}" for c in AXES]
    around = F.sequence(F.lit(-1), F.lit(1))
    listed = site.select("bit", *AXES, *_cells(cutoff))
    for cell in cells:
        listed = listed.withColumn("_step", F.explode(around)).withColumn(
            cell, F.col(cell) + F.col("_step")
        )
    listed = listed.drop("_step")
    placed = atoms.select(*keep, *AXES, *_cells(cutoff))
    if site.limit(broadcast_rows + 1).count() <= broadcast_rows:
        listed = F.broadcast(listed)
        on = cells
    else:
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*keep, *AXES), F.lit(SPREAD)))
        listed = listed.withColumn(
            "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
        )
        on = [*cells, "_salt"]
    near = distance("m", "s") < cutoff
    for column in on:
        near = near & (F.col(f"m.{column}") == F.col(f"s.{column}"))
    joined = placed.alias("m").join(listed.alias("s"), near, "left" if with_free else "inner")
    return joined.select(*(f"m.{c}" for c in keep), "s.bit")


def _around(site: DataFrame, size: float) -> DataFrame:
    """Site atoms listed in their own cube of ``size`` and the 26 around it."""
    listed = site.select("bit", *AXES, *_cells(size))
    for cell in (f"cell_{c}" for c in AXES):
        listed = listed.withColumn("_step", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(cell, F.col(cell) + F.col("_step"))
    return listed.drop("_step")


def nearest_site_atoms(
    atoms: DataFrame,
    site: DataFrame,
    by: tuple[str, ...] = ("mol_id",),
    size: float = CONTACT_CUTOFF,
    broadcast_rows: int = SITE_BROADCAST_ROWS,
) -> DataFrame:
    """The site atom nearest to any atom of every molecule, however far: ``by columns, bit, distance``.

    A small site is met by batches of atoms, which hand on one row per molecule. A molecule first looks into the cubes around its atoms. What lies outside is farther away than a cube is wide, so a
    distance up to that is the smallest; molecules without one go on with cubes of twice the width. Of equally near
    site atoms the smaller bit counts. Molecules without a finite atom, and all of them if the site is empty, are left out.
    """
    finite = lambda: reduce(Column.__and__, (F.abs(c) < float("inf") for c in AXES))
    waiting, site = atoms.where(finite()).select(*by, *AXES), site.where(finite())
    table = _sent_site(site.where("bit is not null"), broadcast_rows)
    if table is not None and table.num_rows:
        return _nearest_sent(waiting, table, site.schema["bit"], by, size)
    few = site.limit(broadcast_rows + 1).count()
    found: list[DataFrame] = []
    while few:
        listed, placed = _around(site, size), waiting.select(*by, *AXES, *_cells(size))
        on = [f"cell_{c}" for c in AXES]
        if few <= broadcast_rows:
            listed = F.broadcast(listed)
        else:
            placed = placed.withColumn("_salt", F.pmod(F.xxhash64(*by, *AXES), F.lit(SPREAD)))
            listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
            on = [*on, "_salt"]
        same = reduce(Column.__and__, (F.col(f"m.{c}") == F.col(f"s.{c}") for c in on))
        # the left join keeps molecules that meet nothing; a task sends one row per molecule
        met = placed.alias("m").join(listed.alias("s"), same, "left")
        near = F.when(F.col("s.bit").isNotNull(), F.struct(distance("m", "s").alias("distance"), F.col("s.bit").alias("bit")))
        best = materialise(met.groupBy(*(F.col(f"m.{c}").alias(c) for c in by)).agg(F.min(near).alias("near")), "nearest")
        sure = F.coalesce(F.col("near.distance") <= size, F.lit(False))
        found.append(best.where(sure).select(*by, "near.bit", "near.distance"))
        rest = best.where(~sure).select(*by)
        if rest.isEmpty():
            break
        waiting = materialise(waiting.join(rest, list(by), "left_semi"), "waiting")
        size *= 2
    if not found:
        return waiting.limit(0).select(*by, F.lit(0).alias("bit"), F.lit(0.0).alias("distance"))
    return reduce(DataFrame.unionByName, found)


def _nearest_sent(atoms: DataFrame, site: pa.Table, bit: StructField, by: tuple[str, ...], size: float) -> DataFrame:
    """The same where the site is sent to the tasks: every batch finds the nearest site atom of its part of a molecule."""
    # of equally near ones the first counts, so they stand in order of their bits
    site = site.sort_by("bit")
    shared = atoms.sparkSession.sparkContext.broadcast((site["bit"].combine_chunks(), _xyz(site)))

    def run(batches):
        bits, sites = shared.value
        grids: dict[float, _Grid] = {}
        for batch in batches:
            first, code = _molecules(batch, by)
            places, left, reach = _xyz(batch), np.arange(batch.num_rows), size
            gap, spot = np.full(len(first), np.inf), np.zeros(len(first), dtype=np.int64)
            while len(left):
                if reach not in grids:
                    grids[reach] = _Grid(sites, reach)
                atom_gap, atom_spot = np.full(len(left), np.inf), np.full(len(left), len(sites))
                for atom, at, gaps in grids[reach].meetings(places[left]):
                    starts = np.flatnonzero(np.append(True, atom[1:] != atom[:-1]))
                    least = np.minimum.reduceat(gaps, starts)
                    equal = gaps == np.repeat(least, np.diff(np.append(starts, len(atom))))
                    atom_gap[atom[starts]] = least
                    atom_spot[atom[starts]] = np.minimum.reduceat(np.where(equal, at, len(sites)), starts)
                order = np.lexsort((atom_spot, atom_gap, code[left]))
                best = order[np.flatnonzero(np.diff(code[left][order], prepend=-1))]
                # what lies outside the cubes is farther away than a cube is wide
                best = best[(atom_gap[best] <= reach) & (atom_spot[best] < len(sites))]
                gap[code[left[best]]], spot[code[left[best]]] = atom_gap[best], atom_spot[best]
                left = left[~np.isin(code[left], code[left[best]])]
                reach *= 2
            taken = [batch.column(c).take(pa.array(first)) for c in by]
            yield pa.RecordBatch.from_arrays([*taken, bits.take(pa.array(spot)), pa.array(gap)], names=[*by, "bit", "distance"])

    source = atoms.select(*by, *(F.col(c).cast("double").alias(c) for c in AXES))
    schema = StructType([*(source.schema[c] for c in by), StructField("bit", bit.dataType), StructField("distance", DoubleType())])
    near = source.mapInArrow(run, schema).groupBy(*by).agg(F.min(F.struct("distance", "bit")).alias("near"))
    return near.select(*by, "near.bit", "near.distance")


def contact_fingerprints(
    atoms: DataFrame,
    site: DataFrame,
    width: int,
    cutoff: float = CONTACT_CUTOFF,
    by: tuple[str, ...] = ("mol_id",),
    **options,
) -> DataFrame:
    """Packed contact fingerprint ``by columns, words`` of every molecule that has atoms.

    Touching atoms collapse before the shuffle, so each task sends one short row per
    molecule. A molecule without contacts keeps an empty fingerprint, as its free atoms stay in the join;
    that needs neither a second look at the molecules nor a join back to them.
    """
    touched = _touched(atoms, site, cutoff, by, options.get("broadcast_rows", SITE_BROADCAST_ROWS))
    if touched is not None:
        return pack_lists(touched.select(*by, F.flatten("parts").alias("bits")), by, width)
    pairs = contact_pairs(atoms, site, cutoff, by, with_free=True, **options)
    return pack_bits(pairs, by, width)
