"""Molecule and residue masses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.chem import element_of_pdbqt
from molweave.functions.text import ascii_lower


#: rows of an element table at most
MAX_ELEMENTS = 1000


def with_mass(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Add ``mass`` by element; an unknown element weighs 0.

    The masses become a literal map, so atoms stay where they are. An element table has one row per symbol
    (``MAX_ELEMENTS`` at most); a larger one is refused.
    """
    known = elements.select("symbol", "mass").limit(MAX_ELEMENTS + 1).collect()
    if len(known) > MAX_ELEMENTS:
        raise ValueError(f"an element table has at most {MAX_ELEMENTS} rows")
    if not known:
        return atoms.withColumn("mass", F.lit(0.0))
    by_symbol = F.map_from_arrays(F.lit([r["symbol"] for r in known]), F.lit([r["mass"] for r in known]))
    return atoms.withColumn("mass", F.coalesce(F.try_element_at(by_symbol, ascii_lower(F.col("element"))), F.lit(0.0)))


def unknown_elements(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements that are not in the table, with their number of atoms."""
    table = elements.select("symbol")
    counted = atoms.groupBy(ascii_lower(F.col("element")).alias("symbol")).agg(
        F.count("*").alias("atoms")
    )
    return counted.join(table, "symbol", "left_anti")


def masses(atoms: DataFrame, elements: DataFrame, by: Sequence[str] = ("mol_id",)) -> DataFrame:
    """Mass per group: molecules by default, residues with ``("mol_id", "resnum", "resname")``."""
    return with_mass(atoms, elements).groupBy(*by).agg(F.sum("mass").alias("mass"))


TYPE_COLUMN = 77


def _lines(models: DataFrame) -> DataFrame:
    keep = [c for c in models.columns if c != "lines"]
    return models.select(*keep, F.posexplode("lines").alias("line_no", "line"))


def pdbqt_atoms(models: DataFrame) -> DataFrame:
    """Atom lines of PDBQT models with their element. ``HETATM`` lines are no atoms here."""
    line = F.col("line")
    whole = line.startswith("ATOM") & (F.length(line) >= TYPE_COLUMN)
    return _lines(models).where(whole).withColumn("element", element_of_pdbqt(line))


def short_atom_lines(models: DataFrame) -> DataFrame:
    """Atom lines that end before the type columns: malformed, and no atoms."""
    line = F.col("line")
    return _lines(models).where(line.startswith("ATOM") & (F.length(line) < TYPE_COLUMN))


def pdbqt_masses(models: DataFrame, elements: DataFrame) -> DataFrame:
    """``ligand, mass`` of every model; a model without atom lines weighs 0.

    The lines of a model sum up inside the task that read it, so one row per model is shuffled. Other
    lines enter the sum without an element: that keeps models without atoms and needs no second read.
    """
    keys = ["src_file", "block_start", "rec_id", "ligand"]
    line = F.col("line")
    whole = line.startswith("ATOM") & (F.length(line) >= TYPE_COLUMN)
    parts = _lines(models.select(*keys, "lines")).select(
        *keys, F.when(whole, element_of_pdbqt(line)).otherwise("").alias("element")
    )
    return masses(parts, elements, keys)
