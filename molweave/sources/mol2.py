"""MOL2 files with many molecules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions.chem import element_of_type, vdw_radius
from molweave.functions.labels import with_label
from molweave.functions.text import lines
from molweave.sources.records import file_order, read_records

MOLECULE = "@<TRIPOS>MOLECULE"
ATOM = "@<TRIPOS>ATOM"
BOND = "@<TRIPOS>BOND"
SECTION = "@<TRIPOS>"


def read_mol2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per molecule: ``mol_id, src_file, block_start, rec_id, name, label, ext_id, block``."""
    records = (
        read_records(spark, path, MOLECULE)
        # text before the first marker is no molecule
        .where(F.col("value").rlike(r"^[ \t\r]*\n") & (F.trim("value") != ""))
        .select(
            F.monotonically_increasing_id().alias("mol_id"),
            "src_file",
            "block_start",
            F.monotonically_increasing_id().alias("rec_id"),
            F.trim(F.get(lines(F.col("value")), F.lit(1))).alias("name"),
            F.col("value").alias("block"),
        )
    )
    return with_label(records)


def with_file_order(molecules: DataFrame) -> DataFrame:
    return file_order(molecules, "ord")


def _section_lines(molecules: DataFrame, start: str, end: str) -> DataFrame:
    """Lines of one section as word arrays: ``mol_id, line_no, t``."""
    section = F.substring_index(F.split_part("block", F.lit(start), F.lit(2)), end, 1)
    spaced = F.split(F.regexp_replace(section, r"[ \t\r]+", " "), "\n")
    # lines are cut into words before they become rows, so that later filters do not cut them again
    cut = F.transform(spaced, lambda line: F.split(F.trim(line), " "))
    return (
        molecules.select("mol_id", F.posexplode(cut).alias("line_no", "t"))
        # position 0 is the rest of the marker line
        .where((F.col("line_no") > 0) & (F.get("t", F.lit(0)) != ""))
    )


def _item(i: int, kind: str | None = None) -> Column:
    value = F.get("t", F.lit(i))
    return value if kind is None else value.try_cast(kind)


def _atom_lines(molecules: DataFrame) -> DataFrame:
    parsed = _section_lines(molecules, ATOM, BOND).select(
        "mol_id",
        "line_no",
        F.array_join("t", " ").alias("line"),
        _item(0, "int").alias("serial"),
        _item(1).alias("atom_name"),
        _item(2, "double").alias("x"),
        _item(3, "double").alias("y"),
        _item(4, "double").alias("z"),
        _item(5).alias("sybyl_type"),
        _item(6, "int").alias("resnum"),
        _item(7).alias("resname"),
        _item(8, "double").alias("charge"),
    )
    good = F.lit(True)
    for name in ("serial", "x", "y", "z", "resnum", "charge"):
        good = good & F.col(name).isNotNull()
    return parsed.withColumn("good", good)


def read_atoms(molecules: DataFrame) -> DataFrame:
    """Atom rows; a malformed line gives no row (see :func:`rejected_atoms`)."""
    element = element_of_type(F.col("sybyl_type"))
    return (
        _atom_lines(molecules)
        .where("good")
        .drop("good", "line")
        .withColumn("element", element)
        .withColumn("radius", vdw_radius(F.col("element")))
    )


def rejected_atoms(molecules: DataFrame) -> DataFrame:
    return _atom_lines(molecules).where(~F.col("good")).select("mol_id", "line_no", "line")


def with_sections(molecules: DataFrame) -> DataFrame:
    """Add ``atoms array<struct<serial, element>>`` and ``bonds array<struct<a, b, btype>>`` to every molecule.

    Both sections are cut from the same row, so a file is read once and nothing is joined back.
    """

    def words(start: str, end: str) -> Column:
        section = F.substring_index(F.split_part("block", F.lit(start), F.lit(2)), end, 1)
        spaced = F.slice(F.split(F.regexp_replace(section, r"[ \t\r]+", " "), "\n"), 2, 2147483647)
        return F.filter(F.transform(spaced, lambda line: F.split(F.trim(line), " ")), lambda t: F.get(t, F.lit(0)) != "")

    def item(t: Column, i: int, kind: str) -> Column:
        return F.get(t, F.lit(i)).try_cast(kind)

    numbers = {0: "int", 2: "double", 3: "double", 4: "double", 6: "int", 8: "double"}
    whole = lambda t: reduce(Column.__and__, (item(t, i, k).isNotNull() for i, k in numbers.items()))
    atom = lambda t: F.struct(item(t, 0, "int").alias("serial"), element_of_type(F.get(t, F.lit(5))).alias("element"))
    bond = lambda t: F.struct(item(t, 1, "int").alias("a"), item(t, 2, "int").alias("b"), F.get(t, F.lit(3)).alias("btype"))
    full = lambda t: item(t, 0, "int").isNotNull() & item(t, 1, "int").isNotNull() & item(t, 2, "int").isNotNull() & (F.size(t) > 3)
    return molecules.withColumns(
        {
            "atoms": F.transform(F.filter(words(ATOM, BOND), whole), atom),
            "bonds": F.transform(F.filter(words(BOND, SECTION), full), bond),
        }
    )


def read_bonds(molecules: DataFrame) -> DataFrame:
    """Bond rows ``mol_id, bond_id, a, b, btype``."""
    return (
        _section_lines(molecules, BOND, SECTION)
        .select(
            "mol_id",
            _item(0, "int").alias("bond_id"),
            _item(1, "int").alias("a"),
            _item(2, "int").alias("b"),
            _item(3).alias("btype"),
        )
        .dropna()
    )
