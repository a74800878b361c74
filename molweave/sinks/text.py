"""Line-oriented outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.geometry import Box
from molweave.operators.contacts import box_atoms
from molweave.operators.ranking import exact_rank
from molweave.operators.similarity import lower_triangle_lines


def write_distance_matrix(vectors: DataFrame, path: str, pairs: DataFrame | None = None) -> None:
    """Lower-triangular distance matrix: the number of compounds, then one line per compound."""
    lines = lower_triangle_lines(vectors, pairs, ordered=True)
    head = vectors.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).alias("ord"), "line")
    head.unionByName(lines).select("line").write.text(path)


def numbered_models(models: DataFrame, order: list[str]) -> DataFrame:
    """``number, text``: each model between its ``MODEL`` and ``ENDMDL`` lines, numbered from 1."""
    # the texts are range-partitioned and never meet in one task, however few they are
    ranked = exact_rank(models, [], [F.asc(c) for c in order], "number", small_rows=0)
    head = F.concat(F.lit("MODEL "), F.col("number").cast("string"))
    text = F.array_join(F.concat(F.array(head), F.col("lines"), F.array(F.lit("ENDMDL"))), "\n")
    return ranked.select("number", text.alias("text"))


def write_models(models: DataFrame, path: str, order: list[str]) -> None:
    numbered_models(models, order).orderBy("number").select("text").write.text(path)


def write_texts(texts: DataFrame, path: str) -> None:
    """Write ``name, value`` rows as files of their own below ``path``, which tasks reach by a pyarrow file system.

    A file appears under its name when it is complete; a task that runs again writes the same files again.
    """

    def run(batches):
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(root)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write((value or "").encode())
                system.move(part, f"{root}/{name}")
            yield batch.slice(0, 0)

    texts.select("name", "value").mapInArrow(run, "name string, value string").write.format("noop").mode("overwrite").save()


def xyz_lines(atoms: DataFrame, box: Box, title: str = "ProteinBox") -> DataFrame:
    """``pos, line`` of the atoms in a box as XYZ text; ``atoms`` needs ``atom_id`` for their order."""
    inside = box_atoms(atoms, box)
    head = inside.agg(F.count("*").cast("string").alias("line")).select(
        F.lit(-2).cast("bigint").alias("pos"), "line"
    )
    name = atoms.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("pos"), F.lit(title).alias("line"))
    body = inside.select(
        F.col("atom_id").cast("bigint").alias("pos"),
        F.concat_ws("\t", "element", *(F.col(c).cast("string") for c in "xyz")).alias("line"),
    )
    return head.unionByName(name).unionByName(body)


def write_xyz(atoms: DataFrame, box: Box, path: str) -> None:
    xyz_lines(atoms, box).orderBy("pos").select("line").write.text(path)


def mol2_text(atoms: DataFrame) -> DataFrame:
    """MOL2 text ``mol_id, text`` of atom rows, for files that :func:`read_mol2` reads back.

    ``atoms`` holds one row per molecule: ``mol_id, name`` and ``atoms``, an array of structs with the
    nine fields of an atom line; an optional ``bonds`` array holds the four fields of a bond line.
    """
    fields = ("serial", "atom_name", "x", "y", "z", "sybyl_type", "resnum", "resname", "charge")
    line = lambda item, names: F.array_join(
        F.array(*(item[n].cast("string") for n in names)), " "
    )
    empty = F.array().cast("array<string>")
    bonds = (
        F.transform("bonds", lambda b: line(b, ("bond_id", "a", "b", "btype")))
        if "bonds" in atoms.columns
        else empty
    )
    counts = F.concat_ws(" ", F.size("atoms").cast("string"), F.size(bonds).cast("string"), F.lit("0 0 0"))
    head = F.array(
        F.lit("@<TRIPOS>MOLECULE"), F.col("name"), counts, F.lit("SMALL"), F.lit("GASTEIGER"), F.lit("")
    )
    text = F.concat(
        head,
        F.array(F.lit("@<TRIPOS>ATOM")),
        F.transform("atoms", lambda a: line(a, fields)),
        F.array(F.lit("@<TRIPOS>BOND")),
        bonds,
    )
    return atoms.select("mol_id", F.array_join(text, "\n").alias("text"))
