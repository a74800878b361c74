"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .words import slices

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: bytes.translate table that lower-cases A-Z and nothing else
LOWER_BYTES = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the fold rule of the queries."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def local_path(path: str) -> tuple:
    """A pyarrow file system and the path inside it, for files that tasks write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def give_back() -> None:
    """At the end of a task: return freed memory to the system, as Spark keeps Python workers for other stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def map_text(df: DataFrame, text: str, outputs: StructType, make: Callable[[], Callable], keep: list[str] | None = None, chars: int = 4_000_000, arrow: bool = False) -> DataFrame:
    """``df`` with columns computed from whole texts, in lots of about ``chars`` characters (longer texts alone).

    ``make()`` runs once in every task and returns a function from a list of texts (None for null) to one Arrow
    array per field of ``outputs``; with ``arrow`` it gets an Arrow array of texts instead. ``keep`` names the input columns to pass on (default: all). Columns of the
    input named like an output are replaced. Nothing is shuffled.
    """
    names = [f.name for f in outputs]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    # a text that is passed on travels once
    place = kept.index(text) if text in kept else len(kept)
    source = df.select(*kept, *([] if text in kept else [F.col(text).alias("__text")]))
    schema = StructType([source.schema[c] for c in kept] + list(outputs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        apply = make()
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()
            for part in slices(sizes, chars):
                rest = batch.slice(part.start, part.stop - part.start)
                arrays = apply(rest.column(place) if arrow else rest.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(len(kept))), *arrays], names=kept + names)
        del apply
        give_back()

    return source.mapInArrow(run, schema)
