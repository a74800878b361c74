"""Incremental intake of docking output.

Logs and poses arrive as one small file each. They are parsed inside their row, so folding all of them needs no
state and no watermark; the file source reads every file once and the checkpoint remembers which. Where only the
first log or pose of a ligand counts, the state store holds one flag per ligand: a lot is checked against the flags
of its own ligands and never against what earlier lots have written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from molweave.operators.docking import docking_summary
from molweave.sources.docking_log import ligand_of_path, parse_logs
from molweave.sources.pdbqt import END_MARK, models_in

FILES_PER_BATCH = 10_000
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


#: within a lot the earliest file comes first, then file names, then the place in the file
FIRST_BY = ["arrived", "src_file", "place"]


def _listing_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which the files of a lot are listed by a few tasks per core.

    By default every file of a lot has a listing task of its own, whose result goes to the driver.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(LISTING_TASKS, 2 * spark.sparkContext.defaultParallelism)
    return own


def _files(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """``src_file, arrived, value`` of whole text files as they come."""
    files = _listing_session(spark).readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return files.load(path).select(
        F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_modification_time").alias("arrived"), "value"
    )


def stream_docking_logs(
    spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """``ligand, arrived, modes, finished, ok`` of the logs in a folder as they come."""
    files = _files(spark, path, files_per_batch).select(ligand_of_path(F.col("src_file")).alias("ligand"), "arrived", "value")
    return parse_logs(files).drop("value")


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of a stream's rows the first one of every ligand.

    A ligand that turns up for the first time keeps its first row of that lot by ``FIRST_BY``; later rows are dropped.
    Rows of a ligand pass in batches and only the best so far is held.
    """

    def choose(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        known, best = state.exists, None
        for frame in frames:
            if not known:
                here = frame.sort_values(FIRST_BY, kind="stable").head(1)
                best = here if best is None else min(best, here, key=lambda f: tuple(f[FIRST_BY].iloc[0]))
        if best is not None:
            state.update((True,))
            yield best

    return rows.groupBy("ligand").applyInPandasWithState(choose, rows.schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def stream_first_logs(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``ligand, arrived, modes, finished, ok`` of every ligand's first log."""
    files = _files(spark, path, files_per_batch)
    named = files.select(ligand_of_path(F.col("src_file")).alias("ligand"), "arrived", "src_file", F.lit(0).alias("place"), "value")
    return parse_logs(first_of_each(named).drop("src_file", "place")).drop("value")


def stream_first_poses(spark: SparkSession, path: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """``ligand, lines`` of the first model of every ligand in PDBQT files."""
    files = _files(spark, path, files_per_batch)
    pieces = F.posexplode(F.split("value", f"\n{END_MARK}")).alias("place", "value")
    models = models_in(files.select("arrived", "src_file", pieces))
    rows = models.select("ligand", "arrived", "src_file", "place", F.array_join("lines", "\n").alias("value"))
    return first_of_each(rows).select("ligand", F.split("value", "\n").alias("lines"))


def append_table(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's rows to a parquet table; a lot that is run again replaces its own files."""
    writer = rows.writeStream.format("parquet").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_summary(logs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every log's summary row to a parquet table."""
    return append_table(docking_summary(logs), path, checkpoint, once)
