"""Session settings, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app: str = "molweave", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the session comes from spark-submit."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster other executors could not
    read it and it would be lost with its machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="molweave-")
    return _LOCAL_DIRS[context.applicationId]


def session_dir(spark: SparkSession) -> str:
    """This session's own folder inside the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/molweave-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the session's folder."""
    return f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the session's intermediate tables. Call it when no result that reads them is needed."""
    drop_table(spark, session_dir(spark))


def write_scratch(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """:func:`materialise`, and the path of the table, for :func:`drop_table`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table that no later result reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut at a replicated table, so a lost executor costs one file read and not a
    recomputation; the table also gives the optimiser true sizes. Unlike ``checkpoint()`` the input
    is computed once.
    """
    return write_scratch(df, name)[0]
