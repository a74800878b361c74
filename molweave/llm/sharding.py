"""Sharding by proportional stratified interleaving (operator 8).

Rows of a source are put in a seeded random order and get the fractional rank (rank - 1/2) / (rows of the source).
All rows are sorted by fractional rank and the order is cut into shards whose row counts differ by at most one, so
every shard holds the sources in the proportions of the whole. Only keys are sorted, never texts. Ranks come from
range-partitioned keys and the counts of partitions, so a source of any size is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molweave.session import materialise

from .common import table

SEED = 17
SHARDS = 24


def ranked(df: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the 1-based rank in the order of ``within`` and ``order``, per value of ``within``.

    Rows are range-partitioned by the whole order; the rank is the rank inside a partition plus the rows of the same
    group in earlier partitions. Ties of the whole order are ranked by the engine in some order.
    """
    group = [F.col(c).asc_nulls_first() for c in within]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id())
    # partitions are written before ranks are counted, so both see the same ones
    dealt = materialise(dealt, "dealt")
    seen = dealt.groupBy("__part", *within).agg(F.count("*").alias("__n"))
    # one row per partition and group that meets it
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1) if within else Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part", *within).orderBy(*order))
    local = dealt.withColumn("__rank", inside).alias("l")
    match = F.col("l.__part") == F.col("s.__part")
    for c in within:
        match &= F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = local.join(seen.alias("s"), match)
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("__rank") + F.col("__before")).alias(name))


def stratified_shards(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key, source, size, text_crc32, shard, slot) of every row.

    ``size`` is the UTF-8 length of the text plus 8. Shards have counts at most one apart; ``slot`` counts from 0 in
    every shard. A null text counts as empty, null sources are one source, repeated rows and null keys are rows of
    their own, an empty table gives an empty result.
    """
    keys = df.select(
        F.col(key).alias("id"), F.col(source).cast("string").alias("src"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
    )
    keys = keys.withColumn("mix", F.xxhash64("id", F.lit(seed)))
    ties = [F.col(c).asc_nulls_first() for c in ("mix", "id", "crc", "size")]
    first = materialise(ranked(keys, ["src"], ties, "rank"), "source_ranks")
    totals = first.groupBy(F.col("src").alias("__s")).agg(F.count("*").alias("n"))
    first = first.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, F.col("src").eqNullSafe(F.col("__s"))).drop("__s")
    placed = first.withColumn("part", (F.col("rank") - 0.5) / F.col("n"))
    # sources meet at equal fractions in an order of their own
    order = [F.col("part").asc(), F.xxhash64("src", F.lit(seed)).asc(), *ties, F.col("rank").asc()]
    whole = ranked(placed, [], order, "place")
    n = df.count()
    shard = F.floor((F.col("place") - 1) * shards / F.lit(n)).cast("int") if n else F.lit(0)
    begin = F.ceil(F.col("shard").cast("long") * F.lit(n) / shards)
    return whole.withColumn("shard", shard).select(
        F.col("id").alias(key), F.col("src").alias(source), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - 1 - begin).cast("long").alias("slot")
    )


def write_shards(df: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df`` below ``path``, a folder per shard, in slot order.

    A row finds its shard by its key, so null and repeated keys are refused before anything is written.
    """
    if not placed.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} must be unique and not null")
    rows = df.join(placed.select(key, "shard", "slot"), key)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
