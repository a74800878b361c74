"""Exact ranks, cuts and first/last picks that never put a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molweave.session import materialise

_BUCKETS = 1024
# up to this many rows a plain window is as good as a range partitioning
SMALL_ROWS = 200_000


def last_by_name(df: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Among rows of one name keep the last. Duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in (name, order)]
    picked = df.groupBy(name).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return picked.select(name, f"_last.{order}", *(f"_last.{c}" for c in rest)).select(*df.columns)


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group for a small fixed ``k``.

    The rank filter lets Spark cut every group to ``k`` rows per map task before it is shuffled, so a
    hot group costs no more than a cold one.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def exact_rank(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    rank: str = "rank",
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """``row_number()`` per group without one task per group.

    Up to ``small_rows`` rows in all (counted) this is a plain window. Beyond, rows are range-partitioned on group and order, so a large group is spread over many chunks; the
    rank is the place inside the chunk plus the sizes of the group's earlier chunks. The chunked rows
    are written once, so that both readers see the same chunks.
    """
    by = list(by)
    if df.limit(small_rows + 1).count() <= small_rows:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    spark = df.sparkSession
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    placed = df.repartitionByRange(chunks, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    placed = materialise(placed, "ranked")
    earlier = (
        Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = placed.groupBy(*by, "_chunk").agg(F.count("*").alias("_rows"))
    sizes = sizes.select(
        *by, "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    ranked = placed.withColumn("_inside", F.row_number().over(inside))
    # a group's key may be null
    sizes = sizes.select("_before", *(F.col(c).alias(f"_of_{i}") for i, c in enumerate([*by, "_chunk"])))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate([*by, "_chunk"])))
    return ranked.join(sizes, same).select(*df.columns, (F.col("_inside") + F.col("_before")).alias(rank))


def top_by_score(
    df: DataFrame, by: Sequence[str], score: str, tie: str, cut: str = "cut"
) -> DataFrame:
    """Rows among the first ``cut`` of their group by ``score`` descending, then ``tie``.

    ``score`` lies in [0, 1] and ``cut`` is constant inside a group and may grow with the data. A
    histogram per group (pre-aggregated, at most 1025 rows) finds the bucket that holds the cut; the
    buckets above are kept as they are and only the rows of that one bucket are ranked.
    """
    by = list(by)
    rows = materialise(
        df.withColumn("_bucket", F.floor(F.col(score) * _BUCKETS).cast("int")), "scored"
    )
    counted = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"), F.max(cut).alias("_cut"))
    downward = (
        Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = counted.withColumn("_upto", F.sum("_rows").over(downward))
    whole = F.col("_upto") <= F.col("_cut")
    split = ~whole & (F.col("_upto") - F.col("_rows") < F.col("_cut"))
    limits = counted.groupBy(*by).agg(
        F.min(F.when(whole, F.col("_bucket"))).alias("_floor"),
        F.max(F.when(split, F.col("_bucket"))).alias("_edge"),
        F.max(F.when(split, F.col("_cut") - F.col("_upto") + F.col("_rows"))).alias("_need"),
    )
    marked = rows.join(limits, by)
    drop = ("_bucket", "_floor", "_edge", "_need")
    sure = marked.where(F.col("_bucket") >= F.col("_floor")).drop(*drop)
    edge = marked.where(F.col("_bucket") == F.col("_edge"))
    picked = exact_rank(edge, by, [F.desc(score), F.asc(tie)], "_rank")
    picked = picked.where(F.col("_rank") <= F.col("_need")).drop("_rank", *drop)
    return sure.unionByName(picked)


def percent_cut(percent: float, rows: Column) -> Column:
    """How many rows a percentage keeps: computed in double, then truncated."""
    return F.floor(F.lit(percent / 100.0) * rows.cast("double")).cast("long")
