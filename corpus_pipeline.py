"""A training-data pipeline over the documents table. Counted as part of the llm subpackage.

Every stage takes all that its predecessor kept and is written as Parquet before the next one reads it. All but the
last return the columns they got. Rows with null ids or texts and repeated rows pass through the same rules: a null
text has no language and leaves in the first stage, of repeated rows one stays in the second. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.llm.bpe import bpe_roundtrip
from molweave.llm.decontaminate import decontaminate
from molweave.llm.language import NO_LANGUAGE, fit, predict
from molweave.llm.pii import QUERY_KEY, replace_pii
from molweave.llm.simhash import fingerprints, near_fingerprints
from molweave.session import materialise

#: row numbers (8 bytes each) that are sent to every task at most; more meet the documents in a shuffle join
SEND_ROWS = 4_000_000


#: the setting of the session that holds the key of surrogates; without it they are drawn with the query's public one
KEY_SETTING = "spark.molweave.surrogateKey"

#: documents of one Arrow batch, and characters that the last stage encodes at once: workers and executors of five
#: stages share their memory
BATCH_ROWS, LOT_CHARS = 1_000, 500_000
#: pieces that a task of the last stage holds
PIECES = 300_000


def _small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of this session, unless it has a setting of its own."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, str(BATCH_ROWS))


def _without(docs: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose ``key`` is in the one-column table ``dropped``."""
    few = dropped.count() <= SEND_ROWS
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def _aside(docs: DataFrame, taken: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with its columns named like an operator's outputs out of the way, and how to get all columns back."""
    away = {c: f"__in_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(away), {c: F.col(away.get(c, c)).alias(c) for c in docs.columns}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; a missing ``lang`` is filled in. Texts that are null or have no letter go.

    Where no row names a language, nothing is learned: texts with a letter stay and ``lang`` stays missing.
    """
    _small_batches(spark)
    model = fit(docs.select("doc_id", "text", "lang"))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    free, back = _aside(docs, ("lang_pred", "score"))
    back["lang"] = F.coalesce("lang", "lang_pred").alias("lang")
    return predict(free, model).where(F.col("lang_pred") != NO_LANGUAGE).select(*(back[c] for c in docs.columns))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the row of the smallest id stays (null ids last, then any one of equal rows)."""
    _small_batches(spark)
    free, back = _aside(docs, ("simhash", "__row"))
    coded = fingerprints(free)
    # rows are numbered in the written table, so that every later read sees the same numbers
    coded = materialise(coded.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = coded.select("__row", "simhash", "doc_id")
    near = near_fingerprints(rows.select(F.col("simhash").alias("fp")).distinct())
    first = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("__row").alias("row"))
    # copies are combined by fingerprint before groups are
    least = rows.groupBy(F.col("simhash").alias("fp")).agg(F.min(first).alias("first")).join(near, "fp")
    kept = least.groupBy("component").agg(F.min("first").alias("first"))
    dropped = rows.select("__row").join(kept.select(F.col("first.row").alias("__row")), "__row", "left_anti")
    return _without(coded, materialise(dropped, "dropped"), "__row").select(*back.values())


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; equal rows share the decision."""
    _small_batches(spark)
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    hit = decontaminate(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__key").where("n_hit > 0").select("__key").distinct()
    return _without(keyed, materialise(hit, "contaminated"), "__key").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts becomes surrogates; ``n_chars`` follows the new text. The session names the key."""
    free, back = _aside(docs, ("n_entities", "kinds"))
    if "n_chars" in back:
        back["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return replace_pii(free, spark.conf.get(KEY_SETTING, QUERY_KEY)).select(*back.values())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit) and whether they decode to its text."""
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded", "exact")]
    _small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    coded = bpe_roundtrip(docs.withColumn("__sha", F.sha2(text, 256)), keep=[*kept, "__sha"], lot_chars=LOT_CHARS, pieces=PIECES, kept=False)
    return coded.select(*kept, "n_tokens", "ids", (F.col("__sha") == F.sha2("decoded", 256)).alias("exact"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_dedup", simhash_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("pii_surrogates", pii_stage),
    ("byte_bpe", bpe_stage),
]

#: fingerprints, surrogates and token ids have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
