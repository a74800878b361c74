"""Embedding near-duplicates by randomised-rotation binary codes (operator 3).

A vector of unit length is turned by a random rotation and kept as the signs of its coordinates; stored with it is
the correction factor a = <code, vector>. For a second rotated vector q, <code, q> / a estimates the inner product
without bias. A pair whose estimate lies below the bound of its confidence is dropped, every other pair is computed
exactly in double precision. The default bound is certain: acos<x,q> >= acos<code,q> - acos a, so no pair at or above
the threshold is ever dropped, and for 64 dimensions it is tighter than four standard errors of the estimate,
sqrt((1 - a^2) / a^2) / sqrt(D - 1). A bound of ``eps`` standard errors can be asked for instead where it is tighter.

Equal vectors are merged first. Codes, factors and rotated vectors are computed once and stored with them. Vectors of a
label are dealt over blocks of bounded size by hash and every pair of blocks is one task's work, in tiles; what leaves it
is a count per vector and a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.session import materialise

from .common import table
from .components import connected_components

THRESHOLD = 0.93
#: vectors of one label in a block
BLOCK = 2048
#: rows compared at once inside a task
TILE = 1024
SEED = 20

OUT = "id long, links long, other long"


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated vectors, sign bits packed, stored inner product of code and vector)."""
    turned = unit @ rotation(unit.shape[1], seed)
    signs = turned >= 0
    return turned, np.packbits(signs, axis=1), np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def survivors(bits: np.ndarray, a: np.ndarray, q: np.ndarray, threshold: float, eps: float | None = None) -> np.ndarray:
    """A boolean matrix: pairs of (code, rotated vector) that may reach the threshold."""
    size = q.shape[1]
    signs = (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(size))
    a = np.clip(a, 1e-9, 1.0)
    estimate = (signs @ q.astype(np.float32).T) / a[:, None]
    least = np.cos(np.minimum(np.arccos(a) + math.acos(threshold), math.pi)) / a
    if eps is not None:
        least = np.maximum(least, threshold - eps * np.sqrt((1 - a**2) / a**2) / math.sqrt(max(size - 1, 1)))
    # single precision of the product
    return estimate >= (least - 1e-5 / a)[:, None]


def coded(classes: DataFrame) -> DataFrame:
    """``classes`` (with ``v``, not zero) with ``bits``, ``factor`` and ``turned`` added: one rotation per vector."""
    schema = T.StructType([*classes.schema, *T.StructType.fromDDL("bits binary, factor double, turned array<float>")])
    place = classes.columns.index("v")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            bits, factor, turned = [None] * n, np.zeros(n), [None] * n
            vectors = batch.column(place)
            sizes = np.diff(vectors.offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                x = _matrix(vectors.take(pa.array(rows)))
                q, signs, a = codes(x / np.sqrt((x**2).sum(1))[:, None])
                factor[rows] = a
                for k, row in enumerate(rows.tolist()):
                    bits[row], turned[row] = signs[k].tobytes(), q[k].astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary()), pa.array(factor), pa.array(turned, pa.list_(pa.float32()))], names=schema.names)

    return classes.mapInArrow(run, schema)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a spanning forest of n vertices."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.values.to_numpy(zero_copy_only=False)[flat.offsets[0].as_py() : flat.offsets[-1].as_py()].reshape(len(flat), -1)


def compare_blocks(rows: pa.Table, threshold: float, eps: float | None) -> pa.Table:
    """Link counts and forest links of one pair of blocks. Columns: id, copies, vector, bits, factor, turned, left."""
    ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
    x = _matrix(rows["vector"])
    norms = np.sqrt((x**2).sum(1))
    turned, a = _matrix(rows["turned"]), rows["factor"].to_numpy()
    bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(len(ids), -1)
    same = rows["block_i"][0].as_py() == rows["block_j"][0].as_py()
    left = np.flatnonzero(rows["left"].to_numpy(zero_copy_only=False))
    right = left if same else np.flatnonzero(~rows["left"].to_numpy(zero_copy_only=False))
    links = np.zeros(len(ids), np.int64)
    tree_a, tree_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(left), TILE):
        li = left[i : i + TILE]
        for j in range(i if same else 0, len(right), TILE):
            rj = right[j : j + TILE]
            may = survivors(bits[li], a[li], turned[rj], threshold, eps)
            p, q = np.nonzero(may)
            p, q = li[p], rj[q]
            if same:
                p, q = p[(keep := p < q)], q[keep]
            for k in range(0, len(p), 1 << 16):
                pk, qk = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                cosine = np.einsum("ij,ij->i", x[pk], x[qk]) / (norms[pk] * norms[qk])
                pk, qk = pk[(hit := cosine >= threshold)], qk[hit]
                np.add.at(links, pk, copies[qk])
                np.add.at(links, qk, copies[pk])
                tree_a, tree_b = _forest(len(ids), np.concatenate([tree_a, pk]), np.concatenate([tree_b, qk]))
    some = np.flatnonzero(links)
    return pa.table(
        {
            "id": pa.array(np.concatenate([ids[some], ids[tree_a]]), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(tree_a), np.int64)]), pa.int64()),
            "other": pa.array(np.concatenate([np.full(len(some), -1), ids[tree_b]]), pa.int64(), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(tree_b), bool)])),
        }
    )


def embedding_groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, eps: float | None = None, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    Rows are compared when their labels are equal and not null. A vector that is null, empty, zero or holds a null
    or non-finite component links with nothing; so do vectors of different lengths. Rows with equal vectors link with one another.
    Rows of one key count as different rows, a null key gets its own component (null).
    """
    real = F.transform(F.col("v"), lambda c: c.cast("double"))
    base = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    base = base.withColumn("v", real)
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    fit &= F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    # scaled by the largest component, so that squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda c: F.abs(c)))
    # -0.0 and 0.0 are one value
    good = base.where(fit).withColumn("v", F.transform("v", lambda c: F.lit(0.0) + c / top))
    # a class: equal vectors of a label, known by its smallest id
    classes = good.groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = materialise(coded(classes), "vectors")
    members = materialise(good.join(classes.select("label", "v", "first", "copies"), ["label", "v"]).select("id", "first", "copies"), "vector_members")

    kind = [F.col("label"), F.size("v")]
    blocks = classes.groupBy(F.col("label").alias("l"), F.size("v").alias("w")).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    placed = classes.join(blocks, (kind[0] == F.col("l")) & (kind[1] == F.col("w")))
    own = F.pmod(F.xxhash64("first"), F.col("n")).cast("int")
    placed = placed.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    sides = placed.select(
        "l", "w", F.least("own", "with").alias("block_i"), F.greatest("own", "with").alias("block_j"),
        F.col("first").alias("id"), "copies", F.col("v").alias("vector"), "bits", "factor", "turned", (F.col("own") <= F.col("with")).alias("left"),
    )

    def run(rows: pa.Table) -> pa.Table:
        return compare_blocks(rows, threshold, eps)

    found = materialise(sides.groupBy("l", "w", "block_i", "block_j").applyInArrow(run, OUT), "vector_links")
    linked = found.where("other is null").groupBy(F.col("id").alias("first")).agg(F.sum("links").alias("links"))
    ends = connected_components(found.where("other is not null"), "id", "other").withColumnRenamed("id", "first")
    of = members.join(linked, "first", "left").join(ends, "first", "left")
    of = of.select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    alone = base.where(~F.coalesce(fit, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return of.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


#: every pair of a label by plain double arithmetic, components by everything that can be reached
OP3_SQL = """
WITH RECURSIVE
good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT vec_id, y FROM reach JOIN pair ON x = other),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT x AS vec_id, count(*) AS n FROM pair GROUP BY x)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN least USING (vec_id) LEFT JOIN links USING (vec_id)
"""
