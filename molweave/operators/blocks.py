"""All-against-all work on packed fingerprints, one bounded block of pairs per step.

Comparing two sets of n and m fingerprints costs n*m comparisons however it is written; what can be
avoided is turning every pair into a row. Here a block of left rows meets a block of right rows as two
bit matrices, one matrix product gives all their shared-bit counts, and only what the caller needs
(best k, sums, kept pairs) leaves the block.

* Right side within ``BLOCK_ROWS`` and ``BLOCK_BYTES`` (measured, not assumed): it is sent to the tasks once and the left
  side is not shuffled at all.
* A right side of more rows within ``BLOCK_BYTES`` is sent once too; the left side is dealt over the tasks and a task goes
  through the right side block by block. Where pairs themselves are the result (:class:`Lists`), a left row leaves the task once
  per block, with its numbers as lists, and Spark makes rows of them next to the names of the block.
* Otherwise both sides are cut into hashed chunks and every pair of chunks is one cogroup. Chunk sizes
  depend on row counts only, never on key values, so there are no hot groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_ROWS = 4096
BLOCK_BYTES = 64 << 20
#: rows of a right side that is sent whole and met block by block; its bytes are bounded too
SENT_ROWS = 1 << 20
#: rows of one batch that leaves a block
OUT_ROWS = 1 << 16
#: left rows whose pairs with a block are made at a time, where pairs are the result
LIST_ROWS = 64
# a left chunk is worked through in steps, so it may be larger than a right one
LEFT_BLOCKS = 16
STEP_ROWS = 1024

Kernel = Callable[[pa.Table, pa.Table], pa.Table]
#: which cells of two blocks are pairs, and the numbers of some cells; it is given what picks them from a matrix
Cells = tuple[np.ndarray, Callable[[Callable[[np.ndarray], np.ndarray]], list[pa.Array]]]


class Lists(NamedTuple):
    """Pairs as lists: ``cells`` of two blocks, the columns of left and right rows by their names in the result, and the numbers."""

    cells: Callable[[pa.Table, pa.Table], Cells]
    left: dict[str, str]
    right: dict[str, str]
    numbers: list[str]


def word_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """``array<bigint>`` column as an (n, words) matrix."""
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 1), dtype=np.int64)
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def bit_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """``array<bigint>`` column as an (n, bits) matrix of 0 and 1."""
    return unpacked(word_matrix(column))


def unpacked(words: np.ndarray) -> np.ndarray:
    """An (n, words) matrix as an (n, bits) matrix of 0 and 1."""
    packed = np.ascontiguousarray(words).view(np.uint8)
    return np.unpackbits(packed, axis=1, bitorder="little").astype(np.float32)


def tanimoto(left: np.ndarray, right: np.ndarray, empty: float) -> np.ndarray:
    """Similarity matrix of two bit matrices; ``empty`` is the value for two empty vectors."""
    if not len(left) or not len(right):
        return np.zeros((len(left), len(right)))
    shared = (left @ right.T).astype(np.float64)
    mine, other = left.sum(axis=1, dtype=np.float64), right.sum(axis=1, dtype=np.float64)
    union = mine[:, None] + other
    union -= shared
    none = np.flatnonzero(mine == 0), np.flatnonzero(other == 0)
    if len(none[0]) and len(none[1]):
        spot = np.ix_(*none)
        shared[spot], union[spot] = empty, 1.0
    return np.divide(shared, union, out=shared)


def once(prepare: Callable[[pa.Table], object]) -> Callable[[pa.Table], object]:
    """``prepare`` for right sides: run once for a right side, however many left steps meet it."""
    last: list = [None, None]

    def prepared(right: pa.Table) -> object:
        if last[0] is not right:
            last[:] = right, prepare(right)
        return last[1]

    return prepared


def _stepped(kernel: Kernel, left: pa.Table, right: pa.Table):
    for start in range(0, left.num_rows, STEP_ROWS):
        yield kernel(left.slice(start, STEP_ROWS), right)


def small_side(df: DataFrame, limit: int = BLOCK_ROWS) -> pa.Table | None:
    """The rows of ``df`` if they are at most ``limit`` and ``BLOCK_BYTES``, else None."""
    # sizes are measured before anything is pulled: a list column may make few rows large
    sizes = [F.octet_length(F.to_json(F.struct(c))) if "<" in t else F.lit(16) for c, t in df.dtypes]
    rows = df.limit(limit + 1).select(reduce(Column.__add__, sizes).cast("long").alias("_bytes"))
    count, size = rows.agg(F.count("*"), F.sum("_bytes")).first()
    if count > limit or (size or 0) > 2 * BLOCK_BYTES:
        return None
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit and table.nbytes <= BLOCK_BYTES else None


def block_apply(
    left: DataFrame,
    right: DataFrame,
    kernel: Kernel,
    schema: str,
    block_rows: int = BLOCK_ROWS,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    left_blocks: int = LEFT_BLOCKS,
    lists: Lists | None = None,
) -> DataFrame:
    """``kernel(left block, right block)`` over all pairs of blocks of two sets; ``lists`` may give the same pairs.

    ``merge`` puts the results of several right blocks together; with one right block every left row
    has its whole result already and ``merge`` is left out. A cogroup returns its result as one table:
    where pairs themselves are the output, ``left_blocks`` 1 and a small ``block_rows`` keep it bounded.
    """
    small = small_side(right, block_rows)
    if small is not None:
        shared = left.sparkSession.sparkContext.broadcast(small)

        def against_small(batches):
            for batch in batches:
                for out in _stepped(kernel, pa.Table.from_batches([batch]), shared.value):
                    yield from out.to_batches()

        return left.mapInArrow(against_small, schema)

    sent = small_side(right, SENT_ROWS)
    if sent is not None and lists:
        return _unfolded(left.repartition(_parts(left, sent, block_rows)), sent, lists, schema, block_rows)
    if sent is not None:
        parts = _against_sent(left.repartition(_parts(left, sent, block_rows)), sent, kernel, schema, block_rows)
        return merge(parts) if merge else parts

    n_left, n_right = _chunks(left, left_blocks * block_rows), _chunks(right, block_rows)
    left = _numbered(left, n_left, "_l").withColumn("_r", F.explode(_numbers(n_right)))
    right = _numbered(right, n_right, "_r").withColumn("_l", F.explode(_numbers(n_left)))
    parts = _cogrouped(left, right, kernel, schema)
    return merge(parts) if merge else parts


def _parts(left: DataFrame, sent: pa.Table, block_rows: int) -> int:
    """Parts of a left side: one per block of pairs, and no more than keep all cores busy to the end."""
    blocks = math.ceil(left.count() / block_rows) * math.ceil(max(1, sent.num_rows) / block_rows)
    return max(1, min(blocks, 16 * left.sparkSession.sparkContext.defaultParallelism))


def _against_sent(left: DataFrame, sent: pa.Table, kernel: Kernel, schema: str, block_rows: int, order: str | None = None) -> DataFrame:
    """``kernel`` of left rows and a right side that every task holds, block by block.

    With ``order`` only blocks that hold a smaller ``order`` than some row of the left step are visited.
    """
    shared = left.sparkSession.sparkContext.broadcast(sent)
    names, step = StructType.fromDDL(schema).names, min(STEP_ROWS, block_rows)

    def run(batches):
        blocks = [shared.value.slice(at, block_rows) for at in range(0, max(1, shared.value.num_rows), block_rows)]
        least = [pc.min(b[order]).as_py() if order else None for b in blocks]
        for batch in batches:
            steps = [pa.Table.from_batches([batch.slice(at, step)]) for at in range(0, batch.num_rows, step)]
            most = [pc.max(part[order]).as_py() if order else None for part in steps]
            # a kernel may prepare a right block, so all steps meet it before the next one
            for block, low in zip(blocks, least, strict=True):
                for part, high in zip(steps, most, strict=True):
                    if order and (low is None or high is None or low >= high):
                        continue
                    yield from kernel(part, block).select(names).combine_chunks().to_batches(OUT_ROWS)

    return left.mapInArrow(run, schema)


def _unfolded(left: DataFrame, sent: pa.Table, lists: Lists, schema: str, block_rows: int, order: str | None = None) -> DataFrame:
    """Pairs of left rows and a right side that every task holds. A row per left row and block leaves a task; what the rows of
    a block are called is joined to it, and a pair is a place in both."""
    number = pa.array(np.arange(sent.num_rows, dtype=np.int32) // block_rows)
    listed = ", ".join(f"{n} array<double>" for n in lists.numbers)
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema)}
    own = ", ".join(f"{n} {kinds[n]}" for n in lists.left)

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        parts = []
        for at in range(0, l.num_rows, LIST_ROWS):
            part = l.slice(at, LIST_ROWS)
            wanted, numbers = lists.cells(part, r)
            # up to the last pair of a row
            count = np.where(wanted.any(axis=1), wanted.shape[1] - np.argmax(wanted[:, ::-1], axis=1), 0) if wanted.size else np.zeros(part.num_rows, np.int64)
            held = np.arange(wanted.shape[1]) < count[:, None]
            pick = np.ravel if held.all() else lambda matrix, held=held: matrix[held]
            flat, shown = numbers(pick), pick(wanted)
            ends = pa.array(np.append(0, np.cumsum(count)), pa.int32())
            if not shown.all():
                flat = [pc.if_else(pa.array(shown), f, None) for f in flat]
            columns = {n: part[c] for n, c in lists.left.items()}
            columns["_block"] = np.full(part.num_rows, r["_block"][0].as_py() if r.num_rows else 0, np.int32)
            columns |= {n: pa.ListArray.from_arrays(ends, f) for n, f in zip(lists.numbers, flat, strict=True)}
            parts.append(pa.table(columns).filter(pa.array(count > 0)))
        return pa.concat_tables(parts)

    found = _against_sent(left, sent.append_column("_block", number), kernel, f"{own}, _block int, {listed}", block_rows, order)
    ends = pa.array(np.append(np.arange(0, sent.num_rows, block_rows), sent.num_rows), pa.int32())
    held = {f"_{n}": pa.ListArray.from_arrays(ends, _one(sent[c])) for n, c in lists.right.items()}
    blocks = left.sparkSession.createDataFrame(pa.table({"_block": pa.array(np.arange(len(ends) - 1), pa.int32()), **held}))
    # the names of the sent side, whose bytes are bounded
    met = found.join(F.broadcast(blocks), "_block")
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.size(lists.numbers[0]) - 1)).alias("_at"))
    values = [F.get(f"_{n}" if n in lists.right else n, F.col("_at")).alias(n) if n not in lists.left else F.col(n) for n in kinds]
    return met.select(*values).where(F.col(lists.numbers[0]).isNotNull())


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole


def block_apply_self(
    df: DataFrame, kernel: Kernel, schema: str, block_rows: int = BLOCK_ROWS, order: str | None = None, lists: Lists | None = None
) -> DataFrame:
    """``kernel`` over the pairs of one set; every unordered pair of blocks is visited once.

    ``order`` names the number that ``kernel`` compares, if it hands on pairs with a smaller one on the right only: where the
    set is sent to the tasks, a left row meets the blocks with smaller ones.


    The kernel sees (block, block) for the pairs inside a block and (block, other block) for the rest;
    rows carry ``_l`` and ``_r`` so that it can tell the two apart (see :func:`same_block`).
    """
    small = small_side(df, block_rows)
    if small is not None:
        # few rows but many pairs: give every core some of them
        spread = df.repartition(df.sparkSession.sparkContext.defaultParallelism)
        return block_apply(spread, df, kernel, schema, block_rows)
    sent = small_side(df, SENT_ROWS)
    if sent is not None:
        parts = _parts(df, sent, block_rows)
        spread = df.repartitionByRange(parts, order).sortWithinPartitions(order) if order else df.repartition(parts)
        sent = sent.sort_by(order) if order else sent
        if lists:
            return _unfolded(spread, sent, lists, schema, block_rows, order)
        return _against_sent(spread, sent, kernel, schema, block_rows, order)
    n = _chunks(df, block_rows)
    rows = _numbered(df, n, "_c")
    left = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.col("_c"))))
    right = rows.withColumn("_l", F.explode(F.sequence(F.col("_c"), F.lit(n - 1))))
    return _cogrouped(
        left.withColumnRenamed("_c", "_l"), right.withColumnRenamed("_c", "_r"), kernel, schema
    )


def same_block(left: pa.Table) -> bool:
    """True where left and right hold the same rows, so a pair would be seen in both directions."""
    if "_l" not in left.column_names:
        return True
    return left.num_rows > 0 and left["_l"][0].as_py() == left["_r"][0].as_py()


def _chunks(df: DataFrame, block_rows: int) -> int:
    return max(1, math.ceil(df.count() / block_rows))


def _numbered(df: DataFrame, chunks: int, column: str) -> DataFrame:
    """Spread rows over ``chunks`` by a hash of the whole row."""
    return df.withColumn(column, F.pmod(F.xxhash64(*df.columns), F.lit(chunks)).cast("int"))


def _numbers(chunks: int):
    return F.sequence(F.lit(0), F.lit(chunks - 1))


def _cogrouped(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    names = StructType.fromDDL(schema).names

    def run(l_rows: pa.Table, r_rows: pa.Table) -> pa.Table:
        parts = list(_stepped(kernel, l_rows, r_rows))
        if not parts:
            parts = [kernel(l_rows, r_rows)]
        return pa.concat_tables(parts).select(names)

    # both sides may come from one table: give the right side columns of its own
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    return left.groupBy("_l", "_r").cogroup(right.groupBy("_l", "_r")).applyInArrow(run, schema)
