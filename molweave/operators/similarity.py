"""Tanimoto similarity between sets of fingerprints.

Vectors are rows ``name, ord, words``. All comparisons run as blocks (:mod:`molweave.operators.blocks`).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.functions.text import fixed4
from molweave.operators.blocks import (
    BLOCK_ROWS,
    Cells,
    Lists,
    bit_matrix,
    block_apply,
    block_apply_self,
    once,
    same_block,
    small_side,
    tanimoto,
    word_matrix,
)
from molweave.operators.ranking import first_per_group, percent_cut, top_by_score

EMPTY_SIMILARITY = 1.0
MEAN_DIGITS = 9
#: rows of a block where every pair is a row of the result: at most about a million rows per cogroup
PAIR_ROWS = 1024
#: vectors that are sent to the tasks where whole matrix lines are made; their bytes are bounded too (see :func:`small_side`)
SENT_ROWS = 1 << 20
#: distances of matrix lines that are made at a time
LINE_CELLS = 1 << 21
#: different pairs of shared and set bits whose texts a task keeps
LINE_TEXTS = 1 << 22
#: how near to a half a number may come before its decimal digits decide how it is rounded
NEAR_HALF = 1e-5


def _similarity(left: pa.Table, right: pa.Table, empty: float, words: str = "words") -> np.ndarray:
    return tanimoto(bit_matrix(left[words]), bit_matrix(right[words]), empty)


def _rounded(values: np.ndarray, digits: int | None, *also) -> list[pa.Array]:
    """Values, and what the functions ``also`` make of them, rounded half up in decimal as SQL does; as they are without ``digits``."""
    return [pa.array(v if digits is None else _half_up(v, digits), pa.float64()) for v in (values, *(f(values) for f in also))]


def _half_up(values: np.ndarray, digits: int) -> np.ndarray:
    size = 10.0**digits
    scaled = np.abs(values) * size
    whole = np.floor(scaled + 0.5)
    # near a half the decimal digits of the number decide
    near = np.flatnonzero(np.abs(whole - scaled) > 0.5 - NEAR_HALF)
    whole = np.copysign(whole / size, values)
    if len(near):
        known, place = np.unique(values[near], return_inverse=True)
        grid = Decimal(1).scaleb(-digits)
        whole[near] = np.array([float(Decimal(repr(v)).quantize(grid, ROUND_HALF_UP)) for v in known.tolist()])[place]
    return whole


def _spots(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the wanted cells, in order."""
    if not wanted.all():
        return np.nonzero(wanted)
    rows, columns = wanted.shape
    return np.repeat(np.arange(rows), columns), np.tile(np.arange(columns), rows)


def similarity_pairs(
    left: DataFrame,
    right: DataFrame,
    empty: float = EMPTY_SIMILARITY,
    keep_zero: bool = False,
    block_rows: int = PAIR_ROWS,
    digits: int | None = None,
) -> DataFrame:
    """``left_name, right_name, sim`` of two sets; pairs without a shared bit are left out by default.

    ``digits`` rounds in the block.
    """

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        sim = _similarity(l, r, empty)
        i, j = _spots(sim >= 0 if keep_zero else sim > 0)
        return pa.table(
            {"left_name": l["name"].take(i), "right_name": r["name"].take(j), "sim": _rounded(sim[i, j], digits)[0]}
        )

    bits = once(lambda r: bit_matrix(r["words"]))

    def cells(l: pa.Table, r: pa.Table) -> Cells:
        sim = tanimoto(bit_matrix(l["words"]), bits(r), empty)
        return sim >= 0 if keep_zero else sim > 0, lambda some: _rounded(some(sim), digits)

    schema = "left_name string, right_name string, sim double"
    columns = ["name", "words"]
    lists = Lists(cells, {"left_name": "name"}, {"right_name": "name"}, ["sim"])
    return block_apply(
        left.select(*columns), right.select(*columns), kernel, schema, block_rows, left_blocks=1, lists=lists
    )


#: columns of the row with the larger ``ord``, and of the one with the smaller
ENDS = {"a": "name", "a_ord": "ord"}, {"b": "name", "b_ord": "ord"}


def _after(l: pa.Table, r: pa.Table) -> np.ndarray:
    return l["ord"].to_numpy()[:, None] > r["ord"].to_numpy()[None, :]


def distance_pairs(
    vectors: DataFrame, empty: float = EMPTY_SIMILARITY, block_rows: int = PAIR_ROWS, digits: int | None = None
) -> DataFrame:
    """Lower triangle of the distance matrix: ``a, b, a_ord, b_ord, sim, dist`` with ``a_ord > b_ord``.

    Its n(n-1)/2 rows are the result asked for; they are written by many tasks and never regrouped. ``digits`` rounds in
    the block.
    """

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        sim = _similarity(l, r, empty)
        lo, ro = l["ord"].to_numpy(), r["ord"].to_numpy()
        after = lo[:, None] > ro[None, :]
        first = [_spots(after)]
        if not same_block(l):
            first.append(_spots(lo[:, None] < ro[None, :]))
        ends = [t.select(["name", "ord"]) for t in (l, r)]
        parts = []
        for turned, (i, j) in enumerate(first):
            here = ends[0].take(i), ends[1].take(j)
            a, b = here[::-1] if turned else here
            similar, dist = _rounded(sim[i, j], digits, lambda v: 1.0 - v)
            parts.append(
                pa.table({"a": a["name"], "b": b["name"], "a_ord": a["ord"], "b_ord": b["ord"], "sim": similar, "dist": dist})
            )
        return pa.concat_tables(parts)

    bits = once(lambda r: bit_matrix(r["words"]))

    def cells(l: pa.Table, r: pa.Table) -> Cells:
        sim = tanimoto(bit_matrix(l["words"]), bits(r), empty)
        return _after(l, r), lambda some: _rounded(some(sim), digits, lambda v: 1.0 - v)

    schema = "a string, b string, a_ord bigint, b_ord bigint, sim double, dist double"
    rows = vectors.select("name", F.col("ord").cast("bigint").alias("ord"), "words")
    return block_apply_self(rows, kernel, schema, block_rows, "ord", Lists(cells, *ENDS, ["sim", "dist"]))


def most_similar(
    compounds: DataFrame,
    labelled: DataFrame,
    k: int,
    empty: float = EMPTY_SIMILARITY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` most similar labelled compounds of each compound: ``name, other, sim, rank``.

    Each block hands on ``k`` rows per compound; ties go to the smaller name.
    """

    order_of = once(lambda r: pc.sort_indices(r["name"]).to_numpy())

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        sim = _similarity(l, r, empty)
        if k < sim.shape[1]:
            edge = np.partition(sim, -k, axis=1)[:, -k][:, None]
            above = sim > edge
            tied = sim == edge
            room = k - above.sum(axis=1)[:, None]
            # ties go to the smaller name
            by_name = order_of(r)
            keep = above.copy()
            keep[:, by_name] |= tied[:, by_name] & (np.cumsum(tied[:, by_name], axis=1) <= room)
        else:
            keep = np.ones(sim.shape, dtype=bool)
        i, j = np.nonzero(keep)
        return pa.table({"name": l["name"].take(i), "other": r["name"].take(j), "sim": sim[i, j]})

    schema = "name string, other string, sim double"
    columns = ["name", "words"]
    best = block_apply(
        compounds.select(*columns), labelled.select(*columns), kernel, schema, block_rows
    )
    return first_per_group(best, ["name"], [F.desc("sim"), F.asc("other")], k)


def _memberships(right: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The subsets of a right side (``scope, subset, size``) and a matrix: which row is in which subset."""
    lists = right["groups"].combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    table = pa.table({n: flat.field(n) for n in ("scope", "subset", "size")})
    unique = table.group_by(["scope", "subset", "size"]).aggregate([])
    keys = zip(unique["scope"].to_pylist(), unique["subset"].to_pylist(), strict=True)
    index = {key: i for i, key in enumerate(keys)}
    place = [index[k] for k in zip(table["scope"].to_pylist(), table["subset"].to_pylist(), strict=True)]
    member = np.zeros((right.num_rows, len(index)))
    member[owner, place] = 1.0
    return unique, member


def mean_similarity(
    base: DataFrame,
    labelled: DataFrame,
    members: DataFrame,
    empty: float = EMPTY_SIMILARITY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean similarity of every base compound to every subset: ``subset, name, avg_sim``.

    ``members`` holds ``subset, name``; a member without a vector still counts in the divisor. When
    ``base`` has an ``array<bigint>`` column ``scopes`` and ``members`` a column ``scope``, a base
    compound is compared only with the subsets of its scopes, and ``scope`` is in the result.

    A block multiplies its similarities with the membership matrix, so a compound gives one row per
    subset and not one per pair.
    """
    scoped = "scope" in members.columns
    keys = ["scope", "subset"] if scoped else ["subset"]
    listed = members if scoped else members.withColumn("scope", F.lit(None).cast("bigint"))
    sizes = listed.groupBy("scope", "subset").agg(F.count("*").alias("size"))
    weighted = listed.join(
        sizes.withColumnRenamed("scope", "_s").withColumnRenamed("subset", "_u"),
        F.col("scope").eqNullSafe(F.col("_s")) & (F.col("subset") == F.col("_u")),
    ).drop("_s", "_u")
    groups = weighted.groupBy("name").agg(
        F.collect_list(F.struct("scope", "subset", "size")).alias("groups")
    )
    right = labelled.select("name", "words").join(groups, "name")
    left = base.select("name", "words", *(["scopes"] if scoped else []))

    memberships = once(_memberships)

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        sim = _similarity(l, r, empty)
        unique, member = memberships(r)
        part = (sim @ member) / unique["size"].to_numpy()
        if scoped:
            scopes = l["scopes"].combine_chunks()
            if isinstance(scopes, pa.ChunkedArray):
                scopes = pa.concat_arrays(scopes.chunks)
            row = pc.list_parent_indices(scopes).to_numpy(zero_copy_only=False)
            known, column = np.unique(unique["scope"].to_numpy(), return_inverse=True)
            has = np.zeros((l.num_rows, len(known)), dtype=bool)
            value = scopes.flatten().to_numpy(zero_copy_only=False)
            spot = np.searchsorted(known, value)
            good = (spot < len(known)) & (known[np.minimum(spot, len(known) - 1)] == value)
            has[row[good], spot[good]] = True
            i, j = np.nonzero(has[:, column])
        else:
            i, j = (a.ravel() for a in np.indices(part.shape))
        out = {"subset": unique["subset"].take(j), "name": l["name"].take(i), "part": part[i, j]}
        if scoped:
            out = {"scope": unique["scope"].take(j), **out}
        return pa.table(out)

    schema = ("scope bigint, " if scoped else "") + "subset bigint, name string, part double"

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys, "name").agg(F.sum("part").alias("part"))

    parts = block_apply(left, right, kernel, schema, block_rows, merge)
    # sums differ in the last digits with their order; equal means must tie whatever the block layout
    return parts.select(*keys, "name", F.round("part", MEAN_DIGITS).alias("avg_sim"))


def top_similar(means: DataFrame, rows: int | DataFrame, percent: float) -> DataFrame:
    """The top ``percent`` of base compounds per subset by mean similarity.

    ``rows`` is the number of base compounds, or a table ``scope, n`` with one number per scope.
    """
    if isinstance(rows, int):
        counted, by = means.withColumn("n", F.lit(rows)), ["subset"]
    else:
        counted, by = means.join(rows, "scope"), ["scope", "subset"]
    counted = counted.withColumn("cut", percent_cut(percent, F.col("n"))).drop("n")
    return top_by_score(counted, by, "avg_sim", "name").drop("cut")


def blend(first: np.ndarray, second: np.ndarray, coefficient: float) -> np.ndarray:
    """Distances of two spaces as one."""
    return (first + second * coefficient) / (1 + coefficient)


def blended_pairs(
    vectors: DataFrame,
    coefficient: float,
    empty: float = EMPTY_SIMILARITY,
    block_rows: int = PAIR_ROWS,
    digits: int | None = None,
) -> DataFrame:
    """Lower triangle of the blended distances of two spaces: ``a, b, a_ord, b_ord, dist``. ``digits`` rounds in the block.

    ``vectors`` holds ``name, ord, words, words2``. Both similarities of a pair are made and blended in
    the block where its rows meet.
    """

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        first, second = (1.0 - _similarity(l, r, empty, w) for w in ("words", "words2"))
        dist = blend(first, second, coefficient)
        lo, ro = l["ord"].to_numpy(), r["ord"].to_numpy()
        sides = [(l, r, dist, lo[:, None] > ro[None, :])]
        if not same_block(l):
            sides.append((r, l, dist.T, ro[:, None] > lo[None, :]))
        parts = []
        for a, b, d, after in sides:
            i, j = _spots(after)
            columns = {"a": a["name"].take(i), "b": b["name"].take(j)}
            columns |= {"a_ord": a["ord"].take(i), "b_ord": b["ord"].take(j), "dist": _rounded(d[i, j], digits)[0]}
            parts.append(pa.table(columns))
        return pa.concat_tables(parts)

    bits = once(lambda r: [(w, bit_matrix(r[w])) for w in ("words", "words2")])

    def cells(l: pa.Table, r: pa.Table) -> Cells:
        first, second = (1.0 - tanimoto(bit_matrix(l[w]), other, empty) for w, other in bits(r))
        dist = blend(first, second, coefficient)
        return _after(l, r), lambda some: _rounded(some(dist), digits)

    schema = "a string, b string, a_ord bigint, b_ord bigint, dist double"
    rows = vectors.select("name", F.col("ord").cast("bigint").alias("ord"), "words", "words2")
    return block_apply_self(rows, kernel, schema, block_rows, "ord", Lists(cells, *ENDS, ["dist"]))


def similarity_stats(
    compounds: DataFrame,
    labelled: DataFrame,
    empty: float = EMPTY_SIMILARITY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Largest and mean similarity of every compound to the labelled ones, 0 where there are none.

    A block hands on one row per compound: maximum, sum and count.
    """

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        sim = _similarity(l, r, empty)
        some = sim.shape[1] > 0
        return pa.table(
            {
                "name": l["name"],
                "max_sim": sim.max(axis=1) if some else np.zeros(len(sim)),
                "total": sim.sum(axis=1),
                "n": np.full(len(sim), sim.shape[1], dtype=np.int64),
            }
        )

    schema = "name string, max_sim double, total double, n bigint"
    columns = ["name", "words"]
    parts = block_apply(compounds.select(*columns), labelled.select(*columns), kernel, schema, block_rows)
    mean = F.try_divide(F.sum("total"), F.sum("n")).alias("avg_sim")
    stats = parts.groupBy("name").agg(F.max("max_sim").alias("max_sim"), mean)
    zero = F.lit(0.0)
    return compounds.select("name").join(stats, "name", "left").select(
        "name",
        F.coalesce("max_sim", zero).alias("max_sim"),
        F.coalesce("avg_sim", zero).alias("avg_sim"),
    )


def select_by_names(vectors: DataFrame, names: DataFrame) -> DataFrame:
    """Vectors named in ``names`` (``name, pos``), in list order."""
    return vectors.join(names, "name").orderBy("pos")


def keep_present(candidates: DataFrame, other: DataFrame) -> DataFrame:
    """Candidates that also have a vector in the other feature space."""
    return candidates.join(other.select("name").distinct(), "name", "left_semi")


def _fragments(vectors: DataFrame, empty: float, block_rows: int) -> DataFrame:
    """Matrix cells as ``ord, cells``: one row per compound and block, with the distances (``%.4f``) to the block's earlier
    compounds in order."""

    def cells(rows: pa.Table, others: pa.Table, dist: np.ndarray) -> pa.Table:
        mine, theirs = rows["ord"].to_numpy(), others["ord"].to_numpy()
        order = np.argsort(theirs, kind="stable")
        count = np.searchsorted(theirs[order], mine)
        inside = np.arange(len(order))[None, :] < count[:, None]
        text = pa.array(list(map("%.4f".__mod__, dist[:, order][inside].tolist())), pa.string())
        place = np.broadcast_to(theirs[order], inside.shape)[inside]
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays([pa.array(place, pa.int64()), text], ["o", "d"])
        )
        return pa.table({"ord": pa.array(mine, pa.int64()), "cells": lists}).filter(pa.array(count > 0))

    def kernel(l: pa.Table, r: pa.Table) -> pa.Table:
        dist = 1.0 - _similarity(l, r, empty)
        parts = [cells(l, r, dist)]
        if not same_block(l):
            parts.append(cells(r, l, dist.T))
        return pa.concat_tables(parts)

    rows = vectors.select(F.col("ord").cast("bigint").alias("ord"), "words")
    return block_apply_self(rows, kernel, "ord bigint, cells array<struct<o: bigint, d: string>>", block_rows, "ord")


def _whole_lines(vectors: DataFrame, empty: float, ordered: bool) -> DataFrame | None:
    """Matrix lines made whole, each in one task that holds all vectors, so that no cell is shuffled. None if the vectors are
    too large to be sent, or if an ``ord`` repeats or is missing."""
    kind = vectors.schema["ord"].dataType.simpleString()
    rows = vectors.select("name", F.col("ord").cast("bigint").alias("ord"), "words")
    sent = small_side(rows.select("ord", "words"), SENT_ROWS)
    if sent is None or sent["ord"].null_count or pc.count_distinct(sent["ord"]).as_py() < sent.num_rows:
        return None
    sent = sent.sort_by("ord").combine_chunks()
    words = word_matrix(sent["words"]).view(np.uint64)
    shared = vectors.sparkSession.sparkContext.broadcast((sent["ord"].to_numpy(), words, np.bitwise_count(words).sum(1, dtype=np.int32)))
    step = max(1, LINE_CELLS // max(1, sent.num_rows))
    # later lines are longer, so there are more parts than cores
    parts = min(max(1, sent.num_rows // step), 16 * vectors.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "ord").sortWithinPartitions("ord") if ordered else rows.repartition(parts)

    def lines(batches):
        ords, words, sizes = shared.value
        texts = _Texts(64 * words.shape[1], empty)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                count = np.searchsorted(ords, part.column(1).to_numpy())
                mine = word_matrix(pa.chunked_array([part.column(2)])).view(np.uint64)
                text = pa.array([texts.line(row, words[:n], sizes[:n]) for row, n in zip(mine, count.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], ["name", "ord", "text"])

    made = rows.mapInArrow(lines, "name string, ord bigint, text string")
    return made.select(F.col("ord").cast(kind).alias("ord"), F.concat_ws("\t", "name", "text").alias("line"))


class _Texts:
    """Distances of one vector to others as ``%.4f``, with tabs between them.

    A distance follows from the shared bits and the sum of both sizes, so a task writes each different one once and puts
    the lines together from those. No vector is unpacked, so a line takes a few numbers per vector.
    """

    def __init__(self, width: int, empty: float):
        self.empty, self.base = empty, 2 * width + 1
        self.known = np.zeros((width + 1) * self.base, bool) if (width + 1) * self.base <= LINE_TEXTS else None
        self.texts = np.zeros(0 if self.known is None else len(self.known), "S7")
        self.plain = self.known is not None

    def line(self, mine: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> str | None:
        if not len(words):
            return None
        shared = np.zeros(len(words), np.int32)
        for k, word in enumerate(mine):
            shared += np.bitwise_count(words[:, k] & word)
        both = sizes + np.int32(np.bitwise_count(mine).sum())
        if self.plain:
            code = shared * self.base + both
            seen = np.zeros_like(self.known)
            seen[code] = True
            new = np.flatnonzero(seen & ~self.known)
            made = self._made(*divmod(new, self.base))
            self.plain = all(len(t) == self.texts.itemsize for t in made)
            if self.plain:
                self.texts[new] = made
                self.known |= seen
                return self.texts[code].tobytes()[:-1].decode()
        pairs, place = np.unique(shared.astype(np.int64) << 32 | both, return_inverse=True)
        made = np.array(self._made(pairs >> 32, pairs & 0xFFFFFFFF), dtype=object)
        return b"".join(made[place].tolist())[:-1].decode()

    def _made(self, shared: np.ndarray, both: np.ndarray) -> list[bytes]:
        union = (both - shared).astype(np.float64)
        sim = np.divide(shared, union, out=np.full(len(union), float(self.empty)), where=union > 0)
        return [b"%.4f\t" % d for d in (1.0 - sim).tolist()]


def lower_triangle_lines(
    vectors: DataFrame,
    pairs: DataFrame | None = None,
    empty: float = EMPTY_SIMILARITY,
    block_rows: int = PAIR_ROWS,
    ordered: bool = False,
) -> DataFrame:
    """Matrix lines ``ord, line``: the name, then one ``%.4f`` distance per earlier compound.

    A line is made whole in one task; where the vectors are too large to be sent to the tasks (measured) or numbers repeat, a
    block hands on one row per compound with its part of the line. ``pairs`` are distances to be used instead, a row each.
    ``ordered`` gives the lines in order, by sorting the vectors and not the lines where that is possible. One line holds one distance per earlier compound by definition of the format; use the pair table
    itself where that is too wide.
    """
    if pairs is None:
        whole = _whole_lines(vectors, empty, ordered)
        if whole is not None:
            return whole
        grouped = _fragments(vectors, empty, block_rows).groupBy("ord").agg(F.collect_list("cells").alias("parts"))
        # a compound that met one block only has its cells in order
        whole = F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(F.array_sort(F.flatten("parts")))
        cells = grouped.select("ord", whole.alias("cells"))
    else:
        cell = F.struct(F.col("b_ord").alias("o"), fixed4(F.col("dist")).alias("d"))
        cells = pairs.groupBy(F.col("a_ord").alias("ord")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    values = F.coalesce(F.col("cells.d"), F.array().cast("array<string>"))
    lines = (
        vectors.select("name", "ord")
        .join(cells, "ord", "left")
        .select("ord", F.array_join(F.concat(F.array("name"), values), "\t").alias("line"))
    )
    return lines.orderBy("ord") if ordered else lines
