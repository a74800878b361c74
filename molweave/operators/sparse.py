"""Similarity of wide fingerprints with few bits, by postings: which vectors have a bit.

Vectors are rows ``name, ord, words``. Where few vectors share a bit, only those that do ever meet; where most do, blocks of
vectors meet as bit matrices. The bits of a fingerprint are as many as its width, so a histogram over bits is small; it decides
how the work is cut, never what comes out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molweave.operators.blocks import BLOCK_ROWS, bit_matrix, block_apply, small_side, unpacked, word_matrix
from molweave.operators.ranking import first_per_group
from molweave.operators.similarity import EMPTY_SIMILARITY
from molweave.session import materialise

#: pairs of vectors that one task counts at once
UNIT = 4_000_000
#: vectors of a tile
TILE = 2048
#: blocks of vectors meet as bit matrices where of so many pairs of vectors and one more there is a meeting by a bit
RARE = 16
#: words that are unpacked at a time
STEP_WORDS = 16
#: partitions per core of two tables that meet in tiles
PARTS = 4
#: left vectors that are checked against a tile at a time
CHECK_ROWS = 256
#: left vectors whose similarities are summed at a time
SUM_ROWS = 64
#: vectors with one bit in a tile of the threshold join
PREFIX_TILE = 4096
EPSILON = 1e-9


def postings(vectors: DataFrame) -> DataFrame:
    """``bit, ord, n``: a row per set bit, with the vector's number of bits. Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = pa.Table.from_batches([batch.slice(at, TILE)])
                on = bit_matrix(part["words"])
                row, bit = np.nonzero(on)
                size = on.sum(1).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"bit": bit.astype(np.int32), "ord": part["ord"].to_numpy()[row], "n": size[row]})

    return vectors.select(F.col("ord").cast("bigint").alias("ord"), "words").mapInArrow(run, "bit int, ord bigint, n int")


def _together(left: DataFrame, right: DataFrame, keys: list[str], kernel, schema: str) -> DataFrame:
    """Cogroup two tables that may come from one: the right one gets columns of its own."""
    right = right.select(*(F.col(c).alias(c) for c in right.columns))
    # tiles are small tables with much to count, so partitions are not put together by their bytes
    parts = PARTS * left.sparkSession.sparkContext.defaultParallelism
    left, right = (side.repartition(parts, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(kernel, schema)


def _work(left: DataFrame, right: DataFrame) -> list[tuple[int, int, int]]:
    """(bit, left vectors, right vectors) of bits that both sides have: as many rows at most as a fingerprint is wide."""
    count = lambda side, name: side.groupBy("bit").agg(F.count("*").alias(name))
    return [tuple(r) for r in count(left, "l").join(count(right, "r"), "bit").orderBy("bit").collect()]


def _units(work: list[tuple[int, int, int]], rows: tuple[int, int], unit: int, tile: int) -> list[tuple[int, int, int, int]]:
    """(bit, group, left tiles, right tiles).

    Where vectors share few bits, bits are dealt over groups of about ``unit`` pairs, and a bit of more is a group of
    its own in tiles. Where they share many, all bits are one group in tiles, so that every pair is counted in one task.
    """
    tiles = [max(1, math.ceil(n / tile)) for n in rows]
    meetings = sum(l * r for _, l, r in work)
    moved = sum(l * tiles[1] + r * tiles[0] for _, l, r in work)
    if meetings > moved:
        return [(bit, 0, *tiles) for bit, _, _ in work]
    out, group, held = [], 0, 0
    for bit, l, r in work:
        if l * r > unit:
            side = math.sqrt(unit)
            out.append((bit, group + 1, math.ceil(l / side), math.ceil(r / side)))
            group, held = group + 2, 0
        else:
            if held + l * r > unit:
                group, held = group + 1, 0
            held += l * r
            out.append((bit, group, 1, 1))
    return out


def _count_shared(left: pa.Table, right: pa.Table) -> pa.Table:
    """Shared bits of the pairs of one tile."""
    sides = []
    for table in (left, right):
        ords, first, place = np.unique(table["ord"].to_numpy(), return_index=True, return_inverse=True)
        bits = table["bit"].to_numpy()
        order = np.argsort(bits, kind="stable")
        sides.append((ords, table["n"].to_numpy()[first], bits[order], place[order]))
    (lo, ln, lb, lp), (ro, rn, rb, rp) = sides
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, waiting = [], 0

    def settle() -> None:
        nonlocal keys, times, waiting
        new, count = np.unique(np.concatenate(held), return_counts=True)
        both, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, count]), minlength=len(both)).astype(np.int64)
        keys, waiting = both, 0
        held.clear()

    for bit in np.intersect1d(lb, rb).tolist():
        l, r = (p[np.searchsorted(b, bit) : np.searchsorted(b, bit, "right")] for b, p in ((lb, lp), (rb, rp)))
        held.append((l[:, None] * len(ro) + r[None, :]).ravel())
        waiting += len(held[-1])
        if waiting > UNIT:
            settle()
    if held:
        settle()
    i, j = keys // max(len(ro), 1), keys % max(len(ro), 1)
    return pa.table({"l": lo[i], "r": ro[j], "ln": ln[i], "rn": rn[j], "shared": times})


def _shared_bits(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared bits of all pairs of two matrices of packed words. Only bits that both sides have are unpacked, some words at a time."""
    shared = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return shared
    common = np.bitwise_or.reduce(left, axis=0) & np.bitwise_or.reduce(right, axis=0)
    words = np.flatnonzero(common)
    for at in range(0, len(words), STEP_WORDS):
        some = words[at : at + STEP_WORDS]
        used = np.flatnonzero(unpacked(common[None, some])[0])
        shared += unpacked(left[:, some])[:, used] @ unpacked(right[:, some])[:, used].T
    return shared


def _sizes(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(1).astype(np.int64)


PAIRS = "l bigint, r bigint, ln int, rn int, shared bigint"
SUMS = "l bigint, pairs bigint, shared bigint, max_sim double, sum_sim double"


def _block_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of two blocks that share a bit."""
    lw, rw = word_matrix(left["words"]), word_matrix(right["words"])
    shared = _shared_bits(lw, rw)
    i, j = np.nonzero(shared)
    ends = {"l": left["ord"].take(pa.array(i)), "r": right["ord"].take(pa.array(j))}
    return pa.table({**ends, "ln": _sizes(lw)[i].astype(np.int32), "rn": _sizes(rw)[j].astype(np.int32), "shared": shared[i, j].astype(np.int64)})


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """The same, summed per vector of the left block."""
    lw, rw = word_matrix(left["words"]), word_matrix(right["words"])
    shared = _shared_bits(lw, rw)
    ln, rn = _sizes(lw).astype(np.float64), _sizes(rw).astype(np.float64)
    most, total = np.zeros(len(lw)), np.zeros(len(lw))
    # few rows at a time stay in the cache
    for at in range(0, len(lw), SUM_ROWS):
        rows = slice(at, at + SUM_ROWS)
        union = ln[rows, None] + rn[None, :]
        union -= shared[rows]
        sim = np.divide(shared[rows], np.maximum(union, 1, out=union), out=union)
        most[rows], total[rows] = sim.max(axis=1, initial=0.0), sim.sum(axis=1)
    return pa.table(
        {
            "l": left["ord"], "pairs": np.count_nonzero(shared, axis=1).astype(np.int64),
            "shared": shared.sum(axis=1, dtype=np.float64).astype(np.int64), "max_sim": most, "sum_sim": total,
        }
    )


def sparse_pairs(left: DataFrame, right: DataFrame, unit: int = UNIT, tile: int = TILE, summary: bool = False) -> DataFrame:
    """``left_ord, right_ord, shared, sim`` of the pairs of two sets that share a bit.

    Two vectors without a bit share none and are not listed, whatever their similarity is taken to be. With ``summary``
    pairs are summed where they are counted: ``left_ord, pairs, shared, max_sim, sum_sim``, a row per left vector with a pair.
    """
    sides = [materialise(postings(df), "postings") for df in (left, right)]
    rows = tuple(side.select("ord").distinct().count() for side in sides)
    work = _work(*sides)
    meetings, moved = sum(l * r for _, l, r in work), sum(l + r for _, l, r in work)
    if meetings > moved and RARE * meetings > rows[0] * rows[1] and all(map(_numbered_once, (left, right))):
        ends = (side.select(F.col("ord").cast("bigint").alias("ord"), "words") for side in (left, right))
        if not summary:
            return _similar(block_apply(*ends, _block_pairs, PAIRS, tile))
        parts = block_apply(*ends, _block_sums, SUMS, 2 * tile).where("pairs > 0")
        return parts.groupBy(F.col("l").alias("left_ord")).agg(
            F.sum("pairs").alias("pairs"), F.sum("shared").alias("shared"), F.max("max_sim").alias("max_sim"), F.sum("sum_sim").alias("sum_sim")
        )
    units = _units(work, rows, unit, tile)
    spark = left.sparkSession
    plan = spark.createDataFrame(units or [], "bit int, grp int, lt int, rt int")
    groups = len({u[1] for u in units})
    dealt = []
    for side, own, other in ((sides[0], "lt", "rt"), (sides[1], "rt", "lt")):
        # as many rows as a fingerprint is wide
        placed = side.join(F.broadcast(plan), "bit")
        mine = F.pmod(F.xxhash64("ord"), F.col(own)).cast("int")
        placed = placed.withColumn(own[0], mine).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        dealt.append(placed.select("grp", "l", "r", "bit", "ord", "n"))
    found = _together(*dealt, ["grp", "l", "r"], _count_shared, PAIRS)
    if groups > 1:
        found = found.groupBy("l", "r").agg(F.max("ln").alias("ln"), F.max("rn").alias("rn"), F.sum("shared").alias("shared"))
    pairs = _similar(found)
    if not summary:
        return pairs
    return pairs.groupBy("left_ord").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"), F.max("sim").alias("max_sim"), F.sum("sim").alias("sum_sim"))


def _numbered_once(side: DataFrame) -> bool:
    """True if every vector has an ``ord`` of its own."""
    every, known = side.agg(F.count("*"), F.count_distinct("ord")).first()
    return every == known


def _similar(found: DataFrame) -> DataFrame:
    union = F.col("ln") + F.col("rn") - F.col("shared")
    return found.select(F.col("l").alias("left_ord"), F.col("r").alias("right_ord"), "shared", (F.col("shared") / union).alias("sim"))


# --- all pairs above a similarity


def classes(vectors: DataFrame) -> DataFrame:
    """Vectors with their class of equal fingerprints: ``ord, first`` (the smallest ``ord`` of the class)."""
    least = vectors.groupBy("words").agg(F.min("ord").alias("first"))
    return vectors.select("ord", "words").join(least, "words").select("ord", "first")


def _prefixes(rows: DataFrame, order: np.ndarray, threshold: float) -> DataFrame:
    """A row per prefix bit: ``bit`` (its rank, rarest first), ``n``, ``band``, ``ord`` and the words in rank order."""
    sent = rows.sparkSession.sparkContext.broadcast(order)
    width = math.log(1 / threshold) if threshold < 1 else 1.0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = pa.Table.from_batches([batch.slice(at, TILE)])
                on = bit_matrix(part["words"]).astype(np.uint8)
                if not len(on):
                    continue
                on = on[:, sent.value]
                n = on.sum(1).astype(np.int64)
                length = n - np.ceil(threshold * n - EPSILON).astype(np.int64) + 1
                row, bit = np.nonzero(on.astype(bool) & (np.cumsum(on, axis=1, dtype=np.int32) <= length[:, None]))
                words = np.ascontiguousarray(np.packbits(on, axis=1, bitorder="little")).view(np.int64)
                # two sizes that can reach the threshold lie in the same band or in neighbouring ones
                band = np.floor(np.log(np.maximum(n, 1)) / width + EPSILON).astype(np.int32) if threshold < 1 else n.astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "bit": bit.astype(np.int32), "n": n[row].astype(np.int32), "band": band[row],
                        "ord": part["ord"].to_numpy()[row], "words": pa.array(list(words[row]), pa.list_(pa.int64())),
                    }
                )

    return rows.mapInArrow(run, "bit int, n int, band int, ord bigint, words array<bigint>")


FOUND = "a bigint, b bigint, sim double, checked bigint"


def _checked_pairs(threshold: float):
    """Kernel of one tile: pairs whose first common bit is the tile's bit, and one row with the number of pairs checked."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left.num_rows and right.num_rows and left["own"][0].as_py() == right["own"][0].as_py() and left["band"][0].as_py() == right["band"][0].as_py()
        out, checked = [], 0
        if left.num_rows and right.num_rows:
            bit = left["bit"][0].as_py()
            left, right = left.sort_by("n"), right.sort_by("n")
            lw, rw = (word_matrix(t["words"]).view(np.uint64) for t in (left, right))
            ln, rn = (t["n"].to_numpy().astype(np.int64) for t in (left, right))
            lo, ro = left["ord"].to_numpy(), right["ord"].to_numpy()
            least = np.searchsorted(rn, np.ceil(threshold * ln - EPSILON))
            most = np.searchsorted(rn, np.floor(ln / threshold + EPSILON), "right")
            word, mask = bit // 64, np.uint64((1 << bit % 64) - 1)
            for begin in range(0, left.num_rows, CHECK_ROWS):
                rows = slice(begin, begin + CHECK_ROWS)
                low, high = int(least[rows].min()), int(most[rows].max())
                place = np.arange(low, high)
                meet = (place >= least[rows, None]) & (place < most[rows, None])
                if same:
                    meet &= ro[place] < lo[rows, None]
                checked += int(np.count_nonzero(meet))
                shared = _shared_bits(lw[rows].view(np.int64), rw[low:high].view(np.int64))
                # numbers of bits are whole, so a half more is room enough
                meet &= shared >= threshold / (1 + threshold) * (ln[rows, None] + rn[low:high]) - 0.5
                i, j = np.nonzero(meet)
                shared, i, j = shared[i, j].astype(np.int64), i + begin, j + low
                sim = shared / (ln[i] + rn[j] - shared)
                hit = sim >= threshold
                i, j, sim = i[hit], j[hit], sim[hit]
                # a pair that shares an earlier bit is found there
                both = lw[i] & rw[j]
                here = (both[:, :word] == 0).all(1) & (both[:, word] & mask == 0)
                mine, other = lo[i[here]], ro[j[here]]
                out.append((np.maximum(mine, other), np.minimum(mine, other), sim[here]))
        a, b, sim = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        none = pa.nulls(1, pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(a.astype(np.int64)), none]),
                "b": pa.concat_arrays([pa.array(b.astype(np.int64)), none]),
                "sim": pa.concat_arrays([pa.array(sim.astype(float)), pa.nulls(1, pa.float64())]),
                "checked": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([checked], pa.int64())]),
            }
        )

    return kernel


def threshold_table(vectors: DataFrame, threshold: float, tile: int = PREFIX_TILE) -> DataFrame:
    """Pairs of classes with ``sim`` of at least ``threshold`` (``a > b``), and rows with ``checked`` pairs instead."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    rows = vectors.select(F.col("ord").cast("bigint").alias("ord"), "words").groupBy("words").agg(F.min("ord").alias("ord"))
    rows = materialise(rows.select("ord", "words"), "classes")
    first = rows.first()
    width = 64 * len(first["words"]) if first else 0
    seen = np.zeros(width, np.int64)
    # as many rows as a fingerprint is wide
    for bit, n in postings(rows).groupBy("bit").agg(F.count("*").alias("n")).collect():
        seen[bit] = n
    order = np.argsort(seen, kind="stable")
    marks = materialise(_prefixes(rows, order, threshold), "prefixes")
    tiles = marks.groupBy("bit", "band").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = marks.join(tiles, ["bit", "band"]).withColumn("own", F.pmod(F.xxhash64("ord"), F.col("tiles")).cast("int"))
    above = tiles.select("bit", (F.col("band") - 1).alias("band"), F.col("tiles").alias("more"))
    columns = ["bit", "n", "band", "ord", "words", "own"]
    # a tile meets the tiles of its band up to itself, and all tiles of the next band
    left = placed.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("own"))))
    left = left.select(*columns, F.col("band").alias("lb"), F.col("band").alias("rb"), "i", "j")
    right = placed.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.col("own"), F.col("tiles") - 1)))
    right = right.select(*columns, F.col("band").alias("lb"), F.col("band").alias("rb"), "i", "j")
    upper = placed.join(above, ["bit", "band"]).withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("more") - 1)))
    upper = upper.select(*columns, F.col("band").alias("lb"), (F.col("band") + 1).alias("rb"), "i", "j")
    below = tiles.select("bit", (F.col("band") + 1).alias("band"), F.col("tiles").alias("fewer"))
    lower = placed.join(below, ["bit", "band"]).withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("fewer") - 1)))
    lower = lower.select(*columns, (F.col("band") - 1).alias("lb"), F.col("band").alias("rb"), "i", "j")
    sides = left.unionByName(upper), right.unionByName(lower)
    return _together(*sides, ["bit", "lb", "rb", "i", "j"], _checked_pairs(threshold), FOUND)


def similar_above(vectors: DataFrame, threshold: float, tile: int = PREFIX_TILE) -> DataFrame:
    """``a, b, sim`` of all pairs of different fingerprints with a similarity of at least ``threshold``; ``a > b`` are the
    smallest ``ord`` of their :func:`classes`, so copies are not multiplied.

    Bits are ordered by how many vectors have them. Of n bits a vector shows the first n - ceil(threshold n) + 1: two
    vectors above the threshold have their first common bit among those, so only vectors that show a bit together, and
    whose sizes allow it, are compared, once. Frequent bits are cut into tiles.
    """
    return threshold_table(vectors, threshold, tile).where("a is not null").select("a", "b", "sim")


# --- the most similar, from an index by bit count


def write_index(vectors: DataFrame, path: str) -> None:
    """Store ``name, words`` in a folder per number of bits."""
    count = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.bit_count(w))
    rows = vectors.select("name", "words", count.alias("n_bits"))
    rows.repartitionByRange("n_bits", "name").sortWithinPartitions("n_bits", "name").write.partitionBy("n_bits").parquet(path)


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema("name string, words array<bigint>, n_bits int").parquet(path)


BEST = "name string, other string, sim double, compared bigint"
RANKED = f"{BEST}, rank int"


def _best_of(k: int, empty: float):
    """Kernel: the best k of both the rows already found (``kind`` 0) and those of the round's buckets."""

    def kernel(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return pa.table({"name": pa.array([], pa.string()), "other": pa.array([], pa.string()), "sim": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        names = np.array(index["name"].to_pylist(), dtype=object)
        index = index.take(pa.array(np.argsort(names, kind="stable")))
        right = bit_matrix(index["words"])
        size = right.sum(1, dtype=np.float64)
        parts = []
        for at in range(0, queries.num_rows, 512):
            part = queries.slice(at, 512)
            left = bit_matrix(part["words"])
            shared = (left @ right.T).astype(np.float64)
            union = left.sum(1, dtype=np.float64)[:, None] + size - shared
            sim = np.divide(shared, union, out=np.full_like(shared, empty), where=union > 0)
            # names are in order, so a stable sort breaks ties by name
            order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(part.num_rows), order.shape[1])
            compared = np.zeros(order.shape, np.int64)
            compared[:, 0] = sim.shape[1]
            parts.append(pa.table({"name": part["name"].take(pa.array(row)), "other": index["name"].take(pa.array(order.ravel())), "sim": np.take_along_axis(sim, order, 1).ravel(), "compared": compared.ravel()}))
        return pa.concat_tables(parts)

    return kernel


def _outward(index: pa.Table, k: int, empty: float):
    """Kernel over queries ``name, words`` for an index that every task holds."""
    rows = index.take(pa.array(np.lexsort((np.array(index["name"].to_pylist(), dtype=object), index["n_bits"].to_numpy()))))
    names = np.array(rows["name"].to_pylist(), dtype=object)
    # ties go to the smaller name
    by_name = np.empty(len(names), np.int64)
    by_name[np.argsort(names, kind="stable")] = np.arange(len(names))
    right, size = bit_matrix(rows["words"]), rows["n_bits"].to_numpy().astype(np.int64)
    counts, starts = np.unique(size, return_index=True)
    ends = np.append(starts[1:], len(size))

    def search(left: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the index, similarities, rows compared) for queries of ``q`` bits."""
        low, high = np.minimum(counts, q), np.maximum(counts, q)
        reach = np.where(high > 0, low / np.maximum(high, 1), empty)
        route = np.argsort(-reach, kind="stable")
        best_row = np.zeros((len(left), 0), np.int64)
        best_sim = np.zeros((len(left), 0))
        compared = np.zeros(len(left), np.int64)
        open_, at, step = np.arange(len(left)), 0, k
        while at < len(route) and len(open_):
            begin, taken = at, 0
            while at < len(route) and taken < step:
                taken += ends[route[at]] - starts[route[at]]
                at += 1
            which = np.concatenate([np.arange(starts[b], ends[b]) for b in route[begin:at]])
            shared = (left[open_] @ right[which].T).astype(np.float64)
            union = q + size[which] - shared
            sim = np.divide(shared, union, out=np.full_like(shared, empty), where=union > 0)
            compared[open_] += len(which)
            room = max(best_row.shape[1], min(k, best_row.shape[1] + len(which)))
            if room > best_row.shape[1]:
                wide = ((0, 0), (0, room - best_row.shape[1]))
                best_row, best_sim = np.pad(best_row, wide, constant_values=-1), np.pad(best_sim, wide, constant_values=-1.0)
            row = np.concatenate([best_row[open_], np.broadcast_to(which, (len(open_), len(which)))], axis=1)
            sim = np.concatenate([best_sim[open_], sim], axis=1)
            order = np.lexsort((np.where(row >= 0, by_name[row], len(names)), -sim), axis=1)[:, :room]
            best_row[open_], best_sim[open_] = np.take_along_axis(row, order, 1), np.take_along_axis(sim, order, 1)
            if at < len(route) and room == k:
                open_ = open_[best_sim[open_, k - 1] <= reach[route[at]]]
            step *= 2
        return best_row, best_sim, compared

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = pa.Table.from_batches([batch.slice(at, 512)])
                left = bit_matrix(part["words"])
                n_bits = left.sum(1).astype(np.int64)
                for q in np.unique(n_bits).tolist():
                    mine = np.flatnonzero(n_bits == q)
                    row, sim, compared = search(left[mine], q)
                    width = row.shape[1]
                    shown = np.zeros(row.shape, np.int64)
                    shown[:, :1] = compared[:, None]
                    yield from pa.table(
                        {
                            "name": part["name"].take(pa.array(np.repeat(mine, width))), "other": pa.array(names[row.ravel()], pa.string()),
                            "sim": sim.ravel(), "compared": shown.ravel(), "rank": np.tile(np.arange(1, width + 1, dtype=np.int32), len(mine)),
                        }
                    ).combine_chunks().to_batches()

    return run


def most_similar_indexed(
    compounds: DataFrame, index: DataFrame, k: int, empty: float = EMPTY_SIMILARITY, tile: int = PREFIX_TILE, sent_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The ``k`` most similar compounds of an index for each of ``compounds``: ``name, other, sim, compared, rank``.

    Bit counts q and c allow a similarity of min(q, c) / max(q, c) at most. Every compound visits the index outward from
    its own count, in steps of twice as many rows as the one before, until the best that is left cannot reach its k-th
    (one that can only equal it is still visited, as ties go to the smaller name). ``compared``, on rank 1, is how many
    rows of the index it was compared with. An index within ``sent_rows`` (and a bound of bytes, both measured) is sent to
    the tasks and visited there; a larger one is visited in rounds, which read the folders that someone visits.
    """
    small = small_side(index.select("name", "words", "n_bits"), sent_rows)
    if small is not None:
        sent = compounds.sparkSession.sparkContext.broadcast(small)
        return compounds.select("name", "words").mapInArrow(lambda batches: _outward(sent.value, k, empty)(batches), RANKED)
    return _in_rounds(compounds, index, k, empty, tile)


def _in_rounds(compounds: DataFrame, index: DataFrame, k: int, empty: float, tile: int) -> DataFrame:
    spark = compounds.sparkSession
    count = F.aggregate("words", F.lit(0), lambda acc, w: acc + F.bit_count(w))
    waiting = materialise(compounds.select("name", "words", count.alias("q")), "queries")
    # as many rows as a fingerprint is wide
    buckets = {r["n_bits"]: r["n"] for r in index.groupBy("n_bits").agg(F.count("*").alias("n")).collect()}
    sizes = [r["q"] for r in waiting.select("q").distinct().collect()]
    bound = lambda q, c: min(q, c) / max(q, c) if max(q, c) else empty
    route = {q: sorted(buckets, key=lambda c, q=q: -bound(q, c)) for q in sizes}
    best = spark.createDataFrame([], RANKED)
    # a tile is one matrix product, so the first round visits as many rows
    seen, wanted = dict.fromkeys(sizes, 0), max(k, tile)
    while any(seen[q] < len(route[q]) for q in sizes):
        visit, left = [], []
        for q in sizes:
            begin, rows = seen[q], 0
            while seen[q] < len(route[q]) and (rows < wanted or seen[q] == begin):
                rows += buckets[route[q][seen[q]]]
                seen[q] += 1
            visit += [(q, c) for c in route[q][begin : seen[q]]]
            left.append((q, float(bound(q, route[q][seen[q]])) if seen[q] < len(route[q]) else -1.0))
        wanted *= 2
        # folders of the index that no one visits in this round are not read
        part = index.where(F.col("n_bits").isin(sorted({c for _, c in visit})))
        found = _visit(waiting, part, spark.createDataFrame(visit, "q int, n_bits int"), k, empty, tile)
        best = materialise(_first(best.drop("rank").unionByName(found), k), "best")
        # compounds whose k-th cannot be reached any more are done
        last = best.groupBy("name").agg(F.count("*").alias("have"), F.min("sim").alias("kth"))
        limits = spark.createDataFrame(left, "q int, reach double")
        rest = waiting.join(F.broadcast(limits), "q").join(last, "name", "left")
        open_ = (F.col("reach") >= 0) & ((F.coalesce("have", F.lit(0)) < k) | (F.col("reach") >= F.col("kth")))
        waiting = materialise(rest.where(open_).select("name", "words", "q"), "queries")
        sizes = [r["q"] for r in waiting.select("q").distinct().collect()]
    return best


def _first(rows: DataFrame, k: int) -> DataFrame:
    """First k per name by similarity, then name; ``compared`` is summed on the first."""
    total = rows.groupBy(F.col("name").alias("_n")).agg(F.sum("compared").alias("_c"))
    ranked = first_per_group(rows.drop("compared"), ["name"], [F.desc("sim"), F.asc("other")], k)
    shown = F.when(F.col("rank") == 1, F.col("_c")).otherwise(F.lit(0).cast("bigint"))
    return ranked.join(total, F.col("name") == F.col("_n")).select("name", "other", "sim", shown.alias("compared"), F.col("rank").cast("int").alias("rank"))


def _visit(waiting: DataFrame, rows: DataFrame, visit: DataFrame, k: int, empty: float, tile: int) -> DataFrame:
    """The best of a round: queries of one bit count meet the buckets they visit, in tiles of both."""
    # both plans are as many rows as a fingerprint is wide, or its square at most
    plan = F.broadcast(visit)
    many = waiting.groupBy("q").agg(F.ceil(F.count("*") / tile).cast("int").alias("lt"))
    large = rows.join(plan, "n_bits").groupBy("q").agg(F.ceil(F.count("*") / tile).cast("int").alias("rt"))
    tiles = materialise(many.join(large, "q"), "tiles")
    left = waiting.join(F.broadcast(tiles), "q").withColumn("i", F.pmod(F.xxhash64("name"), F.col("lt")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("rt") - 1)))
    right = rows.join(plan, "n_bits").join(F.broadcast(tiles), "q").withColumn("j", F.pmod(F.xxhash64("name"), F.col("rt")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lt") - 1)))
    sides = [side.select("name", "words", "q", "i", "j") for side in (left, right)]
    return _together(*sides, ["q", "i", "j"], _best_of(k, empty), BEST)
