"""Average-linkage trees over labelled compounds, as tables.

A tree is built by merging the closest two clusters again and again. Every cluster sits in a slot: a
compound starts in the slot of its ``ord``, a merged cluster takes the smaller slot of its two parts.
Among equally close pairs the one with the larger upper slot, then the larger lower slot, goes first.
The upper slot disappears with its merge, so it names the new inner node.

Trees up to ``LOCAL_LEAVES`` compounds (counted first) are built many at a time, one per task. A larger
tree grows in rounds: every pair that is nearest for both of its clusters merges in the same round, until
``hand_over`` clusters are left (``LOCAL_LEAVES`` at most), which one task merges. Rounds make distances from the vectors
(:mod:`molweave.operators.growth`); a pair table is read and written only where pairs are all that is given or the
vectors are too large to be sent to the tasks (measured). All ways give the same tree:
two clusters that are nearest to each other stay so whatever merges around them, because a merged cluster
is never closer than both of its parts were, and it inherits a slot of one of them for ties. Distances are
compared on a grid of 2**-40, so that averages which differ only in their last binary digits tie.

The result is a tree table ``tree, node, kept, left, right, distance, size, first, place, ord, name`` with one
row per inner node and one per leaf (``node`` = ``-1 - ord``, the only rows with ``ord`` and ``name``). Leaves
are numbered from 0 in tree order, a node's leaves are those from ``first`` on, ``size`` of them, and ``place``
is an inner node's place in post-order. So a clade costs one row however many leaves it has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molweave.functions.labels import is_positive
from molweave.operators.blocks import BLOCK_ROWS, bit_matrix, small_side, tanimoto, unpacked, word_matrix
from molweave.operators.growth import GRID, MERGES, Distance, grow
from molweave.operators.similarity import EMPTY_SIMILARITY, blend, blended_pairs, distance_pairs
from molweave.session import drop_table, materialise, write_scratch

LOCAL_LEAVES = 1024
#: leaves of all large trees whose vectors are sent to the tasks; their bytes are bounded too (see :func:`small_side`)
SENT_LEAVES = 1 << 20
LINKAGES = ("weighted", "average")
TREE = (
    "tree bigint, node bigint, kept bigint, left bigint, right bigint, distance double, "
    "size bigint, first bigint, place bigint, ord bigint, name string"
)
#: tables of pairs that are read together before they are put into one
SEGMENTS = 4
#: leaves that stand side by side in one row, from which the members of clades are listed
SPAN = 1024


def merge_order(
    distances: np.ndarray, linkage: str, sizes: np.ndarray | None = None
) -> list[tuple[int, int, float]]:
    """Merges (upper, lower, distance) of one square distance matrix, closest pair first.

    ``sizes`` are the leaves of the clusters to begin with, one each by default.
    """
    n = len(distances)
    table = np.full((n, n), np.inf)
    on_grid = lambda x: np.floor(x * GRID + 0.5)
    below = np.tril_indices(n, -1)
    table[below] = distances[below]
    order = on_grid(table)
    sizes = np.ones(n) if sizes is None else sizes.astype(float)
    alive = np.ones(n, dtype=bool)
    merges = []
    for _ in range(n - 1):
        # the last of the smallest entries, row by row
        upper, lower = divmod(n * n - 1 - int(np.argmin(order.ravel()[::-1])), n)
        merges.append((upper, lower, float(table[upper, lower])))
        a = np.concatenate([table[upper, :upper], [np.inf], table[upper + 1 :, upper]])
        b = np.concatenate([table[lower, :lower], [np.inf], table[lower + 1 :, lower]])
        if linkage == "weighted":
            mixed = (a + b) / 2
        else:
            mixed = (sizes[upper] * a + sizes[lower] * b) / (sizes[upper] + sizes[lower])
        sizes[lower] += sizes[upper]
        alive[upper] = False
        mixed[~alive] = np.inf
        mixed[lower] = np.inf
        table[lower, :lower] = mixed[:lower]
        table[lower + 1 :, lower] = mixed[lower + 1 :]
        table[upper, :] = np.inf
        table[:, upper] = np.inf
        for place in (np.s_[lower, :], np.s_[:, lower], np.s_[upper, :], np.s_[:, upper]):
            order[place] = on_grid(table[place])
    return merges


def _tree_rows(tree: int, ords: np.ndarray, names: pa.Array, merges) -> pa.Table:
    """The tree table of one tree from its merges."""
    n = len(ords)
    inside = np.ones(n, dtype=np.int64)
    node_of = -1 - np.asarray(ords, dtype=np.int64)
    out = {k: [] for k in ("node", "kept", "left", "right", "distance", "size")}
    for upper, lower, distance in merges:
        out["node"].append(int(ords[upper]))
        out["kept"].append(int(ords[lower]))
        out["left"].append(int(node_of[upper]))
        out["right"].append(int(node_of[lower]))
        out["distance"].append(distance)
        inside[lower] += inside[upper]
        out["size"].append(int(inside[lower]))
        node_of[lower] = ords[upper]
    # from the root down: where a node's leaves begin, and how many inner nodes come before its own
    size = dict(zip(out["node"], out["size"], strict=True))
    begin = {out["node"][-1] if merges else int(node_of[0]): (0, 0)}
    for node, left, right in zip(*(reversed(out[k]) for k in ("node", "left", "right")), strict=True):
        first, before = begin[node]
        width = size.get(left, 1)
        begin[left] = first, before
        begin[right] = first + width, before + width - 1
    leaf = [-1 - int(o) for o in ords]
    columns = {
        "node": out["node"] + leaf,
        **{k: out[k] + [None] * n for k in ("kept", "left", "right", "distance")},
        "size": out["size"] + [1] * n,
        "first": [begin[x][0] for x in out["node"] + leaf],
        "place": [begin[x][1] + size[x] - 2 for x in out["node"]] + [None] * n,
        "ord": [None] * len(merges) + [int(o) for o in ords],
        "name": [None] * len(merges) + names.to_pylist(),
    }
    kinds = {"distance": pa.float64(), "name": pa.string()}
    columns = {"tree": [tree] * (len(merges) + n), **columns}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()})


def _split_by_size(leaves: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, bool]:
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("_leaves"))
    large = sizes.where(F.col("_leaves") > limit).select("tree")
    return (
        leaves.join(large, "tree", "left_anti"),
        leaves.join(large, "tree", "left_semi"),
        not large.isEmpty(),
    )


def tree_of_vectors(
    members: DataFrame,
    linkage: str = "weighted",
    empty: float = EMPTY_SIMILARITY,
    local_leaves: int = LOCAL_LEAVES,
    block_rows: int = BLOCK_ROWS,
    hand_over: int | None = None,
) -> DataFrame:
    """Tree table of every tree in ``members`` (``tree, ord, name, words``).

    A compound has the same ``ord`` in every tree it belongs to. Trees above ``local_leaves`` grow in rounds
    until ``hand_over`` clusters are left (default: ``local_leaves``; 1: to the end; never more than ``LOCAL_LEAVES``).
    """
    _check(linkage)
    leaves = members.select(
        F.col("tree").cast("bigint").alias("tree"), F.col("ord").cast("bigint").alias("ord"), "name", "words"
    )

    def one_tree(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord").combine_chunks()
        bits = bit_matrix(table["words"])
        merges = merge_order(1.0 - tanimoto(bits, bits, empty), linkage)
        return _tree_rows(
            table["tree"][0].as_py(), table["ord"].to_numpy(), table["name"].combine_chunks(), merges
        )

    small, large, any_large = _split_by_size(leaves, local_leaves)
    if not any_large:
        return _rounded(leaves.groupBy("tree").applyInArrow(one_tree, TREE))
    left = _left(local_leaves, hand_over)
    any_bit = lambda words: (words != 0).any(axis=1) | (empty == 1)
    grown = _grow_sent(large, ["words"], partial(_distance, empty=empty), any_bit, linkage, left)
    if grown is not None:
        return _rounded(small.groupBy("tree").applyInArrow(one_tree, TREE).unionByName(grown))
    # the same compound has the same ord in every tree, so its distances are computed once
    vectors = large.groupBy("ord").agg(F.first("name").alias("name"), F.first("words").alias("words"))
    pairs = distance_pairs(vectors, empty, block_rows)
    in_tree = lambda side: large.select("tree", F.col("ord").alias(side))
    pairs = pairs.join(in_tree("a_ord"), "a_ord").join(in_tree("b_ord"), ["tree", "b_ord"])
    grown = _grow(large.drop("words"), pairs, linkage, left)
    return _rounded(small.groupBy("tree").applyInArrow(one_tree, TREE).unionByName(grown))


def tree_of_pairs(
    leaves: DataFrame,
    pairs: DataFrame,
    linkage: str = "weighted",
    local_leaves: int = LOCAL_LEAVES,
    hand_over: int | None = None,
) -> DataFrame:
    """Tree table of one tree from leaves ``ord, name`` and a full table ``a_ord, b_ord, dist``."""
    _check(linkage)
    count = leaves.count()
    if count > local_leaves:
        tree = F.lit(0).cast("bigint").alias("tree")
        given = leaves.select(tree, F.col("ord").cast("bigint").alias("ord"), "name")
        return _rounded(_grow(given, pairs.select(tree, "*"), linkage, _left(local_leaves, hand_over)))

    def one_tree(leaf: pa.Table, pair: pa.Table) -> pa.Table:
        leaf = leaf.sort_by("ord").combine_chunks()
        ords = leaf["ord"].to_numpy()
        square = _square(ords, pair["a_ord"].to_numpy(), pair["b_ord"].to_numpy(), pair["dist"].to_numpy())
        return _tree_rows(0, ords, leaf["name"].combine_chunks(), merge_order(square, linkage))

    zero = F.lit(0).alias("tree")
    left = leaves.select(F.col("ord").cast("bigint").alias("ord"), "name", zero).groupBy("tree")
    right = pairs.select("a_ord", "b_ord", "dist", zero).groupBy("tree")
    return _rounded(left.cogroup(right).applyInArrow(one_tree, TREE))


def tree_of_blends(
    vectors: DataFrame,
    coefficient: float,
    linkage: str = "weighted",
    empty: float = EMPTY_SIMILARITY,
    local_leaves: int = LOCAL_LEAVES,
    hand_over: int | None = None,
) -> DataFrame:
    """Tree table of one tree over the blended distances (see :func:`blended_pairs`) of ``ord, name, words, words2``."""
    _check(linkage)
    ends = vectors.select("ord", "name")
    if ends.count() > local_leaves:
        tree = F.lit(0).cast("bigint").alias("tree")
        given = vectors.select(tree, F.col("ord").cast("bigint").alias("ord"), "name", "words", "words2")

        def one_leaf(words: np.ndarray) -> np.ndarray:
            return (coefficient > 0) & ((empty == 1) | np.all([(w != 0).any(axis=1) for w in np.hsplit(words, 2)], axis=0))

        distance = partial(_blended_distance, coefficient=coefficient, empty=empty)
        grown = _grow_sent(given, ["words", "words2"], distance, one_leaf, linkage, _left(local_leaves, hand_over))
        if grown is not None:
            return _rounded(grown)
    return tree_of_pairs(ends, blended_pairs(vectors, coefficient, empty), linkage, local_leaves, hand_over)


def _distance(left: np.ndarray, right: np.ndarray, empty: float) -> np.ndarray:
    return 1.0 - tanimoto(unpacked(left), unpacked(right), empty)


def _blended_distance(left: np.ndarray, right: np.ndarray, coefficient: float, empty: float) -> np.ndarray:
    spaces = zip(np.hsplit(left, 2), np.hsplit(right, 2), strict=True)
    return blend(*(_distance(a, b, empty) for a, b in spaces), coefficient)


def _left(local_leaves: int, hand_over: int | None) -> int:
    """Clusters that one task merges: its matrix is bounded, whatever is asked for."""
    return min(local_leaves if hand_over is None else hand_over, LOCAL_LEAVES)


def _grow_sent(
    leaves: DataFrame,
    spaces: list[str],
    distance: Distance,
    one_leaf: Callable[[np.ndarray], np.ndarray],
    linkage: str,
    hand_over: int,
) -> DataFrame | None:
    """Large trees of leaves ``tree, ord, name`` and their vectors, in rounds without a pair table; None if the vectors are
    too large to be sent. The ``spaces`` of a leaf stand side by side, padded to one width."""
    sent = small_side(leaves.where("ord is not null").select("tree", "ord", *spaces), SENT_LEAVES)
    if sent is None:
        return None
    words = [word_matrix(sent[s]) for s in spaces]
    width = max(w.shape[1] for w in words)
    words = np.hstack([np.pad(w, ((0, 0), (0, width - w.shape[1]))) for w in words])
    spark = leaves.sparkSession
    tree, ords = (sent[c].to_numpy() for c in ("tree", "ord"))
    merges, rest, number, left = grow(spark, tree, ords, words, distance, one_leaf, linkage, hand_over)
    done = [spark.createDataFrame(merges, MERGES)]
    if rest is not None:
        done.append(materialise(_finished_strips(rest, left, linkage, number), "merges"))
    return nested(materialise(_described(_union(done)), "tree"), leaves.select("tree", "ord", "name"))


def _finished_strips(strips: DataFrame, left: list[tuple], linkage: str, number: int) -> DataFrame:
    """The merges of trees with few clusters left, one task each, from their matrix as a row per cluster."""
    known = {tree: (ords, sizes) for tree, ords, sizes in left}

    def one_tree(rows: pa.Table) -> pa.Table:
        tree = rows["tree"][0].as_py()
        square = np.stack([np.frombuffer(r) for r in rows.sort_by("row")["dist"].to_pylist()])
        slots, sizes = known[tree]
        return _merge_rows(tree, slots, sizes.copy(), merge_order(square, linkage, sizes), number)

    return strips.groupBy("tree").applyInArrow(one_tree, MERGES)


def _merge_rows(tree: int, slots: np.ndarray, sizes: np.ndarray, merges: list[tuple], number: int) -> pa.Table:
    """Merges of numbered clusters as rows, from round ``number`` on."""
    total = []
    for upper, lower, _ in merges:
        sizes[lower] += sizes[upper]
        total.append(int(sizes[lower]))
    upper, lower = (np.array([slots[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
    return pa.table(
        {
            "tree": pa.array([tree] * len(merges), pa.int64()),
            "round": pa.array(range(number, number + len(merges)), pa.int64()),
            "hi": upper,
            "lo": lower,
            "dist": pa.array([m[2] for m in merges], pa.float64()),
            "size": pa.array(total, pa.int64()),
        }
    )


def _square(slots: np.ndarray, a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Lower triangle of the distances between sorted slots."""
    square = np.full((len(slots), len(slots)), np.inf)
    i, j = np.searchsorted(slots, a), np.searchsorted(slots, b)
    square[np.maximum(i, j), np.minimum(i, j)] = dist
    return square


def cluster_vectors(members: DataFrame, linkage: str = "weighted", *args, **options) -> DataFrame:
    """:func:`tree_of_vectors` as a clade table."""
    return clade_table(tree_of_vectors(members, linkage, *args, **options))


def cluster_pairs(leaves: DataFrame, pairs: DataFrame, linkage: str = "weighted", **options) -> DataFrame:
    """:func:`tree_of_pairs` as a clade table."""
    return clade_table(tree_of_pairs(leaves, pairs, linkage, **options))


def _check(linkage: str) -> None:
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")


class _Pairs:
    """The distances between living clusters: tables of which only some rows are still valid.

    A round writes the distances of merged clusters and nothing else. A row is valid if neither of its slots
    has merged since its table was written; several tables are put into one and their files deleted.
    """

    def __init__(self, pairs: DataFrame):
        self.tables: list[tuple[DataFrame, str, int]] = []
        self.merges: list[DataFrame] = []
        self.add(pairs, 0)

    def add(self, pairs: DataFrame, number: int) -> None:
        self.tables.append((*write_scratch(pairs, "pairs"), number))

    def valid(self) -> DataFrame:
        parts = []
        for table, _, number in self.tables:
            for merges in self._since(number):
                touched = merges.select("tree", F.explode(F.array("hi", "lo")).alias("slot")).distinct()
                for side in ("hi", "lo"):
                    table = table.join(touched.withColumnRenamed("slot", side), ["tree", side], "left_anti")
            parts.append(table)
        return _union(parts)

    def _since(self, number: int) -> list[DataFrame]:
        return [_union(self.merges[number:])] if self.merges[number:] else []

    def merge(self, merges: DataFrame, linkage: str) -> None:
        changed = _contract(self.valid(), merges, linkage)
        self.merges.append(merges)
        self.add(changed, len(self.merges))
        if len(self.tables) > SEGMENTS:
            old = self.tables
            self.tables = [(*write_scratch(self.valid(), "pairs"), len(self.merges))]
            for table, path, _ in old:
                drop_table(table.sparkSession, path)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _grow(leaves: DataFrame, pairs: DataFrame, linkage: str, hand_over: int) -> DataFrame:
    """Large trees in rounds, all trees in the same rounds, until no tree has more than ``hand_over`` clusters."""
    one = F.lit(1).cast("bigint")
    pairs = _Pairs(
        pairs.select(
            "tree",
            F.greatest("a_ord", "b_ord").alias("hi"),
            F.least("a_ord", "b_ord").alias("lo"),
            "dist",
            one.alias("nh"),
            one.alias("nl"),
        )
    )
    counts = materialise(leaves.groupBy("tree").agg(F.count("*").alias("leaves")), "leaf_counts")
    done: list[DataFrame] = []
    while True:
        gone = counts.select("tree", "leaves", F.lit(0).cast("bigint").alias("merged"))
        for merges in done:
            merged = merges.groupBy("tree").agg(F.count("*").alias("merged"))
            gone = gone.unionByName(merged.select("tree", F.lit(0).cast("bigint").alias("leaves"), "merged"))
        left = gone.groupBy("tree").agg((F.sum("leaves") - F.sum("merged")).alias("left"))
        most = left.agg(F.max("left")).first()[0] or 0
        if most <= max(hand_over, 1):
            break
        merges = materialise(_mutual(pairs.valid(), len(done)), "merges")
        pairs.merge(merges, linkage)
        done.append(merges)
    if most > 1:
        done.append(materialise(_finished(pairs.valid(), linkage, len(done)), "merges"))
    merges = _described(_union(done)) if done else leaves.sparkSession.createDataFrame([], MERGES)
    return nested(materialise(merges, "tree"), leaves)


def _finished(pairs: DataFrame, linkage: str, number: int) -> DataFrame:
    """The merges of trees with few clusters left, one task each."""

    def one_tree(rows: pa.Table) -> pa.Table:
        hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
        slots = np.unique(np.concatenate([hi, lo]))
        sizes = np.ones(len(slots), dtype=np.int64)
        sizes[np.searchsorted(slots, hi)] = rows["nh"].to_numpy()
        sizes[np.searchsorted(slots, lo)] = rows["nl"].to_numpy()
        merges = merge_order(_square(slots, hi, lo, rows["dist"].to_numpy()), linkage, sizes)
        return _merge_rows(rows["tree"][0].as_py(), slots, sizes, merges, number)

    return pairs.groupBy("tree").applyInArrow(one_tree, MERGES)


def nested(merges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tree table from ``tree, node, kept, left, right, distance, size`` and leaves ``tree, ord, name``.

    A node's first leaf and place are sums over the way up to the root. The ways are halved in every step
    (pointer jumping), so that a tree of any shape takes as many steps as its depth has binary digits.
    """
    sizes = merges.select("tree", F.col("node").alias("left"), F.col("size").alias("_width"))
    known = merges.join(sizes, ["tree", "left"], "left").withColumn("_width", F.coalesce("_width", F.lit(1).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    ways = F.array(
        F.struct(F.col("left").alias("child"), zero.alias("first"), zero.alias("before")),
        F.struct(F.col("right").alias("child"), F.col("_width").alias("first"), (F.col("_width") - 1).alias("before")),
    )
    links = known.select("tree", F.col("node").alias("up"), F.inline(ways))
    while True:
        links = materialise(links, "links")
        if links.where("up is not null").isEmpty():
            break
        above = links.select("tree", F.col("child").alias("up"), F.col("up").alias("_up"), F.col("first").alias("_first"), F.col("before").alias("_before"))
        links = links.join(above, ["tree", "up"], "left").select(
            "tree",
            F.col("_up").alias("up"),
            "child",
            (F.col("first") + F.coalesce("_first", zero)).alias("first"),
            (F.col("before") + F.coalesce("_before", zero)).alias("before"),
        )
    place = links.select("tree", F.col("child").alias("node"), "first", "before")
    inner = merges.join(place, ["tree", "node"], "left").select(
        "tree", "node", "kept", "left", "right", "distance", "size",
        F.coalesce("first", zero).alias("first"),
        (F.coalesce("before", zero) + F.col("size") - 2).alias("place"),
        F.lit(None).cast("bigint").alias("ord"),
        F.lit(None).cast("string").alias("name"),
    )
    none = F.lit(None).cast("bigint")
    ends = leaves.withColumn("node", -1 - F.col("ord")).join(place, ["tree", "node"], "left").select(
        "tree", "node", none.alias("kept"), none.alias("left"), none.alias("right"),
        F.lit(None).cast("double").alias("distance"), F.lit(1).cast("bigint").alias("size"),
        F.coalesce("first", zero).alias("first"), none.alias("place"), "ord", "name",
    )
    return inner.unionByName(ends)


def _on_grid(distance: Column) -> Column:
    return F.floor(distance * GRID + 0.5)


def _rounded(clades: DataFrame) -> DataFrame:
    """Distances on the grid they are compared on, so that both ways give equal numbers."""
    return clades.withColumn("distance", _on_grid(F.col("distance")) / GRID)


def _mutual(pairs: DataFrame, number: int) -> DataFrame:
    """Pairs that are the nearest for both of their clusters, as the merges of round ``number``."""
    key = F.struct(
        _on_grid(F.col("dist")).alias("grid"), (-F.col("hi")).alias("hi"), (-F.col("lo")).alias("lo"),
        "dist", (F.col("nh") + F.col("nl")).alias("size"), F.col("nh").alias("upper"),
    )
    ends = pairs.select("tree", F.explode(F.array("hi", "lo")).alias("slot"), key.alias("pair"))
    nearest = ends.groupBy("tree", "slot").agg(F.min("pair").alias("pair"))
    # what rides at the end of the key decides nothing
    both = nearest.groupBy("tree", "pair").agg(F.count("*").alias("ends")).where("ends = 2")
    return both.select(
        "tree",
        F.lit(number).cast("bigint").alias("round"),
        (-F.col("pair.hi")).alias("hi"),
        (-F.col("pair.lo")).alias("lo"),
        F.col("pair.dist").alias("dist"),
        F.col("pair.size").alias("size"),
    )


def _described(merges: DataFrame) -> DataFrame:
    """Merges as inner nodes: each part is the last earlier merge into its slot, else the leaf of the slot."""
    none = F.lit(None).cast("bigint")
    ends = F.array(
        F.struct(F.col("hi").alias("slot"), none.alias("made"), F.lit(True).alias("upper")),
        F.struct(F.col("lo").alias("slot"), F.col("hi").alias("made"), F.lit(False).alias("upper")),
    )
    events = merges.select("*", F.inline(ends))
    earlier = Window.partitionBy("tree", "slot").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    part = F.coalesce(F.last("made", ignorenulls=True).over(earlier), -1 - F.col("slot"))
    found = events.withColumn("part", part)
    return found.groupBy("tree", F.col("hi").alias("node"), F.col("lo").alias("kept")).agg(
        F.max(F.when(F.col("upper"), F.col("part"))).alias("left"),
        F.max(F.when(~F.col("upper"), F.col("part"))).alias("right"),
        F.max("dist").alias("distance"),
        F.max("size").alias("size"),
    )


def _contract(pairs: DataFrame, merges: DataFrame, linkage: str) -> DataFrame:
    """New distances after a round, of merged slots only. Where both clusters of a pair merged, the earlier
    merge is mixed first."""
    # what a slot turns into, whether it is the upper part of its merge, and the merge's place in order
    turn = merges.select(
        "tree",
        F.explode(F.array("hi", "lo")).alias("slot"),
        F.col("lo").alias("into"),
        F.col("hi").alias("other"),
        F.struct(
            _on_grid(F.col("dist")).alias("grid"),
            (-F.col("hi")).alias("h"),
            (-F.col("lo")).alias("l"),
            F.col("size").alias("t"),
        ).alias("key"),
    ).withColumn("upper", F.col("slot") == F.col("other"))

    def turned(side: str) -> DataFrame:
        return turn.select(
            "tree",
            F.col("slot").alias(side),
            F.col("into").alias(f"{side}_into"),
            F.col("upper").alias(f"{side}_upper"),
            F.col("key").alias(f"{side}_key"),
        )

    moved = pairs.join(turned("hi"), ["tree", "hi"], "left").join(turned("lo"), ["tree", "lo"], "left")
    moved = moved.where("hi_into is not null or lo_into is not null")

    def end(side: str, leaves: str) -> Column:
        return F.struct(
            F.coalesce(f"{side}_into", side).alias("slot"),
            F.coalesce(f"{side}_upper", F.lit(False)).alias("upper"),
            F.col(f"{side}_key").alias("key"),
            F.col(leaves).alias("n"),
        )

    ends = moved.select("tree", end("hi", "nh").alias("e1"), end("lo", "nl").alias("e2"), "dist").where("e1.slot <> e2.slot")
    swap = F.col("e1.slot") > F.col("e2.slot")
    ends = ends.select(
        "tree",
        F.when(swap, F.col("e1")).otherwise(F.col("e2")).alias("a"),
        F.when(swap, F.col("e2")).otherwise(F.col("e1")).alias("b"),
        "dist",
    )

    def part(a_upper: bool, b_upper: bool) -> Column:
        hit = (F.col("a.upper") == a_upper) & (F.col("b.upper") == b_upper)
        return F.max(F.when(hit, F.col("dist"))).alias(f"d{int(a_upper)}{int(b_upper)}")

    parts = ends.groupBy("tree", F.col("a.slot").alias("hi"), F.col("b.slot").alias("lo")).agg(
        part(False, False),
        part(False, True),
        part(True, False),
        part(True, True),
        F.max("a.key").alias("a_key"),
        F.max("b.key").alias("b_key"),
        # a slot that did not merge, and the upper part of one that did
        *(F.max(F.when(F.col(f"{e}.key").isNull(), F.col(f"{e}.n"))).alias(f"{e}_n") for e in "ab"),
        *(F.max(F.when(F.col(f"{e}.upper"), F.col(f"{e}.n"))).alias(f"{e}_u") for e in "ab"),
    )

    def mix(lower: Column, upper: Column, key: str) -> Column:
        if linkage == "weighted":
            return (upper + lower) / 2
        size, total = F.col(f"{key[0]}_u").cast("double"), F.col(f"{key}.t").cast("double")
        return (size * upper + (total - size) * lower) / total

    d = {k: F.col(k) for k in ("d00", "d01", "d10", "d11")}
    a_merged, b_merged = F.col("a_key").isNotNull(), F.col("b_key").isNotNull()
    a_first = mix(mix(d["d00"], d["d10"], "a_key"), mix(d["d01"], d["d11"], "a_key"), "b_key")
    b_first = mix(mix(d["d00"], d["d01"], "b_key"), mix(d["d10"], d["d11"], "b_key"), "a_key")
    dist = (
        F.when(a_merged & b_merged, F.when(F.col("a_key") < F.col("b_key"), a_first).otherwise(b_first))
        .when(a_merged, mix(d["d00"], d["d10"], "a_key"))
        .when(b_merged, mix(d["d00"], d["d01"], "b_key"))
        .otherwise(d["d00"])
    )
    leaves = [F.coalesce(f"{e}_key.t", f"{e}_n").alias(n) for e, n in (("a", "nh"), ("b", "nl"))]
    return parts.select("tree", "hi", "lo", dist.alias("dist"), *leaves)


# --- reading a tree table


def inner_nodes(tree: DataFrame) -> DataFrame:
    """One row per inner node, to be read in post-order by ``place``: ``tree, node, left, right, distance, height, size, first, place``."""
    return tree.where("node >= 0").select(
        "tree", "node", "left", "right", "distance", (F.col("distance") / 2).alias("height"), "size", "first", "place"
    )


def tree_leaves(tree: DataFrame) -> DataFrame:
    """Leaves in tree order: ``tree, ord, name, pos``."""
    return tree.where("node < 0").select("tree", "ord", "name", F.col("first").alias("pos"))


def positive_nodes(tree: DataFrame, percent: float) -> DataFrame:
    """Inner nodes whose share of positive leaves is at least ``percent``: ``tree, node, share, size, first``.

    Positives are counted once along the leaves; a node is the difference of two counts.
    """
    along = Window.partitionBy("tree").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = tree_leaves(tree).select("tree", "pos", F.sum(is_positive(F.col("name")).cast("bigint")).over(along).alias("upto"))
    at = lambda pos, name: counted.select("tree", F.col("pos").alias(pos), F.col("upto").alias(name))
    nodes = tree.where("node >= 0").select("tree", "node", "size", "first")
    nodes = nodes.withColumns({"_last": F.col("first") + F.col("size") - 1, "_before": F.col("first") - 1})
    found = nodes.join(at("_last", "_high"), ["tree", "_last"]).join(at("_before", "_low"), ["tree", "_before"], "left")
    share = (F.col("_high") - F.coalesce("_low", F.lit(0))) / F.col("size").cast("double")
    found = found.withColumn("share", share).where(F.col("share") >= percent / 100.0)
    return found.select("tree", "node", "share", "size", "first")


def node_members(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """Leaves of the chosen inner nodes (``tree, node, first, size``): ``tree, node, ord, name``, a row for each.

    Leaves stand side by side in blocks of ``SPAN`` places; a node meets the blocks that it covers, and its members are
    listed in the task that holds a block. So what is shuffled is a row per node and block, not one per member, and
    members of deep trees, whose number grows with the square of the leaves, are listed by all tasks, block by block.
    """
    block = lambda pos: F.floor(pos / SPAN).cast("bigint")
    held = tree_leaves(tree).groupBy("tree", block(F.col("pos")).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("pos", "ord", "name"))).alias("_leaves"))
    low, high = F.get("_leaves", F.lit(0))["pos"], F.element_at("_leaves", -1)["pos"]
    # compounds that share an ``ord`` share a place and leave others empty
    places = F.size(F.array_distinct(F.col("_leaves")["pos"]))
    held = held.withColumns({"_low": low, "_high": high, "_plain": (places == F.size("_leaves")) & (high - low + 1 == F.size("_leaves"))})
    spans = chosen.select("tree", "node", F.col("first").alias("_first"), (F.col("first") + F.col("size") - 1).alias("_last"))
    spans = spans.select("*", F.explode(F.sequence(block(F.col("_first")), block(F.col("_last")))).alias("_block"))
    # partitions of a given number stay apart though they look small here, and a merge join keeps them
    parts = int(tree.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = spans.repartition(parts, "tree", "_block").join(held.hint("merge"), ["tree", "_block"])
    begin = F.greatest("_first", "_low")
    many = F.greatest(F.least("_last", "_high") - begin + 1, F.lit(0))
    inside = F.when(F.col("_plain"), F.slice("_leaves", (begin - F.col("_low") + 1).cast("int"), many.cast("int")))
    inside = inside.otherwise(F.filter("_leaves", lambda leaf: leaf["pos"].between(F.col("_first"), F.col("_last"))))
    return met.select("tree", "node", F.inline(inside)).select("tree", "node", "ord", "name")


def clade_table(tree: DataFrame) -> DataFrame:
    """``tree, node, kept, left, right, distance, size, ord, name`` with a row per inner node and leaf below it."""
    inner = tree.where("node >= 0")
    rest = inner.select("tree", "node", "kept", "left", "right", "distance", "size")
    members = node_members(tree, inner.select("tree", "node", "first", "size"))
    return rest.join(members, ["tree", "node"])


# --- reading a clade table


def merges_of(clades: DataFrame) -> DataFrame:
    """One row per inner node: ``tree, node, left, right, distance, height, size``."""
    return clades.where("ord = kept").select(
        "tree", "node", "left", "right", "distance", (F.col("distance") / 2).alias("height"), "size"
    )


def positive_clades(clades: DataFrame, percent: float) -> DataFrame:
    """Inner nodes whose share of positive leaves is at least ``percent``: ``tree, node, share, size``."""
    share = clades.groupBy("tree", "node").agg(
        F.avg(is_positive(F.col("name")).cast("double")).alias("share"), F.count("*").alias("size")
    )
    return share.where(F.col("share") >= percent / 100.0)


def clade_members(clades: DataFrame, chosen: DataFrame) -> DataFrame:
    """Leaves of the chosen inner nodes: ``tree, node, ord, name``."""
    return clades.join(chosen.select("tree", "node"), ["tree", "node"], "left_semi").select(
        "tree", "node", "ord", "name"
    )
