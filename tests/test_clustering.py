import math
import random
from functools import partial

import numpy as np
import pytest
from plain import rows
from pyspark.sql import functions as F

from molweave.operators import clustering as cl
from molweave.operators import growth
from molweave.operators.similarity import blended_pairs, distance_pairs
from molweave.session import materialise
from test_similarity import packed, tanimoto


def leaves(n, seed, width=40, k=8):
    rng = random.Random(seed)
    return [(o, f"{'YES' if rng.random() < 0.6 else 'not'}_{o}", packed(set(rng.sample(range(width), k)), 1)) for o in range(n)]


def plain_tree(vectors, linkage):
    """One merge after the other over a shrinking matrix; the last of the smallest entries goes first."""
    names = [{v[1]} for v in vectors]
    table = [[1 - tanimoto(a[2], b[2]) for b in vectors] for a in vectors]
    out = []
    while len(names) > 1:
        best = None
        for i in range(1, len(names)):
            for j in range(i):
                if best is None or table[i][j] <= best[0]:
                    best = (table[i][j], i, j)
        d, i, j = best
        for k in range(len(names)):
            if k not in (i, j):
                if linkage == "weighted":
                    new = (table[i][k] + table[j][k]) / 2
                else:
                    new = (len(names[i]) * table[i][k] + len(names[j]) * table[j][k]) / (len(names[i]) + len(names[j]))
                table[j][k] = table[k][j] = new
        names[j] = names[j] | names[i]
        out.append((frozenset(names[j]), d))
        del names[i], table[i]
        for row in table:
            del row[i]
    return out


def clades_of(df):
    found = {}
    for r in df.collect():
        found.setdefault((r["tree"], r["node"]), (set(), r["distance"], r["size"]))[0].add(r["name"])
    assert all(len(names) == size for names, _, size in found.values())
    return found


@pytest.mark.parametrize("linkage", cl.LINKAGES)
@pytest.mark.parametrize("n, seed", [(2, 1), (17, 2), (40, 3)])
def test_tree_with_ties(spark, linkage, n, seed):
    vectors = leaves(n, seed)
    df = spark.createDataFrame([(7, *v) for v in vectors], "tree long, ord long, name string, words array<bigint>")
    want = plain_tree(vectors, linkage)
    assert len({d for _, d in want}) < len(want) or n == 2
    found = clades_of(cl.cluster_vectors(df, linkage))
    on_grid = lambda d: math.floor(d * cl.GRID + 0.5) / cl.GRID
    assert sorted((sorted(n_), d) for n_, d, _ in found.values()) == sorted((sorted(n_), on_grid(d)) for n_, d in want)


@pytest.mark.parametrize("linkage", cl.LINKAGES)
@pytest.mark.parametrize("hand_over", [1, 9, 30])
def test_rounds_and_hand_over_give_the_same_tree_tables(spark, linkage, hand_over):
    vectors = leaves(40, 5)
    data = [(1, *v) for v in vectors] + [(2, *v) for v in vectors if v[0] % 2] + [(3, *v) for v in vectors[:3]] + [(4, *vectors[0])]
    df = spark.createDataFrame(data, "tree long, ord long, name string, words array<bigint>")
    local = cl.tree_of_vectors(df, linkage)
    grown = cl.tree_of_vectors(df, linkage, local_leaves=2, block_rows=9, hand_over=hand_over)
    assert rows(local) == rows(grown)


def test_intervals_are_post_order(spark):
    vectors = leaves(60, 8)
    df = spark.createDataFrame([(0, *v) for v in vectors], "tree long, ord long, name string, words array<bigint>")
    tree = cl.tree_of_vectors(df)
    nodes = {r["node"]: r for r in cl.inner_nodes(tree).collect()}
    order = {r["pos"]: r["name"] for r in cl.tree_leaves(tree).collect()}
    assert sorted(order) == list(range(60)) and tree.count() == 2 * 60 - 1
    names, met = {-1 - v[0]: {v[1]} for v in vectors}, []

    def walk(node):
        if node in names:
            return names[node]
        below = walk(nodes[node]["left"]) | walk(nodes[node]["right"])
        met.append(node)
        return below

    root = max(nodes, key=lambda k: nodes[k]["size"])
    assert walk(root) == set(order.values())
    assert [nodes[k]["place"] for k in met] == list(range(59))
    members = {}
    for r in cl.node_members(tree, cl.inner_nodes(tree)).collect():
        members.setdefault(r["node"], set()).add(r["name"])
    for k, r in nodes.items():
        assert members[k] == {order[p] for p in range(r["first"], r["first"] + r["size"])} == walk(k)
    shares = {r["node"]: r["share"] for r in cl.positive_nodes(tree, 50).collect()}
    share = lambda k: sum(n.startswith("YES") for n in members[k]) / len(members[k])
    assert shares == {k: share(k) for k in nodes if share(k) >= 0.5}


def test_deep_tree_by_pointer_jumping(spark):
    n = 300
    merges = [(0, i, 0, -1 - i, i - 1 if i > 1 else -1, float(i), i + 1) for i in range(1, n)]
    df = spark.createDataFrame(merges, "tree long, node long, kept long, left long, right long, distance double, size long")
    ends = spark.createDataFrame([(0, i, f"n{i}") for i in range(n)], "tree long, ord long, name string")
    got = {r["node"]: r for r in cl.nested(df, ends).collect()}
    # every node has one leaf to the left and the rest to the right
    assert all((got[i]["first"], got[i]["place"]) == (n - 1 - i, i - 1) for i in range(1, n))
    assert all(got[-1 - i]["first"] == (n - 1 - i if i else n - 1) for i in range(n))


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_rounds_give_the_same_trees(spark, linkage):
    vectors = leaves(40, 5)
    data = [(1, *v) for v in vectors] + [(2, *v) for v in vectors if v[0] % 2] + [(3, *v) for v in vectors[:3]]
    df = spark.createDataFrame(data, "tree long, ord long, name string, words array<bigint>")
    local = cl.cluster_vectors(df, linkage)
    grown = cl.cluster_vectors(df, linkage, local_leaves=5, block_rows=9)
    assert rows(local) == rows(grown)


def test_tree_from_pairs(spark):
    vectors = leaves(15, 6)
    df = spark.createDataFrame(vectors, "ord long, name string, words array<bigint>")
    pairs = distance_pairs(df)
    direct = cl.cluster_vectors(df.withColumn("tree", F.lit(0)))
    assert rows(cl.cluster_pairs(df, pairs)) == rows(direct)
    shown = ["node", "left", "right", "distance", "name"]
    assert rows(cl.cluster_pairs(df, pairs, local_leaves=4), *shown) == rows(direct, *shown)


def test_tree_properties(spark):
    vectors = leaves(30, 9)
    df = spark.createDataFrame([(0, *v) for v in vectors], "tree long, ord long, name string, words array<bigint>")
    tree = cl.cluster_vectors(df)
    merges = {r["node"]: r for r in cl.merges_of(tree).collect()}
    assert len(merges) == 29
    for r in merges.values():
        for child in (r["left"], r["right"]):
            assert child < 0 or merges[child]["height"] <= r["height"]
    children = [c for r in merges.values() for c in (r["left"], r["right"])]
    assert len(children) == len(set(children)) == 58
    sets = [names for names, _, _ in clades_of(tree).values()]
    assert all(a <= b or b <= a or not a & b for a in sets for b in sets)


def test_members_are_listed_where_their_block_is(spark):
    n = 5 * cl.SPAN + 7
    leaf = spark.range(n).selectExpr("0L tree", "-1 - id node", "cast(null as bigint) size", "id first", "id ord", "concat('m', id) name")
    ends = [(3, 4), (0, n), (cl.SPAN - 1, 2), (cl.SPAN, cl.SPAN), (n - 1, 1), (10, 3 * cl.SPAN), (2 * cl.SPAN, n - 2 * cl.SPAN)]
    inner = spark.createDataFrame([(0, k, size, first, None, None) for k, (first, size) in enumerate(ends)], "tree long, node long, size long, first long, ord long, name string")
    tree = materialise(leaf.unionByName(inner).coalesce(1))
    found = cl.node_members(tree, tree.where("node >= 0")).select("*", F.spark_partition_id().alias("task")).collect()
    want = sorted((0, k, i, f"m{i}") for k, (first, size) in enumerate(ends) for i in range(first, first + size))
    assert sorted((r["tree"], r["node"], r["ord"], r["name"]) for r in found) == want
    # one task per block, and not one for all: no row per member is dealt
    tasks = {}
    for r in found:
        tasks.setdefault(r["ord"] // cl.SPAN, set()).add(r["task"])
    assert {len(t) for t in tasks.values()} == {1} and len(set().union(*tasks.values())) > 1


def test_members_that_share_a_place(spark):
    places = [0, 0, 2, 3, 3, 3, 6, cl.SPAN + 1, cl.SPAN + 1, cl.SPAN + 2]
    data = [(0, -1 - k, None, at, k, f"m{k}") for k, at in enumerate(places)]
    ends = [(0, 1), (0, 2), (1, 1), (2, 3), (3, cl.SPAN), (4, cl.SPAN - 4), (cl.SPAN, 2), (5, 2 * cl.SPAN)]
    data += [(0, k, size, first, None, None) for k, (first, size) in enumerate(ends)]
    tree = spark.createDataFrame(data, "tree long, node long, size long, first long, ord long, name string")
    found = cl.node_members(tree, tree.where("node >= 0")).select("node", "ord").collect()
    want = sorted((k, i) for k, (first, size) in enumerate(ends) for i, at in enumerate(places) if first <= at < first + size)
    assert sorted(map(tuple, found)) == want


def test_positive_clades(spark):
    data = [(0, node, f"{label}_{i}", i) for node, labels in {1: "yyy", 2: "yn", 3: "nn", 4: "yyn"}.items() for i, label in enumerate({"y": "Yes", "n": "not"}[c] for c in labels)]
    tree = spark.createDataFrame(data, "tree long, node long, name string, ord long")
    for percent, want in ((50, [1, 2, 4]), (66, [1, 4]), (67, [1]), (100, [1]), (0, [1, 2, 3, 4])):
        assert sorted(r["node"] for r in cl.positive_clades(tree, percent).collect()) == want
    chosen = cl.positive_clades(tree, 60)
    assert cl.clade_members(tree, chosen).count() == 6


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_large_trees_write_no_pairs_and_bound_the_last_task(spark, linkage, monkeypatch):
    vectors = leaves(24, 11)
    # copies of one vector, which would merge one by one, and empty ones
    vectors += [(24 + i, f"not_{24 + i}", vectors[3][2]) for i in range(5)] + [(29 + i, f"YES_{29 + i}", [0]) for i in range(3)]
    df = spark.createDataFrame([(1, *v) for v in vectors], "tree long, ord long, name string, words array<bigint>")
    local = cl.tree_of_vectors(df, linkage)

    def no_pairs(*args):
        raise AssertionError("pairs must not be written")

    asked = []
    monkeypatch.setattr(cl, "distance_pairs", no_pairs)
    monkeypatch.setattr(cl, "LOCAL_LEAVES", 12)
    monkeypatch.setattr(cl, "grow", lambda *a: asked.append(a[-1]) or growth.grow(*a))
    grown = cl.tree_of_vectors(df, linkage, local_leaves=2, hand_over=30)
    assert rows(local) == rows(grown)
    assert asked == [12]


def test_tree_of_blends_is_the_tree_of_blended_pairs(spark):
    data = [(*v, w[2]) for v, w in zip(leaves(18, 13), leaves(18, 14), strict=True)]
    df = spark.createDataFrame(data, "ord long, name string, words array<bigint>, words2 array<bigint>")
    want = cl.tree_of_pairs(df.select("ord", "name"), blended_pairs(df, 0.5))
    assert rows(cl.tree_of_blends(df, 0.5, local_leaves=2, hand_over=5)) == rows(want)


@pytest.mark.parametrize("linkage", cl.LINKAGES)
def test_tiles_of_any_size_give_the_same_distances(linkage, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.integers(1, 2**40, (60, 1))
    rounds, alive, size = [], np.arange(60), np.ones(60)
    for _ in range(4):
        pairs = np.sort(rng.permutation(alive)[: len(alive) // 2 * 2].reshape(-1, 2), axis=1)
        lo, hi = pairs.T
        size[lo] += size[hi]
        rounds.append((hi, lo, size[hi].copy(), size[lo].copy()))
        alive = np.setdiff1d(alive, hi)
    from_vectors = growth._Clusters(vectors, rounds, lambda a, b: cl._distance(a, b, 1.0), linkage)

    def whole(limit):
        parts = from_vectors.parts(from_vectors.slots, limit)
        return np.vstack([np.hstack([from_vectors.between(a, b) for b in parts]) for a in parts])

    want = whole(1000)
    assert want.shape == (len(alive), len(alive))
    assert np.array_equal(want, want.T)
    for cells in (1, 7, 300):
        monkeypatch.setattr(growth, "CELLS", cells)
        assert np.array_equal(whole(10), want)


@pytest.mark.parametrize("linkage", ["weighted", "average"])
@pytest.mark.parametrize("known", [1, 3, 16])
def test_known_near_clusters_are_not_asked_for_again(linkage, known, monkeypatch):
    """Rounds that carry near clusters on find the merges of one matrix, and ask for fewer clusters than have lost their nearest one."""
    monkeypatch.setattr(growth, "KNOWN", known)
    monkeypatch.setattr(growth, "TILE", 32)
    rng = np.random.default_rng(known)
    words = np.unique(rng.integers(0, 1 << 12, 200))[:, None]
    words = words[rng.permutation(len(words))]
    want = cl.merge_order(cl._distance(words, words, 1.0), linkage)
    tree = growth._Tree(0, np.arange(len(words)), words, np.ones(len(words), dtype=bool), linkage)
    turn = asked = lost = 0
    while tree.left() > 1:
        clusters = growth._Clusters(tree.vectors, tree.rounds, partial(cl._distance, empty=1.0), linkage)
        others = clusters.parts(clusters.slots, 40)
        for part in clusters.parts(tree.asked, 24):
            tree.told(*clusters.nearest(part, others))
        near = tree.near.copy()
        tree.merge(turn)
        turn += 1
        slots = np.flatnonzero(tree.alive)
        moved = np.isin(np.arange(len(tree.alive)), np.concatenate(tree.done[-1][1:3]))
        asked, lost = asked + len(tree.asked), lost + int((moved[slots] | moved[near[slots]]).sum())
    merges = tree.merges()
    got = {(h, l): d for h, l, d in zip(*(merges[c].to_pylist() for c in ("hi", "lo", "dist")), strict=True)}
    assert got == pytest.approx({(h, l): d for h, l, d in want})
    assert asked <= lost and (known < 16 or asked < 0.8 * lost)
