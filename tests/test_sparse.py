import random

import pyarrow as pa
import pytest
from plain import rows
from pyspark.sql import functions as F

from molweave.plans import catalog
from molweave.operators import similarity as sim
from molweave.operators import sparse
from molweave.session import scratch_path
from test_similarity import bits_of, packed, tanimoto


def prints(n, seed, width=256, least=0, most=14, hot=True):
    """Few bits of many; one bit is in most vectors, some vectors are equal or empty."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        bits = set(rng.sample(range(width), rng.randint(least, most)))
        if out and rng.random() < 0.4:
            base = bits_of([w % (1 << 64) for w in out[rng.randrange(len(out))][2]])
            bits = set(list(base)[: max(0, len(base) - rng.randint(0, 2))]) | ({rng.randrange(width)} if rng.random() < 0.5 else set())
        if hot and rng.random() < 0.8 and bits:
            bits.add(7)
        out.append((i, f"m{i}", packed(bits, width // 64)))
    return out


VECTOR = "ord long, name string, words array<bigint>"


@pytest.mark.parametrize("unit, tile", [(sparse.UNIT, sparse.TILE), (50, 7), (1, 1000)])
@pytest.mark.parametrize("hot", [True, False])
def test_sparse_pairs_are_the_dense_ones(spark, unit, tile, hot):
    left, right = prints(40, 1, hot=hot), prints(60, 2, width=256 if hot else 256, most=6, hot=hot)
    frames = [spark.createDataFrame(v, VECTOR) for v in (left, right)]
    got = {(r["left_ord"], r["right_ord"]): r["sim"] for r in sparse.sparse_pairs(*frames, unit=unit, tile=tile).collect()}
    dense = sim.similarity_pairs(*frames, empty=0.0).collect()
    assert got == {(int(r["left_name"][1:]), int(r["right_name"][1:])): r["sim"] for r in dense}
    assert len(got) < 40 * 60


@pytest.mark.parametrize("unit, tile", [(sparse.UNIT, sparse.TILE), (50, 7), (1, 1000)])
@pytest.mark.parametrize("most", [4, 14])
def test_sparse_pairs_summed_where_they_are_counted(spark, unit, tile, most):
    left, right = (spark.createDataFrame(prints(n, seed, width=1088, most=most), VECTOR) for n, seed in ((40, 1), (60, 2)))
    pairs = sparse.sparse_pairs(left, right, unit=unit, tile=tile).collect()
    want = {}
    for p in pairs:
        n, shared, best, total = want.get(p["left_ord"], (0, 0, 0.0, 0.0))
        want[p["left_ord"]] = n + 1, shared + p["shared"], max(best, p["sim"]), total + p["sim"]
    got = {r[0]: tuple(r[1:]) for r in sparse.sparse_pairs(left, right, unit=unit, tile=tile, summary=True).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k][:3] == want[k][:3] and got[k][3] == pytest.approx(want[k][3]) for k in want)


def test_sparse_pairs_that_all_meet_are_not_shuffled(spark):
    """Vectors that share a bit meet in blocks; no posting is dealt, no pair leaves the task that counts it."""
    left, right = (spark.createDataFrame(prints(n, seed), VECTOR) for n, seed in ((300, 1), (400, 2)))
    found = sparse.sparse_pairs(left, right, summary=True)
    plan = found._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Window" not in plan
    assert found.count() > 200


def test_sparse_pairs_of_repeated_numbers_are_counted_as_one(spark):
    left = spark.createDataFrame([(1, "a", [3]), (1, "b", [12]), (2, "c", [15])], VECTOR)
    right = spark.createDataFrame([(7, "x", [15])], VECTOR)
    assert rows(sparse.sparse_pairs(left, right), "left_ord", "shared") == rows(sparse.sparse_pairs(left, right, unit=1), "left_ord", "shared")
    assert {(r["left_ord"], r["shared"]) for r in sparse.sparse_pairs(left, right).collect()} == {(1, 4), (2, 4)}


def test_sparse_units():
    work = [(0, 100, 100), (1, 1000, 1000), (2, 10, 10), (3, 100, 99)]
    units = sparse._units(work, (10**6, 10**6), 10_000, 10)
    assert [u[0] for u in units] == [0, 1, 2, 3] and units[1][2:] == (10, 10)
    assert len({u[1] for u in units}) == 3 or len({u[1] for u in units}) == 4
    # where most vectors meet, every pair is counted in one place
    assert {u[1] for u in sparse._units([(b, 50, 50) for b in range(100)], (60, 60), 10_000, 30)} == {0}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 1.0])
@pytest.mark.parametrize("tile", [sparse.PREFIX_TILE, 5])
def test_similar_above_is_brute_force(spark, threshold, tile):
    data = prints(120, 3)
    df = spark.createDataFrame(data, VECTOR)
    first = {}
    for o, _, w in data:
        first.setdefault(tuple(w), o)
    kept = [v for v in data if first[tuple(v[2])] == v[0]]
    want = {(a[0], b[0]): tanimoto(a[2], b[2], 0.0) for a in kept for b in kept if a[0] > b[0] and tanimoto(a[2], b[2], 0.0) >= threshold}
    got = {(r["a"], r["b"]): r["sim"] for r in sparse.similar_above(df, threshold, tile).collect()}
    assert got == want and (threshold == 1.0 or want)
    assert rows(sparse.classes(df)) == sorted(((o, first[tuple(w)]) for o, _, w in data), key=str)


def test_similar_above_checks_few_pairs(spark):
    data = prints(1500, 4, width=1024, least=8, most=20, hot=False)
    table = sparse.threshold_table(spark.createDataFrame(data, VECTOR), 0.8)
    checked = table.agg(F.sum("checked")).first()[0]
    n = len({tuple(v[2]) for v in data})
    assert table.where("a is not null").count() > 100 and checked < n * (n - 1) / 2 / 20


@pytest.mark.parametrize("rows_at_once", [1, 7, 256])
def test_checked_tiles_are_brute_force(rows_at_once, monkeypatch):
    """A tile's pairs and the number checked do not depend on how many rows meet at a time; nor is a row looked at alone."""
    monkeypatch.setattr(sparse, "CHECK_ROWS", rows_at_once)
    calls, counted = [], sparse._shared_bits
    monkeypatch.setattr(sparse, "_shared_bits", lambda a, b: calls.append(len(a)) or counted(a, b))
    data = [(o, w) for o, _, w in prints(90, 9, width=128, least=3) if 1 << 7 & w[0]]
    n = [sum(bin(x % (1 << 64)).count("1") for x in w) for _, w in data]
    tile = pa.table({"bit": [7] * len(data), "n": n, "band": [0] * len(data), "ord": [o for o, _ in data], "words": [w for _, w in data], "own": [0] * len(data)})
    found = sparse._checked_pairs(0.3)(tile, tile)
    got = {(a, b): s for a, b, s in zip(*(found[c].to_pylist() for c in ("a", "b", "sim")), strict=True) if a is not None}
    earlier = lambda a, b: (a[0] & b[0]) & 127
    want = {(p, q): tanimoto(a, b, 0.0) for p, a in data for q, b in data if p > q and not earlier(a, b) and tanimoto(a, b, 0.0) >= 0.3}
    sizes = [(a, b) for i, a in enumerate(n) for b in n[:i] if min(a, b) >= 0.3 * max(a, b) - 1e-9]
    assert got == want and want and found["checked"].to_pylist()[-1] == len(sizes)
    assert sum(calls) == len(data) and len(calls) == -(-len(data) // rows_at_once)


def test_similar_above_edges(spark):
    none = spark.createDataFrame([], VECTOR)
    assert sparse.similar_above(none, 0.8).count() == 0
    empty = spark.createDataFrame([(0, "a", [0, 0]), (1, "b", [0, 0]), (2, "c", [1, 0])], VECTOR)
    assert sparse.similar_above(empty, 0.8).count() == 0
    with pytest.raises(ValueError):
        sparse.similar_above(empty, 0.0)


@pytest.mark.parametrize("k", [1, 3, 200])
@pytest.mark.parametrize("tile, sent_rows", [(0, sparse.BLOCK_ROWS), (9, 1)])
def test_indexed_search_is_brute_force(spark, k, tile, sent_rows):
    mine, labelled = prints(50, 5, most=40), prints(90, 6, most=40)
    path = scratch_path(spark, "index")
    sparse.write_index(spark.createDataFrame(labelled, VECTOR), path)
    found = sparse.most_similar_indexed(spark.createDataFrame([(o, "q" + n, w) for o, n, w in mine], VECTOR), sparse.read_index(spark, path), k, tile=tile, sent_rows=sent_rows)
    want = []
    for _, name, w in mine:
        ranked = sorted((-tanimoto(w, x), other) for _, other, x in labelled)
        want += [("q" + name, other, -s, i + 1) for i, (s, other) in enumerate(ranked[:k])]
    assert rows(found, "name", "other", "sim", "rank") == sorted(want, key=str)
    compared = found.agg(F.sum("compared")).first()[0]
    assert compared <= len(mine) * len(labelled)


@pytest.mark.parametrize("sent_rows", [sparse.BLOCK_ROWS, 1])
def test_indexed_search_leaves_rows_out(spark, sent_rows):
    labelled = prints(400, 6, least=5, most=60, hot=False)
    near = [(o, f"q{n}", packed(list(bits_of([x % (1 << 64) for x in w]))[1:], 4)) for o, n, w in labelled[:60]]
    path = scratch_path(spark, "index")
    sparse.write_index(spark.createDataFrame(labelled, VECTOR), path)
    found = sparse.most_similar_indexed(spark.createDataFrame(near, VECTOR), sparse.read_index(spark, path), 1, tile=20, sent_rows=sent_rows)
    best = {r["name"]: r["sim"] for r in found.collect()}
    assert best == {n: max(tanimoto(w, x) for _, _, x in labelled) for _, n, w in near}
    assert found.agg(F.sum("compared")).first()[0] < 0.4 * len(near) * len(labelled)


def test_index_search_of_nothing(spark):
    path = scratch_path(spark, "index")
    sparse.write_index(spark.createDataFrame([], VECTOR), path)
    some = spark.createDataFrame(prints(3, 1), VECTOR)
    assert sparse.most_similar_indexed(some, sparse.read_index(spark, path), 3).count() == 0
    assert sparse.most_similar_indexed(some.limit(0), sparse.read_index(spark, path), 3).count() == 0


def test_equal_orders_are_fingerprinted_once(spark, tmp_path, monkeypatch):
    lines = [(o, n, "F" if o % 2 else "O", "A" if n == 2 else "N") for o in range(20) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    given = []
    made = catalog.fingerprints.record_fingerprints
    monkeypatch.setattr(catalog.fingerprints, "record_fingerprints", lambda df, *rest: given.append(df.count()) or made(df, *rest))
    found = catalog._order_vectors(spark, str(tmp_path))
    assert given == [2]
    assert sorted(r["ord"] for r in found.collect()) == [0, 1]
