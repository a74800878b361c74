import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from molweave.llm.components import connected_components
from molweave.llm.embeddings import codes, embedding_groups, op3_embeddings, survivors
from molweave.llm.simhash import Plan, bit_groups, fingerprint, masks, near_fingerprints, op6_simhash, parts_for, simhash_groups, values

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(text)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components_of_chains_hubs_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 400)] + [(7, i) for i in range(1000, 1300)] + [(5, 5), (None, 3), (9, 8), (8, 9), (9, 8)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == groups({n for x in real for n in x}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_as_defined():
    for text in [None, "", " \t", "one", "One TWO", "a b c a b c a b c", "É é \x1c x", " ".join(str(i * i % 101) for i in range(40_000))]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_thresholds_follow_the_pigeonhole():
    rng = np.random.default_rng(3)
    sample = rng.integers(0, 2**63, 500).astype(np.uint64)
    plan = Plan(sample, 10.0, 3, 3)
    assert sorted(b for g in plan.groups for b in g) == list(range(64))
    t = plan.thresholds(sample)
    assert ((t + 1).sum(1) == 4).all() and (t >= -1).all()
    assert bit_groups(sample[:0], 3) and len(masks(21, 1)) == 22
    assert values(np.array([0b1011], np.uint64), [0, 1, 3]).tolist() == [0b111]


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:100]:  # neighbours at one to five bits, and a dense group
        for bits in range(1, 6):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    dense = rng.getrandbits(64)
    fps |= {dense ^ sum(1 << b for b in rng.sample(range(12), rng.randrange(13))) for _ in range(600)} | {0}
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = {r["fp"]: r["component"] for r in near_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= 3]
    assert got == groups(signed, near)


@pytest.mark.parametrize("distance", [0, 6, 10])
def test_other_distances_against_brute_force(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(80)}
    for f in list(fps)[:40]:
        for bits in (1, 3, 5, 6, 7, 9, 10, 11):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    got = {r["fp"]: r["component"] for r in near_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and (signed[a] ^ signed[b]).bit_count() <= distance]
    assert got == groups(signed, near)


def test_partitions_reach_every_distance():
    assert [parts_for(d) for d in (0, 1, 3, 5, 6, 10)] == [1, 2, 3, 3, 4, 6] and parts_for(64) <= 64
    with pytest.raises(ValueError):
        parts_for(65)
    with pytest.raises(ValueError):
        Plan(np.zeros(0, np.uint64), 1.0, 3, 6).thresholds(np.array([5], np.uint64))


def test_simhash_edge_cases(spark, edge):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_groups(edge).collect()), key=str)
    assert len(got) == edge.count()
    of = dict(got)
    assert of[2] == of[3] == 2 and of[1] == 1 and of[None] is None
    assert simhash_groups(edge.limit(0)).count() == 0


def test_op6_whole_table(spark, sf):
    docs = {r["doc_id"]: plain_fingerprint(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    links = [(a, b) for a in docs for b in docs if a < b and (docs[a] ^ docs[b]).bit_count() <= 3]
    want = groups(docs, links)
    assert {tuple(r) for r in op6_simhash(spark, sf).collect()} == {(d, f"{docs[d]:016x}", want[d]) for d in docs}


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for n, (i, x, k) in enumerate(good):
        for j, y, m in good[n + 1 :]:
            if k == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((min(i, j), max(i, j)))
    n = Counter(a for x in links for a in x)
    of = groups([i for i, *_ in rows], links)
    return {i: (n[i], of[i], of[i] == i) for i, *_ in rows}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, centres = [], rng.standard_normal((6, 16))
    for i in range(400):
        noise = rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])
        rows.append((i, (centres[i % 6] + noise).tolist(), int(i % 3)))
    rows += [(400 + i, rows[0][1], 0) for i in range(5)]
    nan = float("nan")
    rows += [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [nan] * 16, 1), (504, [None] * 16, 1), (505, rows[1][1], None), (506, [float("inf")] * 16, 1), (507, [1.0, 2.0], 1), (508, [2.0, 4.0], 1), (509, [-0.0, 1.0], 1), (510, [0.0, 2.0], 1), (511, [1e200, 1e200], 2), (512, [1e-200, 1e-200], 2)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, links int")
    want = brute(rows[:-2]) | {511: (1, 511, True), 512: (1, 511, False)}
    for block in (2048, 40):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_groups(df, block=block).collect()}
        assert got == want
    assert embedding_groups(df.limit(0)).count() == 0


def test_bounds_keep_every_close_pair():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    y = x + rng.standard_normal((2000, 64)) * 0.37
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    close = (x * y).sum(1) >= 0.93
    _, bits, a = codes(x)
    turned = codes(y)[0]
    kept = survivors(bits, a, turned, 0.93, 4.0)
    assert close.sum() > 300 and kept[np.arange(2000), np.arange(2000)][close].all()
    assert kept.mean() < 0.02


def test_op3_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in op3_embeddings(spark, sf).collect()} == brute(rows)
