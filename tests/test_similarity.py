import random
from decimal import ROUND_HALF_UP, Decimal


import numpy as np
import pytest
from plain import rows
from pyspark.sql import functions as F

from molweave.operators import fingerprints as fp
from molweave.operators import blocks, selection
from molweave.operators import similarity as sim
from molweave.sinks import text as text_sinks

VECTOR = "ord long, name string, words array<bigint>"


def bits_of(words):
    return {i for i in range(64 * len(words)) if words[i // 64] >> (i % 64) & 1}


def packed(bits, words=2):
    out = [0] * words
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >= 1 << 63 else w for w in out]


def vectors(n, seed, prefix="m", width=100, density=0.1):
    rng = random.Random(seed)
    out = [(i, f"{prefix}{i}", packed({b for b in range(width) if rng.random() < density})) for i in range(n)]
    out[1] = (1, f"{prefix}1", packed(set()))
    out[2] = (2, f"{prefix}2", packed(set()))
    out[4] = (4, f"{prefix}4", out[3][2])
    return out


def tanimoto(a, b, empty=1.0):
    a, b = bits_of([w % (1 << 64) for w in a]), bits_of([w % (1 << 64) for w in b])
    return len(a & b) / len(a | b) if a | b else empty


LEFT, RIGHT = vectors(50, 1, "base"), vectors(23, 2, "train")


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame(LEFT, VECTOR)


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame(RIGHT, VECTOR)


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_similarity_pairs(left, right, block_rows):
    got = {(r[0], r[1]): r[2] for r in sim.similarity_pairs(left, right, keep_zero=True, block_rows=block_rows).collect()}
    assert got == {(a[1], b[1]): tanimoto(a[2], b[2]) for a in LEFT for b in RIGHT}
    sparse = sim.similarity_pairs(left, right, empty=0.0, block_rows=block_rows)
    assert sparse.count() == sum(tanimoto(a[2], b[2], 0.0) > 0 for a in LEFT for b in RIGHT)


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_distance_pairs(left, block_rows):
    got = {(r["a"], r["b"]): r["dist"] for r in sim.distance_pairs(left, block_rows=block_rows).collect()}
    assert got == {(a[1], b[1]): 1 - tanimoto(a[2], b[2]) for a in LEFT for b in LEFT if a[0] > b[0]}


@pytest.mark.parametrize("block_rows", [4096, 8])
@pytest.mark.parametrize("k", [1, 3, 100])
def test_most_similar(left, right, k, block_rows):
    got = sim.most_similar(left, right, k, block_rows=block_rows)
    want = []
    for a in LEFT:
        ranked = sorted(((-tanimoto(a[2], b[2]), b[1]) for b in RIGHT))[:k]
        want += [(a[1], other, -s, i + 1) for i, (s, other) in enumerate(ranked)]
    assert rows(got, "name", "other", "sim", "rank") == sorted(want, key=str)


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_mean_and_top(spark, left, right, block_rows):
    subsets = {1: ["train1", "train5", "train9"], 2: ["train3", "missing"], 3: [f"train{i}" for i in range(23)]}
    members = spark.createDataFrame([(s, n) for s, m in subsets.items() for n in m], "subset long, name string")
    means = sim.mean_similarity(left, right, members, block_rows=block_rows)
    by_name = {b[1]: b[2] for b in RIGHT}
    want = {
        (s, a[1]): round(sum(tanimoto(a[2], by_name[n]) for n in m if n in by_name) / len(m), 9)
        for s, m in subsets.items()
        for a in LEFT
    }
    assert {(r["subset"], r["name"]): r["avg_sim"] for r in means.collect()} == want
    top = sim.top_similar(means, 50, 29)
    expect = []
    for s in subsets:
        ranked = sorted((-want[s, a[1]], a[1]) for a in LEFT)
        expect += [(s, n) for _, n in ranked[: int(29 / 100.0 * 50)]]
    assert rows(top, "subset", "name") == sorted(expect, key=str)


@pytest.mark.parametrize("small_rows", [10_000, 0])
def test_isolated_by_chunks(spark, left, right, small_rows, monkeypatch):
    monkeypatch.setattr(selection.exact_rank, "__defaults__", ("rank", small_rows))
    monkeypatch.setattr(selection, "_best_of_each", lambda *a: None)
    df = spark.createDataFrame([(1, "train1"), (1, "train5"), (2, "train3")], "subset long, name string")
    assert selection.isolated_top(right, left, df, 2, len(LEFT)).groupBy("subset").count().where("count >= 10").count() == 2


def test_isolated_ranks_in_one_step(spark, left, right, monkeypatch):
    df = spark.createDataFrame([(1, "train1"), (1, "train5"), (2, "train3"), (3, "train1"), (3, "missing")], "subset long, name string")
    by_interval = rows(selection.isolated_top(right, left, df.withColumn("scope", F.lit(1).cast("long")), 60, len(LEFT)).drop("scope"))
    assert by_interval

    def no_rows(*args):
        raise AssertionError("a row per member and base compound must not be ranked")

    monkeypatch.setattr(selection, "_above_cuts", no_rows)
    monkeypatch.setattr(selection, "exact_rank", no_rows)
    for cells in (1, 10**6):
        monkeypatch.setattr(selection, "MEMBER_CELLS", cells)
        assert rows(selection.isolated_top(right, left, df, 60, len(LEFT))) == by_interval
    assert rows(selection.isolated_top(right, left.limit(0), df, 60, 0)) == []


@pytest.mark.parametrize("sent_rows", [selection.LABELLED_ROWS, 1])
@pytest.mark.parametrize("percent", [2, 60])
def test_isolated(spark, left, right, percent, sent_rows, monkeypatch):
    monkeypatch.setattr(selection, "LABELLED_ROWS", sent_rows)
    members = [(1, "train1"), (1, "train5"), (2, "train3"), (3, "train1")]
    by_name = {b[1]: b[2] for b in RIGHT}
    want = set()
    for s, m in members:
        amount = max(10, int(percent / 100 * len(LEFT) / sum(x == s for x, _ in members)))
        ranked = sorted((-tanimoto(a[2], by_name[m]), a[1]) for a in LEFT)
        want |= {(s, n) for _, n in ranked[:amount]}
    df = spark.createDataFrame(members, "subset long, name string")
    assert set(rows(selection.isolated_top(right, left, df, percent, len(LEFT)))) == want


@pytest.mark.parametrize("sent_rows", [selection.LABELLED_ROWS, 1])
@pytest.mark.parametrize("percent", [0, 3, 29, 100])
def test_top_of_members(spark, left, right, percent, sent_rows, monkeypatch):
    monkeypatch.setattr(selection, "LABELLED_ROWS", sent_rows)
    monkeypatch.setattr(selection, "STEP_CELLS", 100)
    subsets = {1: ["train1", "train5", "train9"], 2: ["train3", "missing"], 3: [f"train{i}" for i in range(23)], 4: ["train4"], 5: ["missing"]}
    members = spark.createDataFrame([(s, n) for s, m in subsets.items() for n in m], "subset long, name string")
    by_name = {b[1]: b[2] for b in RIGHT}
    want = set()
    for s, m in subsets.items():
        mean = lambda a: round(sum(tanimoto(a[2], by_name[n]) for n in m if n in by_name) / len(m), 9)  # noqa: E731, B023
        ranked = sorted((-mean(a), a[1]) for a in LEFT)
        # with written scores a subset without any vector has no row
        want |= {(s, n, -v) for v, n in ranked[: int(percent / 100.0 * 50)] if s != 5 or sent_rows > 1}
    got = selection.top_of_members(left, right, members, len(LEFT), percent)
    assert {(s, n, round(v, 9)) for s, n, v in rows(got, "subset", "name", "avg_sim")} == want


@pytest.mark.parametrize("dense", [selection.DENSE, 0])
@pytest.mark.parametrize("percent", [3, 29])
def test_once_per_scope(spark, left, right, percent, dense, monkeypatch):
    monkeypatch.setattr(selection, "DENSE", dense)
    monkeypatch.setattr(selection, "STEP_CELLS", 100)
    written = []
    monkeypatch.setattr(selection, "materialise", lambda df, name: written.append(name) or df)
    places = spark.createDataFrame([(f"train{(7 * i + s) % 23}", s, i) for s in (4, 9) for i in range(20)], "name string, scope long, pos long")
    spans = [(s, k, k, k % 5 + 1) for s in (4, 9) for k in range(0, 15, 3)]
    spans = spark.createDataFrame(spans, "scope long, subset long, first long, size long")
    # a scope that nobody asks for, one listed twice, and none
    scopes = F.when(F.col("ord") % 5 == 0, F.array(F.lit(9), F.lit(4), F.lit(9))).when(F.col("ord") % 5 == 1, F.expr("cast(array() as array<long>)"))
    base = left.withColumn("scopes", scopes.otherwise(F.array(F.lit(77), F.lit(4), F.lit(None))).cast("array<long>"))
    counts = base.select(F.explode(F.array_distinct("scopes")).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))
    every = selection.top_in_intervals(base, right, places, spans, counts, percent)
    union = selection.top_in_intervals(base, right, places, spans, counts, percent, once_per_scope=True)
    assert written == ["near", "near"]
    assert rows(union) == rows(every.select("scope", "name").distinct())
    n = {r["scope"]: r["n"] for r in counts.collect()}
    sizes = {(r["scope"], r["subset"]): r["count"] for r in every.groupBy("scope", "subset").count().collect()}
    assert sizes == {(s, k): c for s in (4, 9) for k in range(0, 15, 3) if (c := int(percent / 100.0 * n[s]))}


def test_selection_writes_no_scores(spark, left, right, monkeypatch):
    written = []
    monkeypatch.setattr("molweave.operators.ranking.materialise", lambda df, name: written.append(name) or df)
    members = spark.createDataFrame([(s, f"train{i}") for s in range(9) for i in range(s + 1)], "subset long, name string")
    assert selection.top_of_members(left, right, members, len(LEFT), 10).count() == 9 * 5
    assert not written


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_stats_and_blend(spark, left, right, block_rows):
    got = {r["name"]: (r["max_sim"], r["avg_sim"]) for r in sim.similarity_stats(left, right, block_rows=block_rows).collect()}
    for a in LEFT:
        found = [tanimoto(a[2], b[2]) for b in RIGHT]
        assert got[a[1]] == (max(found), pytest.approx(sum(found) / len(found), abs=1e-12))
    none = sim.similarity_stats(left, right.limit(0), block_rows=block_rows).first()
    assert (none["max_sim"], none["avg_sim"]) == (0.0, 0.0)
    both = left.withColumn("words2", F.transform("words", lambda w: w.bitwiseXOR(F.lit(5))))
    second = {r["name"]: r["words2"] for r in both.collect()}
    pairs = {(r["a"], r["b"]): r["dist"] for r in sim.blended_pairs(both, 0.5, block_rows=block_rows).collect()}
    assert len(pairs) == len(LEFT) * (len(LEFT) - 1) // 2
    names = {a[1]: a[2] for a in LEFT}
    for (a, b), dist in pairs.items():
        want = (1 - tanimoto(names[a], names[b]) + (1 - tanimoto(second[a], second[b])) * 0.5) / 1.5
        assert dist == pytest.approx(want, abs=1e-12)


def test_names_lists(spark, left):
    names = spark.createDataFrame([("base7", 0), ("base2", 1), ("nobody", 2)], "name string, pos int")
    assert [r["name"] for r in sim.select_by_names(left, names).collect()] == ["base7", "base2"]
    assert rows(sim.keep_present(names, left), "name") == [("base2",), ("base7",)]


def test_pack_and_unpack(spark, left):
    long = fp.unpack_bits(left, 128, ["name"])
    assert set(rows(long)) == {(a[1], b) for a in LEFT for b in bits_of([w % (1 << 64) for w in a[2]])}
    none = left.select("name", F.lit(None).cast("int").alias("bit"))
    again = fp.pack_bits(long.unionByName(none), ["name"], 128)
    assert rows(again) == rows(left, "name", "words")
    wide = fp.pack_bits(long.unionByName(none), ["name"], 64 * 70)
    assert rows(wide) == sorted(((a[1], a[2] + [0] * 68) for a in LEFT), key=str)


@pytest.mark.parametrize("chem_width", [128, 70])
def test_concatenation(spark, chem_width):
    rng = random.Random(3)
    def some(width):
        return packed({b for b in range(width) if rng.random() < 0.2})

    chem = [(i, n, some(chem_width)) for i, n in enumerate(["yes_12_a", "not_7_b", "yes_99_c", "yes_5"])]
    box = [(i, n, some(40)) for i, n in enumerate(["pose_3", "pose_712", "pose_12", "pose_7"])]
    got = fp.concat_by_containment(spark.createDataFrame(chem, VECTOR), spark.createDataFrame(box, VECTOR), chem_width, 40)
    want = {}
    for _, name, words in chem:
        # up to the next underscore; without one the id is empty and is found in every name
        short = name[4:][: name[4:].find("_")] if "_" in name[4:] else ""
        first = next((b for b in box if short in b[1]), None)
        if first:
            want[name] = {b for b in bits_of([w % (1 << 64) for w in words])} | {
                chem_width + b for b in bits_of([w % (1 << 64) for w in first[2]])
            }
    assert {r["name"]: bits_of([w % (1 << 64) for w in r["words"]]) for r in got.collect()} == want
    assert set(want) == {"yes_12_a", "not_7_b", "yes_5"}


def test_distance_matrix_file(spark, left, tmp_path):
    out = tmp_path / "dm"
    text_sinks.write_distance_matrix(left, str(out))
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    want = [str(len(LEFT))]
    for i, a in enumerate(LEFT):
        want.append("\t".join([a[1]] + ["%.4f" % (1 - tanimoto(a[2], b[2])) for b in LEFT[:i]]))
    assert text == "\n".join(want) + "\n"


@pytest.mark.parametrize("block_rows", [4096, 8])
def test_matrix_lines_from_blocks(spark, left, block_rows):
    want = []
    for i, a in enumerate(LEFT):
        want.append((a[0], "\t".join([a[1], *(f"{1 - tanimoto(a[2], b[2]):.4f}" for b in LEFT[:i])])))
    assert rows(sim.lower_triangle_lines(left, block_rows=block_rows)) == sorted(want, key=str)
    assert rows(sim.lower_triangle_lines(left, sim.distance_pairs(left))) == sorted(want, key=str)
    assert sim.lower_triangle_lines(left.limit(0)).count() == 0


def test_matrix_lines_are_made_without_a_shuffle_of_cells(spark, left, monkeypatch):
    def no_blocks(*args):
        raise AssertionError("cells must not be shuffled")

    by_blocks = sim._fragments
    monkeypatch.setattr(sim, "_fragments", no_blocks)
    monkeypatch.setattr(sim, "LINE_CELLS", 40)
    got = sim.lower_triangle_lines(left, ordered=True)
    assert [r["ord"] for r in got.collect()] == sorted(r["ord"] for r in left.collect())
    # vectors too large to be sent, and numbers that repeat, go by blocks
    monkeypatch.setattr(sim, "_fragments", by_blocks)
    twice = left.unionByName(left.limit(3))
    assert sim._whole_lines(twice, 1.0, False) is None
    monkeypatch.setattr(sim, "SENT_ROWS", 0)
    assert sim._whole_lines(left, 1.0, False) is None
    assert rows(sim.lower_triangle_lines(left, block_rows=7)) == rows(got)


@pytest.mark.parametrize("sent_rows", [1 << 20, 3])
def test_pairs_meet_a_sent_side_without_a_shuffle_of_pairs(spark, left, right, sent_rows, monkeypatch):
    monkeypatch.setattr(blocks, "SENT_ROWS", sent_rows)
    both = left.withColumn("words2", F.reverse("words"))
    for found, want in (
        (sim.similarity_pairs(left, right, block_rows=8, digits=3), sim.similarity_pairs(left, right).withColumn("sim", F.round("sim", 3))),
        (sim.distance_pairs(left, block_rows=8, digits=3), sim.distance_pairs(left).withColumns({c: F.round(c, 3) for c in ("sim", "dist")})),
        (sim.blended_pairs(both, 0.5, block_rows=8, digits=3), sim.blended_pairs(both, 0.5).withColumn("dist", F.round("dist", 3))),
    ):
        assert rows(found) == rows(want)
        assert ("CoGroup" in found._jdf.queryExecution().optimizedPlan().toString()) == (sent_rows == 3)
    best = [sim.most_similar(left, right, 3, block_rows=n) for n in (8, 4096)]
    assert rows(best[0]) == rows(best[1])


@pytest.mark.parametrize("digits", [None, 3, 6])
def test_pairs_as_lists_are_those_of_the_kernel(spark, digits, monkeypatch):
    """A right side that is sent hands pairs on as lists; the way by chunks gives the same rows, repeated and missing ``ord`` too."""
    rng = random.Random(3)
    kind = "name string, ord long, words array<bigint>, words2 array<bigint>"
    data = [(f"m{i}" if i % 11 else None, i // 2 if i % 13 else None, [rng.choice([0, 1, 2, 5, rng.getrandbits(40)])], [rng.getrandbits(8)]) for i in range(150)]
    df = spark.createDataFrame(data, kind)

    def found():
        pairs = sim.similarity_pairs(df, df.limit(90), block_rows=16, digits=digits)
        every = sim.similarity_pairs(df, df.limit(90), block_rows=16, digits=digits, keep_zero=True)
        return [rows(f) for f in (pairs, every, sim.distance_pairs(df, block_rows=16, digits=digits), sim.blended_pairs(df, 0.5, block_rows=16, digits=digits))]

    sent = found()
    assert "Generate" in sim.distance_pairs(df, block_rows=16, digits=digits)._jdf.queryExecution().toString()
    monkeypatch.setattr(blocks, "SENT_ROWS", 20)
    assert sent == found() and all(sent) and len(sent[0]) < len(sent[1]) == 150 * 90


def test_half_up_is_that_of_decimals():
    values = np.array([0.0000005, 0.0000015, 0.1234565, 0.1234575, 1.0000005, 0.5, 2 / 3, 1 / 3, 0.0, -0.1234565, 0.2999995, 1.0])
    want = [float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-6), ROUND_HALF_UP)) for v in values.tolist()]
    assert sim._half_up(values, 6).tolist() == want


@pytest.mark.parametrize("empty", [1.0, 0.0, -20.0])
def test_matrix_lines_put_together_from_texts(empty, monkeypatch):
    rng = random.Random(4)
    words = np.array([[rng.choice([0, rng.getrandbits(60)]), rng.choice([0, rng.getrandbits(20)])] for _ in range(60)], dtype=np.uint64)
    sizes = np.bitwise_count(words).sum(1, dtype=np.int32)
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    for limit in (sim.LINE_TEXTS, 1):
        monkeypatch.setattr(sim, "LINE_TEXTS", limit)
        texts = sim._Texts(128, empty)
        for k in range(60):
            want = "\t".join("%.4f" % d for d in (1.0 - sim.tanimoto(bits[[k]], bits[:k], empty)).ravel())
            assert texts.line(words[k], words[:k], sizes[:k]) == (want or None)
