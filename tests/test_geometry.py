import math
import random

import pytest
from plain import rows

from molweave.functions.geometry import Box
from molweave.operators import contacts, site
from molweave.operators.fingerprints import bit_text, unpack_bits

POINT = "atom_id long, x double, y double, z double, radius double"


def random_atoms(n, spread, seed, start=0):
    rng = random.Random(seed)
    place = lambda: round(rng.uniform(-spread, spread), 3)
    return [(start + i, place(), place(), place(), rng.choice([1.2, 1.7, 1.55])) for i in range(n)]


def gap(a, b):
    return math.dist(a[1:4], b[1:4]) - a[4] - b[4]


def walked_scores(atoms, box, step, gaps, carry):
    """The sweep as a plain walk. ``carry``: predecessors go on from line to line."""
    score = {a[0]: 0 for a in atoms}
    # atoms are sorted anew for every axis, ties keep the order before
    order = list(atoms)
    plans = (("x", "z", [("y", "z"), ("z", "y")]), ("y", "x", [("z", "x"), ("x", "z")]), ("z", "y", [("x", "y"), ("y", "x")]))
    number = {"x": 1, "y": 2, "z": 3}
    for (axis, sort_by, walks), limit in zip(plans, gaps):
        order.sort(key=lambda a: a[number[sort_by]])
        for outer in site.grid(box.low(axis), box.high(axis), step):
            for inner, _ in walks:
                for forward in (True, False):
                    last = None
                    for at in site.grid(box.low(inner), box.high(inner), step, forward):
                        if not carry:
                            last = None
                        for rank, a in enumerate(order):
                            if not (a[number[axis]] - a[4] <= outer <= a[number[axis]] + a[4]):
                                continue
                            if not (a[number[inner]] - a[4] <= at <= a[number[inner]] + a[4]):
                                continue
                            first_ignored = carry and axis != "y" and last == 0
                            if last is None or first_ignored:
                                score[a[0]] -= 12
                            elif gap(a, order[last]) >= limit:
                                score[a[0]] += 1
                                score[order[last][0]] += 1
                            last = rank
                        if last is not None:
                            score[order[last][0]] -= 12
                        elif carry:
                            score[order[-1][0]] -= 12
    order.sort(key=lambda a: score[a[0]], reverse=True)
    return score, [a[0] for a in order]


@pytest.mark.parametrize("mode", site.MODES)
@pytest.mark.parametrize("n, size, step", [(40, 12.0, 0.5), (25, 9.0, 0.7), (3, 8.0, 1.0), (1, 8.0, 1.0)])
def test_sweep_equals_walk(spark, mode, n, size, step):
    atoms = random_atoms(n, 5.0, n)
    # ties in a coordinate
    if n > 10:
        atoms[3] = (3, atoms[4][1], atoms[4][2], atoms[4][3], 1.7)
    box = Box((0.0, 0.0, 0.0), (size, size - 1, size + 1))
    inside = [a for a in atoms if all(box.low(c) <= a[i] <= box.high(c) for i, c in enumerate("xyz", 1))]
    gaps = (1.5, 2.0, 1.5)
    want, order = walked_scores(inside, box, step, gaps, mode == "reference")
    scored = site.sweep_scores(spark.createDataFrame(atoms, POINT), box, step, gaps, mode)
    assert {r["atom_id"]: r["score"] for r in scored.collect()} == want
    if mode == "reference":
        chosen = site.select_site(scored, 20)
        best = order[: 20 * len(inside) // 100]
        by_place = sorted((a for a in inside if a[0] in best), key=lambda a: a[1:4])
        assert rows(chosen, "bit", "atom_id") == sorted(((i, a[0]) for i, a in enumerate(by_place)), key=str)


def test_sweep_of_an_empty_box(spark):
    atoms = spark.createDataFrame(random_atoms(5, 1.0, 1), POINT)
    box = Box((100.0, 0.0, 0.0), (2.0, 2.0, 2.0))
    assert site.sweep_scores(atoms, box).count() == 0


def test_contacts_equal_brute_force(spark):
    cutoff = 4.5
    site_rows = [(i, *a[1:4]) for i, a in enumerate(random_atoms(60, 9, 1))] + [(60, 0.0, 0.0, 0.0)]
    # exactly at the cutoff is no contact; the last molecule is far away
    atoms = [(a[0] % 12, *a[1:4]) for a in random_atoms(150, 12, 2)] + [(50, 0.0, 0.0, cutoff), (51, 500.0, 0.0, 0.0)]
    where = spark.createDataFrame(site_rows, "bit int, x double, y double, z double")
    ligand = spark.createDataFrame(atoms, "mol_id long, x double, y double, z double")
    want = sorted({(a[0], s[0]) for a in atoms for s in site_rows if math.dist(a[1:], s[1:]) < cutoff})
    for limit in (50_000, 5):
        found = contacts.contact_pairs(ligand, where, cutoff, broadcast_rows=limit).distinct()
        assert sorted(map(tuple, found.collect())) == want
    assert (50, 60) not in want
    packed = contacts.contact_fingerprints(ligand, where, 61, cutoff)
    salted = contacts.contact_fingerprints(ligand, where, 61, cutoff, broadcast_rows=5)
    assert rows(packed) == rows(salted)
    assert packed.count() == 14
    assert packed.where("mol_id = 51").first()["words"] == [0]
    assert sorted(map(tuple, unpack_bits(packed, 61, ["mol_id"]).collect())) == want


def test_more_cutoff_more_contacts(spark):
    where = spark.createDataFrame([(i, *a[1:4]) for i, a in enumerate(random_atoms(40, 9, 5))], "bit int, x double, y double, z double")
    ligand = spark.createDataFrame([(a[0] % 5, *a[1:4]) for a in random_atoms(60, 9, 6)], "mol_id long, x double, y double, z double")
    near, far = (set(map(tuple, contacts.contact_pairs(ligand, where, c).collect())) for c in (2.0, 4.0))
    assert near < far


def test_box_edges_and_quality(spark):
    box = Box((0.0, 0.0, 0.0), (3.0, 2.0, 2.0))
    atoms = spark.createDataFrame([(0, 1.5, 1.0, -1.0, 1.0), (1, 1.5001, 0.0, 0.0, 1.0)], POINT)
    assert [r["atom_id"] for r in contacts.box_atoms(atoms, box).collect()] == [0]
    assert tuple(contacts.box_quality(atoms, box).first()) == (2, 1, True)


def test_box_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "atoms")
    spark.createDataFrame(random_atoms(20, 5, 1), POINT).write.parquet(path)
    inside = contacts.box_atoms(spark.read.parquet(path), Box((0.0, 0.0, 0.0), (3.0, 2.0, 2.0)))
    plan = inside.select("atom_id")._jdf.queryExecution().executedPlan().toString()
    # the plan text cuts the list of pushed filters short
    assert "PushedFilters" in plan and "LessThanOrEqual(x,1.5)" in plan
    assert "radius" not in plan


def test_contacts_meet_the_site_without_a_row_per_pair(spark):
    where = spark.createDataFrame([(i % 70, *a[1:4]) for i, a in enumerate(random_atoms(90, 9, 3))] + [(70, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "bit int, x double, y double, z double")
    atoms = [(f"m{a[0] % 9}", a[0] % 2, *a[1:4]) for a in random_atoms(200, 12, 4)] + [(None, 1, 0.0, 0.0, 0.0), ("free", None, 900.0, 0.0, 0.0), ("free", 3, None, 0.0, math.nan)]
    # atoms of a molecule are spread over partitions, and the last ones are there twice
    ligand = spark.createDataFrame(atoms + atoms[-9:], "name string, part int, x double, y double, z double").repartition(5)
    by = ("name", "part")
    found = contacts.contact_pairs(ligand, where, 4.5, by, once=True)
    assert rows(found) == rows(contacts.contact_pairs(ligand, where, 4.5, by, broadcast_rows=5).distinct())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    packed, salted = (contacts.contact_fingerprints(ligand, where, 71, 4.5, by, broadcast_rows=n) for n in (1000, 5))
    assert rows(packed) == rows(salted)
    assert "Join" not in packed._jdf.queryExecution().optimizedPlan().toString()
    text = {(r["name"], r["part"]): r["bits"] for r in bit_text(packed, by, 71).collect()}
    bits = {key: "" for key in text} | {}
    for name, part, bit in sorted(map(tuple, unpack_bits(packed, 71, list(by)).collect()), key=lambda r: r[2]):
        bits[name, part] += f",{bit}" if bits[name, part] else str(bit)
    assert text == bits and text["free", 3] == ""


def test_nearest_of_sent_site_is_that_of_the_join(spark):
    where = spark.createDataFrame([(i, *a[1:4]) for i, a in enumerate(random_atoms(50, 9, 7) * 2)] + [(None, 0.0, 0.0, 0.0)], "bit int, x double, y double, z double")
    far = [(f"m{a[0]}", *(v + 40.0 * (a[0] % 5) for v in a[1:4])) for a in random_atoms(60, 30, 8)]
    ligand = spark.createDataFrame(far * 2 + [(None, 1.0, 2.0, 3.0)], "name string, x double, y double, z double").repartition(6)
    near, joined = (contacts.nearest_site_atoms(ligand, where, ("name",), broadcast_rows=n) for n in (1000, 5))
    assert rows(near) == rows(joined)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_molecules_may_be_named_by_a_struct(spark):
    where = spark.createDataFrame([(i, *a[1:4]) for i, a in enumerate(random_atoms(30, 9, 3))], "bit int, x double, y double, z double")
    ligand = spark.createDataFrame([((a[0] % 4, "m"), *a[1:4]) for a in random_atoms(40, 9, 4)] + [(None, 0.0, 0.0, 0.0)], "mol struct<id: long, name: string>, x double, y double, z double")
    packed, salted = (contacts.contact_fingerprints(ligand, where, 30, 4.5, ("mol",), broadcast_rows=n) for n in (1000, 5))
    assert rows(packed) == rows(salted) and packed.count() == 5
