import random

from molweave.operators.fingerprints import circular_bits, circular_environments, circular_fingerprints, record_fingerprints

ATOM, BOND = "mol_id long, serial int, element string", "mol_id long, a int, b int, btype string"


def random_molecule(seed, mol_id, n=12):
    rng = random.Random(seed)
    atoms = [(mol_id, i, rng.choice(["C", "N", "O", "H", "Cl"])) for i in range(n)]
    bonds = [(mol_id, rng.randrange(i), i, rng.choice(["1", "2", "ar"])) for i in range(1, n - 1)]
    bonds.append((mol_id, 0, 5, "1"))
    return atoms, bonds


def bits(spark, molecules, **options):
    atoms = spark.createDataFrame([a for m in molecules for a in m[0]], ATOM)
    bonds = spark.createDataFrame([b for m in molecules for b in m[1]], BOND)
    found = {}
    for r in circular_bits(atoms, bonds, **options).collect():
        found.setdefault(r["mol_id"], set()).add(r["bit"])
    return found


def test_renumbering_atoms_changes_nothing(spark):
    atoms, bonds = random_molecule(5, 1)
    turn = list(range(len(atoms)))
    random.Random(9).shuffle(turn)
    other = (
        [(2, turn[s], e) for _, s, e in atoms],
        [(2, turn[b], turn[a], t) for _, a, b, t in bonds],
    )
    # which of two environments over the same bonds is kept depends on their hashes alone
    found = bits(spark, [(atoms, bonds), other])
    assert found[1] == found[2]


def test_chemistry_changes_bits(spark):
    atoms, bonds = random_molecule(5, 1)
    changed = [(2, s, "S" if s == 3 else e) for _, s, e in atoms]
    retyped = [(3, a, b, "3" if i == 0 else t) for i, (_, a, b, t) in enumerate(bonds)]
    found = bits(spark, [(atoms, bonds), (changed, [(2, *b[1:]) for b in bonds]), ([(3, *a[1:]) for a in atoms], retyped)])
    assert found[1] != found[2] and found[1] != found[3]
    assert len(found[1] & found[2]) > 0


def test_environments(spark):
    # propane-like chain: the environment of radius 2 covers what radius 1 of the middle covers
    atoms = spark.createDataFrame([(1, i, "C") for i in (1, 2, 3)] + [(2, 1, "O")], ATOM)
    bonds = spark.createDataFrame([(1, 1, 2, "1"), (1, 2, 3, "1"), (1, 3, 9, "1")], BOND)
    found = circular_environments(atoms, bonds).groupBy("mol_id", "round").count().collect()
    assert {(r["mol_id"], r["round"]): r["count"] for r in found} == {(1, 0): 3, (1, 1): 3, (2, 0): 1}
    packed = circular_fingerprints(atoms, bonds).where("mol_id = 2").first()["words"]
    assert len(packed) == 16 and sum(bin(w % (1 << 64)).count("1") for w in packed) == 1


def test_records_give_what_tables_give(spark):
    molecules = [random_molecule(s, s, n) for s, n in ((1, 3), (2, 12), (3, 30))]
    molecules[2][1].extend([(3, 4, 4, "1"), (3, 5, 99, "1"), (3, 1, 2, "ar"), (3, 1, 2, "ar")])
    molecules.append(([(4, 7, "C"), (4, 7, "N"), (4, 8, "Cl")], []))
    # more bonds than a word has bits, more than are worked on together, negative and far serials
    molecules += [random_molecule(5, 5, 90), random_molecule(6, 6, 700), random_molecule(7, 7, 6)]
    molecules[-1][0].extend([(7, -5, "H"), (7, 2_000_000_000, "H")])
    molecules[-1][1].extend([(7, -5, 1, "1"), (7, 2_000_000_000, 1, "am"), (7, 2, -5, "x")])
    atoms = spark.createDataFrame([a for m in molecules for a in m[0]], ATOM)
    bonds = spark.createDataFrame([b for m in molecules for b in m[1]], BOND)
    want = {r["mol_id"]: r["words"] for r in circular_fingerprints(atoms, bonds).collect()}
    kind = "mol_id long, atoms array<struct<serial: int, element: string>>, bonds array<struct<a: int, b: int, btype: string>>"
    records = [(a[0][0], [x[1:] for x in a], [x[1:] for x in b]) for a, b in molecules]
    got = {r["mol_id"]: r["words"] for r in record_fingerprints(spark.createDataFrame(records, kind), ["mol_id"]).collect()}
    assert got == want


def test_records_without_content(spark):
    kind = "mol_id long, atoms array<struct<serial: int, element: string>>, bonds array<struct<a: int, b: int, btype: string>>"
    rows = [(1, None, None), (2, [], []), (3, [(None, "C"), (1, None)], [(1, 2, "1"), (None, 1, "1")]), (4, [(1, "")], None)]
    got = {r["mol_id"]: sum(bin(w % (1 << 64)).count("1") for w in r["words"]) for r in record_fingerprints(spark.createDataFrame(rows, kind), ["mol_id"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}
    assert record_fingerprints(spark.createDataFrame([], kind), ["mol_id"]).count() == 0
