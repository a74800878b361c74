import json

import pytest
from plain import rows
from pyspark.sql import functions as F

from molweave.operators.docking import docking_summary, first_pose
from molweave.operators.mass import pdbqt_masses, short_atom_lines
from molweave.operators.ranking import last_by_name
from molweave.sources import docking_log, docking_results, elements, mol2, pdbqt, records, report
from molweave.sources import training, xyz
from molweave.functions.geometry import Box
from molweave.sinks import tables, text as text_sinks

MOL2 = """@<TRIPOS>MOLECULE
yes_1
 3 2 0 0 0
SMALL
GASTEIGER

@<TRIPOS>ATOM
      1 C1          2.2500   -7.5000    3.1250 C.3     1  ABC42      -0.3750
      2 XX         broken    -6.2500    4.5000 C.2     1  ABC42       0.2500
      3 ZN          1.7500   -8.0000    2.6250 Zn      1  ABC42       0.8750
@<TRIPOS>BOND
     1     1     3    1
     2     1     2   ar
@<TRIPOS>MOLECULE
NOT_2
 1 0 0 0 0
SMALL
GASTEIGER

@<TRIPOS>ATOM
      1 N          1.5   2.5  -3.5 N.pl3     7  RES       0.5
@<TRIPOS>BOND
@<TRIPOS>MOLECULE
yes_1
 1 0 0 0 0
SMALL
GASTEIGER

@<TRIPOS>ATOM
      1 O          0.0   0.0  0.0 O.2     7  RES       0.5
@<TRIPOS>BOND
"""


@pytest.fixture
def mol2_path(tmp_path):
    path = tmp_path / "set.mol2"
    path.write_text(MOL2)
    return str(path)


def test_mol2(spark, mol2_path):
    molecules = mol2.with_file_order(mol2.read_mol2(spark, mol2_path))
    assert rows(molecules, "ord", "name", "label", "ext_id") == [
        (0, "yes_1", "yes", "1"),
        (1, "NOT_2", "not", "2"),
        (2, "yes_1", "yes", "1"),
    ]
    atoms = mol2.read_atoms(molecules).join(molecules.select("mol_id", "ord"), "mol_id")
    assert rows(atoms, "ord", "serial", "atom_name", "x", "element", "radius", "resname") == [
        (0, 1, "C1", 2.25, "C", 1.7, "ABC42"),
        (0, 3, "ZN", 1.75, "Zn", 1.7, "ABC42"),
        (1, 1, "N", 1.5, "N", 1.55, "RES"),
        (2, 1, "O", 0.0, "O", 1.52, "RES"),
    ]
    assert [r["line"].split()[1] for r in mol2.rejected_atoms(molecules).collect()] == ["XX"]
    assert rows(mol2.read_bonds(molecules), "bond_id", "a", "b", "btype") == [(1, 1, 3, "1"), (2, 1, 2, "ar")]
    last = last_by_name(molecules.select("name", "ord"))
    assert rows(last) == [("NOT_2", 1), ("yes_1", 2)]


def test_mol2_split_size_does_not_matter(spark, tmp_path):
    text = "".join(MOL2.replace("yes_1", f"yes_{i}").replace("NOT_2", f"not_{i}") for i in range(60))
    (tmp_path / "big.mol2").write_text(text)

    def read():
        found = mol2.with_file_order(mol2.read_mol2(spark, str(tmp_path)))
        return found.rdd.getNumPartitions(), rows(found, "ord", "name")

    parts, whole = read()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        split = mol2.read_mol2(spark, str(tmp_path)).rdd.getNumPartitions()
        _, pieces = read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert split > 5
    assert pieces == whole and len(whole) == 180
    assert [o for o, _ in sorted(whole)] == list(range(180))


def test_skip_and_limit(spark, mol2_path):
    molecules = mol2.read_mol2(spark, mol2_path)
    assert [r["name"] for r in records.first_records(molecules, 2).collect()] == ["yes_1", "NOT_2"]
    assert sorted(r["name"] for r in records.skip_records(molecules, 1).collect()) == ["NOT_2", "yes_1"]


def test_xyz(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("2\ntitle\nC 1.0 2.0 3.0\nCl\t4 5 6\nbad line\n")
    assert rows(xyz.read_xyz(spark, str(tmp_path)), "line_no", "element", "x", "radius", "resname") == [
        (2, "C", 1.0, 1.7, "LIG"),
        (3, "Cl", 4.0, 1.75, "LIG"),
    ]


def _pdbqt_line(kind, name, atom_type):
    return f"{kind:<6}    1 {name:<4} UNK A  0       11.250  -3.500   7.125  0.00  0.00    +0.125 {atom_type:<2}"


def test_pdbqt(spark, tmp_path):
    lines = [
        "MODEL 1", "REMARK  Name = first", _pdbqt_line("ATOM", " C", "C"), _pdbqt_line("ATOM", "HD21", "HD"),
        _pdbqt_line("HETATM", " O", "O"), "ATOM      1  C   short", "ENDMDL",
        "MODEL 2", "ENDMDL",
        "MODEL 3", "REMARK  Name = third", _pdbqt_line("ATOM", " Xx", "X"), _pdbqt_line("ATOM", " N", "N"),
    ]
    (tmp_path / "m.pdbqt").write_text("\n".join(lines) + "\n")
    models = pdbqt.read_pdbqt(spark, str(tmp_path))
    assert rows(models.select("ligand", F.size("lines").alias("n"))) == [("first", 5), ("third", 3)]
    found = pdbqt_masses(models, elements.load_elements(spark))
    assert rows(found.select("ligand", F.round("mass", 4))) == [("first", 13.0189), ("third", 14.0067)]
    assert short_atom_lines(models).count() == 1


def test_pdbqt_split_size_does_not_matter(spark, tmp_path):
    text = "".join(
        f"MODEL {i}\r\nREMARK  Name = lig_{i}\r\n{_pdbqt_line('ATOM', ' C', 'C')}\r\nENDMDL\r\n" for i in range(200)
    )
    (tmp_path / "m.pdbqt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        models = pdbqt.read_pdbqt(spark, str(tmp_path))
        assert models.rdd.getNumPartitions() > 5
        found = rows(models, "ligand", F.size("lines"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == sorted(((f"lig_{i}", 2) for i in range(200)), key=str)


def test_models_written_and_read_again(spark, tmp_path):
    models = spark.createDataFrame(
        [(i, f"lig_{i % 3}", [f"REMARK  Name = lig_{i % 3}", f"ROOT {i}"]) for i in range(7)],
        "model_no int, ligand string, lines array<string>",
    )
    assert rows(first_pose(models), "ligand", "model_no") == [("lig_0", 0), ("lig_1", 1), ("lig_2", 2)]
    out = str(tmp_path / "all")
    text_sinks.write_models(models, out, ["model_no"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("part-*")))
    assert text.startswith("MODEL 1\nREMARK  Name = lig_0\nROOT 0\nENDMDL\nMODEL 2\n")
    again = pdbqt.read_pdbqt(spark, out)
    assert sorted(r["ligand"] for r in again.collect()) == sorted(f"lig_{i % 3}" for i in range(7))


GOOD = """Reading input ... done.
mode |   affinity | dist from best mode
     | (kcal/mol) | rmsd l.b.| rmsd u.b.
-----+------------+----------+----------
   1         -7,5      0.000      0.000
   2         -7.1      1.500      2.250
Writing output ... done.
"""


def plain_log(text):
    """The log rules as a plain loop."""
    modes, finished, table = [], False, False
    for line in text.splitlines():
        if not table:
            table = line[:4] == "mode"
            continue
        words = [w for w in line.split(" ") if w]
        if words and words[0][0].isdigit():
            if len(words) != 4:
                return modes, finished, False
            modes.append(tuple(float(w.replace(",", ".")) for w in words[1:]))
        elif words and "done" in line:
            finished = True
    return modes, finished, bool(modes)


LOGS = {
    "good": GOOD,
    "no_table": GOOD.replace("mode |", "table |"),
    "bad_row": GOOD.replace("Writing", "   3   1.0\n   4  1 2 3\nWriting"),
    "long_row": GOOD.replace("   2  ", "   2  9 "),
    "not_done": GOOD.replace("Writing output ... done.", "Stopped."),
    "row_with_done": GOOD.replace("Writing output ... done.", "3 1 done 2"),
    "one_mode": GOOD.replace("   2         -7.1      1.500      2.250\n", ""),
    "no_rows": GOOD.split("   1  ")[0],
    "windows": GOOD.replace("\n", "\r\n"),
    "no_final_break": GOOD.rstrip("\n"),
}


def test_docking_logs(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for name, text in LOGS.items():
        (folder / f"{name}_out.log").write_bytes(text.encode())
    logs = docking_log.read_docking_logs(spark, str(folder))
    found = {r["ligand"]: r for r in logs.collect()}
    for name, text in LOGS.items():
        if name == "row_with_done":
            continue
        modes, finished, ok = plain_log(text)
        got = found[name]
        assert [(m["energy"], m["rmsd_lb"], m["rmsd_ub"]) for m in got["modes"]] == modes, name
        assert [m["mode"] for m in got["modes"]] == list(range(1, len(modes) + 1))
        assert (got["finished"], got["ok"]) == (finished, ok), name
    assert not found["row_with_done"]["finished"]
    wide = {r["Name"]: r for r in docking_summary(logs).collect()}
    assert wide["good"]["2_RMSDRB"] == 2.25 and wide["good"]["3_Energy"] is None
    assert wide["no_rows"]["1_Energy"] is None
    out = str(tmp_path / "summary")
    tables.write_docking_summary(logs, out)
    again = {r["ligand"]: r["energy"] for r in docking_results.read_docking_results(spark, out).collect()}
    assert again["good"] == -7.5 and again["no_table"] is None


def test_docking_results(spark, tmp_path):
    good = tmp_path / "good.tsv"
    good.write_text("Ligand\t1_Energy\t2_Energy\nA\t-7,5\t1\nB  -6.25 1\nA\t-8.5\t2\n")
    assert rows(docking_results.read_docking_results(spark, str(good))) == [("A", -8.5), ("B", -6.25)]
    bad = tmp_path / "bad.tsv"
    bad.write_text("Ligand\tEnergy\nA\t1\n")
    assert docking_results.read_docking_results(spark, str(bad)).count() == 0


def test_elements(spark):
    assert elements.load_elements(spark).count() == 109
    lines = spark.createDataFrame([(0, "One\tXx\t1\t2,5"), (1, "Two\txX\t2\t3")], "ord long, line string")
    assert rows(elements.load_elements(spark, lines)) == [("One", "xx", 1, 2.5)]
    assert rows(elements.repeated_elements(lines)) == [("xx", 2)]


def test_training_names(spark):
    ids = training.labelled_ids(spark)
    assert rows(ids.groupBy("label").count()) == [("not", 35), ("yes", 68)]
    table = spark.createDataFrame([("5", "a (b)"), ("6", "c")], "ext_id string, long_name string")
    named = training.training_set(table.where("ext_id = '5'"), table.where("ext_id = '6'"), True, True)
    assert rows(named, "name", "label") == [("not_6_c", "not"), ("yes_5_ab", "yes")]
    assert rows(training.with_long_names(named.withColumn("name", F.concat("label", F.lit("_5"))), table).select("name", "label")) == [
        ("not_5", "not"), ("yes_5", "yes")
    ]


def test_report(spark, tmp_path):
    record = {"id": "1", "energy": -7.5, "score": 1.0, "similarChem": [{"id": "2", "type": "inhibitor", "longname": "x", "similarity": 50}], "similarContacts": []}
    path = tmp_path / "report.json"
    path.write_text(json.dumps([record, {**record, "id": "0"}]))
    saved = report.read_report(spark, str(path), one_array=True)
    out = str(tmp_path / "lines")
    tables.write_report(saved, out)
    assert rows(report.read_report(spark, out), "id", "energy") == [("0", -7.5), ("1", -7.5)]
    assert report.read_report(spark, out).where("id = '1'").first()["similarChem"][0]["similarity"] == 50
    assert report.read_report(spark, str(tmp_path / "missing.json")) is None
    (tmp_path / "broken.json").write_text('{"id": "1", "energy"')
    assert report.read_report(spark, str(tmp_path / "broken.json")) is None
    assert report.read_report(spark, str(tmp_path / "broken.json"), one_array=True) is None


def test_xyz_of_a_box(spark, tmp_path):
    atoms = spark.createDataFrame(
        [(0, "C", 0.0, 0.0, 0.0), (1, "N", 1.0, -1.0, 1.0), (2, "O", 1.5, 0.0, 0.0)],
        "atom_id long, element string, x double, y double, z double",
    )
    text_sinks.write_xyz(atoms, Box((0.0, 0.0, 0.0), (2.0, 2.0, 2.0)), str(tmp_path / "box"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "box").glob("part-*")))
    assert text == "2\nProteinBox\nC\t0.0\t0.0\t0.0\nN\t1.0\t-1.0\t1.0\n"
