from plain import rows

from molweave.plans import jobs
from molweave.sources import pdbqt
from molweave.streaming import intake
from test_sources import GOOD


def log(folder, name, energy):
    (folder / f"{name}_out.log").write_text(GOOD.replace("-7,5", energy))


def test_logs_arrive_in_two_lots(spark, tmp_path):
    logs, out, seen = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "seen")
    logs.mkdir()
    log(logs, "a", "-1.0")
    log(logs, "b", "-2.0")

    def fold():
        stream = intake.stream_docking_logs(spark, str(logs))
        intake.append_summary(stream, out, seen).awaitTermination()
        return rows(spark.read.parquet(out), "Name", "1_Energy")

    assert fold() == [("a", -1.0), ("b", -2.0)]
    log(logs, "c", "-3.0")
    assert fold() == [("a", -1.0), ("b", -2.0), ("c", -3.0)]
    assert fold() == [("a", -1.0), ("b", -2.0), ("c", -3.0)]


def test_first_log_of_a_ligand_stays(spark, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")

    def fold(folder, **energies):
        (tmp_path / folder).mkdir()
        for name, energy in energies.items():
            log(tmp_path / folder, name, energy)
        # a new query from the same checkpoint: what it knows comes from the state store
        intake.append_summary(intake.stream_first_logs(spark, f"{tmp_path}/logs*"), out, seen).awaitTermination()
        return rows(spark.read.parquet(out), "Name", "1_Energy")

    assert fold("logs1", a="-1.0", b="-2.0") == [("a", -1.0), ("b", -2.0)]
    assert fold("logs2", a="-9.0", d="-4.0") == [("a", -1.0), ("b", -2.0), ("d", -4.0)]
    assert fold("logs3", a="-9.5", d="-9.9") == [("a", -1.0), ("b", -2.0), ("d", -4.0)]


def test_earliest_log_of_a_lot(spark, tmp_path):
    import os

    for k, (folder, energy) in enumerate((("logs1", "-3.0"), ("logs2", "-1.0"), ("logs3", "-2.0"))):
        (tmp_path / folder).mkdir()
        log(tmp_path / folder, "a", energy)
        # the second folder's log is the oldest
        os.utime(tmp_path / folder / "a_out.log", (1_700_000_000 + (k - 1) ** 2 * 60, 1_700_000_000 + (k - 1) ** 2 * 60))
    out = str(tmp_path / "out")
    intake.append_summary(intake.stream_first_logs(spark, f"{tmp_path}/logs*"), out, str(tmp_path / "seen")).awaitTermination()
    assert rows(spark.read.parquet(out), "Name", "1_Energy") == [("a", -1.0)]


def test_first_pose_of_a_ligand_stays(spark, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    model = lambda name, text: f"MODEL 1\nREMARK  Name = {name}\nROOT {text}\nENDMDL"

    def fold(file, *models):
        (tmp_path / "poses").mkdir(exist_ok=True)
        (tmp_path / "poses" / file).write_text("\n".join(models) + "\n")
        intake.append_table(intake.stream_first_poses(spark, f"{tmp_path}/poses"), out, seen).awaitTermination()
        return {r["ligand"]: r["lines"][-1] for r in spark.read.parquet(out).collect()}

    assert fold("one.pdbqt", model("a", "a1"), model("a", "a2"), model("b", "b1")) == {"a": "ROOT a1", "b": "ROOT b1"}
    assert fold("two.pdbqt", model("c", "c1"), model("b", "b2"), model("c", "c2")) == {"a": "ROOT a1", "b": "ROOT b1", "c": "ROOT c1"}
    # empty and blank files bring nothing
    assert fold("three.pdbqt", "", "MODEL 2", "ENDMDL") == {"a": "ROOT a1", "b": "ROOT b1", "c": "ROOT c1"}


def test_docking_collection(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "poses").mkdir()
    for name, energy in (("a", "-1.0"), ("b", "-2.0")):
        log(tmp_path / "logs", name, energy)
        models = [f"MODEL {i}\nREMARK  Name = {name}\nROOT {name}{i}\nENDMDL" for i in (1, 2, 3)]
        (tmp_path / "poses" / f"{name}.pdbqt").write_text("\n".join(models) + "\n")
    summary, collected = str(tmp_path / "summary"), str(tmp_path / "collected")
    jobs.docking_collection_job(spark, str(tmp_path / "logs"), str(tmp_path / "poses"), summary, collected)
    table = spark.read.csv(summary, sep="\t", header=True)
    assert rows(table, "Name") == [("a",), ("b",)]
    kept = {r["ligand"]: r["lines"][-1] for r in pdbqt.read_pdbqt(spark, collected).collect()}
    assert kept == {"a": "ROOT a1", "b": "ROOT b1"}


def test_a_lot_is_listed_by_few_tasks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log(tmp_path / "logs", "a", "-1.0")
    before = spark.conf.get(intake.LISTING_TASKS)
    stream = intake.stream_first_logs(spark, str(tmp_path / "logs"))
    assert int(stream.sparkSession.conf.get(intake.LISTING_TASKS)) == 2 * spark.sparkContext.defaultParallelism
    # settings that were made while the session ran hold, and the caller's are left alone
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        assert stream.sparkSession.conf.get(key) == spark.conf.get(key)
    assert spark.conf.get(intake.LISTING_TASKS) == before
