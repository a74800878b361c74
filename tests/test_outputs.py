"""Stored atoms, committed outputs, counts along a run and nearest site atoms."""

import json
import math
import os
import random

import pyarrow.parquet as pq
import pytest
from plain import rows
from pyspark.sql import functions as F

from molweave.functions.geometry import Box
from molweave.operators.contacts import nearest_site_atoms
from molweave.plans.counts import RunCounts
from molweave.session import materialise, scratch_path
from molweave.sinks import atoms as stored
from molweave.sinks import committed

BOX = Box((2.0, 2.0, 2.0), (3.0, 3.0, 3.0))


def cloud(n, seed, spread=20.0):
    rng = random.Random(seed)
    return [(i, *(rng.uniform(-spread, spread) for _ in range(3))) for i in range(n)]


def test_box_filter_skips_row_groups(spark):
    data = cloud(60_000, 1)
    df = spark.createDataFrame([*data, (-1, None, 1.0, 1.0)], "atom_id long, x double, y double, z double")
    path = scratch_path(spark, "atoms")
    stored.write_atom_table(df, path, 1 << 15)
    found = stored.read_box(spark, path, BOX)
    inside = [a for a in data if all(0.5 <= c <= 3.5 for c in a[1:])]
    assert rows(found) == sorted(inside, key=str) and len(inside) > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x)" in plan and "GreaterThanOrEqual(x,0.5)" in plan
    groups = kept = 0
    for file in spark.read.parquet(path).inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            kept += all(columns[c].min is not None and columns[c].min <= 3.5 and columns[c].max >= 0.5 for c in "xyz")
    assert groups >= 40 and kept <= groups / 5


def test_stored_atoms_edges(spark):
    none = spark.createDataFrame([], "x double, y double, z double")
    for df in (none, spark.createDataFrame([(1.0, 1.0, 1.0)] * 3, "x double, y double, z double")):
        path = scratch_path(spark, "atoms")
        stored.write_atom_table(df, path)
        assert stored.read_box(spark, path, BOX).count() == df.count()


def lines(spark, n, parts=4):
    df = spark.range(1, n + 1).repartitionByRange(parts, "id").sortWithinPartitions("id")
    return df.select(F.col("id").alias("number"), F.concat(F.lit("line "), F.col("id")).alias("line"))


def test_committed_lines(spark):
    path = scratch_path(spark, "lines")
    committed.write_committed(lines(spark, 50).select("line"), path, count_line=True)
    parts = committed.committed_parts(path)
    got = [r["line"] for p in parts for r in spark.read.text(p).select(F.col("value").alias("line")).collect()]
    assert got == ["50"] + [f"line {i}" for i in range(1, 51)]
    # a later write takes the place of the first
    committed.write_committed(lines(spark, 3), path)
    assert rows(committed.read_committed(spark, path)) == [(f"line {i}",) for i in range(1, 4)]


def test_failed_write_shows_nothing(spark):
    path = scratch_path(spark, "lines")
    bad = F.when(F.col("number") == 17, F.raise_error(F.lit("stop"))).otherwise(F.col("line"))
    with pytest.raises(Exception, match="stop"):
        committed.write_committed(lines(spark, 50).select(bad.alias("line")), path, count_line=True)
    with pytest.raises(FileNotFoundError):
        committed.read_committed(spark, path)
    committed.write_committed(lines(spark, 5), path)
    # a task that outlives its aborted write may leave its staging file, which no reader looks at
    shown = lambda: sorted(f for f in os.listdir(path) if not f.startswith(".staging"))
    before = shown()
    with pytest.raises(Exception, match="stop"):
        committed.write_committed(lines(spark, 50).select(bad.alias("line")), path)
    assert shown() == before and committed.read_committed(spark, path).count() == 5


def test_gap_in_numbers_is_refused(spark):
    path = scratch_path(spark, "lines")
    for drop in (20, 1):
        with pytest.raises(Exception, match="number"):
            committed.write_committed(lines(spark, 50).where(F.col("number") != drop), path)
        assert committed.committed_parts(path) is None


def test_committed_nothing(spark):
    path = scratch_path(spark, "lines")
    committed.write_committed(lines(spark, 0).select("line"), path, count_line=True)
    assert rows(committed.read_committed(spark, path)) == [("0",)]
    committed.write_committed(lines(spark, 0), path)
    assert committed.read_committed(spark, path).count() == 0


def test_counts_without_a_scan_of_their_own(spark, tmp_path):
    counts = RunCounts()
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.range(100).withColumn("x", F.col("id") % 10)
    df = counts.watch(source.mapInArrow(touch, source.schema), box_atoms=F.count_if(F.col("x") < 1), protein_atoms=F.count(F.lit(1)))
    materialise(df.groupBy("x").count(), "pass")
    assert counts.values() == {"box_atoms": 10, "protein_atoms": 100, "too_few": False}
    assert seen.value == 100
    (row,) = counts.table(spark).collect()
    assert json.loads(json.dumps(row.asDict())) == counts.values()


@pytest.mark.parametrize("broadcast_rows", [50_000, 3])
def test_nearest_site_atom_at_any_distance(spark, broadcast_rows):
    rng = random.Random(2)
    site = [(b, *c) for b, (_, *c) in enumerate(cloud(40, 3, 8.0))] + [(40, 1.0, 1.0, 1.0), (41, 1.0, 1.0, 1.0)]
    atoms = []
    for mol in range(60):
        far = rng.choice([0.0, 10.0, 300.0, 5e4])
        atoms += [(mol, *(rng.uniform(-9, 9) + far for _ in range(3))) for _ in range(3)]
    atoms += [(60, 1.0, 1.0, 1.0), (61, math.nan, 0.0, 0.0), (62, None, 1.0, 1.0), (61, math.inf, 0.0, 0.0)]
    kind = "{} long, x double, y double, z double"
    sites = spark.createDataFrame(site, kind.format("bit").replace("bit long", "bit int"))
    got = {r["mol_id"]: (r["bit"], r["distance"]) for r in nearest_site_atoms(spark.createDataFrame(atoms, kind.format("mol_id")), sites, broadcast_rows=broadcast_rows).collect()}
    assert set(got) == set(range(61)) and got[60] == (40, 0.0)
    for mol, (bit, found) in got.items():
        every = [(math.dist(a[1:], s[1:]), s[0]) for a in atoms if a[0] == mol for s in site]
        assert math.isclose(found, min(every)[0], rel_tol=1e-12) and (min(every)[1] == bit or mol != 60)


def test_nearest_plan_has_no_cross_join(spark):
    atoms = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "mol_id long, x double, y double, z double")
    empty = spark.createDataFrame([], "bit int, x double, y double, z double")
    assert nearest_site_atoms(atoms, empty).count() == 0
    assert nearest_site_atoms(atoms.limit(0), spark.createDataFrame([(1, 0.0, 0.0, 0.0)], empty.schema)).count() == 0
