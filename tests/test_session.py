from molweave import session


def test_scratch_follows_the_setting(spark, tmp_path, monkeypatch):
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")
    monkeypatch.setattr(session, "CHECKPOINT_KEY", "spark.some.unset.key")
    first, second = session.shared_dir(spark), session.shared_dir(spark)
    assert first == second and "molweave-" in first


def test_materialise_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "array(id, null) a", "struct(id x) s")
    stored = session.materialise(df)
    # reading a file makes every field nullable; names and types stay
    assert stored.dtypes == df.dtypes
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))
    assert session.materialise(df.where("id < 0")).count() == 0
