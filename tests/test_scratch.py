"""Scratch tables: the shared folder, clean-up, and what they return."""

import os

import pytest

from graphloom.plans import scratch


def test_tables_live_in_the_shared_folder(spark):
    run = scratch.Scratch(spark, "t")
    assert run.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    made = run.table(spark.range(5).selectExpr("id", "id % 2 AS k"), "x")
    path = made._graphloom_path.removeprefix("file://")
    assert made.count() == 5 and made.dtypes == [("id", "bigint"), ("k", "bigint")] and os.path.isdir(path)
    run.drop(made)
    assert not os.path.exists(path)
    run.drop(None)
    run.table(spark.range(1), "y")
    scratch.close_all()
    assert not os.path.exists(run.root.removeprefix("file://"))


def test_without_a_named_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            applicationId = "app-1"
            master = "local[2]"
            getCheckpointDir = staticmethod(lambda: None)

    first = scratch.shared_dir(Session)
    assert first == scratch.shared_dir(Session) and os.path.isdir(first.removeprefix("file://"))
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Session)
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://x/y/")
    assert scratch.shared_dir(Session) == "hdfs://x/y"


def test_counted_tables_and_parts(spark):
    run = scratch.Scratch(spark, "t")
    made = run.table(spark.range(7), "n", counted=True)
    assert made._graphloom_rows == 7 and "MERGE" in side_plan(scratch.side(made, 6)) and "MERGE" not in side_plan(scratch.side(made, 7)).upper()
    with pytest.raises(ValueError):
        scratch.side(run.table(spark.range(1)))
    parts = run.split(spark.range(10).selectExpr("id", "if(id < 3, 'a', 'b') AS k"), "p", "k", lambda: {"a": 3, "b": 7, "c": 0})
    assert {k: (v.columns, v.count()) for k, v in parts.items()} == {"a": (["id"], 3), "b": (["id"], 7)}
    run.drop(parts["a"])
    assert parts["b"].count() == 7
    run.keep(parts["b"])
    assert parts["b"].count() == 7 and not os.path.exists(made._graphloom_path.removeprefix("file://"))


def side_plan(df):
    return df._jdf.queryExecution().analyzed().toString().upper()


def test_names_must_differ(spark):
    with pytest.raises(Exception, match="already exists"):
        scratch.Scratch(spark).table(spark.range(1).selectExpr("id", "id AS ID"))
