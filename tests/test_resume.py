"""Runs that a restarted driver goes on with, and the table function of local solves."""

import random

import pytest

from graphloom import connected_components
from graphloom.functions import table_functions
from graphloom.plans.api import release
from graphloom.plans.manifest import Manifest
from graphloom.plans.metrics import RunMetrics
from graphloom.plans.scratch import Scratch
from tests.test_components import frame, labels, non_roots


class Died(Exception):
    pass


def dying(monkeypatch, steps):
    """Commits fail after so many steps, their tables written; returns the steps that were committed."""
    commit, done = Manifest.commit, []

    def run(self, step, facts):
        if len(done) == steps:
            raise Died
        done.append(step)
        commit(self, step, facts)

    monkeypatch.setattr(Manifest, "commit", run)
    return done


@pytest.mark.parametrize("algorithm, steps", [("alternating", 3), ("alternating_hub", 2), ("pa_base", 3), ("pa_filtered", 4), ("pa_full", 4)])
def test_goes_on_after_the_last_finished_step(spark, monkeypatch, algorithm, steps):
    rng = random.Random(steps)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(9)] + [(50, 51), (51, 52)]
    table, name = frame(spark, edges), f"dies-{algorithm}-{steps}"
    run = lambda resume=name, metrics=None: connected_components(table, algorithm, 3, 0, partition_fn="mod", resume=resume, metrics=metrics)
    whole, again = RunMetrics("", 0, 0), RunMetrics("", 0, 0)
    assert labels(run(None, whole)) == non_roots(edges)
    with monkeypatch.context() as patch:
        first = dying(patch, steps)
        with pytest.raises(Died):
            run()
    with monkeypatch.context() as patch:
        rest = dying(patch, 10_000)
        out = run(metrics=again)
    assert len(first) == steps and not set(first) & set(rest) and rest
    assert labels(out) == non_roots(edges) and again.rounds == whole.rounds
    with monkeypatch.context() as patch:
        dying(patch, 0)
        assert labels(run()) == non_roots(edges)
    with pytest.raises(ValueError, match="was begun with"):
        connected_components(table, algorithm, 4, 0, resume=name)
    release(out)
    assert not Manifest(spark, Scratch(spark, "cc", name).root).done


def test_names_of_runs(spark):
    for name in ("", "a/b", "..\\x", "a b"):
        with pytest.raises(ValueError, match="run's name"):
            Scratch(spark, "cc", name)


def test_roots_of_a_named_run_are_released(spark):
    out = connected_components(frame(spark, [(1, 2), (3, 3)]), include_roots=True, resume="roots")
    assert labels(out) == [(1, 1), (2, 1), (3, 3)]
    release(out)
    assert not Manifest(spark, Scratch(spark, "cc", "roots").root).done


def test_local_components_by_sql(spark):
    rng = random.Random(3)
    edges = [(p * 1000 + rng.randrange(60), p * 1000 + rng.randrange(60)) for p in range(9) for _ in range(40)]
    rows = [(u, v, "extra") for u, v in edges] + [(None, 1, "x"), (2, None, "x")]
    spark.createDataFrame(rows, "u long, v int, node string").createOrReplaceTempView("local_edges")
    table_functions.register(spark)
    query = "SELECT * FROM local_components(TABLE(SELECT * FROM local_edges WHERE {}) PARTITION BY u DIV 1000)"
    assert labels(spark.sql(query.format("true"))) == non_roots(edges)
    assert spark.sql(query.format("false")).count() == 0
    assert labels(spark.sql("SELECT * FROM local_components(TABLE(SELECT * FROM local_edges) WITH SINGLE PARTITION)")) == non_roots(edges)
