"""The tasks of a half round follow the rows that it works on; the session's settings do not stay changed."""

import os

import pytest

from graphloom import connected_components, steps
from graphloom import queries as core
from graphloom.plans import scratch
from tests.test_components import GRAPHS, frame, labels, non_roots

SF = "/root/testdata/sf0.001"
NAMES = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.minPartitionNum")
STARS = ["op_large_star", "op_small_star", "op_pa_large_star", "op_hub_large_star", "op_hub_small_star", "op_hub_copies"]


def settings(spark):
    return [spark.conf.get(name, None) for name in NAMES]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", STARS)
def test_star_queries_have_tasks_by_rows(spark, monkeypatch, name):
    """6000 edges at 500 a task: more tasks write than the four of the session."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 500)
    before = settings(spark)
    got = core.QUERIES[name](spark, SF)
    files = [f for f in os.listdir(got._graphloom_path.removeprefix("file://")) if f.startswith("part")]
    assert len(files) > 4 and settings(spark) == before


@pytest.mark.parametrize("algorithm", ["alternating", "alternating_hub", "pa_base", "pa_filtered", "pa_full"])
def test_rounds_are_sized(spark, monkeypatch, algorithm):
    """Every half round over many rows runs with more shuffle partitions, and the labels stay the same."""
    monkeypatch.setattr(scratch, "TASK_ROWS", 20)
    edges, before, seen = GRAPHS["random"] + GRAPHS["zigzag"], settings(spark), []
    write = scratch.sized

    def watched(session, rows):
        seen.append(rows)
        return write(session, rows)

    monkeypatch.setattr(scratch, "sized", watched)
    assert labels(connected_components(frame(spark, edges), algorithm, 3, 0)) == non_roots(edges)
    assert sum(rows is not None and rows > 80 for rows in seen) >= 2 and settings(spark) == before


def test_settings_come_back_after_an_error(spark):
    before = settings(spark)
    with pytest.raises(RuntimeError), scratch.sized(spark, 10**9):
        assert spark.conf.get(NAMES[0]) == "2000"
        raise RuntimeError
    assert settings(spark) == before


def test_labels_are_counted_as_they_are_written(spark, monkeypatch, tmp_path):
    """The number of nodes comes from the job that writes them, not from a second run of the join."""
    frame(spark, [(1, 2), (2, 3), (7, 7)]).selectExpr("concat_ws(' ', u, v) AS value").write.text(str(tmp_path / "e"))
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: pytest.fail("a second run"))
    assert steps.label_text(spark, str(tmp_path / "e"), str(tmp_path / "labels")) == 4
