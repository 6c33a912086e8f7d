"""Text layouts, malformed lines, label files and the command line."""

import pytest

from graphloom import steps
from graphloom.cli import main
from graphloom.functions.partitioner import PartitionFn
from graphloom.plans.algorithms import NotConverged
from graphloom.sources.edges import read_edges_parquet, read_edges_text, read_labels_text, write_labels_parquet, write_labels_text, write_routed


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_layouts(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b"0 1\n2\t3\r\n  4   5 six\n\x0c7 \t 8\n")
    (tmp_path / "other").write_text("not an edge\n")
    assert rows(read_edges_text(spark, str(tmp_path), glob="part*")) == [(0, 1), (2, 3), (4, 5), (7, 8)]
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "part-1").write_text("9 9\n")
    assert rows(read_edges_text(spark, str(tmp_path / "part-0"), str(tmp_path / "more"))) == [(0, 1), (2, 3), (4, 5), (7, 8), (9, 9)]


def test_malformed(spark, tmp_path):
    (tmp_path / "e").write_text("1 2\n\nx 3\n4\n# 5 6\n-7 8\n99999999999999999999 1\n")
    assert rows(read_edges_text(spark, str(tmp_path / "e"), mode="DROPMALFORMED")) == [(-7, 8), (1, 2)]
    with pytest.raises(Exception, match="malformed edge line"):
        read_edges_text(spark, str(tmp_path / "e")).collect()
    with pytest.raises(ValueError):
        read_edges_text(spark, "x", mode="LENIENT")


def test_label_files(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1), (2**41, -4)], "node long, component long")
    for _ in range(2):
        write_labels_text(labels, str(tmp_path / "l"))
        write_labels_parquet(labels, str(tmp_path / "p"))
    assert rows(read_labels_text(spark, str(tmp_path / "l"))) == rows(labels)
    assert rows(read_edges_parquet(spark, str(tmp_path / "p"), u="node", v="component")) == rows(labels)
    write_routed(spark.createDataFrame([(1, 2, False, "in")], "u long, v long, leaf boolean, route string"), str(tmp_path / "r"))
    assert (tmp_path / "r" / "route=in").is_dir()
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == [(1, 2, False, "in")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("0 1\n1 2\n2 3\n3 4\n4 5\n5 6\n7 8\n8 9\n9 10\n0 2\n1 3\n7 9\n8 10\n")
    main([str(tmp_path / "e"), str(tmp_path / "out"), "-a", "pa_full", "-p", "2", "-t", "1000", "-v"], spark)
    assert rows(read_labels_text(spark, str(tmp_path / "out"))) == [*((i, 0) for i in range(1, 7)), (8, 7), (9, 7), (10, 7)]
    said = capsys.readouterr().out
    assert said.startswith("pa_full\t")
    main([str(tmp_path / "e"), str(tmp_path / "out"), "-a", "pa_base", "-p", "3", "-t", "0", "--partition-fn", "tabular", "--include-roots", "-v"], spark)
    assert rows(read_labels_text(spark, str(tmp_path / "out"))) == [*((i, 0) for i in range(7)), *((i, 7) for i in range(7, 11))]
    said = capsys.readouterr().out
    assert said.startswith("RoundMetrics(round=0, lout=") and said.splitlines()[-1].startswith("pa_base\t")
    with pytest.raises(NotConverged):
        main([str(tmp_path / "e"), str(tmp_path / "out"), "-a", "alternating", "--max-rounds", "1", "-q"], spark)


def test_partition_functions(spark):
    ids = [0, 1, -1, 2**31, 2**32 + 5, -(2**40), 2**62]
    df = spark.createDataFrame([(i,) for i in ids], "n long")

    def java_hash(n):
        folded = ((n & 0xFFFFFFFFFFFFFFFF) ^ ((n & 0xFFFFFFFFFFFFFFFF) >> 32)) & 0xFFFFFFFF
        return folded - 2**32 if folded >= 2**31 else folded

    got = df.select("n", PartitionFn(7, "long_hash")(df.n), PartitionFn(7, "mod")(df.n)).collect()
    assert [tuple(r) for r in got] == [(i, java_hash(i) % 7, i % 7) for i in ids]


def test_steps_by_themselves(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("0 1\n1 2\nbad\n2 3\n5 6\n")
    steps.main(["init", str(tmp_path / "e"), str(tmp_path / "edges")], spark)
    assert capsys.readouterr().out == "input 5 output 4 skipped 1\n"
    now = "edges"
    for step in ("sketch-localize", "pa-large-star-routed", "pa-small-star-routed"):
        steps.main([step, str(tmp_path / now), str(tmp_path / step), "-p", "3"], spark)
        now = step
    assert capsys.readouterr().out.startswith("input 4 output 4 changes 0\n")
    steps.main(["large-star", str(tmp_path / "edges"), str(tmp_path / "l")], spark)
    steps.main(["small-star", str(tmp_path / "l"), str(tmp_path / "s")], spark)
    steps.main(["hub-init", str(tmp_path / "edges"), str(tmp_path / "h0")], spark)
    for i in range(4):
        steps.main(["hub-large-star", str(tmp_path / f"h{2 * i}"), str(tmp_path / f"h{2 * i + 1}"), "-p", "2"], spark)
        steps.main(["hub-small-star", str(tmp_path / f"h{2 * i + 1}"), str(tmp_path / f"h{2 * i + 2}")], spark)
    steps.main(["hub-labels", str(tmp_path / "h8"), str(tmp_path / "hl")], spark)
    steps.main(["local-cc", str(tmp_path / "edges"), str(tmp_path / "ll")], spark)
    want = [(1, 0), (2, 0), (3, 0), (6, 5)]
    assert rows(spark.read.parquet(str(tmp_path / "hl"))) == rows(spark.read.parquet(str(tmp_path / "ll"))) == want
    (tmp_path / "g").write_text("0 1\n1 2\n2 3\n5 6\n8 8\n")
    steps.main(["union-find", str(tmp_path / "g"), str(tmp_path / "labels")], spark)
    assert rows(read_labels_text(spark, str(tmp_path / "labels"))) == [(0, 0), (1, 0), (2, 0), (3, 0), (5, 5), (6, 5), (8, 8)]
