import os

import numpy as np
import pytest

from graphloom import CATALOGUE, Graph, compile_plan
from graphloom.__main__ import main
from graphloom.functions import statistics as S
from graphloom.sources import edges as E
from graphloom.sources import logs

TRIANGLE = ([0, 2, 4, 6], [1, 2, 0, 2, 0, 1])


def test_triangle_from_arrays(spark):
    g = Graph.from_csr(spark, *TRIANGLE)
    assert (g.num_vertices, g.num_edges, g.num_triangles) == (3, 6, 1)
    assert compile_plan(g, CATALOGUE["triangle"], "vertex").run().result == 1
    g = Graph.from_csr(spark, np.array(TRIANGLE[0], float), TRIANGLE[1], offsets=[0, 1, 2], triangles=[2, 2, 2], reorder_by_degree=True)
    assert g.num_triangles == 1


@pytest.mark.parametrize("arrays,why", [
    (([0], []), "two entries"), (([1, 2], [0]), "begin with 0"), (([0, 2, 1, 3], [1, 2, 0]), "decrease"), (([0, 1], [0]), "loops"), (([0, 1, 2], [5, 0]), "range"),
    (([0, 2, 3, 4], [2, 1, 0, 0]), "sorted"), (([0, 2, 4], [1, 1, 0, 0]), "repeat"), (([0, 1, 1], [1]), "reverse"), (([0, 1, 2], [1, 0], [5, 0]), "offset"),
    (([0, 1, 2], [1, 0], [0]), "one entry"), (([0, 1, 2], [1, 0], [0, 1], [1, 0]), "multiple of 6"), (([[0, 1]], [1]), "one dimension"),
])
def test_bad_arrays(arrays, why):
    with pytest.raises(ValueError, match=why):
        E.check_csr(*arrays)


@pytest.fixture
def text(tmp_path):
    folder = tmp_path / "toy"
    folder.mkdir()
    (folder / "snap.txt").write_text("# nodes\n\n10 20\n20\t10\n 20 30 7\n30 10\n30 40\n9 9\n")
    return folder


def test_text(spark, text):
    g = Graph.from_snap(spark, str(text))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 3), (3, 2)]
    assert {r.vid: (r.degree, r.offset) for r in g.degrees().collect()} == {0: (2, 0), 1: (2, 1), 2: (3, 2), 3: (1, 1)}
    assert {r.vid: r.triangles for r in g.raw_triangles().collect()} == {0: 2, 1: 2, 2: 2, 3: 0}
    assert g.validate() is g


def test_bad_line(spark, text):
    (text / "snap.txt").write_text("1 2\nx y\n")
    with pytest.raises(Exception, match="not an edge"):
        E.read_text(spark, str(text / "snap.txt")).collect()


def test_problems(spark):
    g = Graph(spark.createDataFrame([(0, 1), (1, 0), (1, 1), (2, 3), (0, 1)], "src long, dst long"))
    assert {r.problem for r in g.problems().collect()} == {"loop", "duplicate", "no reverse edge"}
    with pytest.raises(ValueError):
        g.validate()


def test_reordering(spark, text):
    g = Graph.from_snap(spark, str(text)).reordered()
    d = {r.vid: r.degree for r in g.degrees().collect()}
    assert d == {0: 3, 1: 2, 2: 2, 3: 1}


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS x")
    assert all(r.x == r.at for r in S.numbered(df, ["x"], "at").collect())


@pytest.mark.parametrize("binary", [False, True])
def test_storage(spark, text, tmp_path, binary):
    g = Graph.from_snap(spark, str(text))
    folder = str(tmp_path / "stored")
    meta = (g.save_binary if binary else g.save)(folder)
    h = Graph.from_preprocessed(spark, folder)
    assert h.metadata == meta and meta.num_triangle == 1 and meta.max_degree == 3
    assert sorted(map(tuple, h.edges.collect())) == sorted(map(tuple, g.edges.collect()))
    if binary:
        assert os.path.getsize(f"{folder}/indices_u64.bin") == 2 * os.path.getsize(f"{folder}/indices_u32.bin")


def test_estimate_is_exact_for_small_graphs(spark, text):
    g = Graph.from_snap(spark, str(text))
    assert g.num_triangles == 1 and g.metadata.scheduler_avg_degree == 2.0


def test_command_line(spark, text, tmp_path, capsys):
    stored, log = str(tmp_path / "g"), str(tmp_path)
    assert main(["prep", "--path_to_graph", str(text), "--out", stored]) == 0
    assert main(["run", "--path_to_graph", stored, "--query", "triangle", "--query_type", "vertex", "--log_dir", log, "--exp_id", "7"]) == 0
    assert "1 matches" in capsys.readouterr().out
    assert main(["compare", "--path_to_graph", stored, "--query", "010101010"]) == 0
    (tmp_path / "q.csv").write_text("exp_id,query,query_type,pruning_type\na,wedge,edge_iep,\nb,0,,\nc,triangle,,eager\n")
    assert main(["batch", "--path_to_graph", stored, "--queries", str(tmp_path / "q.csv"), "--log_dir", log]) == 1
    out = capsys.readouterr().out
    assert "a: 5 matches" in out and "b: ValueError" in out and "c: 1 matches" in out
    assert main(["profile", "--path_to_graph", stored, "--query", "triangle", "--out", log, "--prunings", "none"]) == 0
    lines = open(f"{log}/run_log.csv").read().splitlines()
    assert lines[0].split(",") == list(logs.RUN_COLUMNS) and lines[1].startswith("7,")
    assert os.path.isdir(f"{log}/0_none_loop")


def test_readable():
    assert logs.readable_size(1536) == "1.5 KB" and logs.readable_time(90) == "1.5 min"
    assert logs.run_time(1.5, False).endswith("(Time Out)")
    assert logs.logger().name == "graphloom"
