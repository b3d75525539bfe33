"""Counts without listing: closed forms, squares and triangles by pairs of blocks."""

import random

import pytest

from graphloom import CATALOGUE, Graph, Pattern, compile_plan
from graphloom.operators import pairs

from .test_matching import brute


@pytest.fixture(scope="module")
def dense(spark):
    rng = random.Random(7)
    rows = [(i, j) for i in range(11) for j in range(i) if rng.random() < 0.6]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    yield g, [{j for e in rows for j in e if i in e and j != i} for i in range(11)]
    g.unpersist()


def _plan(g, name, kind):
    return compile_plan(g, CATALOGUE[name], kind, "none", scheduler="structural")


@pytest.mark.parametrize("kind", ["edge", "vertex", "edge_iep"])
@pytest.mark.parametrize("name", ["wedge", "triangle", "path4", "square", "star3", "diamond", "p1"])
def test_small_patterns(dense, name, kind):
    g, adj = dense
    assert _plan(g, name, kind).run().result == brute(adj, Pattern(CATALOGUE[name]), kind == "vertex")


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_pairs_of_blocks(dense, blocks, monkeypatch):
    g, adj = dense
    got = sorted(map(tuple, pairs.triangles(g.persisted(), g.num_edges, blocks).collect()))
    assert got == sorted((a, b, c) for a in range(11) for b in adj[a] for c in adj[a] & adj[b] if a > b > c)
    assert sum(r.n for r in pairs.squares(g.persisted(), g.num_edges, blocks).collect()) == brute(adj, Pattern(CATALOGUE["square"]), False)


def test_pairs_made_some_at_a_time(spark):
    """Runs of lists that are cut at the bound, and one vertex that is beyond it alone."""
    import pyarrow as pa

    rows = [(i, j) for i in range(60) for j in range(60) if i != j]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["src", "dst"])
    for bound in (1, 100, 5000, 1 << 22):
        pairs_, pairs.PAIRS = pairs.PAIRS, bound
        try:
            pieces = list(pairs._cut(1, False)(iter([batch])))
            assert sum(b.column(0)[0].as_py() for b in pairs._squares(iter(pieces))) == 3 * 60 * 59 * 58 * 57 // 24
            assert sum(b.num_rows for b in pairs._triangles(iter(pairs._cut(1, True)(iter([batch]))))) == 60 * 59 * 58 // 6
        finally:
            pairs.PAIRS = pairs_


def test_squares_are_counted_without_a_join(dense):
    g, _ = dense
    for kind in ("edge", "edge_iep"):
        assert "Join" not in _plan(g, "square", kind).generated_code


@pytest.mark.parametrize("name,rows,want", [
    ("star3", [(0, i) for i in range(1, 8001)], 8000 * 7999 * 7998 // 6),
    ("path4", [(0, 1)] + [(i % 2, i) for i in range(2, 160002)], 80000**2),
])
def test_stars_and_paths_are_not_listed(spark, name, rows, want):
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    r = _plan(g, name, "vertex").run(timeout=60)
    assert r.finished and r.result == want
    g.unpersist()


def test_ids_beyond_32_bits_are_relabelled_for_counts(spark):
    g = Graph.from_edges(spark.createDataFrame([(-5, 1 << 40), (1 << 40, 7), (7, -5), (7, 8)], "src long, dst long"))
    assert [_plan(g, n, "vertex").run().result for n in ("triangle", "wedge", "square")] == [1, 2, 0]
    g.unpersist()


@pytest.mark.parametrize("most", [1, 4000])
def test_plans_beyond_the_broadcast_bound(spark, most, monkeypatch):
    """All pruning types read triangles there; rows that are few (most: 4000) are broadcast to the edges, others shuffled."""
    from graphloom.operators import match

    rng = random.Random(13)
    rows = [(i, j) for i in range(9) for j in range(i) if rng.random() < 0.75]
    adj = [{j for e in rows for j in e if i in e and j != i} for i in range(9)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    monkeypatch.setattr(match, "BROADCAST_ROWS", most)
    monkeypatch.setattr(Graph, "num_edges", property(lambda self: 5000 if self is g else self._summary[1]))
    for name in ("p2", "p3", "p5", "p6", "p7"):
        p = Pattern(CATALOGUE[name])
        edge, vertex = brute(adj, p, False), brute(adj, p, True)
        assert edge
        for kind, want in (("edge", edge), ("vertex", vertex), ("edge_iep", edge)):
            plan = _plan(g, name, kind)
            assert plan.run().result == want, (name, kind)
    plan = compile_plan(g, CATALOGUE["p4"], "edge", "static", scheduler="structural")
    assert plan.run().result == brute(adj, Pattern(CATALOGUE["p4"]), False) == plan.matches().count()
    for pruning in ("static", "online", "costmodel"):
        assert compile_plan(g, CATALOGUE["p3"], "edge", pruning, scheduler="structural").run().result == brute(adj, Pattern(CATALOGUE["p3"]), False)
    g.unpersist()


def test_no_wedge_is_shuffled(spark, monkeypatch):
    """Hubs without triangles: 80,000 vertices that two hubs share have 6.4 billion wedges, and no triangle."""
    from graphloom.operators import match

    monkeypatch.setattr(match, "BROADCAST_ROWS", 1000)
    pairs_ = spark.range(80000).selectExpr("explode(array(0, 1)) AS src", "id + 2 AS dst")
    g = Graph.from_edges(pairs_)
    for pruning in ("none", "static"):
        r = compile_plan(g, CATALOGUE["p2"], "vertex", pruning, scheduler="structural").run(timeout=60)
        assert r.finished and r.result == 0
    g.unpersist()
