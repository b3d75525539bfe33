import random
import time
from itertools import permutations

import pytest

from graphloom import CATALOGUE, Graph, Pattern, compile_plan
from graphloom.api import token
from graphloom.plans.schedule import SCHEDULERS


def brute(adj, p, induced):
    n = len(adj)
    found = 0
    for m in permutations(range(n), p.size):
        found += all((m[j] in adj[m[i]]) == p.edge(i, j) if induced else not p.edge(i, j) or m[j] in adj[m[i]] for i in range(p.size) for j in range(i))
    return found // len(p.automorphisms)


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    adj = [set() for _ in range(10)]
    rows = []
    for i in range(10):
        for j in range(i):
            if rng.random() < 0.55:
                adj[i].add(j)
                adj[j].add(i)
                rows.append((i, j))
    g = Graph.from_edges(spark.createDataFrame(rows + [(3, 3), rows[0], (None, 1)], "src long, dst long"))
    yield g, adj
    g.unpersist()


@pytest.mark.parametrize("name", ["wedge", "triangle", "path4", "square", "star3", "diamond", "p1", "p2", "p3"])
def test_counts(small, name):
    g, adj = small
    p = Pattern(CATALOGUE[name])
    edge, vertex = brute(adj, p, False), brute(adj, p, True)
    plan = lambda kind, *a, **k: compile_plan(g, CATALOGUE[name], kind, *a, **k).run().result
    assert plan("edge", "none", scheduler="structural") == edge
    assert plan("vertex", "none", scheduler="structural") == vertex
    assert plan("edge_iep", "none", scheduler="structural") == edge


@pytest.mark.parametrize("pruning", ["static", "eager", "online", "costmodel"])
def test_pruning_does_not_change_counts(small, pruning):
    g, adj = small
    for name in ("diamond", "p2", "p4"):
        p = Pattern(CATALOGUE[name])
        assert compile_plan(g, CATALOGUE[name], "vertex", pruning).run().result == brute(adj, p, True)
        assert compile_plan(g, CATALOGUE[name], "edge_iep", pruning).run().result == brute(adj, p, False)


@pytest.mark.parametrize("scheduler", SCHEDULERS)
def test_schedulers_and_lowerings_agree(small, scheduler):
    g, adj = small
    p = Pattern(CATALOGUE["p3"])
    for lowering in ("join", "array"):
        assert compile_plan(g, CATALOGUE["p3"], "vertex", "none", scheduler=scheduler, lowering=lowering).run().result == brute(adj, p, True)


def test_matches_are_distinct_occurrences(small):
    g, adj = small
    rows = compile_plan(g, CATALOGUE["diamond"], "edge", "none").matches().collect()
    p = compile_plan(g, CATALOGUE["diamond"], "edge", "none").schedule.pattern
    seen = {frozenset((r[i], r[j]) if r[i] < r[j] else (r[j], r[i]) for i, j in p.edges) for r in rows}
    assert len(seen) == len(rows) and all(r[j] in adj[r[i]] for r in rows for i, j in p.edges)


def test_tokens():
    assert token("Vertex-Induced", ("vertex",), "query type") == "vertex"
    assert token("NestedRT", ("nested_rt",), "parallel type") == "nested_rt"
    with pytest.raises(ValueError):
        token("both", ("vertex",), "query type")


def test_plan_surface(small):
    g, _ = small
    plan = compile_plan(g, CATALOGUE["star3"], "edge-induced-iep", "eager", "tbb_top")
    assert plan.pattern_size == 4 and plan.module_path is None
    assert "prefix of 1" in plan.describe() and "Aggregate" in plan.generated_code
    r = plan.run(num_threads=3)
    assert r.result == r.num_matches and "num_matches" in repr(r) and r.finished


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert g.num_vertices == 0 and g.num_triangles == 0
    assert compile_plan(g, CATALOGUE["p1"], "vertex").run().result == 0
    assert compile_plan(g, CATALOGUE["star3"], "edge_iep", scheduler="structural").run().result == 0


@pytest.mark.parametrize("pruning", ["none", "eager"])
def test_shuffled_plans_give_the_same(spark, small, pruning):
    """Beyond the broadcast bound: no join is broadcast."""
    from graphloom.operators import match

    g, adj = small
    g.unpersist()  # relations of other tests hold broadcasts
    plan = compile_plan(g, CATALOGUE["p3"], "vertex", pruning)
    bounds = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in bounds}
    try:
        for k in bounds:
            spark.conf.set(k, "-1")
        r = match.Relations(g, broadcast_rows=0)
        rows = match.matches(plan.schedule, r, True, plan.auxiliary)
        assert rows.count() == brute(adj, Pattern(CATALOGUE["p3"]), True)
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_last_vertex_is_counted_by_degree(small):
    g, adj = small
    plan = compile_plan(g, CATALOGUE["p7"], "edge", "none")
    for name in ("p6", "p7"):
        plan = compile_plan(g, CATALOGUE[name], "edge", "none")
        assert plan.run().result == plan.matches().count()
    tail = "0111" "1010" "1100" "1000"  # a triangle with a tail
    plan = compile_plan(g, tail, "edge", "none", scheduler="structural")
    assert plan.suffix and plan.suffix.prefix == 3 and plan.run().result == brute(adj, Pattern(tail), False) == plan.matches().count()


def test_common_neighbours_of_cliques(spark):
    """Bounded and unbounded relations of edges and triangles, and a plan that reads both."""
    from itertools import combinations

    from graphloom.operators import match

    rng = random.Random(11)
    rows = [(i, j) for i in range(10) for j in range(i) if rng.random() < 0.8]
    adj = [{j for e in rows for j in e if i in e and j != i} for i in range(10)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    plan = compile_plan(g, CATALOGUE["p4"], "edge", "eager", scheduler="structural")
    assert {len(at) for at in plan.auxiliary.closed.values()} == {2, 3} and plan.auxiliary.bounded
    assert plan.run().result == brute(adj, Pattern(CATALOGUE["p4"]), False) > 0
    r = match.Relations(g)
    for size in (2, 3):
        cliques = [c for c in combinations(range(10), size + 1) if all(b in adj[a] for a, b in combinations(c, 2))]
        for bounded in (True, False):
            orders = [c[::-1] for c in cliques] if bounded else [p for c in cliques for p in permutations(c)]
            want = sorted((p[0] * r.shift + p[1], *p[2:]) for p in orders)
            assert sorted(map(tuple, r.closed(size, bounded, False).collect())) == want and want


def test_hubs_are_relabelled_for_counts(spark):
    """A hub of 300 leaves among a few triangles: counts by rank, occurrences by the given ids."""
    rows = [(0, i) for i in range(1, 301)] + [(i, i + 1) for i in range(1, 40, 3)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src long, dst long"))
    assert g.ranked() is not g and g.ranked().ranked() is g.ranked()
    plan = compile_plan(g, CATALOGUE["triangle"], "edge", "none", scheduler="structural")
    assert plan.run().result == 13 and {max(r) for r in plan.matches().collect()} == {i + 1 for i in range(1, 40, 3)}
    assert compile_plan(g, CATALOGUE["star3"], "edge_iep").run().result == 300 * 299 * 298 // 6
    g.unpersist()


def test_metrics(small):
    g, _ = small
    r = compile_plan(g, CATALOGUE["triangle"], "edge", "none").run(metrics=True)
    low, mean, high, std = r.task_seconds
    assert 0 <= low <= mean <= high and std >= 0 and r.allocated >= 0


def test_timeout(small):
    g, _ = small
    slow = compile_plan(g, CATALOGUE["triangle"], "edge", "none")
    slow.counts = lambda graph=None: g.edges.sparkSession.sql("SELECT count(x) AS n FROM (SELECT java_method('java.lang.Thread', 'sleep', 20000L + id) AS x FROM range(4))")
    r = slow.run(timeout=0.5)
    assert not r.finished and "timed out" in repr(r)
    tracker = g.edges.sparkSession.sparkContext.statusTracker()
    for _ in range(50):
        if not tracker.getActiveJobsIds():
            break
        time.sleep(0.1)
    assert not tracker.getActiveJobsIds()
