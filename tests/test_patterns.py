import random
from itertools import permutations
from math import factorial

import pytest

from graphloom.patterns import CATALOGUE, Pattern, closure, cycles, reduced, surviving_images
from graphloom.plans.inclusion_exclusion import set_partitions, suffix_count
from graphloom.plans.pruning import gain, place
from graphloom.plans.schedule import SCHEDULERS, Stats, independent_suffix, schedule


@pytest.mark.parametrize("text", ["0101", "01", "", "0110101", "012101210", "010001000", "0100100000010010"])
def test_bad_patterns(text):
    with pytest.raises(ValueError):
        Pattern(text)


def test_parts_are_named():
    with pytest.raises(ValueError, match=r"\[0, 1\].*\[2, 3\]"):
        Pattern("0100100000010010")


def test_diagonal_is_ignored():
    assert Pattern("111111111").adjacency == "011101110"


@pytest.mark.parametrize("name,size", [("wedge", 2), ("triangle", 6), ("square", 8), ("star3", 6), ("p1", 24), ("p4", 120)])
def test_automorphisms(name, size):
    p = Pattern(CATALOGUE[name])
    assert len(p.automorphisms) == size
    brute = [g for g in permutations(range(p.size)) if all(p.edge(i, j) == p.edge(g[i], g[j]) for i in range(p.size) for j in range(p.size))]
    assert sorted(p.automorphisms) == sorted(brute)


@pytest.mark.parametrize("name", CATALOGUE)
@pytest.mark.parametrize("scheduler", SCHEDULERS)
def test_each_occurrence_once(name, scheduler):
    s = schedule(Pattern(CATALOGUE[name]), scheduler, Stats(2000, 20000, 4000, 10.0))
    assert surviving_images(s.pattern, s.restrictions) == 1
    assert s.pattern == Pattern(CATALOGUE[name]).relabelled(s.order)
    assert all(any(s.pattern.edge(i, j) for j in range(i)) for i in range(1, s.pattern.size))


def test_closure_and_reduction():
    assert closure([(0, 1), (1, 2)]) == {(0, 1), (1, 2), (0, 2)}
    assert reduced([(0, 1), (1, 2), (0, 2)]) == ((0, 1), (1, 2))
    assert cycles((1, 0, 2)) == [(0, 1), (2,)]


def test_partitions():
    assert [len(list(set_partitions(list(range(n))))) for n in range(6)] == [1, 1, 2, 5, 15, 52]


@pytest.mark.parametrize("name", CATALOGUE)
def test_inclusion_exclusion_on_a_random_graph(name):
    """The terms against a plain count of ordered matches."""
    p0 = Pattern(CATALOGUE[name])
    if p0.size > 5:
        return
    s = schedule(p0)
    iep = suffix_count(s)
    if iep is None:
        assert independent_suffix(s.pattern) == 1
        return
    rng = random.Random(3)
    n = 9
    adj = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if rng.random() < 0.6:
                adj[i].add(j)
                adj[j].add(i)
    ordered = sum(all(m[b] in adj[m[a]] for a, b in p0.edges) for m in permutations(range(n), p0.size))
    total = 0
    for m in permutations(range(n), iep.prefix):
        if all(m[b] in adj[m[a]] for a, b in s.pattern.edges if max(a, b) < iep.prefix) and all(m[a] > m[b] for a, b in iep.restrictions):
            for c, blocks in iep.terms:
                x = c
                for b in blocks:
                    x *= len(set.intersection(*(adj[m[i]] for i in b)) - set(m))
                total += x
    assert total == ordered // len(p0.automorphisms) * iep.divisor


def test_independent_suffix():
    assert independent_suffix(Pattern(CATALOGUE["star3"])) == 3
    assert independent_suffix(Pattern(CATALOGUE["triangle"])) == 1


def test_pruning_placement():
    s = schedule(Pattern(CATALOGUE["p4"]))
    stats = Stats(1000, 100000, 500000, 100.0)
    assert not place(s, "none", stats).closed and not place(s, "none", stats).degree
    assert place(s, "static", stats).degree
    assert set(place(s, "eager", stats).closed) == {2, 3, 4}
    assert gain(1000, 10, 1, 100, 20, 10) > 0 > gain(1, 10, 5, 10, 10, 10)
    assert gain(0, 10, 10, 10, 40, 10) == float("inf")
    with pytest.raises(ValueError):
        place(s, "bold", stats)


def test_unknown_scheduler():
    with pytest.raises(ValueError):
        schedule(Pattern(CATALOGUE["p1"]), "best")


def test_restriction_count_of_cliques():
    p = Pattern(CATALOGUE["p4"])
    assert len(closure(p.restriction_set())) == 10 and factorial(5) == len(p.automorphisms)
