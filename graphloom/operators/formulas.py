"""Counts of patterns of three and four vertices from degrees, triangles, edges' supports, 4-cliques and squares.

How many injective maps take a pattern's edges to edges is known for each such pattern in closed form.  Induced maps are
what remains of them by inclusion and exclusion of further edges: paths and stars, of which there are far more than edges,
are not listed."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..patterns import CATALOGUE, Pattern
from . import pairs

_KNOWN = {n: CATALOGUE[n] for n in ("wedge", "triangle", "path4", "star3", "square", "diamond", "p1")} | {"paw": "0111101011001000"}


def _canonical(p: Pattern) -> str:
    return min(p.relabelled(o).adjacency for o in permutations(range(p.size)))


_NAMES = {_canonical(Pattern(a)): n for n, a in _KNOWN.items()}


def maps(p: Pattern, induced: bool) -> dict[str, int]:
    """The known patterns whose injective maps add up to those of p, and how often each."""
    absent = [e for e in combinations(range(p.size), 2) if not p.edge(*e)] if induced else []
    out: Counter = Counter()
    for k in range(len(absent) + 1):
        for more in combinations(absent, k):
            pairs_ = {*p.edges, *more}
            whole = Pattern("".join("1" if (min(i, j), max(i, j)) in pairs_ else "0" for i in range(p.size) for j in range(p.size)))
            out[_NAMES[_canonical(whole)]] += (-1) ** k
    return {n: c for n, c in out.items() if c}


def _total(df: DataFrame, expression: str) -> DataFrame:
    """The sum of products of 64-bit numbers, beyond 64 bits."""
    return df.agg(F.expr(f"coalesce(sum({expression}), 0)").alias("t"))


def _long(name: str, less: int = 0) -> str:
    return f"CAST({name} - {less} AS DECIMAL(12,0))"


def _terms(name: str, r) -> list[tuple[int, DataFrame]]:
    """Injective maps of a known pattern: numbers, and how often each counts."""
    d = lambda: r.degrees()
    if name == "wedge":
        return [(1, _total(d(), f"{_long('degree')} * {_long('degree', 1)}"))]
    if name == "star3":
        return [(1, _total(d(), f"{_long('degree')} * {_long('degree', 1)} * {_long('degree', 2)}"))]
    if name == "path4":
        # Both ends of the middle edge go on, without meeting.
        near = d().select(F.col("vid").alias("src"), (F.col("degree") - 1).alias("n"))
        ends = r.edges.join(near, "src").groupBy("dst").agg(F.sum("n").alias("n"), F.count("*").alias("degree"))
        return [(1, _total(ends, f"CAST(n AS DECIMAL(19,0)) * {_long('degree', 1)}")), *[(-c, t) for c, t in _terms("triangle", r)]]
    if name == "triangle":
        return [(6, r.triangles().agg(F.count("*").alias("t")))]
    if name == "paw":
        at = r.triangles().select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count("*").alias("n")).join(d(), "vid")
        return [(2, _total(at, f"CAST(n AS DECIMAL(19,0)) * {_long('degree', 2)}"))]
    if name == "diamond":
        return [(1, _total(r.support(), f"{_long('n')} * {_long('n', 1)}"))]
    if name == "p1":
        return [(24, r.cliques().agg(F.count("*").alias("t")))]
    return [(8, _total(pairs.squares(r.edges, r.graph.num_edges), "CAST(n AS DECIMAL(38,0))"))]


def count(p: Pattern, r, induced: bool) -> DataFrame:
    """One row: matches of a pattern of at most four vertices."""
    terms = [(c * n, t) for name, c in maps(p, induced).items() for n, t in _terms(name, r)]
    rows = reduce(DataFrame.unionByName, [t.select((F.col("t").cast("decimal(38,0)") * F.lit(c).cast("decimal(6,0)")).cast("decimal(38,0)").alias("t")) for c, t in terms])
    return rows.agg(F.sum("t").alias("t")).select(F.expr(f"CAST(t DIV {len(p.automorphisms)} AS BIGINT)").alias("matches"))
