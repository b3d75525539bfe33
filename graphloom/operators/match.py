"""Lowering of matching plans to DataFrames.

A level binds one more vertex: its candidates come from the edge list of one earlier neighbour, the other
earlier neighbours are semi-joins, forbidden edges (vertex-induced) anti-joins, restrictions and
distinctness predicates that Catalyst pushes into the joins.  An edge test uses one key, src * n + dst, so it
is a single-column join.  Auxiliary relations (pruning) replace the edges that a level reads.

Relations below ``broadcast_rows`` (16 bytes a row) are broadcast, and a plan then runs without a shuffle;
larger ones are left to shuffled joins and adaptive execution.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import adjacency, degrees
from ..plans.inclusion_exclusion import SuffixCount
from ..plans.pruning import Auxiliary
from ..plans.schedule import Schedule
from .vertex_sets import intersect

BROADCAST_ROWS = 2_000_000


class Relations:
    """The edges that a plan reads, sized."""

    def __init__(self, graph, broadcast_rows: int | None = None):
        self.graph, self.edges = graph, graph.persisted()
        self.most = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
        self.small, self.auxiliary = graph.num_edges <= self.most, graph.auxiliary
        self.shift = graph.largest_id + 1
        if self.shift**2 >= 1 << 63:
            raise ValueError("ids must be below 3037000499; use dense ids")
        self._adjacency: DataFrame | None = None

    def sized(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def few(self, df: DataFrame) -> DataFrame | None:
        """Rows that are broadcast to the edges of a larger graph instead of meeting them by a shuffle; None if they are more
        than that, or if the graph is small itself. They are counted, so what makes them runs."""
        if self.small or not self.most or df.limit(self.most + 1).count() > self.most:
            return None
        rows = self.auxiliary[("rows", len(self.auxiliary))] = df.persist()
        return rows

    def edges_among(self, rows: DataFrame, ends: list[tuple[str, str]]) -> DataFrame:
        """(__k): the keys of edges that few rows ask for, to be broadcast."""
        asked = rows.select(F.explode(F.array(*[self.key(a, b) for a, b in ends])).alias("__w")).distinct()
        found = self.edges.select(self.key("src", "dst").alias("__k")).join(F.broadcast(asked), F.col("__k") == F.col("__w"), "left_semi").persist()
        self.auxiliary[("among", len(self.auxiliary))] = found
        return F.broadcast(found)

    def key(self, a: str, b: str) -> Column:
        return F.col(a) * F.lit(self.shift) + F.col(b)

    def kept(self, name, make, persist: bool) -> DataFrame:
        """An auxiliary relation; a persisted one is made once for all plans on the graph."""
        if not persist:
            return make()
        if name not in self.auxiliary or not self.auxiliary[name].storageLevel.useMemory:
            self.auxiliary[name] = make().persist()
        return self.auxiliary[name]

    def reduced(self, least: int, persist: bool) -> DataFrame:
        """Edges whose ends have a degree of at least least: others are in no occurrence."""

        def make() -> DataFrame:
            fit = self.sized(degrees(self.edges).where(F.col("degree") >= least).select("vid"))
            return self.edges.join(fit, self.edges["src"] == fit["vid"], "left_semi").join(fit, self.edges["dst"] == fit["vid"], "left_semi")

        return self.kept(("reduced", least), make, persist)

    def triangles(self) -> DataFrame:
        """(a, b, c): every triangle once, a > b > c; of the whole graph, kept for all plans."""
        return self.graph.triangles()

    def cliques(self) -> DataFrame:
        """(a, b, c, d): every 4-clique once, a > b > c > d, from three triangles each."""

        def make() -> DataFrame:
            t = self.triangles()
            one = t.select("a", "b", "c", self.key("a", "b").alias("e"))
            two = t.select(self.key("a", "b").alias("e2"), F.col("c").alias("d"))
            three = t.select(self.key("a", "b").alias("f"), F.col("c").alias("d3"))
            both = one.join(two, (F.col("e") == F.col("e2")) & (F.col("d") < F.col("c")))
            return both.join(three, (self.key("b", "c") == F.col("f")) & (F.col("d") == F.col("d3")), "left_semi").select("a", "b", "c", "d")

        return self.kept("cliques", make, True)

    def closed(self, size: int, bounded: bool, persist: bool) -> DataFrame:
        """(e[, f], x): the common neighbours x of two adjacent vertices (by their edge's key) or of a triangle (its third
        vertex is f); bounded: with vertices and x descending only."""
        names = "abcd"[: size + 1]

        def make() -> DataFrame:
            rows = self.triangles() if size == 2 else self.cliques()
            if not bounded:
                orders = [F.struct(*[F.col(c).alias(n) for n, c in zip(names, o)]) for o in permutations(names)]
                rows = rows.select(F.explode(F.array(*orders)).alias("o")).select("o.*")
            third = [F.col("c").alias("f")] if size == 3 else []
            return rows.select(self.key("a", "b").alias("e"), *third, F.col(names[-1]).alias("x"))

        return self.kept(("closed", size, bounded), make, persist)

    def degrees(self) -> DataFrame:
        return self.kept("degrees", lambda: degrees(self.edges), True)

    def triple_support(self) -> DataFrame:
        """(e, f, n): how many common neighbours the vertices of a triangle have that has any, in all orders."""
        return self.kept("triple_support", lambda: self.closed(3, False, False).groupBy("e", "f").agg(F.count("*").alias("n")), True)

    def support(self) -> DataFrame:
        """(e, n): how many common neighbours the ends of each directed edge have that has any."""

        def make() -> DataFrame:
            ends = F.array(*[self.key(a, b) for a, b in permutations("abc", 2)])
            return self.triangles().select(F.explode(ends).alias("e")).groupBy("e").agg(F.count("*").alias("n"))

        return self.kept("support", make, True)

    def lists_of(self, rows: DataFrame, ends: list[str]) -> DataFrame:
        """Neighbour lists of the vertices of few rows only."""
        vertices = rows.select(F.explode(F.array(*ends)).alias("__w")).distinct()
        return adjacency(self.edges.join(F.broadcast(vertices), F.col("src") == F.col("__w"), "left_semi")).select("vid", "nbrs")

    def lists(self) -> DataFrame:
        if self._adjacency is None:
            self._adjacency = adjacency(self.edges).select("vid", "nbrs")
        return self._adjacency


def _level_predicates(s: Schedule, u: int, induced: bool, restrictions) -> list[Column]:
    p, out, apart = s.pattern, [], set()
    for a, b in restrictions:
        if a < u and b == u:
            out.append(F.col(f"v{u}") < F.col(f"v{a}"))
            apart.add(a)
        elif b < u and a == u:
            out.append(F.col(f"v{u}") > F.col(f"v{b}"))
            apart.add(b)
    out += [F.col(f"v{u}") != F.col(f"v{i}") for i in range(u) if not p.edge(u, i) and i not in apart]
    return out


def matches(s: Schedule, r: Relations, induced: bool, aux: Auxiliary | None = None, levels: int | None = None, restrictions=None) -> DataFrame:
    """One row per occurrence (v0 .. v{k-1} in matching order), each once; or of the first levels only."""
    p = s.pattern
    k = levels or p.size
    pairs = s.implied if restrictions is None else restrictions
    edges = r.edges
    if aux and k > 2 and aux.closed.get(2) == (0, 1):
        # All else follows from triangles, whose vertices the degree filter keeps.
        out, begun = _cliques(r, 4 if k > 3 and aux.closed.get(3) == (0, 1, 2) else 3, pairs)
        for u in range(begun, k):
            out = _tested(s, r, _extended(s, r, edges, out, u, induced, pairs, aux), edges, u, induced, aux)
        return out
    if aux and aux.degree:
        least = min(p.degree(i) for i in range(p.size))
        if least > 1:
            edges = r.reduced(least, aux.persist)
    if k == 1:
        return edges.select(F.col("src").alias("v0")).distinct()
    out = edges.select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    for c in _level_predicates(s, 1, induced, pairs):
        out = out.where(c)
    for u in range(2, k):
        out = _tested(s, r, _extended(s, r, edges, out, u, induced, pairs, aux), edges, u, induced, aux)
    return out


def _cliques(r: Relations, size: int, pairs) -> tuple[DataFrame, int]:
    """The first levels where they are a triangle or 4-clique: each in the orders that restrictions leave."""
    names = "abcd"[:size]
    rows = r.triangles() if size == 3 else r.cliques()
    orders = [o for o in permutations(range(size)) if all(o[x] < o[y] for x, y in pairs if max(x, y) < size)]  # a is the largest id
    of = [F.struct(*[F.col(names[o[i]]).alias(f"v{i}") for i in range(size)]) for o in orders]
    return (rows.select("*", F.explode(F.array(*of)).alias("o")).select("o.*") if len(of) > 1 else rows.select(of[0].alias("o")).select("o.*")), size


def source(s: Schedule, u: int, pairs, aux: Auxiliary | None) -> tuple[int, ...]:
    """The earlier vertices whose list a level reads: one neighbour, or some whose common neighbours are known."""
    if aux and u in aux.closed:
        return aux.closed[u]
    near = [i for i in range(u) if s.pattern.edge(u, i)]
    # An upper-bounded neighbour first (its list is cut by the bound), else the latest.
    return (([i for i in near if (i, u) in pairs] or near)[-1],)


def _extended(s: Schedule, r: Relations, edges: DataFrame, out: DataFrame, u: int, induced: bool, pairs, aux: Auxiliary | None) -> DataFrame:
    """Rows of earlier levels with the candidates that the level reads."""
    at = source(s, u, pairs, aux)
    cols, ids, conds = [f"v{i}" for i in range(u)], [f"v{i}" for i in at], _level_predicates(s, u, induced, pairs)
    if len(at) == 1:
        read = r.sized(edges.select(F.col("src").alias("__s"), F.col("dst").alias(f"v{u}")))
        if aux and aux.closed and (rows := r.few(out)) is not None:
            return read.join(F.broadcast(rows), reduce(Column.__and__, conds, F.col(ids[0]) == F.col("__s"))).select(*cols, f"v{u}")
        return out.join(read, reduce(Column.__and__, conds, F.col(ids[0]) == F.col("__s"))).select(*cols, f"v{u}")
    # Fewer restrictions may hold than those that the relation was chosen by.
    descends = u in aux.bounded and all(pair in pairs for pair in zip((*at, u), (*at[1:], u)))
    read = r.closed(len(at), descends, aux.persist)
    read = read.select(F.col("e").alias("__e"), *[F.col("f").alias("__f")] * (len(at) == 3), F.col("x").alias(f"v{u}"))
    on = [r.key(*ids[:2]) == F.col("__e"), *([F.col(ids[2]) == F.col("__f")] if len(at) == 3 else [])]
    return out.join(read, reduce(Column.__and__, [*on, *conds])).select(*cols, f"v{u}")


def tests(s: Schedule, u: int, induced: bool, pairs, aux: Auxiliary | None) -> tuple[list[int], list[int]]:
    """The earlier vertices that a candidate is tested against: those it must be adjacent to, and must not."""
    at = source(s, u, pairs, aux)
    return [x for x in range(u) if s.pattern.edge(u, x) and x not in at], [x for x in range(u) if induced and not s.pattern.edge(u, x)]


def _tested(s: Schedule, r: Relations, out: DataFrame, edges: DataFrame, u: int, induced: bool, aux: Auxiliary | None) -> DataFrame:
    present, absent = tests(s, u, induced, s.implied, aux)
    # Rows from triangles are few: then the edges that they ask for are found first.
    if (present or absent) and aux and aux.closed and (rows := r.few(out)) is not None:
        there = r.edges_among(rows, [(f"v{x}", f"v{u}") for x in present + absent])
        for how, ends in (("left_semi", present), ("left_anti", absent)):
            for x in ends:
                rows = rows.join(there, r.key(f"v{x}", f"v{u}") == F.col("__k"), how)
        return rows
    for how, ends, of in (("left_semi", present, edges), ("left_anti", absent, r.edges)):
        for x in ends:
            test = r.sized(of.select(r.key("src", "dst").alias("__k")))
            out = out.join(test, r.key(f"v{x}", f"v{u}") == F.col("__k"), how)
    return out


def work(s: Schedule, r: Relations, induced: bool, aux: Auxiliary | None = None) -> DataFrame:
    """(level, vid, reads, neighbours, auxiliary, tests) by the vertex whose list is read when a level is bound: how often,
    elements of neighbour lists and of auxiliary relations that this reads, and edge tests of the candidates."""
    parts = []
    for u in range(1, s.pattern.size):
        at = source(s, u, s.implied, aux)
        rows = matches(s, r, induced, aux, u)
        owner = F.col(f"v{at[-1]}").alias("vid")
        n_tests = sum(map(len, tests(s, u, induced, s.implied, aux))) if u > 1 else 0
        reads = rows.groupBy(owner).agg(F.count("*").alias("reads"))
        if len(at) == 1:
            reads = reads.join(r.degrees().select("vid", "degree"), "vid").select("vid", "reads", (F.col("reads") * F.col("degree")).alias("neighbours"), F.lit(0).cast("long").alias("auxiliary"))
        else:
            size = r.closed(len(at), u in aux.bounded, aux.persist)
            on = [c for c in size.columns if c != "x"]
            size = size.groupBy(*[F.col(c).alias(f"__{c}") for c in on]).agg(F.count("*").alias("size"))
            keys = [r.key(f"v{at[0]}", f"v{at[1]}") == F.col("__e"), *([F.col(f"v{at[2]}") == F.col("__f")] if len(at) == 3 else [])]
            read = rows.join(size, reduce(Column.__and__, keys)).groupBy(owner).agg(F.sum("size").alias("auxiliary"))
            reads = reads.join(read, "vid", "left").select("vid", "reads", F.lit(0).cast("long").alias("neighbours"), F.coalesce("auxiliary", F.lit(0)).alias("auxiliary"))
        if n_tests:
            found = _extended(s, r, r.edges, rows, u, induced, s.implied, aux).groupBy(owner).agg((n_tests * F.count("*")).alias("tests"))
            reads = reads.join(found, "vid", "left")
        else:
            reads = reads.withColumn("tests", F.lit(0))
        parts.append(reads.select(F.lit(u).alias("level"), "vid", "reads", "neighbours", "auxiliary", F.coalesce("tests", F.lit(0)).cast("long").alias("tests")))
    return reduce(DataFrame.unionByName, parts)


def array_matches(s: Schedule, r: Relations, induced: bool, levels: int | None = None) -> DataFrame:
    """The same rows by set algebra on neighbour lists: candidates are array intersections and differences."""
    p, k = s.pattern, levels or s.pattern.size
    lists = r.lists()
    get = lambda i: r.sized(lists.select(F.col("vid").alias(f"__v{i}"), F.col("nbrs").alias(f"n{i}")))
    out = lists.select(F.col("vid").alias("v0"), F.col("nbrs").alias("n0"))
    for u in range(1, k):
        later = range(u, k)
        near = [i for i in range(u) if p.edge(u, i)]
        cand = reduce(intersect, (F.col(f"n{i}") for i in near))
        if induced:
            for i in range(u):
                if not p.edge(u, i):
                    cand = F.array_except(cand, F.col(f"n{i}"))
        # Bounds are applied after explode: predicates stay in generated code, lambdas would not.
        keep = [f"v{i}" for i in range(u)] + [f"n{i}" for i in range(u) if any(p.edge(x, i) or induced for x in later if x > u)]
        out = out.select(*keep, F.explode(cand).alias(f"v{u}"))
        for c in _level_predicates(s, u, induced, s.implied):
            out = out.where(c)
        if any(p.edge(x, u) or induced for x in range(u + 1, k)):
            g = get(u)
            out = out.join(g, F.col(f"v{u}") == F.col(f"__v{u}")).drop(f"__v{u}")
    return out.select(*[f"v{i}" for i in range(k)])


def suffix_counts(s: Schedule, iep: SuffixCount, r: Relations, aux: Auxiliary | None = None) -> DataFrame:
    """One row: matches, by matching the prefix and adding up products of set sizes.

    The candidates of one neighbour number its degree, those of two adjacent ones their edge's support, both less the
    matched vertices among them; neighbour lists are read for other sets only."""
    p, k = s.pattern, iep.prefix
    blocks = sorted({b for _, bs in iep.terms for b in bs})
    sized_ = {b for b in blocks if len(b) == 1 or len(b) < 4 and all(p.edge(i, j) for i, j in combinations(b, 2))}
    # Where a set is in every product, rows without it count nothing.
    needed = {b for b in sized_ if len(b) > 1 and all(b in bs for _, bs in iep.terms)}
    if k == 1:
        out = r.degrees().select(F.col("vid").alias("v0"), F.col("degree").alias("d0"))
    elif k == 2 and needed and not any(len(b) == 1 for b in sized_):
        # Edges without common neighbours count nothing: the others have their keys in the supports.
        out = r.support().select(F.expr(f"e DIV {r.shift}").alias("v0"), (F.col("e") % F.lit(r.shift)).alias("v1"), F.col("n").alias("d0_1"))
        for c in _level_predicates(s, 1, False, iep.restrictions):
            out = out.where(c)
    else:
        out = matches(s, r, False, aux, k, iep.restrictions)
        for i in sorted({b[0] for b in sized_ if len(b) == 1}):
            read = r.sized(r.degrees().select(F.col("vid").alias("__v"), F.col("degree").alias(f"d{i}")))
            out = out.join(read, F.col(f"v{i}") == F.col("__v")).drop("__v")
    for b in sorted((b for b in sized_ if len(b) > 1 and "d" + "_".join(map(str, b)) not in out.columns), key=lambda b: (b not in needed, -len(b), b)):
        n, on = F.col("n").alias("d" + "_".join(map(str, b))), [r.key(f"v{b[0]}", f"v{b[1]}") == F.col("__e")]
        if len(b) == 2:
            read = r.support().select(F.col("e").alias("__e"), n)
        else:
            read = r.triple_support().select(F.col("e").alias("__e"), F.col("f").alias("__f"), n)
            on.append(F.col(f"v{b[2]}") == F.col("__f"))
        out = out.join(read, reduce(Column.__and__, on), "inner" if b in needed else "left").drop("__e", "__f")
    # Matched vertices that are not adjacent in the pattern may be in the graph.
    unsure = sorted({tuple(sorted((t, i))) for b in sized_ for t in range(k) if t not in b for i in b if not p.edge(t, i)})
    read_lists = sorted({i for b in blocks if b not in sized_ for i in b})
    rows = r.few(out) if (unsure or read_lists) and aux and aux.closed else None
    out = out if rows is None else rows
    among = r.edges_among(rows, [(f"v{i}", f"v{j}") for i, j in unsure]) if unsure and rows is not None else None
    for i, j in unsure:
        test = (r.sized(r.edges.select(r.key("src", "dst").alias("__k"))) if among is None else among).withColumn(f"x{i}_{j}", F.lit(1))
        out = out.join(test, r.key(f"v{i}", f"v{j}") == F.col("__k"), "left").drop("__k")
    lists = r.lists() if rows is None or not read_lists else r.lists_of(rows, [f"v{i}" for i in read_lists])
    for i in read_lists:
        read = r.sized(lists.select(F.col("vid").alias(f"__v{i}"), F.col("nbrs").alias(f"n{i}")))
        out = out.join(read, F.col(f"v{i}") == F.col(f"__v{i}")).drop(f"__v{i}")
    taken = F.array(*[f"v{i}" for i in range(k)])

    def size(b: tuple[int, ...]) -> Column:
        if b not in sized_:
            return F.size(F.array_except(reduce(intersect, (F.col(f"n{i}") for i in b)), taken)).cast("long")
        found = F.coalesce(F.col("d" + "_".join(map(str, b))), F.lit(0).cast("long"))
        for t in range(k):
            if t not in b:
                tests = [F.coalesce(F.col("x{}_{}".format(*sorted((t, i)))), F.lit(0)) for i in b if not p.edge(t, i)]
                found = found - (reduce(Column.__mul__, tests) if tests else F.lit(1))
        return found

    out = out.select(*[size(b).alias(f"s{n}") for n, b in enumerate(blocks)])
    name = {b: f"s{n}" for n, b in enumerate(blocks)}
    total = reduce(Column.__add__, (F.lit(c).cast("long") * reduce(Column.__mul__, (F.col(name[b]) for b in bs)) for c, bs in iep.terms))
    # A sum of products can exceed 64 bits before the division.
    return out.agg(F.coalesce(F.sum(total.cast("decimal(38,0)")), F.lit(0)).alias("t")).select(F.expr(f"CAST(t DIV {iep.divisor} AS BIGINT)").alias("matches"))
