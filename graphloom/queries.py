"""The engine's operators as queries over the star-schema tables, each with SQL for the same rows.

The data graph links the parts on consecutive lines of an order, over all of ``lineitem``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import compile_plan
from .functions import statistics as S
from .graph import Graph
from .operators import vertex_sets as V
from .patterns import CATALOGUE, Pattern
from .plans.schedule import schedule
from .sources import edges as E
from .sources import files
from .sources.edges import normalised
from .sources.tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

_graphs: dict[tuple[str, str], Graph] = {}


def linked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of parts on consecutive lines, as they come."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    a = l.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    b = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "n"]).select("src", "dst")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The data graph; one object a session and folder, so that its edges are persisted once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = Graph.from_edges(linked_parts(spark, sf_dir), name="linked_parts")
    return _graphs[key]


EDGES = """p AS (SELECT a.l_partkey AS s, b.l_partkey AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
        WHERE a.l_partkey <> b.l_partkey),
e AS (SELECT s, d FROM p UNION SELECT d, s FROM p)"""


def matching_sql(adjacency: str, induced: bool) -> str:
    """Level by level: one CTE a vertex, semi-joins for edges, anti-joins for forbidden ones."""
    s = schedule(Pattern(adjacency))
    p = s.pattern
    ctes = [EDGES]
    first = [f"{'v0 > v1' if (a, b) == (0, 1) else 'v1 > v0'}" for a, b in s.implied if {a, b} == {0, 1}]
    ctes.append(f"l1 AS (SELECT s AS v0, d AS v1 FROM e{' WHERE ' + ' AND '.join(x.replace('v0', 's').replace('v1', 'd') for x in first) if first else ''})")
    for u in range(2, p.size):
        near = [i for i in range(u) if p.edge(u, i)]
        where = [f"l.v{a} > x.d" if b == u else f"x.d > l.v{b}" for a, b in s.implied if u in (a, b) and max(a, b) == u]
        where += [f"x.d <> l.v{i}" for i in range(u) if not p.edge(u, i)]
        where += [f"EXISTS (SELECT 1 FROM e y WHERE y.s = l.v{i} AND y.d = x.d)" for i in near[:-1]]
        if induced:
            where += [f"NOT EXISTS (SELECT 1 FROM e y WHERE y.s = l.v{i} AND y.d = x.d)" for i in range(u) if not p.edge(u, i)]
        ctes.append(f"l{u} AS (SELECT l.*, x.d AS v{u} FROM l{u - 1} l JOIN e x ON x.s = l.v{near[-1]}{' WHERE ' + ' AND '.join(where) if where else ''})")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT count(*) AS matches FROM l{p.size - 1}"


def _matching(adjacency: str, kind: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compile_plan(graph(spark, sf_dir), adjacency, kind, **({"pruning_type": "none", "scheduler": "structural"} | options)).counts()

    return run


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

for _name, _adjacency in CATALOGUE.items():
    QUERIES[f"match_edge_{_name}"] = _matching(_adjacency, "edge")
    QUERIES[f"match_vertex_{_name}"] = _matching(_adjacency, "vertex")
    QUERIES[f"match_edge_iep_{_name}"] = _matching(_adjacency, "edge_iep")
    SQL[f"match_edge_{_name}"] = SQL[f"match_edge_iep_{_name}"] = matching_sql(_adjacency, False)
    SQL[f"match_vertex_{_name}"] = matching_sql(_adjacency, True)
for _kind in ("static", "eager", "online", "costmodel"):
    for _name in ("p2", "p3", "p4", "p5", "p7"):
        QUERIES[f"pruning_{_kind}_{_name}"] = _matching(CATALOGUE[_name], "edge", pruning_type=_kind)
        SQL[f"pruning_{_kind}_{_name}"] = SQL[f"match_edge_{_name}"]
for _name in ("p2", "p5"):
    QUERIES[f"pruning_eager_iep_{_name}"] = _matching(CATALOGUE[_name], "edge_iep", pruning_type="eager", scheduler="cost")
    SQL[f"pruning_eager_iep_{_name}"] = SQL[f"match_edge_{_name}"]
for _kind in ("cost", "density"):
    QUERIES[f"scheduler_{_kind}_p1"] = _matching(CATALOGUE["p1"], "vertex", scheduler=_kind)
    SQL[f"scheduler_{_kind}_p1"] = SQL["match_vertex_p1"]
for _name in ("triangle", "diamond"):
    QUERIES[f"array_lowering_{_name}"] = _matching(CATALOGUE[_name], "vertex", lowering="array", pruning_type="none")
    SQL[f"array_lowering_{_name}"] = SQL[f"match_vertex_{_name}"]


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = "WITH " + EDGES + sql
        return f

    return add


@_query(" SELECT s AS src, d AS dst FROM e")
def edges_normalised(spark, sf_dir):
    return normalised(linked_parts(spark, sf_dir))


@_query(" SELECT s AS vid, count(*) AS degree, count(*) FILTER (d < s) AS \"offset\" FROM e GROUP BY s")
def vertex_degrees(spark, sf_dir):
    return graph(spark, sf_dir).degrees()


@_query(", g AS (SELECT s, count(*) AS degree, string_agg(d, ',' ORDER BY d) AS nbrs FROM e GROUP BY s) SELECT s AS vid, nbrs, degree, CAST(sum(degree) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) - degree AS BIGINT) AS start FROM g")
def csr_rows(spark, sf_dir):
    """Neighbour lists with each list's place in the concatenation: range-partitioned running sums."""
    a = graph(spark, sf_dir).adjacency()
    entries = S.numbered(graph(spark, sf_dir).edges, [F.asc("src"), F.asc("dst")], "at").groupBy("src").agg(F.min("at").alias("start"))
    return a.join(entries, a["vid"] == entries["src"]).select("vid", F.concat_ws(",", F.transform("nbrs", lambda x: x.cast("string"))).alias("nbrs"), "degree", "start")


@_query(", t AS (SELECT a.s, count(*) AS t FROM e a JOIN e b ON b.s = a.d JOIN e c ON c.s = a.s AND c.d = b.d GROUP BY a.s) SELECT v.s AS vid, coalesce(t.t, 0) AS triangles FROM (SELECT DISTINCT s FROM e) v LEFT JOIN t ON t.s = v.s")
def triangles_raw(spark, sf_dir):
    return graph(spark, sf_dir).raw_triangles()


@_query(", g AS (SELECT s, count(*) AS degree FROM e GROUP BY s ORDER BY degree DESC, s LIMIT 100), t AS (SELECT a.s, count(*) AS t FROM g JOIN e a ON a.s = g.s JOIN e b ON b.s = a.d JOIN e c ON c.s = a.s AND c.d = b.d GROUP BY a.s) SELECT g.s AS vid, g.degree, coalesce(t.t, 0) AS triangles FROM g LEFT JOIN t ON t.s = g.s")
def triangles_sampled(spark, sf_dir):
    """The hundred vertices of largest degree, from which triangles are estimated."""
    return S.sampled_triangles(graph(spark, sf_dir).edges)


@_query(", g AS (SELECT s, count(*) AS n, count(*) FILTER (d < s) AS o FROM e GROUP BY s) SELECT count(*) AS num_vertex, CAST(sum(n) AS BIGINT) AS num_edge, max(n) AS max_degree, max(o) AS max_offset FROM g")
def graph_summary(spark, sf_dir):
    return S.summary(graph(spark, sf_dir).edges)


@_query(", g AS (SELECT s, count(*) AS n FROM e GROUP BY s), m AS (SELECT s, row_number() OVER (ORDER BY n DESC, s) - 1 AS r FROM g) SELECT a.r AS src, b.r AS dst FROM e JOIN m a ON a.s = e.s JOIN m b ON b.s = e.d")
def degree_reordering(spark, sf_dir):
    return graph(spark, sf_dir).reordered().edges


@_query(", m AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM (SELECT DISTINCT s FROM e)) SELECT s AS vid, r AS new FROM m")
def id_densification(spark, sf_dir):
    return S.dense_ids(graph(spark, sf_dir).edges)


@_query(", x AS (SELECT s, d FROM p WHERE s < d) SELECT s AS src, d AS dst, 'no reverse edge' AS problem FROM (SELECT DISTINCT s, d FROM x)")
def graph_problems(spark, sf_dir):
    """Invariants of the upward half of the edges, none of which has its reverse."""
    half = linked_parts(spark, sf_dir).where("src < dst").distinct()
    return S.problems(half)


@_query("""
, n AS (SELECT s, list(d ORDER BY d) AS n FROM e GROUP BY s)
SELECT e.s AS src, e.d AS dst,
  len(list_filter(a.n, lambda x: list_contains(b.n, x))) AS both, len(list_filter(a.n, lambda x: list_contains(b.n, x) AND x < e.s)) AS both_below,
  len(list_filter(a.n, lambda x: NOT list_contains(b.n, x) AND x <> e.d)) AS apart, len(list_filter(a.n, lambda x: NOT list_contains(b.n, x) AND x <> e.d AND x < e.s)) AS apart_below,
  len(list_filter(a.n, lambda x: x < e.d)) AS bounded, len(a.n) - 1 AS removed, list_position(a.n, e.d) - 1 AS place
FROM e JOIN n a ON a.s = e.s JOIN n b ON b.s = e.d""")
def vertex_set_algebra(spark, sf_dir):
    """Intersection, difference, bound, removal and index of the neighbour lists at every edge."""
    g = graph(spark, sf_dir)
    lists = g.adjacency().select("vid", "nbrs")
    a, b = lists.select(F.col("vid").alias("src"), F.col("nbrs").alias("a")), lists.select(F.col("vid").alias("dst"), F.col("nbrs").alias("b"))
    s, d, x, y = (F.col(c) for c in ("src", "dst", "a", "b"))
    long = lambda c, n: c.cast("long").alias(n)
    return g.edges.join(a, "src").join(b, "dst").select(
        "src", "dst", long(V.intersect_count(x, y), "both"), long(V.intersect_count(x, y, s), "both_below"), long(V.subtract_count(x, y, d), "apart"),
        long(V.subtract_count(x, y, d, s), "apart_below"), long(V.bounded_count(x, d), "bounded"), long(V.remove_count(x, d), "removed"), long(V.indices(x, F.array(d))[0], "place"),
    )


@_query(" SELECT a.s AS v0, a.d AS v1, b.d AS v2 FROM e a JOIN e b ON b.s = a.d JOIN e c ON c.s = a.s AND c.d = b.d WHERE a.s > a.d AND a.d > b.d")
def enumerate_triangles(spark, sf_dir):
    """The occurrences themselves, largest vertex first."""
    rows = compile_plan(graph(spark, sf_dir), CATALOGUE["triangle"], "edge", "none", scheduler="structural").matches()
    v = F.sort_array(F.array("v0", "v1", "v2"), asc=False)
    return rows.select(v[0].alias("v0"), v[1].alias("v1"), v[2].alias("v2"))


@_query(", l AS (SELECT 0 AS level, s AS vid, 1 AS reads FROM (SELECT DISTINCT s FROM e) UNION ALL SELECT 1, d, count(*) FROM e WHERE s > d GROUP BY d) SELECT CAST(level AS INTEGER) AS level, vid, CAST(reads AS BIGINT) AS reads FROM l")
def profile_reads(spark, sf_dir):
    """How often each vertex's list is read at each level of the triangle plan."""
    return compile_plan(graph(spark, sf_dir), CATALOGUE["triangle"], "edge", "none", scheduler="structural").profile()


_DENSE = ", m AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS r FROM (SELECT DISTINCT s FROM e)) SELECT a.r AS src, b.r AS dst FROM e JOIN m a ON a.s = e.s JOIN m b ON b.s = e.d"


def _folder(spark: SparkSession, name: str) -> str:
    return files.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


@_query(_DENSE)
def source_edge_list(spark, sf_dir):
    """The links written as an edge-list text, with a comment and loops in it, and read again."""
    path = _folder(spark, "edges")
    lines = linked_parts(spark, sf_dir).select(F.concat_ws("\t", "src", "dst", F.lit("more")).alias("value"))
    spark.createDataFrame([("# src dst",), ("",)], "value string").unionByName(lines).write.text(path)
    return Graph.from_edges(E.read_text(spark, path), dense=True).edges


@_query(_DENSE)
def source_csr(spark, sf_dir):
    """The links as index arrays, in files since no machine need hold them."""
    folder = _folder(spark, "csr")
    g = Graph.from_edges(linked_parts(spark, sf_dir), dense=True)
    g.save_csr(folder)
    g.unpersist()
    return Graph.from_csr_files(spark, folder).edges


@_query(_DENSE)
def stored_parquet(spark, sf_dir):
    """The graph saved as Parquet and read again."""
    folder = _folder(spark, "graph")
    g = Graph.from_edges(linked_parts(spark, sf_dir), dense=True)
    g.save(folder)
    g.unpersist()
    return Graph.from_preprocessed(spark, folder).edges


@_query(_DENSE)
def stored_binary(spark, sf_dir):
    """The graph saved as raw arrays with metadata and read again."""
    folder = _folder(spark, "graph")
    g = Graph.from_edges(linked_parts(spark, sf_dir), dense=True)
    g.save_binary(folder)
    g.unpersist()
    return Graph.from_preprocessed(spark, folder).edges


@_query("""
, g AS (SELECT s, count(*) AS n, count(*) FILTER (d < s) AS o FROM e GROUP BY s), t AS (SELECT a.s, count(*) AS t FROM e a JOIN e b ON b.s = a.d JOIN e c ON c.s = a.s AND c.d = b.d GROUP BY a.s)
SELECT count(*) AS num_vertex, CAST(sum(n) AS BIGINT) AS num_edge, CAST((SELECT sum(t) FROM t) // 6 AS BIGINT) AS num_triangle, max(n) AS max_degree, max(o) AS max_offset,
       greatest((SELECT max(t) FROM t), max(n)) AS max_triangle, round(sum(n) / count(*), 6) AS scheduler_avg_degree FROM (SELECT g.n, (SELECT count(*) FROM e x WHERE x.s = g.s AND x.d < x.s) AS o FROM g) g""")
def stored_metadata(spark, sf_dir):
    """Exact metadata, saved and read again."""
    folder = _folder(spark, "graph")
    g = Graph.from_edges(linked_parts(spark, sf_dir))
    g.save(folder)
    g.unpersist()
    meta = Graph.from_preprocessed(spark, folder).metadata
    out = spark.createDataFrame([tuple(vars(meta).values())], "num_vertex long, num_edge long, num_triangle long, max_degree long, max_offset long, max_triangle long, scheduler_avg_degree double")
    return out.withColumn("scheduler_avg_degree", F.round("scheduler_avg_degree", 6))


@_query("""
, g AS (SELECT s, count(*) AS n FROM e GROUP BY s), w AS (
  SELECT 1 AS level, s AS vid, n AS elements, 1 AS reads, 0 AS tests FROM g UNION ALL
  SELECT 2, e.d, g.n, 1, (SELECT count(*) FROM e x WHERE x.s = e.d AND x.d < e.d) FROM e JOIN g ON g.s = e.d WHERE e.s > e.d)
SELECT CAST(level AS INTEGER) AS level, vid, CAST(sum(reads) AS BIGINT) AS reads, CAST(sum(elements) AS BIGINT) AS neighbours, CAST(0 AS BIGINT) AS auxiliary, CAST(sum(tests) AS BIGINT) AS tests FROM w GROUP BY level, vid""")
def profile_work(spark, sf_dir):
    """Elements read and edges tested by each vertex's list, at each level of the triangle plan."""
    return compile_plan(graph(spark, sf_dir), CATALOGUE["triangle"], "edge", "none", scheduler="structural").work()
