"""Statistics and transforms of an edge table (src, dst: both directions of every edge, no loops)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 100


def degrees(edges: DataFrame) -> DataFrame:
    """(vid, degree, offset): neighbours, and neighbours with a smaller id."""
    return edges.groupBy(F.col("src").alias("vid")).agg(F.count("*").alias("degree"), F.count_if(F.col("dst") < F.col("src")).alias("offset"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(vid, nbrs, degree, offset): ascending neighbour lists."""
    return edges.groupBy(F.col("src").alias("vid")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs")).select("vid", "nbrs", F.size("nbrs").cast("long").alias("degree"), F.size(F.filter("nbrs", lambda x: x < F.col("vid"))).cast("long").alias("offset"))


def directed(edges: DataFrame) -> DataFrame:
    """(src, dst) once an edge, from the end of smaller degree (ties: smaller id) to the other.

    No vertex has more than sqrt(2 E) outgoing edges, however large a hub is."""
    d = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("d"))
    a, b = d.select(F.col("v").alias("src"), F.col("d").alias("ds")), d.select(F.col("v").alias("dst"), F.col("d").alias("dd"))
    return edges.join(a, "src").join(b, "dst").where("ds < dd OR (ds = dd AND src < dst)").select("src", "dst")


def triangle_list(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle once: what both ends of an edge point to, edges being directed by degree.

    Lists of outgoing edges are short however large a hub is, and meet at their edge: an edge and a list are moved once,
    where a join of edges would move and sort every pair in a list."""
    e = directed(edges)
    lists = e.groupBy(F.col("src").alias("a")).agg(F.collect_list("dst").alias("to"))
    ab = e.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(lists, "a")
    both = ab.join(lists.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b")
    return both.select("a", "b", F.explode(F.array_intersect("to", "to_b")).alias("c"))


def raw_triangles(edges: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """(vid, triangles): twice the triangles at each vertex; zero where there are none. triangles: the list of them, if
    there is one."""
    found = found_triangles(triangle_list(edges) if triangles is None else triangles)
    return edges.select(F.col("src").alias("vid")).distinct().join(found, "vid", "left").select("vid", F.coalesce("t", F.lit(0)).alias("triangles"))


def found_triangles(triangles: DataFrame) -> DataFrame:
    """(vid, t): twice the triangles at each vertex that has any."""
    return triangles.select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg((2 * F.count("*")).alias("t"))


def sampled_triangles(edges: DataFrame, sample: int = SAMPLE, few: bool = False) -> DataFrame:
    """(vid, degree, triangles) of the vertices of largest degree (ties: smaller id), triangles raw and exact. few: their
    lists are known to be short enough to be broadcast, and the edges are then not shuffled."""
    top = degrees(edges).orderBy(F.desc("degree"), "vid").limit(sample).select("vid", "degree")
    if few:
        top = edges.sparkSession.createDataFrame(top.collect(), top.schema)  # found once; at most sample rows
    near = edges.join(F.broadcast(top), edges["src"] == top["vid"]).select("vid", "degree", F.col("dst").alias("j"))  # at most sample rows broadcast
    near = F.broadcast(near) if few else near
    paths = near.join(edges, near["j"] == edges["src"]).select("vid", F.col("dst").alias("w"))
    ends = near.select(F.col("vid").alias("v2"), F.col("j").alias("w2"))
    closed = paths.join(F.broadcast(ends) if few else ends, (F.col("vid") == F.col("v2")) & (F.col("w") == F.col("w2")), "left_semi")
    return top.join(closed.groupBy("vid").agg(F.count("*").alias("t")), "vid", "left").select("vid", "degree", F.coalesce("t", F.lit(0)).alias("triangles"))


def estimated_triangles(edges: DataFrame, vertices: int, sample: int = SAMPLE, few: bool = False) -> tuple[int, float]:
    """Estimated number of triangles and the sample's average degree."""
    t, d = sampled_triangles(edges, sample, few).agg(F.avg("triangles"), F.avg("degree")).first()
    return (int((t or 0.0) * vertices / 6 + 0.5), float(d or 0.0))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with 0-based places in a global order, without one task seeing all rows: range partitions are
    counted, then each numbers its own rows from the sum of those before it."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    # The partition number is part of the row from here on; a written table keeps it stable.
    from ..sources.tables import stable

    parts = stable(parts)
    counts = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"))  # a row a partition
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "__p").withColumn(name, (F.col("__before") + nth).cast("long")).drop("__p", "__before")


def relabelled(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by mapping (vid, new)."""
    a, b = mapping.select(F.col("vid").alias("src"), F.col("new").alias("s")), mapping.select(F.col("vid").alias("dst"), F.col("new").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def degree_order(edges: DataFrame) -> DataFrame:
    """(vid, new): larger degree, smaller new id; ties by old id."""
    return numbered(degrees(edges).select("vid", "degree"), [F.desc("degree"), F.asc("vid")], "new").select("vid", "new")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(vid, new): ids 0, 1, ... in the order of the old ones."""
    return dense_order(edges.select(F.col("src").alias("vid")).distinct())


def dense_order(vertices: DataFrame) -> DataFrame:
    """(vid, new) of distinct vertices (vid), in the order of their ids."""
    return numbered(vertices, [F.asc("vid")], "new").select("vid", "new")


def summary(edges: DataFrame) -> DataFrame:
    """One row: vertices, directed edges, largest degree and offset."""
    return degrees(edges).agg(
        F.count("*").alias("num_vertex"), F.coalesce(F.sum("degree"), F.lit(0)).alias("num_edge"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.max("offset"), F.lit(0)).alias("max_offset"),
    )


def problems(edges: DataFrame) -> DataFrame:
    """Rows that break the invariants, with the reason: loop, duplicate, or missing reverse edge."""
    loops = edges.where("src = dst").select("src", "dst", F.lit("loop").alias("problem"))
    twice = edges.groupBy("src", "dst").count().where("count > 1").select("src", "dst", F.lit("duplicate").alias("problem"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    alone = edges.join(back, ["src", "dst"], "left_anti").select("src", "dst", F.lit("no reverse edge").alias("problem"))
    return loops.unionByName(twice).unionByName(alone)
