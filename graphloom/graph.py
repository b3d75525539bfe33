"""A data graph: a normalised edge table, its statistics, and how large it is."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import statistics as S
from .operators import pairs
from .plans.schedule import Stats
from .sources import binary, edges as E, files


#: A vertex of so many times the average degree is a hub.
HUB = 32
#: So many entries of lists are broadcast.
FEW = 1_000_000


@dataclass(frozen=True)
class MetaData:
    """num_edge counts directed entries, num_triangle distinct triangles, max_triangle a vertex's raw count
    (twice its triangles, at least the largest degree)."""

    num_vertex: int
    num_edge: int
    num_triangle: int
    max_degree: int
    max_offset: int
    max_triangle: int
    scheduler_avg_degree: float

    @property
    def stats(self) -> Stats:
        return Stats(self.num_vertex, self.num_edge, self.num_triangle, self.scheduler_avg_degree)


class Graph:
    """An undirected simple graph as a DataFrame of (src, dst), both directions.

    The edges are persisted on first use by a plan.  Statistics are computed on demand, in one pass each."""

    def __init__(self, edges: DataFrame, *, triangles: int | None = None, meta: MetaData | None = None, name: str = "graph"):
        self.edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.name = name
        self._triangles, self._meta = triangles, meta
        #: Relations that pruned plans share (operators.match.Relations.kept).
        self.auxiliary: dict = {}
        self._ranked: Graph | None = None
        #: What the edges are made of, if that is persisted.
        self._base: DataFrame | None = None

    # -- sources

    @classmethod
    def from_edges(cls, pairs: DataFrame, src: str = "src", dst: str = "dst", reorder_by_degree: bool = False, dense: bool = False, name: str = "graph") -> Graph:
        """From any two id columns: loops dropped, directions and duplicates normalised."""
        once, base = E.once(pairs, src, dst), None
        if dense:
            # Made once for the ids and for the edges; an edge gets its new ids before it has two directions.
            base = once.persist()
            ids = S.dense_order(base.select(F.explode(F.array("a", "b")).alias("vid")).distinct())
            once = S.relabelled(base.toDF("src", "dst"), ids).toDF("a", "b")
        g = cls(E.both(once), name=name)
        g._base = base
        return g.reordered() if reorder_by_degree else g

    @classmethod
    def from_snap(cls, spark: SparkSession, path: str, reorder_by_degree: bool = False, dense: bool = True) -> Graph:
        """From an edge-list text file, or a folder that holds snap.txt."""
        folder = files.is_folder(spark, path)
        name = files.base(path if folder else path.rpartition("/")[0]) or "graph"
        return cls.from_edges(E.read_text(spark, files.join(path, "snap.txt") if folder else path), reorder_by_degree=reorder_by_degree, dense=dense, name=name)

    @classmethod
    def from_csr(cls, spark: SparkSession, indptr: Sequence[int], indices: Sequence[int], offsets: Sequence[int] | None = None, triangles: Sequence[int] | None = None, reorder_by_degree: bool = False) -> Graph:
        e = E.from_csr(spark, indptr, indices, offsets, triangles)
        g = cls(e, triangles=None if triangles is None else int(np.asarray(triangles, np.int64).sum()) // 6)
        return g.reordered() if reorder_by_degree else g

    @classmethod
    def from_csr_files(cls, spark: SparkSession, folder: str, reorder_by_degree: bool = False) -> Graph:
        """From index arrays in files (indptr and indices, raw), which no machine has to hold."""
        g = cls(binary.read_csr(spark, folder), name=files.base(folder))
        return g.reordered() if reorder_by_degree else g

    @classmethod
    def from_preprocessed(cls, spark: SparkSession, folder: str, reorder_by_degree: bool = False) -> Graph:
        """From a folder written by save (Parquet) or save_binary (raw arrays and meta.txt)."""
        name = files.base(folder)
        if files.exists(spark, files.join(folder, "meta.json")):
            meta = MetaData(**json.loads(files.read(spark, files.join(folder, "meta.json"))))
            g = cls(binary.read_parquet(spark, folder), meta=meta, name=name)
        else:
            kv = binary.read_meta(spark, folder)
            meta = MetaData(int(kv["NUM_VERTEX"]), int(kv["NUM_EDGE"]), int(kv["NUM_TRIANGLE"]) // 6, int(kv.get("MAX_DEGREE", 0)), int(kv.get("MAX_OFFSET", 0)), int(kv.get("MAX_TRIANGLE", 0)), float(kv.get("SCHEDULER_AVG_DEGREE", 0)))
            g = cls(binary.read_csr(spark, folder), meta=meta, name=name)
        return g.reordered() if reorder_by_degree else g

    # -- statistics

    @cached_property
    def _summary(self) -> tuple[int, int, int, int]:
        return tuple(self.persisted().transform(S.summary).first())

    @property
    def num_vertices(self) -> int:
        """Vertices with an edge."""
        return self._meta.num_vertex if self._meta else self._summary[0]

    @property
    def num_edges(self) -> int:
        """Directed entries: twice the edges."""
        return self._meta.num_edge if self._meta else self._summary[1]

    @cached_property
    def id_bounds(self) -> tuple[int, int]:
        return tuple(self.persisted().agg(F.coalesce(F.min("src"), F.lit(0)), F.coalesce(F.max("src"), F.lit(0))).first())

    @property
    def largest_id(self) -> int:
        return self.id_bounds[1]

    @cached_property
    def _estimate(self) -> tuple[int, float]:
        most = self._meta.max_degree if self._meta else self._summary[2]
        return S.estimated_triangles(self.persisted(), self.num_vertices, few=S.SAMPLE * most <= FEW)

    @property
    def num_triangles(self) -> int:
        """Given or stored; else estimated from the vertices of largest degree."""
        if self._meta:
            return self._meta.num_triangle
        return self._triangles if self._triangles is not None else self._estimate[0]

    @cached_property
    def metadata(self) -> MetaData:
        """Cheap statistics: triangles as in num_triangles."""
        if self._meta:
            return self._meta
        v, e, degree, offset = self._summary
        average = e / v if v and self._triangles is not None else (self._estimate[1] if v else 0.0)
        return MetaData(v, e, self.num_triangles, degree, offset, degree, average)

    @cached_property
    def stats(self) -> Stats:
        """What cost models know: the metadata, and the mean degree of edges' ends."""
        d = S.degrees(self.persisted()).agg(F.sum(F.col("degree") * F.col("degree")).cast("double")).first()[0]
        return replace(self.metadata.stats, end_degree=(d or 0.0) / max(self.num_edges, 1))

    def exact_metadata(self) -> MetaData:
        """Statistics with exact triangle counts, as preprocessing stores them."""
        v, e, degree, offset = self._summary
        total, most = S.found_triangles(self.triangles()).agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.max("t"), F.lit(0))).first()
        return MetaData(v, e, total // 6, degree, offset, max(most, degree), e / v if v else 0.0)

    def degrees(self) -> DataFrame:
        return S.degrees(self.edges)

    def adjacency(self) -> DataFrame:
        return S.adjacency(self.edges)

    def triangles(self) -> DataFrame:
        """(a, b, c) of every triangle once; persisted, for statistics and plans."""
        if "triangles" not in self.auxiliary or not self.auxiliary["triangles"].storageLevel.useMemory:
            if self._hubs() or not self._short_ids():
                t = F.sort_array(F.array("a", "b", "c"), asc=False)
                found = S.triangle_list(self.persisted()).select(t.alias("t")).select(*[F.col("t")[i].alias(n) for i, n in enumerate("abc")])
            else:
                found = pairs.triangles(self.persisted(), self.num_edges)
            self.auxiliary["triangles"] = found.persist()
        return self.auxiliary["triangles"]

    def raw_triangles(self) -> DataFrame:
        return S.raw_triangles(self.persisted(), self.triangles())

    def problems(self) -> DataFrame:
        return S.problems(self.edges)

    def validate(self) -> Graph:
        if found := self.problems().limit(5).collect():
            raise ValueError("not an undirected simple graph: " + "; ".join(f"({r.src}, {r.dst}) {r.problem}" for r in found))
        return self

    # -- transforms and sinks

    def reordered(self) -> Graph:
        """Larger degree, smaller id: upper bounds on ids then cut hubs' lists."""
        e = self.persisted()
        return Graph(S.relabelled(e, S.degree_order(e)), triangles=self._triangles, name=self.name)

    def _hubs(self) -> bool:
        """Whether a degree is over HUB averages, on a graph that is not ranked by degree yet."""
        if self._ranked is self:
            return False
        v, e, degree = (self._meta.num_vertex, self._meta.num_edge, self._meta.max_degree) if self._meta else self._summary[:3]
        return degree * v > HUB * e

    def _short_ids(self) -> bool:
        low, high = self.id_bounds
        return low >= 0 and high < 1 << 32

    def ranked(self) -> Graph:
        """The same graph, relabelled by degree if it has hubs (a degree over HUB averages) or ids beyond 32 bits: for counts,
        which do not depend on ids, bounds then cut hubs' lists. Made once."""
        if self._ranked is self or not self._hubs() and self._short_ids():
            return self
        if self._ranked is None:
            self._ranked = self.reordered()
            self._ranked._ranked = self._ranked
        return self._ranked

    def persisted(self) -> DataFrame:
        if not self.edges.storageLevel.useMemory:
            self.edges.persist()
        return self.edges

    def unpersist(self) -> None:
        for df in [self.edges, *self.auxiliary.values(), *([self._base] if self._base is not None else [])]:
            df.unpersist()
        self.auxiliary.clear()
        if self._ranked not in (None, self):
            self._ranked.unpersist()

    def save(self, folder: str) -> MetaData:
        """Adjacency with triangle counts as Parquet, and exact metadata."""
        e, meta = self.persisted(), self.exact_metadata()
        binary.write_parquet(e, S.found_triangles(self.triangles()), folder)
        files.write(e.sparkSession, files.join(folder, "meta.json"), json.dumps(asdict(meta)).encode())
        return meta

    def save_binary(self, folder: str) -> MetaData:
        """Raw CSR arrays and meta.txt; ids must be dense. The arrays pass through the driver in pieces."""
        e, meta = self.persisted(), self.exact_metadata()
        self._write_csr(folder, self.raw_triangles())
        binary.write_meta(e.sparkSession, folder, dict(zip(binary.FIELDS, (meta.num_vertex, meta.num_edge, 6 * meta.num_triangle, meta.max_degree, meta.max_offset, meta.max_triangle, meta.scheduler_avg_degree))))
        return meta

    def save_csr(self, folder: str) -> None:
        """The index arrays alone, for from_csr_files."""
        self._write_csr(folder, None)

    def _write_csr(self, folder: str, triangles: DataFrame | None) -> None:
        e = self.persisted()
        if self.num_vertices and (self.id_bounds[0] < 0 or self.id_bounds[1] >= self.num_vertices):
            raise ValueError("ids must be dense; use from_edges(..., dense=True)")
        binary.write_csr(e.sparkSession, folder, e, self.num_vertices, self.num_edges, triangles)
