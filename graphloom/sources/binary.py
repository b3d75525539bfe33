"""Little-endian CSR files and the text metadata beside them (the preprocessed layout), and its Parquet twin."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

FIELDS = ("NUM_VERTEX", "NUM_EDGE", "NUM_TRIANGLE", "MAX_DEGREE", "MAX_OFFSET", "MAX_TRIANGLE", "SCHEDULER_AVG_DEGREE")
#: Entries of an array in a task, and in a piece of it.
PART, PIECE = 1 << 22, 1 << 19


def write_meta(spark: SparkSession, folder: str, values: dict[str, float]) -> None:
    """One tab-separated name and value a line."""
    files.write(spark, files.join(folder, "meta.txt"), "".join(f"{k}\t{values[k]}\n" for k in FIELDS).encode())


def read_meta(spark: SparkSession, folder: str) -> dict[str, float]:
    """NUM_TRIANGLE is stored as the sum over vertices (six a triangle)."""
    out: dict[str, float] = {}
    for line in files.read(spark, files.join(folder, "meta.txt")).decode().splitlines():
        if line.strip():
            k, v = line.split()
            out[k] = float(v) if k == FIELDS[-1] else int(float(v))
    if missing := set(FIELDS[:3]) - set(out):
        raise ValueError(f"meta.txt lacks {', '.join(sorted(missing))}")
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of whole lists in, pieces of the arrays in vertex order out: degrees, offsets and neighbours."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches]
    if not sum(len(p[0]) for p in parts):
        return
    src, dst = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del parts
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
    below = np.concatenate([[0], np.cumsum(dst < src)])
    ends = np.append(first, len(src))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        cols = (np.diff(ends[at : to + 1]), np.diff(below[ends[at : to + 1]]), dst[ends[at] : ends[to]])
        yield pa.RecordBatch.from_arrays([pa.array([c.astype("<u8").tobytes()], pa.binary()) for c in cols], ["degree", "offset", "indices"])
        at = to


def _cut_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().astype("<u8").tobytes()], pa.binary())], ["triangle"])


def _streamed(pieces: DataFrame) -> Iterator:
    """Pieces made by all executors, in order, of which the driver holds one partition at a time."""
    pieces = pieces.persist(StorageLevel.DISK_ONLY)
    try:
        pieces.count()
        yield from pieces.toLocalIterator()
    finally:
        pieces.unpersist()


class _Sink:
    """64-bit files of arrays, and 32-bit ones where all values fit, written by and by."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.local = spark, folder, tempfile.mkdtemp(prefix="graphloom-")
        self.open: dict[str, tuple] = {}
        self.most: dict[str, int] = {}

    def add(self, name: str, values: np.ndarray) -> None:
        if name not in self.open:
            self.open[name] = tuple(open(os.path.join(self.local, f"{name}_u{bits}.bin"), "wb") for bits in (64, 32))
            self.most[name] = 0
        self.most[name] = max(self.most[name], int(values.max(initial=0)))
        for f, kind in zip(self.open[name], ("<u8", "<u4")):
            f.write(values.astype(kind).tobytes())

    def close(self) -> None:
        try:
            for name, both in self.open.items():
                for f, bits in zip(both, (64, 32)):
                    f.close()
                    if bits == 64 or self.most[name] < 1 << 32:
                        files.move_in(self.spark, f.name, files.join(self.folder, f"{name}_u{bits}.bin"))
        finally:
            shutil.rmtree(self.local, ignore_errors=True)


def write_csr(spark: SparkSession, folder: str, edges: DataFrame, n: int, entries: int, triangles: DataFrame | None = None) -> None:
    """indptr, indices, degree and offset of n vertices with dense ids, and triangle if counts (vid, triangles) are given.

    Executors cut the arrays into pieces, which pass through the driver to the files one after another."""
    sink, at = _Sink(spark, folder), 0
    try:
        for name in ("indptr", "indices", "degree", "offset"):
            sink.add(name, np.zeros(int(name == "indptr"), np.uint64))
        for row in _streamed(edges.select("src", "dst").repartitionByRange(max(1, -(-entries // PART)), "src").mapInArrow(_cut, "degree binary, offset binary, indices binary")):
            degree = np.frombuffer(row.degree, "<u8")
            sink.add("degree", degree)
            sink.add("offset", np.frombuffer(row.offset, "<u8"))
            sink.add("indices", np.frombuffer(row.indices, "<u8"))
            ends = at + np.cumsum(degree)
            sink.add("indptr", ends)
            at = int(ends[-1])
        if triangles is not None:
            sink.add("triangle", np.zeros(0, np.uint64))
            ordered = triangles.repartitionByRange(max(1, -(-n // PART)), "vid").sortWithinPartitions("vid").select("triangles")
            for row in _streamed(ordered.mapInArrow(_cut_values, "triangle binary")):
                sink.add("triangle", np.frombuffer(row.triangle, "<u8"))
    finally:
        sink.close()


def _array_files(spark: SparkSession, folder: str) -> dict[str, tuple[str, int, int]]:
    """(file name, bytes a value, values) of indptr and indices."""
    out = {}
    for name in ("indptr", "indices"):
        for bits in (64, 32):
            file = f"{name}_u{bits}.bin"
            if name not in out and files.exists(spark, files.join(folder, file)):
                size = files.size(spark, files.join(folder, file))
                if size % (bits // 8):
                    raise ValueError(f"{files.join(folder, file)} does not hold whole numbers of {bits} bits")
                out[name] = (file, bits // 8, size // (bits // 8))
    if len(out) < 2:
        raise ValueError(f"{folder} has no indptr and indices")
    return out


def read_csr(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of index arrays in files, which tasks read in slices; ValueError names the broken rule, as in check_csr.

    Whether each edge has its reverse is told by sums of 64-bit hashes: no edge is moved for it."""
    at = _array_files(spark, folder)
    n, m = at["indptr"][2] - 1, at["indices"][2]
    if n < 1:
        raise ValueError("indptr needs at least two entries")
    place = files.on_executors(spark, folder)
    slices = max(1, -(-max(n, m) // PART))
    tasks = spark.range(0, slices, 1, slices)
    found = tasks.mapInArrow(_checked(place, at, slices), "problem string, balance long").where("problem IS NOT NULL OR balance <> 0").collect()
    if bad := next((r.problem for r in found if r.problem), None):
        raise ValueError(bad)
    if sum(r.balance for r in found) % (1 << 64):
        raise ValueError("an edge has no reverse edge")
    return tasks.mapInArrow(_expanded(place, at, slices), "src long, dst long")


def _opened(place, at: dict, name: str) -> np.ndarray:
    file, width, values = at[name]
    return np.memmap(os.path.join(place(), file), f"<u{width}", "r") if values else np.zeros(0, np.uint64)


def _slice(at: dict, slices: int, k: int) -> tuple[int, int]:
    n = at["indptr"][2] - 1
    return n * k // slices, n * (k + 1) // slices


def _lists(ptr: np.ndarray, idx: np.ndarray, v: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owners, neighbours) of vertices from v on, whole lists, some at a time."""
    at = 0
    while at < len(ptr) - 1:
        to = max(at + 1, int(np.searchsorted(ptr, ptr[at] + PIECE, "right")) - 1)
        yield np.repeat(np.arange(v + at, v + to), np.diff(ptr[at : to + 1])), np.asarray(idx[ptr[at] : ptr[to]]).astype(np.int64)
        at = to


def _expanded(place, at: dict, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (int(x) for b in batches for x in b.column(0).to_numpy()):
            v, to = _slice(at, slices, k)
            ptr = np.asarray(_opened(place, at, "indptr")[v : to + 1]).astype(np.int64)
            for src, dst in _lists(ptr, _opened(place, at, "indices"), v):
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return run


def _checked(place, at: dict, slices: int):
    n, m = at["indptr"][2] - 1, at["indices"][2]

    def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
        return x ^ x >> np.uint64(31)

    def of(k: int) -> tuple[str | None, int]:
        v, to = _slice(at, slices, k)
        ptr = np.asarray(_opened(place, at, "indptr")[v : to + 1]).astype(np.int64)
        if v == 0 and ptr[0] != 0 or to == n and ptr[-1] != m or ptr.min() < 0 or ptr.max() > m:
            return "indptr must begin with 0 and end with the number of indices", 0
        if (np.diff(ptr) < 0).any():
            return "indptr must not decrease", 0
        balance = np.uint64(0)
        for owner, idx in _lists(ptr, _opened(place, at, "indices"), v):
            if ((idx < 0) | (idx >= n)).any():
                return "a neighbour is out of range", 0
            if (owner == idx).any():
                return "self loops are not allowed", 0
            same = owner[1:] == owner[:-1]
            if (same & (idx[1:] < idx[:-1])).any():
                return "neighbours must be sorted", 0
            if (same & (idx[1:] == idx[:-1])).any():
                return "neighbours must not repeat", 0
            h, up = mixed(np.minimum(owner, idx), np.maximum(owner, idx)), owner < idx
            balance = np.uint64((int(balance) + int(h[up].sum(dtype=np.uint64)) - int(h[~up].sum(dtype=np.uint64))) % (1 << 64))
        return None, int(balance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in (int(x) for b in batches for x in b.column(0).to_numpy()):
            problem, balance = of(k)
            yield pa.RecordBatch.from_arrays([pa.array([problem], pa.string()), pa.array(np.array([balance], np.uint64).view(np.int64))], ["problem", "balance"])

    return run


def write_parquet(edges: DataFrame, found: DataFrame, folder: str, parts: int | None = None) -> None:
    """(vid, nbrs, degree, offset, triangles), range-partitioned and sorted by vid: the layout for large graphs. found: (vid, t)
    of vertices in triangles.

    Edges and counts are ranged together and meet there, so that an edge is shuffled once."""
    rows = edges.select(F.col("src").alias("vid"), "dst", F.lit(None).cast("long").alias("t")).unionByName(found.select("vid", F.lit(None).cast("long").alias("dst"), "t"))
    ranged = rows.repartitionByRange(parts, "vid") if parts else rows.repartitionByRange("vid")
    lists = ranged.groupBy("vid").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"), F.coalesce(F.max("t"), F.lit(0)).alias("triangles"))
    out = lists.select("vid", "nbrs", F.size("nbrs").cast("long").alias("degree"), F.size(F.filter("nbrs", lambda x: x < F.col("vid"))).cast("long").alias("offset"), "triangles")
    out.sortWithinPartitions("vid").write.mode("overwrite").parquet(files.join(folder, "adjacency.parquet"))


def read_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of a stored graph."""
    return spark.read.parquet(files.join(folder, "adjacency.parquet")).select(F.col("vid").alias("src"), F.explode("nbrs").alias("dst"))
