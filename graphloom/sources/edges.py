"""Edge tables from text, arrays and tables. All come out as (src, dst): both directions, once, no loops."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def once(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b), a < b: each edge once. Loops and rows with a null end are dropped."""
    p = pairs.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src <> dst")
    return p.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def both(edges: DataFrame) -> DataFrame:
    """(src, dst): both directions of (a, b)."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def normalised(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Loops dropped, both directions, each once. Rows with a null end are dropped."""
    # Once an edge before both directions: half the rows are shuffled.
    return both(once(pairs, src, dst))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) as written: two whitespace-separated ids a line, more columns ignored; empty lines and lines
    that begin with # skipped.  Lines have no order here, so a line that cannot be read raises an error (the
    query fails) instead of ending the input."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("line")).where("line <> '' AND NOT line LIKE '#%'")
    part = F.split("line", " ")
    ids = lines.select(F.get(part, F.lit(0)).try_cast("long").alias("src"), F.get(part, F.lit(1)).try_cast("long").alias("dst"), "line")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("line"))).cast("long")
    fine = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") >= 0) & (F.col("dst") >= 0)
    return ids.select(F.when(fine, F.col("src")).otherwise(bad).alias("src"), F.when(fine, F.col("dst")).otherwise(bad).alias("dst"))


def check_csr(indptr: Sequence[int], indices: Sequence[int], offsets: Sequence[int] | None = None, triangles: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The arrays as int64, or ValueError naming the broken rule."""
    arrays = []
    for name, a in (("indptr", indptr), ("indices", indices), ("offsets", offsets), ("triangles", triangles)):
        a = None if a is None else np.asarray(a)
        if a is not None and a.ndim != 1:
            raise ValueError(f"{name} must have one dimension")
        arrays.append(None if a is None else a.astype(np.int64))
    ptr, idx, off, tri = arrays
    if len(ptr) < 2:
        raise ValueError("indptr needs at least two entries")
    if ptr[0] != 0 or ptr[-1] != len(idx):
        raise ValueError("indptr must begin with 0 and end with the number of indices")
    if (np.diff(ptr) < 0).any():
        raise ValueError("indptr must not decrease")
    n = len(ptr) - 1
    for name, a in (("offsets", off), ("triangles", tri)):
        if a is not None and len(a) != n:
            raise ValueError(f"{name} needs one entry a vertex")
    if off is not None and ((off < 0) | (off > np.diff(ptr))).any():
        raise ValueError("an offset exceeds its degree")
    owner = np.repeat(np.arange(n), np.diff(ptr))
    if ((idx < 0) | (idx >= n)).any():
        raise ValueError("a neighbour is out of range")
    if (owner == idx).any():
        raise ValueError("self loops are not allowed")
    same = owner[1:] == owner[:-1]
    if (same & (idx[1:] < idx[:-1])).any():
        raise ValueError("neighbours must be sorted")
    if (same & (idx[1:] == idx[:-1])).any():
        raise ValueError("neighbours must not repeat")
    if not np.array_equal(np.sort(owner * n + idx), np.sort(idx * n + owner)):
        raise ValueError("an edge has no reverse edge")
    if tri is not None and tri.sum() % 6:
        raise ValueError("the triangle counts must add up to a multiple of 6")
    return ptr, idx


def from_csr(spark: SparkSession, indptr: Sequence[int], indices: Sequence[int], offsets: Sequence[int] | None = None, triangles: Sequence[int] | None = None) -> DataFrame:
    ptr, idx = check_csr(indptr, indices, offsets, triangles)
    return spark.createDataFrame(pd.DataFrame({"src": np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), "dst": idx}), "src long, dst long")
