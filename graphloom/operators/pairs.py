"""Pairs of neighbours that meet at a vertex, without moving the pairs: squares and triangles.

Vertices are in blocks by a hash of their ids.  A task has a pair of blocks and receives, of each vertex's list, the
neighbours in one block and those in the other.  What it has to know of a pair of vertices (how often they meet, whether they
are adjacent) is then complete in it.  An element of a list is moved once a block, while its pairs, as many as the list
is long, are made in memory only, some at a time.  Blocks grow in number with the edges, so that a task's lists are bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directed edges that a task cuts up, elements of lists that a pair of blocks has, and pairs made at once.
CUT, ELEMENTS, PAIRS = 1 << 20, 3 << 24, 1 << 22
#: Blocks that a graph has for parallelism only.
LEAST_BLOCKS = 4

_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PIECES = "key int, w binary, left binary, n_left binary, right binary, n_right binary, edges binary"


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _MIX >> _HALF) % np.uint64(blocks)).astype(np.int64)


def _pack(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << _HALF | low.astype(np.uint64)


def _cut(blocks: int, triangles: bool):
    """Edges of whole lists in, pieces of the lists by pair of blocks out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [_pack(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not sum(map(len, codes)):
            return
        code = np.sort(np.concatenate(codes))
        del codes
        w, x = (code >> _HALF).astype(np.uint32), (code & _LOW).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        row, below, at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w)))), x < w, _block(x, blocks)
        owners = w[first]

        def piece(key: int, **parts: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array([key], pa.int32())] + [pa.array([parts[n].tobytes() if n in parts else None], pa.binary()) for n in ("w", "left", "n_left", "right", "n_right", "edges")]
            return pa.RecordBatch.from_arrays(cols, ["key", "w", "left", "n_left", "right", "n_right", "edges"])

        def lists(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return x[chosen], row[chosen], np.bincount(row[chosen], minlength=len(first)).astype(np.uint32)

        rights = [lists((at == j) & below if triangles else at == j) for j in range(blocks)]
        for i in range(blocks):
            left, left_row, n_left = lists((at == i) & below)
            for j, (right, right_row, n_right) in enumerate(rights):
                both = (n_left > 0) & (n_right > 0)
                if both.any():
                    named = {"w": owners[both]} if triangles else {}
                    yield piece(i * blocks + j, left=left[both[left_row]], n_left=n_left[both], right=right[both[right_row]], n_right=n_right[both], **named)
        if triangles:
            up = ~below
            key = _block(w[up], blocks) * blocks + at[up]
            order = np.argsort(key, kind="stable")
            code, key = code[up][order], key[order]
            for k in np.unique(key):
                yield piece(int(k), edges=code[np.searchsorted(key, k) : np.searchsorted(key, k, "right")])

    return run


def _pieces(edges: DataFrame, n: int, blocks: int, triangles: bool) -> DataFrame:
    lists = edges.select("src", "dst").repartition(max(1, -(-n // CUT)), "src")
    return lists.mapInArrow(_cut(blocks, triangles), _PIECES).repartitionById(blocks * blocks, F.col("key"))


def _together(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {n: [] for n in names}
    for b in batches:
        for n in names:
            parts[n] += [np.frombuffer(v.as_py(), np.uint64 if n == "edges" else np.uint32) for v in b.column(b.schema.get_field_index(n)) if v.is_valid]
    return {n: np.concatenate(parts.pop(n)) if parts[n] else np.zeros(0, np.uint64 if n == "edges" else np.uint32) for n in names}


def _crossed(row: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry of row with each element of that row's list: places in row, and places of the elements."""
    times = n[row].astype(np.int64)
    which = np.repeat(np.arange(len(row)), times)
    return which, np.arange(len(which)) + np.repeat(start[row] - (np.cumsum(times) - times), times)


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = _together(batches, ("left", "n_left", "right", "n_right"))
    right, n = p["right"], p["n_right"]
    start = np.cumsum(n, dtype=np.int64) - n
    # By the smallest vertex: its squares are complete in a run of the lists that it is in.
    code = np.sort(_pack(p.pop("left"), np.repeat(np.arange(len(n)), p.pop("n_left"))))
    small, row = code >> _HALF, (code & _LOW).astype(np.int64)
    del code
    ends = np.append(np.flatnonzero(small[1:] != small[:-1]) + 1, len(small)) if len(small) else np.zeros(0, np.int64)
    made = np.cumsum(n[row], dtype=np.int64)
    at = total = 0
    while at < len(small):
        reach = np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, "right")
        k = np.searchsorted(ends, reach, "right")
        end = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[np.searchsorted(ends, at, "right")])
        which, place = _crossed(row[at:end], start, n)
        v, u = small[at:end][which], right[place].astype(np.uint64)
        fit = u > v
        pair = np.sort(v[fit] << _HALF | u[fit])
        if len(pair):
            bounds = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            c = np.diff(bounds)
            total += int((c * (c - 1) // 2).sum())
        at = end
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])


def _member(codes: np.ndarray):
    """Whether codes are in a set: a table of hashes first, then a search."""
    known = np.sort(codes)
    bits = min(26, max(10, int(8 * len(known)).bit_length()))
    down, table = np.uint64(64 - bits), np.zeros(1 << bits, bool)
    table[known * _MIX >> down] = True

    def test(x: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(table[x * _MIX >> down])
        place = np.searchsorted(known, x[may])
        place[place == len(known)] = 0
        return may[known[place] == x[may]]

    return test


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p = _together(batches, ("w", "left", "n_left", "right", "n_right", "edges"))
    if not len(p["left"]) or not len(p["edges"]):
        return
    test, left, right, n = _member(p.pop("edges")), p["left"], p["right"], p["n_right"]
    start = np.cumsum(n, dtype=np.int64) - n
    row = np.repeat(np.arange(len(n)), p.pop("n_left"))
    made = np.cumsum(n[row], dtype=np.int64)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, "right")))
        which, place = _crossed(row[at:end], start, n)
        c, b = left[at:end][which], right[place]
        fit = np.flatnonzero(b > c)
        found = fit[test(_pack(c[fit], b[fit]))]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int64)) for y in (p["w"][row[at:end][which[found]]], b[found], c[found])], ["a", "b", "c"])
        at = end


def blocks_of(elements: int) -> int:
    return max(-(-elements // ELEMENTS), min(LEAST_BLOCKS, -(-elements // (1 << 20))), 1)


def squares(edges: DataFrame, n: int, blocks: int | None = None) -> DataFrame:
    """(n): numbers of squares that add up to all, each counted at its smallest vertex; edges are n directed ones.

    Ids are to fall with degree, if there are hubs: a list then meets its few neighbours of smaller ids only."""
    blocks = blocks or blocks_of(3 * n // 2)
    return _pieces(edges, n, blocks, False).mapInArrow(_squares, "n long")


def triangles(edges: DataFrame, n: int, blocks: int | None = None) -> DataFrame:
    """(a, b, c), a > b > c, of every triangle once, found at its largest vertex; ids as for squares."""
    blocks = blocks or blocks_of(n)
    return _pieces(edges, n, blocks, True).mapInArrow(_triangles, "a long, b long, c long")
