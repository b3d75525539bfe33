"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``width``-word shingles joined by a space,
repeats included (fewer words: the whole sequence; none: fingerprint zero); a bit is one if it is set in
over half of the shingles' XXH64 (seed 42).  Whole batches are hashed at once, shingles of one length
together.

Links (``radius`` or fewer differing bits): distinct fingerprints are sorted by the population counts of
their four 16-bit quarters and cut into blocks; a task compares two blocks, tile by tile, with exclusive-or
and bit counts.  Two fingerprints differ in at least the sum of the differences of their quarters' counts,
so blocks and tiles whose ranges are further apart than the radius are skipped.  This is exact: no link is
lost.  A task reduces what it finds to one link per fingerprint (a forest), so a group of m near copies
costs m rows, not m * m.  Components are then found by ``components.components``.

The comparison is quadratic in the number of distinct fingerprints by its nature; equal texts and equal
fingerprints are one before it begins.

Defined cases: a null text has no words; null and repeated ids keep their rows (a component's id is its
smallest non-null one); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U
from .components import checkpointed, components

WIDTH, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a block, and blocks at most while they stay under MAX_BLOCK.
BLOCK, BLOCKS, MAX_BLOCK = 1 << 14, 64, 1 << 20
TILE_A, TILE_B = 64, 2048
_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of buf[s : s + length] for every start; buf is followed by 8 bytes at least."""
    word = K.loads(buf, 0, len(buf) - 7)
    p = start
    s = np.uint64(seed)
    if length >= 32:
        acc = [np.full(len(p), (int(s) + c) & (2**64 - 1), U) for c in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        at = 0
        while at + 32 <= length:
            for i in range(4):
                acc[i] = _rotl(acc[i] + word[p + (at + 8 * i)] * _P2, 31) * _P1
            at += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for v in acc:
            h = (h ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4
    else:
        at = 0
        h = np.full(len(p), (int(s) + int(_P5)) & (2**64 - 1), U)
    h += U(length)
    while at + 8 <= length:
        h = _rotl(h ^ (_rotl(word[p + at] * _P2, 31) * _P1), 27) * _P1 + _P4
        at += 8
    if at + 4 <= length:
        h = _rotl(h ^ ((word[p + at] & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at += 4
    while at < length:
        h = _rotl(h ^ (buf[p + at].astype(U) * _P5), 11) * _P1
        at += 1
    h ^= h >> U(33)
    h *= _P2
    h ^= h >> U(29)
    h *= _P3
    return h ^ (h >> U(32))


def shingle_hashes(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each document's shingles, and their number by document."""
    start, end, word_off = K.word_spans(buf, off)
    n_words = np.diff(word_off)
    # The words of the batch, each followed by one space.
    lens = end - start + 1
    g, k = K.spread(lens)
    src = start[g] + k
    joined = np.full(len(g) + 16, 0x20, np.uint8)
    real = k < lens[g] - 1
    joined[: len(g)][real] = K.LOWER[buf[src[real]]]
    at = np.cumsum(lens) - lens
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    doc, k = K.spread(n)
    first = word_off[doc] + k
    last = first + np.minimum(n_words[doc], width) - 1
    s = at[first]
    size = at[last] + lens[last] - 1 - s
    out = np.empty(len(s), U)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    raw = None
    for rows in np.split(order, cut):
        if not len(rows):
            continue
        length = int(size[rows[0]])
        if length > 512 and len(rows) < 64:  # few and long: the library is faster
            raw = raw if raw is not None else joined.tobytes()
            for r in rows.tolist():
                out[r] = xxhash.xxh64_intdigest(raw[s[r] : s[r] + length], SEED)
        else:
            out[rows] = xxh64(joined, s[rows], length)
    return out, n


_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], U)


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By document: the bits set in over half of its n hashes."""
    out = np.zeros(len(n), U)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begin = (np.cumsum(n) - n)[some]
    pieces = -(-n[some] // 255)  # byte lanes hold sums to 255
    g, k = K.spread(pieces)
    cut = begin[g] + 255 * k
    by_piece = np.cumsum(pieces) - pieces
    octets = h.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, b]], cut).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), by_piece, axis=0)
        bits = (2 * counts > n[some][:, None]) @ (1 << np.arange(8))
        out[some] |= bits.astype(U) << U(8 * b)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text, its 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            buf, off = K.string_buffer(batch.column(1))
            for i, j in K.chunks(off, 2 << 20):
                h, n = shingle_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(majority(h, n).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return K.small_batches(rows).mapInArrow(K.tidy(run), "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _gap(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least sum of differences of quarters' counts between boxes."""
    return np.maximum(np.maximum(lo_a - hi_b, lo_b - hi_a), 0).sum(axis=-1)


def _boxes(q: np.ndarray, size: int):
    at = np.arange(0, len(q), size)
    return np.minimum.reduceat(q, at), np.maximum.reduceat(q, at)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that join what lies within radius between a and b (b is a if same)."""
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    parent = np.arange(len(values))
    alo, ahi = _boxes(_quarters(a), TILE_A)
    blo, bhi = _boxes(_quarters(b), TILE_B)
    x = np.empty((TILE_A, TILE_B), U)
    c = np.empty((TILE_A, TILE_B), np.uint8)
    for i in range(len(alo)):
        left = a[i * TILE_A : (i + 1) * TILE_A]
        for j in np.flatnonzero(_gap(alo[i], ahi[i], blo, bhi) <= radius):
            if same and (j + 1) * TILE_B <= i * TILE_A:
                continue
            right = b[j * TILE_B : (j + 1) * TILE_B]
            xs, cs = x[: len(left), : len(right)], c[: len(left), : len(right)]
            np.bitwise_xor(left[:, None], right[None, :], out=xs)
            np.bitwise_count(xs, out=cs)
            near = np.flatnonzero(cs.ravel() <= radius)
            if not len(near):
                continue
            u, v = near // len(right) + i * TILE_A, near % len(right) + j * TILE_B + shift
            while len(u):
                ru, rv = parent[u], parent[v]
                open_ = ru != rv
                u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
                if len(u):
                    np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
                    parent = _roots(parent)
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return values[linked].view(np.int64), values[parent[linked]].view(np.int64)


def fingerprint_links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) links that connect exactly the distinct fingerprints (column fp) within radius."""
    n = max(1, min(BLOCKS, math.ceil(count / BLOCK)), math.ceil(count / MAX_BLOCK))
    q = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"q{i}") for i in range(4)]
    blocks = checkpointed(distinct.select("fp", *q).repartitionByRange(n, "q0", "q1", "q2", "q3", "fp").withColumn("block", F.spark_partition_id()))
    # Driver-side: one box per block, at most max(BLOCKS, count / MAX_BLOCK) of them.
    boxes = blocks.groupBy("block").agg(*[f(f"q{i}") for f in (F.min, F.max) for i in range(4)]).orderBy("block").collect()
    ids = [r[0] for r in boxes]
    lo = np.array([r[1:5] for r in boxes], np.int64).reshape(-1, 4)
    hi = np.array([r[5:9] for r in boxes], np.int64).reshape(-1, 4)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in i + np.flatnonzero(_gap(lo[i], hi[i], lo[i:], hi[i:]) <= radius)]
    spark = distinct.sparkSession
    todo = F.broadcast(spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(pairs)], "pair int, i int, j int"))
    left = blocks.join(todo, F.col("block") == F.col("i")).select("pair", "fp", *[f"q{i}" for i in range(4)])
    right = blocks.join(todo.where("i <> j"), F.col("block") == F.col("j"))
    right = right.select(*[F.col(c).alias(f"{c}_") for c in ("pair", "fp", "q0", "q1", "q2", "q3")])

    def values(table: pa.Table, tail: str = "") -> np.ndarray:
        fp = np.asarray(table[f"fp{tail}"]).astype(np.int64).view(U)
        return fp[np.lexsort((fp, *[np.asarray(table[f"q{i}{tail}"]) for i in (3, 2, 1, 0)]))]

    def compare(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        a, b = values(l), values(r, "_")
        u, v = forest(a, b if len(b) else a, radius, not len(b))
        return pa.table({"a": pa.array(u, pa.int64()), "b": pa.array(v, pa.int64())})

    tasks = max(1, len(pairs))
    return (
        left.repartition(tasks, "pair").groupBy("pair").cogroup(right.repartition(tasks, "pair_").groupBy("pair_")).applyInArrow(compare, "a long, b long")
    )


def simhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    prints = checkpointed(fingerprints(docs, doc_id, text, width))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = components(fingerprint_links(distinct, distinct.count(), radius))
    members = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    roots = members.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = members.join(roots, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_dedup(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
