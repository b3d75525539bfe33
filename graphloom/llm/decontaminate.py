"""Benchmark decontamination: containment search of short items inside long documents.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; shingles are ``width`` words
(an item with fewer words is one shingle of its own length).  Containment is the share of an item's distinct
shingles that a document holds; a pair counts at ``threshold`` or more.

Items are partitioned by size (powers of two of their shingles).  A partition with at most u shingles keeps,
of each item, the floor((1 - threshold) * u) + 1 smallest hashes (all if it has fewer): a document that holds
the threshold's share of an item misses too few of its shingles to miss all of these, so the sketch loses no
pair, however long the document is.  A symmetric MinHash signature would: an item of 40 shingles inside a
document of 20,000 has a Jaccard similarity of 0.002.  Documents look their shingles up in the sketches;
candidates are verified by all shingles' hashes first, then by exact shingles.

A benchmark of at most ``block_bytes`` of text (measured) is broadcast, and documents are read once.  A larger one
stays on the executors: its sketches are a table that documents' shingles meet in a join by hash, and only documents
and items that share one are brought together and verified, a pair at a time.

Defined cases: null or empty item texts match nothing, null or empty documents hold nothing; repeated item
ids are separate items, repeated document ids separate documents; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U
from .components import checkpointed

WIDTH, THRESHOLD = 5, 0.8
BLOCK_BYTES = 32 << 20
OUT = "doc_id long, item_id long, n_shared long, n_shingles long"
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _words(buf: np.ndarray, off: np.ndarray):
    part = K.LOWER[buf]
    return part, *K.word_spans(part, off, _APART)


def sketched(size: int, threshold: float) -> int:
    """How many smallest hashes an item of so many distinct shingles keeps, by the largest size in its partition."""
    return math.floor((1 - threshold) * (1 << (size - 1).bit_length()) + 1e-9) + 1


class Items:
    """Sketches and shingles of one block of items."""

    def __init__(self, ids: list, texts: list[str | None], width: int, threshold: float):
        self.width, self.threshold = width, threshold
        buf, off = K.string_buffer(pa.array(texts, pa.large_string()))
        part, s, e, wo = _words(buf, off)
        raw = part.tobytes()
        words = [[raw[a:b] for a, b in zip(s[x:y].tolist(), e[x:y].tolist())] for x, y in zip(wo[:-1], wo[1:])]
        h = K.hash_spans(part, s, e)
        self.ids, self.shingles, self.size = ids, [], []
        sketch: dict[int, list] = {}
        full: dict[int, list] = {}
        for i, w in enumerate(words):
            k = min(width, len(w))
            self.shingles.append({b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set())
            self.size.append(len(self.shingles[-1]))
            if not k:
                continue
            keys = np.unique(K.hash_windows(h, np.arange(wo[i], wo[i + 1] - k + 1), k))
            sketch.setdefault(k, []).append((keys[: sketched(len(keys), threshold)], i))
            full.setdefault(k, []).append((keys, i))
        flat = lambda t: {k: self._table(v) for k, v in t.items()}
        self.sketch, self.full = flat(sketch), flat(full)

    @staticmethod
    def _table(entries: list):
        """Ascending distinct hashes, the items of each, and a bitmap of their top 16 bits."""
        keys = np.concatenate([k for k, _ in entries])
        items = np.concatenate([np.full(len(k), i) for k, i in entries])
        order = np.argsort(keys, kind="stable")
        distinct, first, count = np.unique(keys[order], return_index=True, return_counts=True)
        bitmap = np.zeros(1 << 20, bool)
        bitmap[(distinct >> U(44)).astype(np.int64)] = True
        return distinct, first, count, items[order], bitmap

    @staticmethod
    def lookup(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h, item) of every hash that the table holds."""
        distinct, first, count, items, bitmap = table
        at = np.flatnonzero(bitmap[(h >> U(44)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(distinct, h[at]), len(distinct) - 1)
        hit = distinct[pos] == h[at]
        at, pos = at[hit], pos[hit]
        g, k = K.spread(count[pos])
        return at[g], items[first[pos][g] + k]

    def search(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of every pair at the threshold."""
        part, s, e, wo = _words(buf, off)
        n_words = np.diff(wo)
        if not len(s):
            return []
        words = K.hash_spans(part, s, e)
        out = []
        m = len(self.ids)
        for k in self.sketch:
            doc, j = K.spread(np.maximum(n_words - k + 1, 0))
            h = K.hash_windows(words, wo[doc] + j, k)
            at, item = self.lookup(self.sketch[k], h)
            pairs = np.unique(doc[at] * m + item)
            if not len(pairs):
                continue
            docs = np.unique(pairs // m)
            rows = np.flatnonzero(np.isin(doc, docs))
            at, item = self.lookup(self.full[k], h[rows])
            held = np.unique(np.stack([doc[rows[at]] * m + item, h[rows[at]].view(np.int64)]), axis=1)[0] if len(at) else np.zeros(0, np.int64)
            found, shared = np.unique(held, return_counts=True)
            size = np.array(self.size)[found % m]
            good = (shared >= self.threshold * size - 1e-9) & np.isin(found, pairs)
            raw, of, sets = None, -1, set()
            for p in found[good].tolist():
                d, i = divmod(p, m)
                if d != of:  # exact shingles of the document
                    raw = raw or part.tobytes()
                    w = [raw[a:b] for a, b in zip(s[wo[d] : wo[d + 1]].tolist(), e[wo[d] : wo[d + 1]].tolist())]
                    sets, of = {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)}, d
                exact = len(self.shingles[i] & sets)
                if exact >= self.threshold * self.size[i] - 1e-9:
                    out.append((d, i, exact))
        return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): each document and item that it contains."""
    if width < 1 or not 0 < threshold <= 1:
        raise ValueError("width must be positive and threshold in (0, 1]")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if size + 64 * count > block_bytes:
        return _joined(rows, items, width, threshold)
    part = items.orderBy("i", "t").collect()
    data = docs.sparkSession.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], width, threshold))

    def run(batches):
        table = data.value
        for batch in batches:
            buf, off = K.string_buffer(batch.column(1))
            for i, j in K.chunks(off):
                found = table.search(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                ids = batch.column(0).take(pa.array([i + d for d, _, _ in found], pa.int64()))
                cols = [[table.ids[k] for _, k, _ in found], [n for _, _, n in found], [table.size[k] for _, k, _ in found]]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return K.small_batches(rows).mapInArrow(K.tidy(run), OUT)


def _keys(batches, of):
    """(row, k, h) rows from (row, text) batches: of gives, for each text's words, the lengths and hashes to look up."""
    for batch in batches:
        buf, off = K.string_buffer(batch.column(1))
        for i, j in K.chunks(off):
            part, s, e, wo = _words(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            doc, k, h = of(K.hash_spans(part, s, e), wo)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + i)), pa.array(k, pa.int32()), pa.array(h.view(np.int64))], names=["row", "k", "h"])


def _joined(rows: DataFrame, items: DataFrame, width: int, threshold: float) -> DataFrame:
    """The same pairs where the benchmark is a table: nothing of it reaches the driver but the lengths of its shingles."""
    docs = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    items = checkpointed(items.withColumn("row", F.monotonically_increasing_id()))

    def sketch(words: np.ndarray, wo: np.ndarray):
        out = []
        for i in range(len(wo) - 1):
            k = min(width, int(wo[i + 1] - wo[i]))
            if k:
                keys = np.unique(K.hash_windows(words, np.arange(wo[i], wo[i + 1] - k + 1), k))
                keys = keys[: sketched(len(keys), threshold)]
                out.append((np.full(len(keys), i), np.full(len(keys), k), keys))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))

    known = checkpointed(K.small_batches(items.select("row", "t")).mapInArrow(K.tidy(lambda b: _keys(b, sketch)), "row long, k int, h long"))
    lengths = sorted(r[0] for r in known.select("k").distinct().collect())  # at most width of them

    def shingles(words: np.ndarray, wo: np.ndarray):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))]
        for k in lengths:
            doc, j = K.spread(np.maximum(np.diff(wo) - k + 1, 0))
            h = K.hash_windows(words, wo[doc] + j, k)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            out.append((doc[new], np.full(int(new.sum()), k), h[new]))
        return tuple(np.concatenate(x) for x in zip(*out))

    asked = K.small_batches(docs.select("row", "text")).mapInArrow(K.tidy(lambda b: _keys(b, shingles)), "row long, k int, h long")
    pairs = asked.join(known.select(F.col("row").alias("item"), "k", "h"), ["k", "h"]).select("row", "item").distinct()
    texts = pairs.join(items.select(F.col("row").alias("item"), "i", "t"), "item").join(docs, "row").select("doc_id", "i", "text", "t")

    def verify(batches):
        for batch in batches:
            found = []
            for n in range(batch.num_rows):
                table = Items([0], [batch.column(3)[n].as_py()], width, threshold)
                for _, _, shared in table.search(*K.string_buffer(batch.column(2)[n : n + 1])):
                    found.append((n, shared, table.size[0]))
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array([x[c] for x in found], pa.int64()) for c in (1, 2)]], names=["doc_id", "item_id", "n_shared", "n_shingles"])

    return K.small_batches(texts).mapInArrow(K.tidy(verify), OUT)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items)


SQL = r"""
WITH w AS (SELECT 'd' AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
t AS (SELECT kind, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM w),
i AS (SELECT r, id, least(5, len(w)) AS k, w FROM t WHERE kind = 'i' AND len(w) > 0),
si AS (SELECT DISTINCT r, id, k, array_to_string(w[j:j + k - 1], ' ') AS s FROM i, unnest(range(1, len(w) - k + 2)) AS u(j)),
n AS (SELECT r, count(*) AS n FROM si GROUP BY r),
sd AS (SELECT DISTINCT t.r, t.id, q.k, array_to_string(w[j:j + q.k - 1], ' ') AS s
       FROM t, (SELECT DISTINCT k FROM i) AS q, unnest(range(1, len(w) - q.k + 2)) AS u(j) WHERE kind = 'd')
SELECT sd.id AS doc_id, si.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_shingles
FROM si JOIN sd ON sd.s = si.s AND sd.k = si.k JOIN n ON n.r = si.r
GROUP BY sd.r, sd.id, si.r, si.id HAVING count(*) >= 0.8 * any_value(n.n)
"""
