"""Substring deduplication of word sequences by level-wise doubling.

A word goes when a window of ``window`` consecutive words that covers it also starts in a document with
a smaller id.  Windows are judged on the input.  The levels double from ``first`` words, the last one clipped to
``window`` (4, 8 and 13 words by default): a window can only repeat if the shorter windows in it do, so only
windows repeated at one length are extended to twice that length.

* First level: every window of ``first`` words is looked up, a distinct one once a bucket.
* Each middle level looks up the windows whose two halves the level before found repeated; a level without
  candidates sends nothing, and neither do those after it.
* The last level exchanges each bucket's distinct windows for their smallest id, by 96 bits of two independent hashes
  of the words.

Defined cases: null text = no words (nothing removed, ``kept`` empty); null id = larger than every other
id; rows that repeat an id count as one document; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as K
from .blocks import U

WINDOW, FIRST = 13, 4
OUT = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"


def levels_of(window: int, first: int = FIRST) -> list[int]:
    """Doubling lengths from first to the window itself."""
    levels = [min(first, window)]
    while levels[-1] < window:
        levels.append(min(2 * levels[-1], window))
    return levels


class _Bucket:
    """The words of one bucket and the windows that survived the levels answered so far."""

    def __init__(self, table: pa.Table, levels: list[int]):
        self.ids, self.buf, self.off = K.unpack(table)
        self.levels = levels
        spans, hashes, counts = [], [], []
        for i, j in K.chunks(self.off):
            a, b = int(self.off[i]), int(self.off[j])
            s, e, wo = K.word_spans(self.buf[a:b], self.off[i : j + 1] - a)
            hashes.append(K.hash_spans(self.buf[a:b], s, e))
            spans.append((s + a, e + a))
            counts.append(np.diff(wo))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.start, self.end = join([x[0] for x in spans], np.int64), join([x[1] for x in spans], np.int64)
        self.words, self.n_words = join(hashes, U), join(counts, np.int64)
        self.word_off = np.concatenate([[0], np.cumsum(self.n_words)])

    def second(self, rows: np.ndarray) -> np.ndarray:
        """Other hashes of some words, independent of the first ones."""
        a, b = self.start[rows], self.end[rows]
        lens = b - a
        g, k = K.spread(lens)
        end = np.cumsum(lens)
        return K.hash_spans(self.buf[a[g] + k], end - lens, end, 1)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and document of each window of the given width."""
        doc, k = K.spread(np.maximum(self.n_words - width + 1, 0))
        return self.word_off[doc] + k, doc

    def alive(self, answers: list[pa.Table], parts: int) -> np.ndarray:
        """By word: whether a window of the level after the answered ones that starts there has only repeated parts."""
        out = np.ones(len(self.words), bool)
        for level, answer in enumerate(answers):
            at, _, h = self.asked(out, self.levels[level])
            keys, inverse = np.unique(h, return_inverse=True)
            out = np.zeros(len(out), bool)
            if len(keys):
                out[at[K.read_repeated(keys, answer, parts)[inverse]]] = True
            if level + 1 < len(self.levels):
                step = self.levels[level + 1] - self.levels[level]
                stop = max(0, len(out) - step)
                out[:stop] &= out[len(out) - stop :]
                out[stop:] = False
        return out

    def asked(self, alive: np.ndarray, width: int):
        at, doc = self.windows(width)
        live = alive[at]
        at, doc = at[live], doc[live]
        return at, doc, K.hash_windows(self.words, at, width)

    def distinct(self, alive: np.ndarray):
        """Windows of the last level: first word, document, and which of the distinct ones each is; of those, in the order
        of their hashes, both hashes and the smallest id."""
        width = self.levels[-1]
        at, doc, key = self.asked(alive, width)
        # Words of the windows left, one after another: few of all.
        used = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(used, at, 1)
        np.add.at(used, np.minimum(at + width, len(self.words)), -1)
        rows = np.flatnonzero(np.cumsum(used[:-1]))
        more = (K.hash_windows(self.second(rows), np.searchsorted(rows, at), width) >> U(32)).astype(np.uint32)
        order = np.lexsort((more, key))
        sk, sm = key[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (sk[1:] != sk[:-1]) | (sm[1:] != sm[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(self.ids[doc[order]], first) if len(first) else np.zeros(0, np.int64)
        return at, doc, which, sk[first], sm[first], low


def _request(table, to, bodies) -> pa.Table:
    return K.rows_of(to, [table["bucket"][0].as_py()] * len(to), bodies, ("part", "bucket"))


def _smallest(requests: DataFrame, parts: int) -> DataFrame:
    """Answers (key, 32 more bits, smallest id) requests by the smallest id over all buckets."""

    def run(table: pa.Table) -> pa.Table:
        asked = [K.apart(x) for x in table["body"].to_pylist()]
        key = [K.unsqueeze_keys(x) for x, *_ in asked]
        sizes = [len(x) for x in key]
        key = np.concatenate(key)
        low = np.concatenate([K.unsqueeze_planes(x, np.int64) for _, x, _ in asked])
        more = np.concatenate([K.unsqueeze_planes(x, np.uint32) for *_, x in asked])
        order = np.lexsort((more, key))
        sk, sm = key[order], more[order]
        at = np.flatnonzero(np.concatenate([[True], (sk[1:] != sk[:-1]) | (sm[1:] != sm[:-1])]))
        out = np.empty(len(key), np.int64)
        out[order] = np.repeat(np.minimum.reduceat(low[order], at), np.diff(np.concatenate([at, [len(sk)]])))
        bodies = [K.squeeze_planes(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
        return K.rows_of(table["bucket"].to_pylist(), table["part"].to_pylist(), bodies, ("bucket", "part"))

    return requests.repartition(parts, "part").groupBy("part").applyInArrow(run, K.REPLY)


def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, first: int = FIRST, buckets: int | None = None,
    parts: int | None = None, bucket_bytes: int = K.BUCKET_BYTES,
) -> DataFrame:
    """One row per row of docs: word counts, the kept words joined by a space, and their hash.

    buckets, parts: numbers of text buckets and of hash ranges, from the corpus' size and bucket_bytes unless given."""
    if window < 1 or first < 1:
        raise ValueError("window and first must be positive")
    n = buckets or K.buckets_of(K.corpus_bytes(docs, text), bucket_bytes)
    m = parts or n
    ids = K.Ids(docs, doc_id)
    packed = K.pack(docs, n, ids, doc_id, text, bucket_bytes=bucket_bytes)
    levels = levels_of(window, first)

    def of_level(replies: pa.Table, level: int) -> pa.Table:
        part = np.asarray(replies["part"])
        mine = replies.filter(pa.array(part // m == level))
        return mine.set_column(mine.schema.get_field_index("part"), "part", pa.array(np.asarray(mine["part"]) % m, pa.int32()))

    def request(table: pa.Table, answers: list[pa.Table]) -> pa.Table:
        b = _Bucket(table, levels)
        _, doc, h = b.asked(b.alive(answers, m), levels[len(answers)])
        _, to, bodies = K.ask_repeated(h, b.ids[doc], m)
        return _request(table, to, bodies)

    def extend(level: int):
        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return K.rows_of([], [], [], ("part", "bucket"))
            return request(table, [of_level(replies, x) for x in range(level)])

        return run

    last = len(levels) - 1
    replies = None
    for level in range(last):
        if replies is None:
            asked = packed.groupBy("bucket").applyInArrow(lambda table: request(table, []), K.REQUEST)
        else:
            asked = packed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(extend(level), K.REQUEST)
        found = K.repeated(asked, m).selectExpr("bucket", f"CAST(part + {level * m} AS INT) AS part", "body")
        replies = found if replies is None else replies.unionByName(found)

    def answered(replies: pa.Table | None) -> list[pa.Table]:
        return [of_level(replies, x) for x in range(last)]

    def send(table: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        if not table.num_rows:
            return K.rows_of([], [], [], ("part", "bucket"))
        b = _Bucket(table, levels)
        *_, key, more, low = b.distinct(b.alive(answered(replies), m))
        to, bodies = [], []
        for p, x, y in K.cut_by_part(key, m):
            to.append(p)
            bodies.append(K.together(K.squeeze_keys(key[x:y]), K.squeeze_planes(low[x:y]), K.squeeze_planes(more[x:y])))
        return _request(table, to, bodies)

    by_bucket = packed.groupBy("bucket")
    sent = by_bucket.applyInArrow(lambda table: send(table), K.REQUEST) if replies is None else by_bucket.cogroup(replies.groupBy("bucket")).applyInArrow(send, K.REQUEST)
    owners = _smallest(sent, m).selectExpr("bucket", f"CAST(part + {last * m} AS INT) AS part", "body")
    everything = owners if replies is None else replies.unionByName(owners)

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _digest(None, None, ids)
        b = _Bucket(table, levels)
        at, doc, which, key, *_ = b.distinct(b.alive(answered(replies), m))
        by = dict(zip(*(of_level(replies, last)[c].to_pylist() for c in ("part", "body"))))
        low = np.concatenate([np.zeros(0, np.int64)] + [K.unsqueeze_planes(by[p], np.int64) for p, _, _ in K.cut_by_part(key, m)])
        where = at[low[which] < b.ids[doc]]
        edge = np.zeros(len(b.words) + 1, np.int32)
        np.add.at(edge, where, 1)
        np.add.at(edge, where + window, -1)
        return _digest(b, np.cumsum(edge[:-1]) > 0, ids)

    return packed.groupBy("bucket").cogroup(everything.groupBy("bucket")).applyInArrow(cover, OUT)


def _digest(b: _Bucket | None, gone: np.ndarray | None, ids: K.Ids) -> pa.Table:
    kept, removed = [], np.zeros(0, np.int64)
    if b is not None:
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[b.word_off])
        for i, j in K.chunks(b.off):
            w = np.arange(b.word_off[i], b.word_off[j])[~gone[b.word_off[i] : b.word_off[j]]]
            lens = b.end[w] - b.start[w] + 1  # with the space after it
            g, k = K.spread(lens)
            out = np.full(len(g), 0x20, np.uint8)
            real = k < lens[g] - 1
            out[real] = b.buf[(b.start[w][g] + k)[real]]
            edges = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(w, b.word_off[i : j + 1])]
            raw = out.tobytes()
            kept += [raw[x : max(x, y - 1)] for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return pa.table({
        "doc_id": ids.back(b.ids) if b else pa.array([], pa.int64()), "n_words": pa.array(b.n_words if b else [], pa.int64()),
        "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
    })


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT r, k, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
v AS (SELECT d.r, d.k, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT s, min(k) AS low FROM v GROUP BY s),
hit AS (SELECT v.r, v.i FROM v JOIN m USING (s) WHERE m.low < v.k),
c AS (SELECT b.r, b.i, b.word, max(hit.i) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM b LEFT JOIN hit ON hit.r = b.r AND hit.i = b.i),
a AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
