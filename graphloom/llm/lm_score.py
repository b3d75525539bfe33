"""Stupid-backoff scores of documents under the n-gram counts of the corpus.

The count tables hold (n-gram hash, count) and are partitioned by ranges of the hash.  Each bucket explodes its
documents' n-grams, counts the distinct ones, and sends (hash, count) to the partitions; these sum over all buckets
and join the sums to each bucket's n-grams, in the order in which it sent them.  The bucket sums log scores by
document.  Tables and n-grams travel as arrays and not as rows of a DataFrame: a row takes some 13 bytes of shuffle
where an array's entry takes 6, and rows would be shuffled twice (README).

    S(w | h) = c(hw) / c(h)       if c(hw) > 0
             = alpha * S(w | h')  otherwise, h' being h without its first word
    S(w)     = c(w) / N           if c(w) > 0, alpha / N otherwise

With ``leave_one_out`` a document's own n-grams and words are not counted in c and N, so that what occurs in no other
document backs off; without, c counts the whole corpus, in which every n-gram of a document is seen, so that only
``min_count`` (which asks for as many instead of one) makes scores back off.  Words are ``[^\\x20\\x09-\\x0D]+``
after lower-casing A-Z.  At a document's start the history is as long as it can be, without a penalty.

Defined cases: a null or empty text has no words, ``log_score`` 0 and a null ``mean_log_score``; an N of zero (one
document, left out) counts as one; rows that repeat a text count each time and are documents of their own; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U

ORDER, ALPHA = 3, 0.4
#: Bytes of text in a bucket. The larger it is, the fewer distinct n-grams a byte has.
BUCKET_BYTES = 16 << 20
OUT = "doc_id long, n_words long, log_score double, mean_log_score double"


def _grams(table: pa.Table, order: int):
    """ids, words by document, and for each length k the hashes of the k-grams that end at each word (0
    where the document has fewer words before it)."""
    ids, buf, off = K.unpack(table)
    words, counts = [], []
    for i, j in K.chunks(off):
        part = K.LOWER[buf[off[i] : off[j]]]
        s, e, wo = K.word_spans(part, off[i : j + 1] - off[i])
        words.append(K.hash_spans(part, s, e))
        counts.append(np.diff(wo))
    words = np.concatenate(words) if words else np.zeros(0, U)
    n_words = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    _, place = K.spread(n_words)
    grams = [words]
    for k in range(2, order + 1):
        h = np.zeros(len(words), U)
        at = np.flatnonzero(place >= k - 1)
        if len(at):
            h[at] = K.hash_windows(words, at - k + 1, k) + U(k)
        grams.append(h)
    return ids, n_words, place, grams


def _distinct(h: np.ndarray, there: np.ndarray):
    return np.unique(h[there], return_inverse=True, return_counts=True)


def count_words(docs: DataFrame, text: str = "text") -> int:
    """Words of the corpus: one aggregate."""

    def run(batches):
        for batch in batches:
            buf, off = K.string_buffer(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(K.word_spans(buf[off[i] : off[j]], off[i : j + 1] - off[i])[2][-1]) for i, j in K.chunks(off))], pa.int64())], names=["n"])

    rows = K.small_batches(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(run, "n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def lm_score(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, leave_one_out: bool = True, min_count: int = 1,
    buckets: int | None = None, parts: int | None = None, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of docs: words, sum of log scores (natural), and their mean.

    buckets, parts: numbers of text buckets and of hash ranges, from the corpus' size and bucket_bytes unless given."""
    if order < 1 or not 0 < alpha <= 1 or min_count < 1:
        raise ValueError("order and min_count must be positive and alpha in (0, 1]")
    size = K.corpus_bytes(docs, text)
    n, m = buckets or K.buckets_of(size, bucket_bytes), parts or K.buckets_of(size)
    words = count_words(docs, text)
    code = K.Ids(docs, doc_id)
    packed = K.pack(docs, n, code, doc_id, text, bucket_bytes=bucket_bytes)

    def ask(table: pa.Table) -> pa.Table:
        _, _, place, grams = _grams(table, order)
        to, bodies, bucket = [], [], table["bucket"][0].as_py()
        for k, h in enumerate(grams, 1):
            keys, _, counts = _distinct(h, place >= k - 1)
            for p, a, b in K.cut_by_part(keys, m):
                to.append(p * order + k - 1)
                bodies.append(K.together(K.squeeze_keys(keys[a:b]), K.squeeze_planes(counts[a:b].astype(np.uint32))))
        return K.rows_of(to, [bucket] * len(to), bodies, ("part", "bucket"))

    def total(table: pa.Table) -> pa.Table:
        """The count table of one range and length, joined to the n-grams asked for: counts in other buckets."""
        asked = [K.apart(x) for x in table["body"].to_pylist()]
        keys = [K.unsqueeze_keys(x) for x, _ in asked]
        sizes = [len(x) for x in keys]
        keys = np.concatenate(keys)
        counts = np.concatenate([K.unsqueeze_planes(x, np.uint32) for _, x in asked]).astype(np.int64)
        by_key = np.argsort(keys, kind="stable")
        sk = keys[by_key]
        at = np.flatnonzero(np.concatenate([[True], sk[1:] != sk[:-1]]))
        sums = np.empty(len(keys), np.int64)
        sums[by_key] = np.repeat(np.add.reduceat(counts[by_key], at), np.diff(np.concatenate([at, [len(sk)]])))
        bodies = [K.squeeze_planes(x.astype(np.uint32)) for x in np.split(sums - counts, np.cumsum(sizes)[:-1])]
        return K.rows_of(table["bucket"].to_pylist(), table["part"].to_pylist(), bodies, ("bucket", "part"))

    requests = packed.groupBy("bucket").applyInArrow(ask, K.REQUEST)
    replies = requests.repartition(m, "part").groupBy("part").applyInArrow(total, K.REPLY)

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "mean_log_score": pa.array([], pa.float64())})
        ids, n_words, place, grams = _grams(table, order)
        doc = np.repeat(np.arange(len(n_words)), n_words)
        by = dict(zip(replies["part"].to_pylist(), replies["body"].to_pylist()))
        counts = []
        for k, h in enumerate(grams, 1):
            there = place >= k - 1
            keys, which, here = _distinct(h, there)
            sums = here + np.concatenate([np.zeros(0, np.int64)] + [K.unsqueeze_planes(by[p * order + k - 1], np.uint32) for p, _, _ in K.cut_by_part(keys, m)])
            c = np.zeros(len(h), np.int64)
            c[there] = sums[which]
            if leave_one_out and len(keys):
                _, pair, own = np.unique(doc[there] * len(keys) + which, return_inverse=True, return_counts=True)
                c[there] -= own[pair]
            counts.append(c)
        # What c(h) is at the position of a history: of the same document's view.
        whole = np.log(np.maximum(words - (n_words if leave_one_out else 0), 1).astype(np.float64) * np.ones(len(n_words)))[doc]
        value = np.where(counts[0] >= min_count, np.log(np.maximum(counts[0], 1)), np.log(alpha)) - whole if len(doc) else np.zeros(0)
        for k in range(2, order + 1):
            there = np.flatnonzero(place >= k - 1)
            seen = counts[k - 1][there] >= min_count
            value[there[~seen]] += np.log(alpha)
            hit = there[seen]
            value[hit] = np.log(counts[k - 1][hit] / counts[k - 2][hit - 1])
        sums = np.zeros(len(n_words))
        some = np.flatnonzero(n_words)
        if len(some):
            sums[some] = np.add.reduceat(value, (np.cumsum(n_words) - n_words)[some])
        return pa.table({
            "doc_id": code.back(ids), "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(sums, pa.float64()),
            "mean_log_score": pa.array(sums / np.maximum(n_words, 1), pa.float64(), mask=n_words == 0),
        })

    return packed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(score, OUT)


def op9_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_score(docs).select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d),
p AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS t FROM b),
o1 AS (SELECT r, w, count(*) AS c FROM p GROUP BY r, w),
o2 AS (SELECT r, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY r, v, w),
o3 AS (SELECT r, t, v, w, count(*) AS c FROM p WHERE t IS NOT NULL GROUP BY r, t, v, w),
e1 AS (SELECT r, w, sum(c) OVER (PARTITION BY w) - c AS c FROM o1),
e2 AS (SELECT r, v, w, sum(c) OVER (PARTITION BY v, w) - c AS c FROM o2),
e3 AS (SELECT r, t, v, w, sum(c) OVER (PARTITION BY t, v, w) - c AS c FROM o3),
n AS (SELECT d.r, greatest((SELECT count(*) FROM b) - len(w), 1) AS n FROM d),
s AS (SELECT p.r, ln(CASE WHEN e3.c > 0 THEN e3.c / h2.c ELSE CASE WHEN p.t IS NULL THEN 1::DOUBLE ELSE 0.4::DOUBLE END *
                     CASE WHEN e2.c > 0 THEN e2.c / h1.c ELSE CASE WHEN p.v IS NULL THEN 1::DOUBLE ELSE 0.4::DOUBLE END *
                     CASE WHEN e1.c > 0 THEN e1.c::DOUBLE ELSE 0.4::DOUBLE END / n.n END END) AS x
      FROM p JOIN n ON n.r = p.r JOIN e1 ON e1.r = p.r AND e1.w = p.w
      LEFT JOIN e2 ON e2.r = p.r AND e2.v = p.v AND e2.w = p.w LEFT JOIN e3 ON e3.r = p.r AND e3.t = p.t AND e3.v = p.v AND e3.w = p.w
      LEFT JOIN e1 AS h1 ON h1.r = p.r AND h1.w = p.v LEFT JOIN e2 AS h2 ON h2.r = p.r AND h2.v = p.t AND h2.w = p.v),
a AS (SELECT r, sum(x) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x, 0), 3) AS log_score, round(x / len(w), 5) AS mean_log_score
FROM d LEFT JOIN a USING (r)
"""
