"""Near copies by their shingles: all pairs of documents whose Jaccard similarity is at least ``threshold``.

Words as in ``simhash`` (A-Z lower-cased), shingles of ``width`` words (fewer words: the whole sequence), each
distinct one once.  A document without words has an empty set, which equals other empty ones only.

1. A document with n distinct shingles keeps, in one order for all documents, its first n - ceil(threshold n) + l(n),
   l(n) = 1 + floor(n / 16).  Two documents at the threshold share at least ceil(threshold n) shingles, n being the
   larger set's size, so by counting they share l(n) of those, n being the smaller one's: no pair is lost, whatever
   the order is.
2. In the order, shingles that are frequent in a sample of documents come last, the others by a hash.  The sample
   decides only how many candidates there are; it grows with the documents, so that a shingle's meetings do not.
3. FAMILY sets and more that agree in three of MINIMA smallest hashes, and what these chain to, are a family: many edited
   copies of one text, whose pairs grow with their square.  (One hash is not enough: a passage that many texts hold would
   join them all.)  A family's sets are all compared with each other, in
   blocks (``compared``); a task gives back a forest, so pairs are never rows.
4. The shingles kept go to hash ranges as packed arrays, equal sets once a batch of texts; sets of different families that
   meet in l(n) shingles and whose sizes allow the threshold are candidates, given back some PAIRS at a time.
5. Candidates are bounded by bitmaps of their shingles (8 bits and more a shingle): a bit that one set has and the other
   has not is a shingle that they do not share.  Those that this does not rule out are verified by all of their
   shingles' 64-bit hashes.

Every pair is of one family and compared, or of two and a candidate: families decide only where a pair is judged.
Equal sets are one before that.  Work in a family grows with the square of its distinct sets, rows by one copy of a set
a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U
from .components import checkpointed, components
from .simhash import _roots

WIDTH, THRESHOLD = 5, 0.8
#: Documents sampled for frequent shingles (and one of how many, if that is more), occurrences there that make one
#: frequent, and frequent ones at most.
SAMPLE, ONE_OF, FREQUENT, MOST = 4000, 64, 3, 1 << 20
#: Smallest hashes of a set, and sets with the same three that make a family.
MINIMA, FAMILY = 5, 32
BANDS = comb(MINIMA, 3)
#: Sets and shingles in a block of a family, and sets that have a shingle from which on it is a column of a matrix.
BLOCK_SETS, BLOCK_SHINGLES, DENSE, COLUMNS = 1024, 1 << 19, 16, 1024
#: Keys of candidates are broadcast up to this number, so that texts do not move.
BROADCAST = 1_000_000
#: Pairs of one numpy step: some 400 bytes each.
PAIRS = 1 << 18
_ORDER, _SUM = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles' hashes by document, in the common order (late: ascending hashes that come last), their
    number by document, and a key of each set."""
    part = K.LOWER[buf]
    s, e, wo = K.word_spans(part, off)
    n_words = np.diff(wo)
    words = K.hash_spans(part, s, e) if len(s) else np.zeros(0, U)
    docs, hashes = [], []
    for k in range(1, width + 1):
        n = np.where(n_words == k, 1, 0) if k < width else np.maximum(n_words - width + 1, 0)
        doc, j = K.spread(n)
        if len(doc):
            docs.append(doc)
            hashes.append(K.hash_windows(words, wo[doc] + j, k))
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    last = np.zeros(len(h), np.int64)
    if len(late) and len(h):
        last = (late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h).astype(np.int64)
    order = np.lexsort((K.mix(h ^ _ORDER), 2 * doc + last))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    n = np.bincount(doc, minlength=len(n_words))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(K.mix(h + _SUM), dtype=U)])
    end = np.cumsum(n)
    return h, n, K.mix((sums[end] - sums[end - n]) ^ (n.astype(U) * _ORDER))


def _least(n: np.ndarray) -> np.ndarray:
    """In how many of the kept shingles sets meet at least, the smaller one having n."""
    return 1 + n // 16


def _first(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many shingles of a set of n a document keeps."""
    return np.where(n > 0, np.minimum(n, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + _least(n)), 0)


def _meetings(h: np.ndarray, key: np.ndarray, n: np.ndarray, family: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """(a, b, shared, least): pairs of distinct sets of different families that share hashes and whose sizes allow the
    threshold, how many hashes, and how many they must share over all parts. A pair may come more than once, to be added;
    what is held is bounded by PAIRS."""
    order = np.lexsort((key, family, h))
    h, key, n, family = h[order], key[order], n[order], family[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])]) if len(h) else np.zeros(0, bool)
    h, key, n, family = h[new], key[new], n[new], family[new]
    apart = h[1:] != h[:-1]

    def stop(edge):  # the end of each entry's run
        at = np.flatnonzero(np.concatenate([[True], edge])) if len(h) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(h)))
        return np.repeat(at + size, size)

    # An entry meets those of its shingle that are behind its family.
    begin = stop(apart | (family[1:] != family[:-1]))
    behind = stop(apart) - begin
    rows = np.flatnonzero(behind)
    held, size = [], 0
    for a, k in _steps(rows, behind[rows]):
        b = begin[a] + k
        good = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
        a, b = a[good], b[good]
        x, y = key[a].view(np.int64), key[b].view(np.int64)
        held.append(_summed(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(a), np.int64), _least(np.minimum(n[a], n[b]))])))
        size += held[-1].shape[1]
        if size >= PAIRS:
            yield _summed(np.concatenate(held, axis=1))
            held, size = [], 0
    if size:
        yield _summed(np.concatenate(held, axis=1))


def _steps(rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row as often as its count, and the place among them, at most PAIRS at a time (and those of one row's rest)."""
    while len(rows):
        total = np.cumsum(counts)
        j = max(1, int(np.searchsorted(total, PAIRS, side="right")))
        g, k = K.spread(counts[:j])
        for i in range(0, len(g), PAIRS):
            yield rows[:j][g[i : i + PAIRS]], k[i : i + PAIRS]
        rows, counts = rows[j:], counts[j:]


def compared(h: np.ndarray, n: np.ndarray, left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (set, set) that connect what is at the threshold between the first left sets and the others (all sets, if
    left is all of them), which have n of the hashes h each, one set after another.

    Shared shingles are counted as a product of matrices, those of few sets pair by pair."""
    m = len(n)
    right = 0 if left == m else left
    row = np.repeat(np.arange(m), n)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = np.zeros((left, m - right), np.float32)
    dense = np.flatnonzero(count >= DENSE)
    for i in range(0, len(dense), COLUMNS):
        at = np.full(len(count), -1, np.int64)
        at[dense[i : i + COLUMNS]] = np.arange(len(dense[i : i + COLUMNS]))
        some = np.flatnonzero(at[column] >= 0)
        matrix = np.zeros((m, min(COLUMNS, len(dense) - i)), np.float32)
        matrix[row[some], at[column[some]]] = 1
        shared += matrix[:left] @ matrix[right:].T
    rest = np.flatnonzero((count[column] >= 2) & (count[column] < DENSE))
    rest = rest[np.argsort(column[rest], kind="stable")]  # rows ascend within a column
    c, r = column[rest], row[rest]
    behind = np.searchsorted(c, c, side="right") - np.arange(len(c)) - 1
    for a, k in _steps(np.flatnonzero(behind), behind[behind > 0]):
        x, y = r[a], r[a + 1 + k]
        if right:
            x, y = x[(x < left) & (y >= left)], y[(x < left) & (y >= left)]
        shared += np.bincount(x * shared.shape[1] + y - right, minlength=shared.size).reshape(shared.shape)
    shared = shared.astype(np.float64)
    good = shared >= threshold * (n[:left, None] + n[None, right:] - shared) - 1e-9
    x, y = np.nonzero(good)
    x, y = x[x < y + right], y[x < y + right] + right
    parent = np.arange(m)
    while len(x):
        px, py = parent[x], parent[y]
        open_ = px != py
        x, y, px, py = x[open_], y[open_], px[open_], py[open_]
        if len(x):
            np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
            parent = _roots(parent)
    linked = np.flatnonzero(parent != np.arange(m))
    return linked, parent[linked]


def _summed(t: np.ndarray) -> np.ndarray:
    """One column a pair, its shared hashes added."""
    if not t.shape[1]:
        return t
    t = t[:, np.lexsort((t[1], t[0]))]
    at = np.flatnonzero(np.concatenate([[True], (t[0, 1:] != t[0, :-1]) | (t[1, 1:] != t[1, :-1])]))
    return np.stack([t[0, at], t[1, at], np.add.reduceat(t[2], at), t[3, at]])


def minima(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each set that is not empty a row: a hash of each three of its MINIMA smallest hashes."""
    begin = (np.cumsum(n) - n)[n > 0]
    if not len(begin):
        return np.zeros((0, BANDS), U)
    low = [np.minimum.reduceat(h * U((0xD6E8FEB86659FD93 * (2 * i + 3)) & (2**64 - 1)), begin) for i in range(MINIMA)]
    return np.stack([K.mix(K.mix(low[i] ^ _SUM) + K.mix(low[j] ^ _ORDER) * _ORDER + low[k]) for i, j, k in combinations(range(MINIMA), 3)], axis=1)


def bitmap(h: np.ndarray) -> bytes:
    """A bit for each value of the hashes' last digits; sizes are powers of two, so that a larger one folds to a smaller."""
    out = np.zeros(max(64, 8 << max(len(h) - 1, 0).bit_length()), bool)
    out[(h & U(len(out) - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def most_shared(x: bytes, y: bytes, n_x: int, n_y: int) -> int:
    """An upper bound of how many shingles two sets share, by their bitmaps and sizes."""
    a, b = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (x, y))
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] | a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] | b[len(b) // 2 :]
    return int(min(n_x - (a > b).sum(), n_y - (b > a).sum()))


def near_copies(docs: DataFrame, key: str, text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(key, group) of every row: group is the smallest key reachable over pairs at the threshold. Keys are distinct longs."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    none = np.zeros(0, U)

    def each(late, out):
        def run(batches):
            hot = late.value if late is not None else none
            for batch in batches:
                buf, off = K.string_buffer(batch.column(1))
                for i, j in K.chunks(off):
                    yield from out(batch.column(0)[i:j], *shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width, hot))

        return K.tidy(run)

    def hashes(_, h, n, of):
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rate = min(1.0, max(SAMPLE / max(total[0], 1), 1 / ONE_OF))
    some = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30))))
    found = K.small_batches(some).mapInArrow(each(None, hashes), "h long").groupBy("h").count().where(F.col("count") >= FREQUENT)
    # Driver-side: at most MOST hashes.
    frequent = found.orderBy(F.desc("count"), "h").limit(MOST).select("h").toArrow()["h"]
    late = sc.broadcast(np.sort(np.asarray(frequent).astype(np.int64).view(U)))

    def keys(rows_, h, n, of):
        low = pa.ListArray.from_arrays(pa.array(BANDS * np.concatenate([[0], np.cumsum(n > 0)]), pa.int32()), pa.array(minima(h, n).view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([rows_, pa.array(of.view(np.int64)), pa.array(n, pa.int64()), low], names=["key", "of", "n", "low"])

    sets = checkpointed(K.small_batches(rows).mapInArrow(each(late, keys), "key long, of long, n long, low array<long>"))
    parts = K.buckets_of(total[1] or 0)
    family = checkpointed(_families(sets))
    members = sets.join(family, "of").select("key", "family")
    some_family = family.count()
    known = rows.join(F.broadcast(members) if sets.join(family, "of", "left_semi").count() <= BROADCAST else members, "key", "left") if some_family else rows.withColumn("family", F.lit(None).cast("long"))
    known = known.select("key", "text", F.coalesce("family", F.lit(0)).alias("family"))

    def send(batches):
        held: dict[int, list] = {}
        size = 0
        hot = late.value

        def out():
            for p, entries in sorted(held.items()):
                h, of, n, of_family = (np.concatenate([x[k] for x in entries]) for k in range(4))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([K.squeeze(h.tobytes() + of.tobytes() + n.tobytes() + of_family.tobytes())], pa.binary())], names=["part", "body"])

        for batch in batches:
            buf, off = K.string_buffer(batch.column(1))
            for i, j in K.chunks(off):
                h, n, of = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width, hot)
                _, once = np.unique(of, return_index=True)
                g, k = K.spread(_first(n[once], threshold))
                if not len(g):
                    continue
                h, of, n, of_family = h[(np.cumsum(n) - n)[once][g] + k], of[once][g], n[once][g], np.asarray(batch.column(2))[i:j][once][g]
                to = K.part_of(h, parts)
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.diff(to[order])) + 1
                for at in np.split(order, cut):
                    held.setdefault(int(to[at[0]]), []).append((h[at], of[at], n[at], of_family[at]))
                size += len(h)
            if size > K.BUCKET_BYTES // 4:
                yield from out()
                held, size = {}, 0
        yield from out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, of, n, of_family = np.concatenate([np.frombuffer(K.unsqueeze(x), U).reshape(4, -1) for batch in batches for x in batch["body"].to_pylist()], axis=1)
        for found in _meetings(h, of, n.view(np.int64), np.where(of_family == 0, of, of_family), threshold):
            for i in range(0, found.shape[1], PAIRS // 2):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + PAIRS // 2]) for x in found], names=["a", "b", "shared", "least"])

    kept = K.small_batches(known).mapInArrow(K.tidy(send), "part int, body binary").repartition(parts, "part")
    met = kept.groupBy("part").applyInArrow(meet, "a long, b long, shared long, least long")
    pairs = checkpointed(met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("least").alias("least")).where("shared >= least").select("a", "b"))

    def chosen(ends: DataFrame) -> DataFrame:
        """(key, text) of one document of every set in ends."""
        one = checkpointed(sets.join(ends, "of", "left_semi").groupBy("of").agg(F.min("key").alias("key")).select("key"))
        return rows.join(F.broadcast(one) if one.count() <= BROADCAST else one, "key", "left_semi").select("key", "text")

    def of_sets(pairs: DataFrame, make) -> DataFrame:
        """The pairs, with what make gives for the sets of both: (n, body) as (n_a, x) and (n_b, y)."""

        def each_set(rows_, h, n, of):
            end = np.cumsum(n)
            bodies = [make(h[i:j]) for i, j in zip((end - n).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(n, pa.int64()), pa.array(bodies, pa.binary())], names=["of", "n", "body"])

        ends = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
        bodies = K.small_batches(chosen(ends)).mapInArrow(each(late, each_set), "of long, n long, body binary")
        left, right = (bodies.select(F.col("of").alias(s), F.col("n").alias(f"n_{s}"), F.col("body").alias(t)) for s, t in (("a", "x"), ("b", "y")))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "x", "n_b", "y")

    def in_families() -> DataFrame:
        """Links that connect what is at the threshold within the families."""

        def whole(rows_, h, n, of):
            end = np.cumsum(n)
            bodies = [h[i:j].tobytes() for i, j in zip((end - n).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(bodies, pa.binary())], names=["of", "body"])

        def compare(table: pa.Table) -> pa.Table:
            table = table.sort_by("mine")
            of, mine = np.asarray(table["of"]), np.asarray(table["mine"])
            bodies = [np.frombuffer(x.as_buffer(), U) for x in table["body"]]
            a, b = compared(np.concatenate(bodies), np.array([len(x) for x in bodies]), int((mine == mine[0]).sum()), threshold)
            return pa.table({"a": pa.array(of[a]), "b": pa.array(of[b])})

        one = sets.join(family, "of").groupBy("family", "of").agg(F.first("n").alias("n"))
        blocks = one.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        of_block = checkpointed(one.join(blocks, "family").select("family", "of", "blocks", F.pmod(F.xxhash64("of"), "blocks").cast("int").alias("mine")))
        bodies = K.small_batches(chosen(of_block.select("of"))).mapInArrow(each(late, whole), "of long, body binary")
        # A block meets itself and every other one.
        sent = bodies.join(of_block, "of").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.select("family", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "of", "body")
        return sent.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")

    def keep(test):
        def run(batches):
            for batch in batches:
                good = [test(x.as_buffer(), y.as_buffer(), n, m) for n, x, m, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5))]
                yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

        return K.tidy(run)

    def near(shared: int, n: int, m: int) -> bool:
        return shared >= threshold * (n + m - shared) - 1e-9

    def verified(x, y, n, m) -> bool:
        return near(len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)), n, m)

    possible = checkpointed(K.small_batches(of_sets(pairs, bitmap)).mapInArrow(keep(lambda x, y, n, m: near(most_shared(x, y, n, m), n, m)), "a long, b long"))
    links = K.small_batches(of_sets(possible, lambda h: h.tobytes())).mapInArrow(keep(verified), "a long, b long")
    if some_family:
        links = links.unionByName(in_families())
    found = components(links)
    rooted = sets.join(found, sets["of"] == found["node"], "left").select("key", F.coalesce("root", "of").alias("root"))
    low = rooted.groupBy("root").agg(F.min("key").alias("group"))
    return rooted.join(low, "root").select("key", "group")


def _families(sets: DataFrame) -> DataFrame:
    """(of, family) of the sets that are in a family; a family is never 0."""
    low = sets.select("of", "low").distinct().select("of", F.posexplode("low").alias("i", "low"))
    hot = low.groupBy("i", "low").agg(F.count("*").alias("sets"), F.min("of").alias("first")).where(F.col("sets") >= FAMILY)
    found = components(low.join(hot.drop("sets"), ["i", "low"]).select(F.col("of").alias("a"), F.col("first").alias("b")))
    return found.select(F.col("node").alias("of"), F.when(F.col("root") == 0, 1).otherwise(F.col("root")).alias("family"))
