"""Vectorised text primitives and the bucketed exchange that the text operators share.

Texts travel as *buckets*: rows ``(bucket, ids, lens, body)`` whose body is the compressed concatenation
of the UTF-8 texts.  A bucket is the unit of work of every later step; its size is bounded by
``bucket_bytes`` (one longer text makes a longer bucket), so that a task's memory does not depend on
how many rows share a source, a key or a passage.

A question about the whole corpus ("which of my hashes occur elsewhere?") is asked by a *request*
``(part, bucket, body)``: a bucket's distinct keys in ascending order, cut into hash ranges.  A part
answers all buckets at once, and its *reply* lists values in the order of the request, so keys never
travel back.  Each bucket sends a key once however often it holds it: this is the pre-aggregation that
keeps hot keys small (a key reaches a part at most once per bucket).

Nulls: a null text is empty, a null id sorts after all others and comes back as null (``Ids``).
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
NO_ID = np.iinfo(np.int64).max
PACKED = "bucket int, ids binary, lens binary, body binary"
REQUEST = "part int, bucket int, body binary"
REPLY = "bucket int, part int, body binary"
#: Bytes of text in one bucket. 4 MB suits Python workers of about 200 MB; on executors with more
#: memory larger buckets mean fewer, larger shuffle blocks.
BUCKET_BYTES = 4 << 20
#: Bytes of texts that a task sorts into buckets at once.
HELD_BYTES = 12 << 20
#: Bounds of one Arrow batch.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def few_arenas() -> None:
    """Threads of this process share two heaps instead of having one each."""
    if _libc is not None:
        _libc.mallopt(-8, 2)


def trim() -> None:
    """Returns what earlier work of this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def tidy(run):
    """A function over Arrow batches that leaves no freed memory behind when its task ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches between the JVM and Python by bytes (their default bound is in rows, and ten
    thousand long texts are a lot). A setting that the session already has below the bound stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        have = conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            conf.set(key, str(most))
    return df


def kept_names(keep: tuple[str, ...], schema: str) -> list[str]:
    """Names of columns to keep beside an operator's own (of its schema): those that clash have _kept behind them."""
    own = {f.split()[0].lower() for f in schema.split(", ")}
    return [f"{c}_kept" if c.lower() in own else c for c in keep]


def squeeze(data: bytes | np.ndarray) -> bytes:
    raw = data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def squeeze_planes(values: np.ndarray) -> bytes:
    """Integers, a byte plane after another: those of the high bytes are mostly zero."""
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T))


def unsqueeze_planes(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return squeeze_planes(np.diff(keys, prepend=U(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze_planes(data, U), dtype=U)


def together(*parts: bytes) -> bytes:
    """Byte strings in one, each after its length."""
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def apart(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    x ^= x >> U(30)
    x *= _C2
    x ^= x >> U(27)
    x *= _C3
    x ^= x >> U(31)
    return x


def string_buffer(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.zeros(0, np.uint8)
    return buf, off - off[0]


def loads(buf: np.ndarray, at: int, n: int) -> np.ndarray:
    """Little-endian 8-byte words at offsets at .. at + n - 1 (buf is padded by the caller)."""
    return np.ndarray(n, U, buffer=buf.data, offset=at, strides=(1,))


def slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over each window of the given width."""
    if len(a) < width:
        return a[:0]
    k = 1
    while 2 * k <= width:
        a = f(a[: len(a) - k], a[k:])
        k *= 2
    if k < width:
        a = f(a[: len(a) - (width - k)], a[width - k :])
    return a


def chunks(off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about limit bytes, so that temporary arrays stay in cache."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1))
        yield i, j
        i = j


#: Longer byte spans are hashed one by one by the library.
LONG_SPAN = 256
_SHORT = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: a chain of mixed 8-byte words.

    Each step is a bijection of what came before and not linear, so no pair of texts collides for every seed (a
    polynomial modulo 2**64 has such pairs)."""
    n = np.asarray(end - start, np.int64)
    add = U(0xD6E8FEB86659FD93 * (2 * seed + 1) & (2**64 - 1))
    h = mix(n.astype(U) * _C1 + add)
    if not len(h) or not len(buf):
        return h
    word = loads(np.concatenate([buf, np.zeros(8, np.uint8)]), 0, len(buf))
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at = start[live]
    left = n[live]
    while len(live):
        h[live] = mix((h[live] ^ (word[at] & _SHORT[np.minimum(left, 8)])) + add)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    long = np.flatnonzero(n > LONG_SPAN)
    if len(long):
        h[long] = [xxhash.xxh3_64_intdigest(buf[a:b].data, int(add)) for a, b in zip(start[long].tolist(), end[long].tolist())]
    return h


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * _C1) ^ b)


def hash_windows(values: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of width consecutive values from each start: hashes of half the length, joined."""
    h = slide(values, width, _joined)
    return mix(h[start] + np.full(1, width, U) * _C2) if len(start) else np.zeros(0, U)


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n + 1 offsets into them by document. Words do not cross documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~space[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = off[:-1][off[:-1] < off[1:]]
    first[starts] |= word[starts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends = starts[starts > 0] - 1
    last[ends] |= word[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off).astype(np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each element and its place in the group."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


class Ids:
    """Ids as longs in their order, a null after all others, for the ids of one table.

    A null takes the largest long. Where the table has that id too, the ids above some number that no row has move down
    by one to make room. The driver sees a minimum, a maximum and whether there are nulls."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id"):
        ids = docs.select(F.col(doc_id).cast("long").alias("i"))
        low, high, self.nulls = ids.agg(F.min("i"), F.max("i"), F.count_if(F.col("i").isNull()) > 0).first()
        self.unused: int | None = None
        if self.nulls and high == NO_ID:
            self.unused = low - 1 if low > -NO_ID - 1 else ids.where(F.col("i") < NO_ID).select((F.col("i") + 1).alias("i")).join(ids.distinct(), "i", "left_anti").agg(F.min("i")).first()[0]

    def read(self, col) -> np.ndarray:
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        if not len(col):
            return np.zeros(0, np.int64)
        out = np.asarray(col.cast(pa.int64()).fill_null(NO_ID))
        return np.where((out > self.unused) & np.asarray(col.is_valid()), out - 1, out) if self.unused is not None else out

    def back(self, ids: np.ndarray) -> pa.Array:
        none = ids == NO_ID if self.nulls else np.zeros(len(ids), bool)
        return pa.array(np.where((ids >= self.unused) & ~none, ids + 1, ids) if self.unused is not None else ids, pa.int64(), mask=none)


def corpus_bytes(docs: DataFrame, text: str = "text") -> int:
    """About the bytes of the texts. It only chooses numbers of buckets, so the sizes of the files that docs is read from
    do (twice, as they are compressed); where docs comes from elsewhere, texts are measured."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return 2 * total if total < 1 << 60 else docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def buckets_of(total: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(6, math.ceil(total / bucket_bytes))


def _stream(tables: list) -> bytes:
    sink = pa.BufferOutputStream()
    whole = pa.Table.from_batches(tables).combine_chunks()
    with pa.ipc.new_stream(sink, whole.schema) as out:
        out.write_table(whole)
    return sink.getvalue().to_pybytes()


def carried(table: pa.Table) -> pa.Table:
    """The columns that travelled with a bucket's texts, in the order of unpack."""
    return pa.concat_tables([pa.ipc.open_stream(unsqueeze(x)).read_all() for x in table["extra"].to_pylist()])


def pack(docs: DataFrame, buckets: int, ids_: Ids, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of docs as packed buckets, exchanged by bucket: the one shuffle of the texts.

    A row's bucket is a hash of the whole row and of its task: rows without an id and rows that repeat one spread, of
    equal rows a bucket gets one task's, and a task that runs again puts the same rows into the same buckets whatever
    order it reads them in.  carry: further columns that travel with them (carried)."""

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        task = np.full(1, TaskContext.get().partitionId(), U) * _C2

        def out():
            for b, parts in sorted(held.items()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32())]
                    + [pa.array([x], pa.binary()) for x in (
                        np.concatenate([p[0] for p in parts]).tobytes(),
                        np.concatenate([p[1] for p in parts]).tobytes(),
                        squeeze(np.concatenate([p[2] for p in parts])),
                        *([squeeze(_stream([p[3] for p in parts]))] if carry else []),
                    )],
                    names=["bucket", "ids", "lens", "body", "extra"][: 5 if carry else 4],
                )

        for batch in batches:
            buf, off = string_buffer(batch.column(1))
            ids, lens = ids_.read(batch.column(0)), np.diff(off)
            h = np.asarray(batch.column(2)).astype(np.int64)  # of the row
            to = (mix(mix(h.view(U) + _C1) + task) >> U(33)) % U(buckets)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.diff(to[order])) + 1
            for rows in np.split(order, cut):
                if len(rows):
                    g, k = spread(lens[rows])
                    held.setdefault(int(to[rows[0]]), []).append((ids[rows], lens[rows], buf[off[rows][g] + k], batch.select(range(3, 3 + len(carry))).take(pa.array(rows)) if carry else None))
            size += len(buf)
            if size > HELD_BYTES:
                yield from out()
                held, size = {}, 0
        yield from out()

    types = dict(docs.dtypes)
    whole = F.xxhash64(*[F.col(c) for c in dict.fromkeys((doc_id, text, *carry)) if "map<" not in types[c] and types[c] != "variant"])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), whole.alias("row"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    return small_batches(rows).mapInArrow(tidy(run), PACKED + ", extra binary" * bool(carry)).repartition(buckets, "bucket")


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of one bucket."""
    ids = [np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()]
    lens = [np.frombuffer(x, np.int64) for x in table["lens"].to_pylist()]
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ids, lens = np.concatenate(ids), np.concatenate(lens)
    buf = np.frombuffer(b"".join(unsqueeze(x) for x in table["body"].to_pylist()), np.uint8)
    return ids, buf, np.concatenate([[0], np.cumsum(lens)])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each 64-bit key; it does not decrease as the key grows."""
    return ((keys >> U(32)) * U(parts)) >> U(32)


def cut_by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of ascending keys."""
    p = part_of(keys, parts).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield int(p[a]), int(a), int(b)


def rows_of(a: list, b: list, bodies: list, names: tuple[str, str]) -> pa.Table:
    return pa.table({names[0]: pa.array(a, pa.int32()), names[1]: pa.array(b, pa.int32()), "body": pa.array(bodies, pa.binary())})


def repeated(requests: DataFrame, parts: int) -> DataFrame:
    """Answers requests of (key u64, in-more-than-one-document flag u8) arrays: a bit for each key, set
    when the key has the flag or comes from two buckets."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        asked = [apart(x) for x in table["body"].to_pylist()]
        keys = [unsqueeze_keys(k) for k, _ in asked]
        sizes = [len(x) for x in keys]
        keys = np.concatenate(keys)
        flag = np.concatenate([np.unpackbits(np.frombuffer(unsqueeze(f), np.uint8), count=n) for (_, f), n in zip(asked, sizes)])
        order = np.argsort(keys, kind="stable")
        sk = keys[order]
        new = np.concatenate([[True], sk[1:] != sk[:-1]])
        at = np.flatnonzero(new)
        many = (np.diff(np.concatenate([at, [len(sk)]])) > 1) | (np.maximum.reduceat(flag[order], at) > 0)
        found = np.empty(len(keys), bool)
        found[order] = np.repeat(many, np.diff(np.concatenate([at, [len(sk)]])))
        cut = np.cumsum(sizes)[:-1]
        bodies = [np.packbits(x).tobytes() for x in np.split(found, cut)]
        return rows_of(table["bucket"].to_pylist(), [part] * len(bodies), bodies, ("bucket", "part"))

    return requests.repartition(parts, "part").groupBy("part").applyInArrow(run, REPLY)


def ask_repeated(keys: np.ndarray, docs: np.ndarray, parts: int) -> tuple[np.ndarray, list, list]:
    """Distinct ascending keys of a bucket, and the parts and bodies of its request."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    if not len(at):
        return k, [], []
    flag = (np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)).astype(np.uint8)
    k = k[at]
    to, bodies = [], []
    for p, a, b in cut_by_part(k, parts):
        to.append(p)
        bodies.append(together(squeeze_keys(k[a:b]), squeeze(np.packbits(flag[a:b]))))
    return k, to, bodies


def read_repeated(keys: np.ndarray, replies: pa.Table, parts: int) -> np.ndarray:
    """The reply's bits, in the order of the bucket's distinct ascending keys."""
    by = dict(zip(replies["part"].to_pylist(), replies["body"].to_pylist()))
    found = np.zeros(len(keys), bool)
    for p, a, b in cut_by_part(keys, parts):
        found[a:b] = np.unpackbits(np.frombuffer(by[p], np.uint8), count=b - a)
    return found


def beside(table: pa.Table, extra: pa.Table | None, names: tuple[str, ...]) -> pa.Table:
    """table with the carried columns beside its own (nulls where there are none)."""
    for i, name in enumerate(names):
        table = table.append_column(name, extra.column(i) if extra is not None else pa.nulls(table.num_rows))
    return table
