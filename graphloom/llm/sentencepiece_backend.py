"""SentencePiece encoding and decoding by the tokenizers library.

The model file is parsed here (protobuf wire format); normaliser, metaspace marker, pieces with their
scores, and byte fallback are rebuilt as a ``tokenizers.Tokenizer``: a unigram model keeps its scores, a BPE
model's merges follow from them (all pairs of pieces that join into a piece, best score first).  Batches
are encoded and decoded by the library's threads.

Where no piece holds the marker after another character (checked when the model is read), no merge crosses a
word boundary, so a text's ids are those of its marked words; distinct words of ``TEXT_BYTES`` of texts are then
encoded and decoded once, and texts are put together from them.  Parity with the sentencepiece library is verified
on every distinct word (whole texts otherwise) and reported by row.

Defined cases: null text = empty = no ids, decoded to an empty text; a literal marker character decodes to
a space, as in SentencePiece; null and repeated ids keep their rows.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text that are encoded together.
TEXT_BYTES = 2 << 20
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


class Model:
    """What a model file says: pieces, and the settings that encoding needs."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for k, v in _fields(data):
            if k == 1:
                f = dict(_fields(v))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                normalizer = dict(_fields(v))
        self.unigram = trainer.get(3, 1) == 1
        if trainer.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normalizer.get(2, b"")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        if trainer.get(24, 0) or not normalizer.get(5, 1):
            raise ValueError("suffix markers and unescaped spaces are not supported")
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        #: No piece has a marker after another character: words can be encoded one by one.
        self.by_word = not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind == NORMAL)


def build(model: Model):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.unigram:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk, byte_fallback=model.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        merges = sorted(
            (-score, vocab[p[:i]], vocab[p[i:]], p[:i], p[i:])
            for p, score, kind in model.pieces if kind == NORMAL
            for i in range(1, len(p)) if p[:i] in vocab and p[i:] in vocab
        )
        core = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=model.pieces[model.unk][0], byte_fallback=model.byte_fallback, fuse_unk=True)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
    t.normalizer = normalizers.Sequence(steps)
    if model.by_word:
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * model.dummy_prefix)
    return t


class Codec:
    """One task's encoder and decoder."""

    #: Bytes of distinct words that are encoded as one string, and strings of one batch.
    JOINED, GROUP = 1 << 15, 8

    def __init__(self, data: bytes, verify: bool = True, spec: str | None = None):
        import sentencepiece
        from tokenizers import Tokenizer

        self.model = Model(data)
        self.tokenizer = Tokenizer.from_str(spec) if spec else build(self.model)
        self.words = Tokenizer(self.tokenizer.model)  # the same model, for words that are already marked
        if self.tokenizer.pre_tokenizer is not None:
            self.words.pre_tokenizer = self.tokenizer.pre_tokenizer
        plain = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        bytes_known = self.model.byte_fallback and sum(kind == BYTE for *_, kind in self.model.pieces) == 256
        self.by_word = self.model.by_word and plain and bytes_known
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data) if verify else None
        #: Bytes of text that a token stands for, the marker being a space.
        self.size = np.array([1 if kind == BYTE else len(p.replace(MARK, " ").encode()) for p, _, kind in self.model.pieces], np.int64)

    def encode(self, texts: pa.Array, decode: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
        """All ids, their number by text, whether they are SentencePiece's own, and the ids turned back."""
        if not self.by_word:
            rows = [x or "" for x in texts.to_pylist()]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
            same = [a == b for a, b in zip(ids, self.reference.encode(rows, num_threads=1))] if self.reference else [True] * len(ids)
            back = pa.array(self.decode(ids), pa.large_string()) if decode else None
            return np.concatenate([np.zeros(0, np.int32), *[np.array(x, np.int32) for x in ids]]), np.array([len(x) for x in ids], np.int64), np.array(same, bool), back
        buf, off = self._led(texts)
        space = buf == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(first)
        cut = np.searchsorted(start, off)  # words before each text
        # A text's words are exactly its pieces between starts, so Arrow finds the distinct ones without copying any.
        every = _binary(np.append(start, len(buf)), buf).dictionary_encode()
        codes = np.asarray(every.indices).astype(np.int64)
        ids, n, good, words = self._distinct(every.dictionary, decode)
        begin = np.cumsum(n) - n
        g, k = K.spread(n[codes])
        flat = ids[begin[codes][g] + k] if len(g) else np.zeros(0, np.int32)
        tokens = np.concatenate([[0], np.cumsum(n[codes])])[cut]
        bad = np.concatenate([[0], np.cumsum(~good[codes])])[cut]
        back = None
        if decode:
            out, at = K.string_buffer(words.take(pa.array(codes)))
            edge = at[cut]
            keep = np.ones(len(out), bool)
            keep[edge[:-1][edge[:-1] < edge[1:]]] = False  # the space in front of each text
            back = _binary(edge - np.concatenate([[0], np.cumsum(edge[:-1] < edge[1:])]), out[keep]).cast(pa.large_string())
        return flat, np.diff(tokens), np.diff(bad) == 0, back

    @staticmethod
    def _led(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes with a space before each that is not empty; a literal marker is a space."""
        buf, off = K.string_buffer(texts)
        mark = np.frombuffer(MARK.encode(), np.uint8)
        if len(buf) > 2:
            at = np.flatnonzero((buf[:-2] == mark[0]) & (buf[1:-1] == mark[1]) & (buf[2:] == mark[2]))
            if len(at):
                buf, keep = buf.copy(), np.ones(len(buf), bool)
                buf[at] = 0x20
                keep[at + 1] = keep[at + 2] = False
                buf, off = buf[keep], np.concatenate([[0], np.cumsum(keep)])[off]
        some = off[:-1] < off[1:]
        led = off + np.concatenate([[0], np.cumsum(some)])
        out = np.full(int(led[-1]), 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[led[:-1][some]] = False
        out[keep] = buf
        return out, led

    def _distinct(self, words: pa.Array, decode: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Ids of distinct words one after another, their number, parity by word, and the decoded words.

        Words are joined and encoded some thousands at a time: a token never crosses a word, and the bytes that tokens
        stand for tell which word each belongs to.  Where a joined string differs from SentencePiece, or is not
        decoded to itself, its words go one by one.  So do words of spaces only, which joining would change."""
        buf, off = K.string_buffer(words)
        m = len(off) - 1
        full = np.concatenate([[0], np.cumsum(buf != 0x20)])[off]
        solid = np.diff(full) > 0
        order = np.concatenate([np.flatnonzero(solid), np.flatnonzero(~solid)])
        lens = np.diff(off)[order]
        raw = K.string_buffer(words.take(pa.array(order)))[0].tobytes()
        end = np.cumsum(lens)
        begin = end - lens
        solids = int(solid.sum())
        cut = np.unique(np.concatenate([np.searchsorted(begin[:solids], np.arange(0, begin[solids - 1] + 1, self.JOINED)), [solids]])) if solids else np.zeros(1, np.int64)
        spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        ids, numbers, good, odd, alone = [], [], np.ones(m, bool), {}, list(range(solids, m))
        for i in range(0, len(spans), self.GROUP):
            some = spans[i : i + self.GROUP]
            joined = [raw[begin[a] : end[b - 1]].decode() for a, b in some]
            found = [np.array(e.ids, np.int32) for e in self.words.encode_batch_fast([x.replace(" ", MARK) for x in joined], add_special_tokens=False)]
            want = self.reference.encode([x[1:] for x in joined], num_threads=1) if self.reference else [None] * len(joined)
            back = self.decode([x.tolist() for x in found]) if decode else [x[1:] for x in joined]
            for (a, b), text, x, y, z in zip(some, joined, found, want, back):
                upto = np.cumsum(self.size[x])
                tokens = np.searchsorted(upto, end[a:b] - begin[a], side="right")
                whole = len(upto) and upto[-1] == end[b - 1] - begin[a] and np.array_equal(upto[tokens - 1], end[a:b] - begin[a])
                if whole and z == text[1:] and (y is None or np.array_equal(x, np.array(y, np.int32))):
                    ids.append(x)
                    numbers.append(np.diff(np.concatenate([[0], tokens])))
                else:
                    self._one_by_one(range(a, b), raw, begin, end, ids, numbers, good, odd, decode)
        self._one_by_one(alone, raw, begin, end, ids, numbers, good, odd, decode)
        # Back to the order of the words.
        n = np.concatenate([np.zeros(0, np.int64), *numbers])
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        g, k = K.spread(n[place])
        flat = flat[(np.cumsum(n) - n)[place][g] + k] if len(g) else flat
        if odd:
            column = words.to_pylist()
            for i, x in odd.items():
                column[order[i]] = x
            words = pa.array(column, pa.large_binary())
        return flat, n[place], good[place], words

    def _one_by_one(self, rows, raw, begin, end, ids, numbers, good, odd, decode: bool) -> None:
        words = [raw[begin[i] : end[i]].decode() for i in rows]
        found = [e.ids for e in self.words.encode_batch_fast([x.replace(" ", MARK) for x in words], add_special_tokens=False)]
        want = self._expected(words) if self.reference else found
        back = self.decode([[self.lead, *x] for x in found]) if decode else [""] * len(words)
        for i, x, y, z, w in zip(rows, found, want, back, words):
            good[i] = x == y
            if decode and z != w:
                odd[i] = z.encode()
            ids.append(np.array(x, np.int32))
            numbers.append(np.array([len(x)]))

    @cached_property
    def lead(self) -> int:
        """The marker's own token: decoded in front of a word, it is the space that a text's start does not have."""
        return next(i for i, p in enumerate(self.model.pieces) if p[0] == MARK)

    def _expected(self, words: list[str]) -> list[list[int]]:
        """SentencePiece's ids of words with their spaces. Spaces alone only occur after another word, so after one they are encoded."""
        bare = [not w.strip(" ") for w in words]
        lead = len(self.reference.encode("x"))
        found = self.reference.encode(["x" + w if b else w[1:] for w, b in zip(words, bare)], num_threads=1)
        return [x[lead:] if b else x for x, b in zip(found, bare)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _binary(off: np.ndarray, buf: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def _grouped(batches, at: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until their column at holds limit bytes: the more texts, the fewer distinct words by text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _read(path: str) -> bytes:
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    with open(SparkFiles.get(os.path.basename(path)), "rb") as f:
        return f.read()


def sentencepiece_encode(docs: DataFrame, text: str = "text", model: str = MODEL, verify: bool = True, decode: bool = True, threads: int = 2) -> DataFrame:
    """docs with ids (array of int), parity (ids equal SentencePiece's) and decoded (the ids turned back).

    threads: of the library, in each task. Columns of docs with these names are replaced.  The model file (some hundred KB) is read by the driver
    and shipped with the tasks, and so is the tokenizer built from it."""
    file = _read(model)
    data = docs.sparkSession.sparkContext.broadcast((file, verify, build(Model(file)).to_str()))
    new = ["ids", "parity", "decoded"][: 3 if decode else 2]
    rows = docs.select(*[c for c in docs.columns if c not in new])
    at = rows.columns.index(text)
    rows = rows.withColumn(text, F.col(text).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema += ", ids array<int>, parity boolean" + ", decoded string" * decode

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        K.few_arenas()
        codec = Codec(*data.value)  # one a task: workers outlive tasks, and would keep its memory
        for batch in _grouped(batches, at, TEXT_BYTES):
            flat, n, same, back = codec.encode(batch.column(at), decode)
            off = np.concatenate([[0], np.cumsum(n)])
            size = K.string_buffer(batch.column(at))[1]
            for i, j in K.chunks(size):
                ids = pa.ListArray.from_arrays(pa.array(off[i : j + 1] - off[i], pa.int32()), pa.array(flat[off[i] : off[j]], pa.int32()))
                cols = [ids, pa.array(same[i:j], pa.bool_()), *([back[i:j].cast(pa.string())] if decode else [])]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *cols], names=[*batch.schema.names, *new])

    return K.small_batches(rows).mapInArrow(K.tidy(run), schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sentencepiece_encode(docs)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "parity",
        (F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))).alias("round_trip"),
    )
