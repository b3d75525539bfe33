"""Media columns: baseline JPEG, decoded to dimensions, luminance thumbnails and thumbnail hashes.

``decode_batch`` parses markers, Huffman-decodes the scans of all images of a batch in lockstep (one lane a
restart interval) and keeps the luminance DC coefficients only: one thumbnail pixel for each 8x8 block.

``encode_batch`` stores bytes losslessly in such images: with a DC quantiser of 8 a flat block of value v
has the DC coefficient v - 128, so the thumbnail of an image of flat blocks is the payload itself, 64
blocks a row and a restart interval a row.  More than 8,191 rows make several images, one after another.

Defined cases: null text = empty; an empty text is one row of zeros; a stored form that is no baseline
JPEG with all components in one scan (baseline images with a scan a component are not decoded) gives null columns and feature ``unreadable``; null and repeated ids keep their rows; other columns
are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U

ROW = 64
MAX_ROWS = 8191
_DC_LENGTHS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_SYMBOLS = tuple(range(12))
_AC_LENGTHS = (1,) + (0,) * 15  # a single code: end of block
_AC_SYMBOLS = (0,)


def _codes(lengths, symbols) -> dict[int, tuple[int, int]]:
    """Canonical Huffman codes: symbol -> (code, bits)."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lookup(lengths, symbols) -> np.ndarray:
    """Next 16 bits -> bits << 8 | symbol; zero where no code fits."""
    table = np.zeros(1 << 16, np.uint16)
    for s, (code, bits) in _codes(lengths, symbols).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | s
    return table


def _diff_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a DC difference d, at d + 255: all bits of its block, and their number."""
    dc, eob = _codes(_DC_LENGTHS, _DC_SYMBOLS), _codes(_AC_LENGTHS, _AC_SYMBOLS)[0]
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = dc[s]
        value = d if d >= 0 else d + (1 << s) - 1
        bits[d + 255] = ((code << s | value) << eob[1]) | eob[0]
        size[d + 255] = n + s + eob[1]
    return bits, size


_BITS, _SIZE = _diff_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + bytes([8]) * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\0" + bytes(_DC_LENGTHS) + bytes(_DC_SYMBOLS)), _segment(0xC4, b"\x10" + bytes(_AC_LENGTHS) + bytes(_AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", ROW)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def encode_batch(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """One stored form (one or more images) for each span of buf, zero-padded to a positive multiple of 64."""
    n = np.diff(off)
    rows = np.maximum(-(-n // ROW), 1)
    first = np.cumsum(rows) - rows
    total = int(rows.sum())
    payload = np.zeros(total * ROW, np.int16)
    g, k = K.spread(n)
    payload[first[g] * ROW + k] = buf
    payload = payload.reshape(total, ROW)
    diff = np.empty_like(payload)
    diff[:, 0] = payload[:, 0] - 128
    np.subtract(payload[:, 1:], payload[:, :-1], out=diff[:, 1:])
    diff += 255
    size = _SIZE[diff]
    end = np.cumsum(size, axis=1)
    length = -(-end[:, -1] // 8)
    begin = np.cumsum(length) - length
    out = np.zeros(int(length.sum()) + 4, np.uint8)
    at = begin[:, None] * 8 + end - size
    shifted = _BITS[diff] << (24 - size - (at & 7)).astype(np.uint32)
    at >>= 3
    for j in range(ROW):  # within a column no two codes share a byte
        for b in range(3):
            out[at[:, j] + b] |= (shifted[:, j] >> np.uint32(16 - 8 * b)).astype(np.uint8)
    out = out[:-4]
    out[begin + length - 1] |= ((1 << (8 * length - end[:, -1])) - 1).astype(np.uint8)
    # Stuffing, and a restart marker after each row but the last of an image.
    place = np.arange(total) - np.repeat(first, rows)
    last = np.zeros(total, bool)
    last[first + rows - 1] = True
    last |= place % MAX_ROWS == MAX_ROWS - 1
    full = out == 0xFF
    extra = np.cumsum(full) - full
    row = np.repeat(np.arange(total), length)
    mark = np.cumsum(np.where(last, 0, 2)) - np.where(last, 0, 2)
    dest = np.arange(len(out)) + extra + mark[row]
    scan = np.zeros(len(out) + int(full.sum()) + int(2 * (~last).sum()), np.uint8)
    scan[dest] = out
    stop = dest[begin + length - 1] + 1 + full[begin + length - 1]
    rst = stop[~last]
    scan[rst] = 0xFF
    scan[rst + 1] = 0xD0 + (place[~last] % MAX_ROWS) % 8
    edges = np.concatenate([[0], stop[last]])
    raw = scan.tobytes()
    images, i = [], 0
    for r in rows.tolist():
        parts = []
        while r > 0:
            parts += [_header(min(r, MAX_ROWS)), raw[edges[i] : edges[i + 1]], b"\xff\xd9"]
            r, i = r - MAX_ROWS, i + 1
        images.append(b"".join(parts))
    return images


class Unreadable(ValueError):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Markers of one image from at: frame, tables, scan bytes; and where the image ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Unreadable("no start of image")
    at += 2
    im: dict = {"q": {}, "dc": {}, "ac": {}, "restart": 0}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise Unreadable("no marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                im["q"][body[0] & 15] = (body[1] << 8 | body[2]) if wide else body[1]
                body = body[129:] if wide else body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                im["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0 or marker == 0xC1:
            if body[0] != 8:
                raise Unreadable("not 8 bits a sample")
            im["height"], im["width"] = body[1] << 8 | body[2], body[3] << 8 | body[4]
            im["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise Unreadable("not baseline")
        elif marker == 0xDD:
            im["restart"] = body[0] << 8 | body[1]
        elif marker == 0xDA:
            if "parts" not in im or body[0] != len(im["parts"]):
                raise Unreadable("scan without all components")
            im["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = data.find(b"\xff\xd9", at)
            if end < 0:
                raise Unreadable("no end of image")
            im["bytes"] = data[at:end]
            return im, end + 2


def _layout(im: dict):
    """Blocks of an MCU as (component, DC table, AC table, x, y), MCUs across and down."""
    parts = im["parts"]
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    h, v = max(p[1] for p in parts), max(p[2] for p in parts)
    blocks = [(i, im["dc"][im["scan"][p[0]][0]], im["ac"][im["scan"][p[0]][1]], x, y) for i, p in enumerate(parts) for y in range(p[2]) for x in range(p[1])]
    return tuple(blocks), -(-im["width"] // (8 * h)), -(-im["height"] // (8 * v)), parts[0][1], parts[0][2], h, v


def _lockstep(images: list[dict], layout, restart: int) -> list[np.ndarray]:
    """Luminance DC values (block rows by block columns) of images that share tables and MCU layout."""
    blocks = layout[0]
    lanes_of = []
    mcus = []
    for im in images:
        _, across, down, *_ = _layout(im)
        n = across * down
        step = restart or n
        lanes_of.append(-(-n // step))
        mcus += [min(step, n - s) for s in range(0, n, step)]
    raw = np.frombuffer(b"".join(im["bytes"] + b"\xff\xd7" for im in images), np.uint8)
    after = np.empty(len(raw), bool)
    after[0] = False
    after[1:] = raw[:-1] == 0xFF
    rst = np.flatnonzero(after & (raw >= 0xD0) & (raw <= 0xD7))
    if len(rst) != sum(lanes_of):
        raise Unreadable("restart markers do not match the dimensions")
    keep = ~(after & (raw == 0))
    keep[rst] = False
    keep[rst - 1] = False
    where = np.cumsum(keep)
    stop = where[rst] * 8
    pos = np.concatenate([[0], stop[:-1]])
    data = np.concatenate([raw[keep], np.full(16, 0xFF, np.uint8)])
    word = np.ndarray(len(data) - 7, ">u8", buffer=data.data, strides=(1,))
    limit = (len(data) - 8) * 8
    mcus = np.array(mcus)
    n_lanes, n_lum = len(mcus), sum(1 for b in blocks if b[0] == 0)
    lum = np.zeros((n_lanes, int(mcus.max()), n_lum), np.int32)
    last = np.zeros((max(b[0] for b in blocks) + 1, n_lanes), np.int64)
    tables: dict = {}
    for b in blocks:
        for t in b[1:3]:
            if t not in tables:
                tables[t] = _lookup(*t)
    for m in range(int(mcus.max())):
        lane = np.flatnonzero(mcus > m)
        if len(lane) == n_lanes:
            lane = slice(None)
        p = pos[lane]
        seen = 0
        for comp, dc, ac, _, _ in blocks:
            w = word[np.minimum(p, limit) >> 3].astype(U) << (p & 7).astype(U)
            hit = tables[dc][(w >> U(48)).astype(np.int64)]
            bits, s = (hit >> 8).astype(np.int64), (hit & 255).astype(np.int64)
            if not bits.all() or (s > 11).any():
                raise Unreadable("broken code")
            w <<= bits.astype(U)
            value = ((w >> U(1)) >> (63 - s).astype(U)).astype(np.int64)
            value -= np.where(value < (1 << s) >> 1, (1 << s) - 1, 0)
            last[comp, lane] += value
            if comp == 0:
                lum[lane, m, seen] = last[0, lane]
                seen += 1
            w <<= s.astype(U)
            p = p + bits + s
            hit = tables[ac][(w >> U(48)).astype(np.int64)]
            if not hit.all():
                raise Unreadable("broken code")
            p += hit >> 8
            open_ = np.flatnonzero(hit & 255)
            k = np.ones(len(open_), np.int64)
            sym = (hit[open_] & 255).astype(np.int64)
            while len(open_):  # alternating coefficients are skipped
                k += np.where(sym == 0xF0, 16, (sym >> 4) + 1)
                p[open_] += np.where(sym == 0xF0, 0, sym & 15)
                go = k < 64
                open_, k = open_[go], k[go]
                at = p[open_]
                hit = tables[ac][((word[np.minimum(at, limit) >> 3].astype(U) << (at & 7).astype(U)) >> U(48)).astype(np.int64)]
                if not hit.all():
                    raise Unreadable("broken code")
                p[open_] += hit >> 8
                sym = (hit & 255).astype(np.int64)
                go = sym != 0
                open_, k, sym = open_[go], k[go], sym[go]
        pos[lane] = p
    if (pos > stop).any() or (stop - pos > 7).any():
        raise Unreadable("scan and dimensions differ")
    out, lane = [], 0
    places = [(b[3], b[4]) for b in blocks if b[0] == 0]
    for im, n in zip(images, lanes_of):
        _, across, down, h, v, hm, vm = _layout(im)
        flat = np.concatenate([lum[i, : mcus[i]] for i in range(lane, lane + n)]) if n > 1 and (mcus[lane : lane + n] < lum.shape[1]).any() else lum[lane : lane + n].reshape(-1, n_lum)[: across * down]
        lane += n
        grid = np.empty((down * v, across * h), np.int32)
        for i, (x, y) in enumerate(places):
            grid[y::v, x::h] = flat[:, i].reshape(down, across)
        out.append(grid[: -(-(-(-im["height"] * v // vm)) // 8), : -(-(-(-im["width"] * h // hm)) // 8)])
    return out


def decode_batch(stored: list[bytes | None]) -> list[tuple[int, int, np.ndarray] | None]:
    """(width, height, thumbnail) of each stored form, its images stacked; None if unreadable."""
    images, owner = [], []
    bad = set()
    for i, data in enumerate(stored):
        try:
            at, mine = 0, []
            while data is None or at < len(data) or not mine:
                im, at = parse(data or b"", at)
                im["key"] = (_layout(im)[0], im["restart"])
                mine.append(im)
            images += mine
            owner += [i] * len(mine)
        except (Unreadable, IndexError, KeyError, struct.error):
            bad.add(i)
    groups: dict = {}
    for k, im in enumerate(images):
        groups.setdefault(im["key"], []).append(k)
    thumbs: list = [None] * len(images)

    def run(ks: list[int], key) -> None:
        try:
            for k, lum in zip(ks, _lockstep([images[k] for k in ks], key, key[1])):
                q = images[k]["q"][images[k]["parts"][0][3]]
                thumbs[k] = np.clip((lum * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        except (Unreadable, IndexError, KeyError):
            if len(ks) == 1:
                bad.add(owner[ks[0]])
            else:  # find the broken ones by halves
                run(ks[: len(ks) // 2], key)
                run(ks[len(ks) // 2 :], key)

    for key, ks in groups.items():
        run(ks, key)
    out: list = [None] * len(stored)
    for k, i in enumerate(owner):
        if i in bad:
            out[i] = None
        elif out[i] is None:
            out[i] = (images[k]["width"], images[k]["height"], thumbs[k])
        else:
            w, h, t = out[i]
            out[i] = (w, h + images[k]["height"], np.concatenate([t, thumbs[k]]))
    return out


def thumbnail_hash(t: np.ndarray) -> str:
    """Difference hash: the thumbnail averaged to 8 rows of 9, one bit for each rise along a row."""
    rows, cols = (np.arange(n) * size // n for n, size in ((8, t.shape[0]), (9, t.shape[1])))
    total = np.add.reduceat(np.add.reduceat(t.astype(np.int64), rows, axis=0), cols, axis=1)
    count = np.maximum(np.diff(np.append(rows, t.shape[0])), 1)[:, None] * np.maximum(np.diff(np.append(cols, t.shape[1])), 1)[None, :]
    mean = total * 1000 // count
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return np.packbits(bits).tobytes().hex()


OUT = "doc_id long, n_bytes long, media binary, width long, height long, thumbnail binary, thumbnail_hash string"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's text stored as JPEG, and what is read back from the stored bytes."""

    def run(batches):
        for batch in batches:
            buf, off = K.string_buffer(batch.column(1))
            for i, j in K.chunks(off, 1 << 20):
                stored = encode_batch(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                read = decode_batch(stored)
                get = lambda f: [None if r is None else f(r) for r in read]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], pa.array(np.diff(off[i : j + 1]), pa.int64()), pa.array(stored, pa.binary()),
                        pa.array(get(lambda r: r[0]), pa.int64()), pa.array(get(lambda r: r[1]), pa.int64()),
                        pa.array(get(lambda r: r[2].tobytes()), pa.binary()), pa.array(get(lambda r: thumbnail_hash(r[2])), pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "media", "width", "height", "thumbnail", "thumbnail_hash"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return K.small_batches(rows).mapInArrow(K.tidy(run), OUT)


FOUND = "width long, height long, thumbnail binary, thumbnail_hash string"


def decode_column(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """width, height, thumbnail and thumbnail_hash of a column of JPEG bytes, with the columns to keep (those with one of
    these names as <name>_kept)."""
    kept = df.select(*[F.col(c).alias(n) for c, n in zip(keep, K.kept_names(keep, FOUND))], F.col(media).cast("binary").alias("__media"))
    schema = kept.schema
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            read = decode_batch(batch.column(batch.num_columns - 1).to_pylist())
            cols = [pa.array([None if r is None else f(r) for r in read], kind) for f, kind in (
                (lambda r: r[0], pa.int64()), (lambda r: r[1], pa.int64()), (lambda r: r[2].tobytes(), pa.binary()), (lambda r: thumbnail_hash(r[2]), pa.string()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + cols, names=batch.schema.names[:-1] + ["width", "height", "thumbnail", "thumbnail_hash"])

    return K.small_batches(kept).mapInArrow(K.tidy(run), ", ".join([*fields, FOUND]))


def op10_media_jpeg(spark, sf_dir: str) -> DataFrame:
    media = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.substring("thumbnail", -ROW, ROW)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.coalesce(F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash"), F.lit("unreadable")).alias("feature"),
    )
