"""Suffix-array deduplication of byte strings across documents.

A byte goes when a ``window``-byte string that covers it also starts in a document with a smaller id.
Windows never cross documents and are judged on the input.

1. Every window has an *anchor*: the leftmost smallest hash among its ``gram``-byte substrings.  Equal
   windows have equal anchors, so a window can only repeat if its anchor does; anchors that stay in one
   document are sorted out by an exchange of hashes (``blocks.repeated``).
2. Consecutive windows with the same repeated anchor form one string; strings go to the shard of their
   anchor, a distinct string once per bucket.
3. Each shard sorts the suffixes of its distinct strings by induced sorting (``suffix_array``) and
   computes permuted common prefixes; suffixes that share ``window`` bytes get the smallest id among
   their owners.  A task takes a range of shards, one after another.  The reply lists these ids, run-length coded, in the order of the request.
4. The bucket marks the windows whose smallest owner is smaller than their own document.

Texts are shuffled once, compressed; anchors cost about 0.06 x 8 bytes a byte.  A hot passage reaches
its shard once per bucket, however many rows hold it.

Defined cases: null text = empty (nothing removed); null id = larger than every other id; rows that
repeat an id count as one document (they never remove from one another); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as K
from .blocks import U

WINDOW = 50
GRAM = 16
#: Buckets for one hash range, and shards in one: a bucket sends a range one row, which holds its strings of all shards
#: there, so rows grow with the square of the buckets divided by PER_PART; a shard is sorted on its own.
PER_PART, SHARDS = 8, 16
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


# ---------------------------------------------------------------- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour (S); separators (0) are S."""
    n = len(t)
    up = np.ones(n, bool)
    up[:-1] = t[:-1] < t[1:]
    flat = np.zeros(n, bool)
    flat[:-1] = (t[:-1] == t[1:]) & (t[:-1] > 0)
    if flat.any():  # equal neighbours take the type at the end of their run
        stop = np.flatnonzero(~flat)
        runs = np.flatnonzero(flat)
        up[runs] = up[stop[np.searchsorted(stop, runs)]]
    return up


def _leftmost(up: np.ndarray) -> np.ndarray:
    """Positions of smaller (S) suffixes right of a larger (L) one."""
    lms = up.copy()
    lms[0] = False
    lms[1:] &= ~up[:-1]
    return np.flatnonzero(lms).astype(np.int64)


def _order(s: np.ndarray, up: np.ndarray, bits: int, apart: int) -> np.ndarray:
    """Leftmost-smaller positions of s in the order of their suffixes.

    The substrings between them are named by sorting packed (symbol, type) codes of the given bits, as many as a word
    holds; a longer substring is cut into such pieces.  Where names repeat, the string of names is sorted by recursion.
    Symbols below apart are separators: they rank by position, and none repeats in the string of names."""
    n, width = len(s), 64 // bits
    base = _leftmost(up)
    gaps = np.diff(np.concatenate([base, [n]]))
    group, k = K.spread((gaps - 1) // width + 1)
    at = base[group] + width * k
    main = k == 0
    code = np.zeros(n + width + 1, U)
    code[:n] = s.astype(U) * U(2) + up
    keys = np.zeros(len(at), U)
    reach = np.minimum(np.diff(np.concatenate([at, [n - 1]])), width - 1)
    for i in range(width):
        keys = (keys << U(bits)) | np.where(i <= reach, code[at + i], U(0))
    sep = np.flatnonzero(s[at] < apart)
    keys[sep] = np.arange(len(sep), dtype=U)
    order = np.argsort(keys)
    sk = keys[order]
    new = np.concatenate([[True], sk[1:] != sk[:-1]])
    if not new.all():
        names = np.empty(len(at), np.int64)
        names[order] = np.cumsum(new) - 1
        order = _sorted_names(names, int(new.sum()))
    return at[order[main[order]]]


def _sorted_names(names: np.ndarray, count: int) -> np.ndarray:
    """Positions of a string over 0 .. count - 1 in suffix order: the leftmost-smaller ones by recursion, which induce the
    others.  A shorter suffix comes before those that it begins."""
    s = np.concatenate([names + 1, [0]])  # with an end smaller than all
    n = len(s)
    less, same = s[:-1] < s[1:], s[:-1] == s[1:]
    up = np.concatenate([less, [True]])
    if same.any():
        stop = np.flatnonzero(np.concatenate([~same, [True]]))
        runs = np.flatnonzero(same)
        up[runs] = up[stop[np.searchsorted(stop, runs)]]
    lms = _order(s, up, max(1, (2 * count + 3).bit_length()), 1)
    counts = np.bincount(s, minlength=count + 1)
    end = np.cumsum(counts)
    sa = np.full(n, -1, np.int64)
    sym = s[lms]
    tail_rank = np.arange(len(lms)) - np.searchsorted(sym, sym)  # lms ascend by symbol
    ends = end[sym] - np.searchsorted(sym, sym, side="right") + np.searchsorted(sym, sym) + tail_rank
    sa[ends] = lms
    _induce(sa, s, ~up, end - counts, 1)
    sa[ends] = -1
    sa[0] = n - 1
    _induce(sa, s, up, end, -1)
    return sa[1:]


#: Entries that one step of a scan takes.
STEP_BITS = 11
STEP = 1 << STEP_BITS


def _induce(sa: np.ndarray, s: np.ndarray, kind: np.ndarray, ptr: np.ndarray, sign: int) -> None:
    """One scan of induced sorting, from the left (sign 1) or the right (-1): each entry puts its left neighbour, if that
    is of the kind, at the next free place of its symbol's bucket.

    The scan reads and writes one entry after another, STEP of them at a time: what a step's entries put inside the step
    itself is added and the step is done again, until that no longer changes (as often as entries depend on
    one another; an entry is right once those before it are)."""
    n = len(sa)
    ptr = ptr.copy()
    view = sa if sign > 0 else sa[::-1]
    for at in range(0, n, STEP):
        part, inside = view[at : at + STEP], np.zeros((2, 0), np.int64)
        while True:
            before = part[part > 0] - 1
            before = before[kind[before]]
            if not len(before):
                break
            ch = s[before]
            packed = np.sort((ch << STEP_BITS) | np.arange(len(ch)))  # a stable sort by symbol
            sc, o = packed >> STEP_BITS, packed & (STEP - 1)
            k = np.arange(len(sc))
            k -= np.maximum.accumulate(np.where(np.concatenate([[True], sc[1:] != sc[:-1]]), k, 0))
            place, before = (ptr[sc] if sign > 0 else n - ptr[sc]) + k, before[o]
            here = place < at + STEP
            again = np.stack([place[here], before[here]])
            if np.array_equal(again, inside):
                view[place] = before
                np.add.at(ptr, ch, sign)
                break
            inside = again
            part = view[at : at + STEP].copy()
            part[again[0] - at] = again[1]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of t (uint8; 0 separates strings and ends t) in suffix order, separators left out.

    Induced sorting: the leftmost-smaller suffixes, sorted by recursion on the names of the substrings between them,
    induce the larger (L) ones bucket by bucket from the left, these the smaller (S) ones from the right.  A bucket
    is scanned in vectorised rounds, as many as its longest run of one byte."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int32)
    up = _types(t)
    lms = _order(t, up, 9, 1).astype(np.int32)
    counts = np.bincount(t, minlength=256)
    end = np.cumsum(counts)
    begin = end - counts
    lms_at = np.searchsorted(t[lms], np.arange(257))
    sa = np.empty(n, np.int32)
    larger, smaller = np.where(up, 0, t).astype(np.uint8), np.where(up, t, 0).astype(np.uint8)

    def place(cur, kind, ptr, sign):
        before = cur - 1
        ch = kind[before]
        keep = ch > 0
        before, ch = before[keep], ch[keep]
        if not len(ch):
            return
        o = np.argsort(ch, kind="stable")
        ch = ch[o]
        cnt = np.bincount(ch, minlength=256)
        k = np.arange(len(ch)) - (np.cumsum(cnt) - cnt)[ch]
        sa[ptr[ch] + k if sign > 0 else ptr[ch] - 1 - k] = before[o]
        ptr += sign * cnt

    chars = np.flatnonzero(counts)
    head = begin.copy()
    for c in chars:
        lo = begin[c]
        while lo < head[c]:
            hi = head[c]
            place(sa[lo:hi], larger, head, 1)
            lo = hi
        place(lms[lms_at[c] : lms_at[c + 1]], larger, head, 1)
    tail = end.copy()
    for c in chars[::-1]:
        hi = end[c]
        while tail[c] < hi:
            lo = tail[c]
            place(sa[lo:hi][::-1], smaller, tail, -1)
            hi = lo
        place(sa[begin[c] : head[c]][::-1], smaller, tail, -1)
    return sa[begin[chars[1]] if chars[0] == 0 and len(chars) > 1 else (end[0] if chars[0] == 0 else 0) :]


def permuted_common_prefixes(t: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each entry of order (in suffix order) the common prefix with the entry before it, up to limit.

    It is computed in text order, where neighbouring positions read neighbouring bytes."""
    padded = np.concatenate([t, np.zeros(limit + 16, np.uint8)])
    word = K.loads(padded, 0, len(t) + limit + 8)
    by_text = np.argsort(order)
    p = order[by_text].astype(np.int64)
    phi = np.where(by_text > 0, order[by_text - 1], -1).astype(np.int64)
    plcp = np.zeros(len(order), np.int64)
    live = np.flatnonzero(phi >= 0)
    for k in range(0, limit, 8):
        x = word[p[live] + k] ^ word[phi[live] + k]
        same = x == 0
        rest = ~same
        low = x[rest]
        plcp[live[rest]] = k + (np.bitwise_count((low & (~low + U(1))) - U(1)) >> 3)
        live = live[same]
    plcp[live] = limit
    out = np.empty(len(order), np.int64)
    out[by_text] = np.minimum(plcp, limit)
    return out


def smallest_owner(buf: np.ndarray, lens: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string, string by string: the smallest owner of an equal window."""
    m = len(lens)
    off = np.cumsum(lens) - lens
    t = np.zeros(len(buf) + m, np.uint8)
    g, k = K.spread(lens)
    t[off[g] + g + k] = buf + np.uint8(1)
    n_win = lens - window + 1
    wg, wk = K.spread(n_win)
    starts = off[wg] + wg + wk
    number = np.full(len(t), -1, np.int32)
    number[starts] = np.arange(len(starts))
    sa = suffix_array(t)
    order = sa[number[sa] >= 0]
    if not len(order):
        return np.zeros(0, np.int64)
    lcp = permuted_common_prefixes(t, order, window)
    at = np.flatnonzero(lcp < window)
    win = number[order]
    low = np.minimum.reduceat(owner[wg[win]], at)
    out = np.empty(len(order), np.int64)
    out[win] = np.repeat(low, np.diff(np.concatenate([at, [len(order)]])))
    return out


def string_owners(prints: np.ndarray, owner: np.ndarray, lens: np.ndarray, buf: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Run-length coded smallest owners of the windows of a shard's strings: the distinct string of each string, the
    number of runs of each distinct one, and the lengths and owners of these runs."""
    off = np.cumsum(lens) - lens
    # A string that several buckets sent enters the suffix array once, with its smallest owner.
    order = np.lexsort((lens, prints))
    sp, sl = prints[order], lens[order]
    new = np.ones(len(order), bool)
    new[1:] = (sp[1:] != sp[:-1]) | (sl[1:] != sl[:-1])
    at = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    one = order[at]
    low_owner = np.minimum.reduceat(owner[order], at)
    g, k = K.spread(lens[one])
    low = smallest_owner(buf[off[one][g] + k], lens[one], low_owner, window)
    wg, wk = K.spread(lens[one] - window + 1)
    start = np.ones(len(low), bool)
    start[1:] = (low[1:] != low[:-1]) | (wk[1:] == 0)
    at = np.flatnonzero(start)
    return which, np.bincount(wg[at], minlength=len(one)), np.diff(np.concatenate([at, [len(low)]])), low[at]


# ---------------------------------------------------------------- buckets


def _strings(buf: np.ndarray, off: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor: document, first window, windows, anchor hash. Chunk by chunk."""
    width = window - gram + 1
    found = []
    for i, j in K.chunks(off):
        a, b = int(off[i]), int(off[j])
        n = b - a
        if n < window:
            continue
        pad = np.concatenate([buf[a:b], np.zeros(gram + 16, np.uint8)])
        h = np.zeros(n, U)
        for k in range(0, gram, 8):
            w = K.loads(pad, k, n)
            h += (w & U((1 << (8 * gram)) - 1) if gram < 8 else w) * U(_FACTORS[k // 8 % len(_FACTORS)] + 2 * (k // 8 // len(_FACTORS)))
        h = K.mix(h)
        low = K.slide((h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U), width, np.minimum)
        anchor = (low & U(0xFFFFFFFF)).astype(np.int64)
        lens = np.maximum(np.diff(off[i : j + 1]) - window + 1, 0)
        g, k = K.spread(lens)
        start = off[i:j][g] - a + k
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (g[1:] != g[:-1])
        at = np.flatnonzero(new)
        # Minima are small numbers; mixed again they spread evenly over the hash ranges.
        found.append((g[at] + i, start[at] + a, np.diff(np.concatenate([at, [len(start)]])), K.mix(h[anchor[at]])))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U)
    return tuple(np.concatenate(x) for x in zip(*found))


def _candidates(table: pa.Table, replies: pa.Table, parts: int, window: int, gram: int):
    """The bucket's strings with a repeated anchor, and the distinct ones among them in request order."""
    ids, buf, off = K.unpack(table)
    doc, start, n_win, anchor = _strings(buf, off, window, gram)
    keys, inverse = np.unique(anchor, return_inverse=True)
    keep = K.read_repeated(keys, replies, parts)[inverse] if len(keys) else np.zeros(0, bool)
    doc, start, n_win, anchor = doc[keep], start[keep], n_win[keep], anchor[keep]
    print_ = np.zeros(len(start), U)
    cut = np.searchsorted(start, [int(off[i]) for i, _ in K.chunks(off)] + [len(buf)])
    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            lo, hi = int(start[a]), int(start[b - 1] + n_win[b - 1] + window - 1)
            print_[a:b] = K.hash_spans(buf[lo:hi], start[a:b] - lo, start[a:b] - lo + n_win[a:b] + window - 1)
    order = np.lexsort((ids[doc], print_, anchor))
    sa, sp = anchor[order], print_[order]
    new = np.ones(len(order), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sp[1:] != sp[:-1])
    first = order[new]
    unique_of = np.empty(len(order), np.int64)
    unique_of[order] = np.cumsum(new) - 1
    return ids, buf, off, doc, start, n_win, anchor, print_, first, unique_of


def suffix_array_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, buckets: int | None = None,
    carry: tuple[str, ...] = (), parts: int | None = None, bucket_bytes: int = K.BUCKET_BYTES, characters: bool = False,
) -> DataFrame:
    """One row per row of docs: sizes, the kept bytes, the removed spans, and the columns to carry.

    buckets, parts: numbers of text buckets and of hash ranges, from the corpus' size and bucket_bytes unless given.
    characters: kept is without the parts of characters that a removed span has cut; what counts as removed stays the same.
    Columns to carry that are named like one of the operator's own are <name>_kept in the result."""
    if not 1 <= gram <= window or gram % 8 and gram > 8:
        raise ValueError("gram must be at most window, and a multiple of 8 above 8")
    n = buckets or K.buckets_of(K.corpus_bytes(docs, text), bucket_bytes)
    m_parts = parts or max(6, -(-n // PER_PART))
    shards = SHARDS * m_parts  # a shard's suffix array takes about 60 bytes a byte of its distinct strings
    code = K.Ids(docs, doc_id)
    packed = K.pack(docs, n, code, doc_id, text, carry, bucket_bytes)
    names = K.kept_names(carry, OUT.replace("<start:long,end:long>", ""))
    carried = "".join(f", `{n}` {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, names))

    def ask(table: pa.Table) -> pa.Table:
        ids, buf, off = K.unpack(table)
        doc, _, _, anchor = _strings(buf, off, window, gram)
        _, to, bodies = K.ask_repeated(anchor, ids[doc], m_parts)
        return K.rows_of(to, [table["bucket"][0].as_py()] * len(to), bodies, ("part", "bucket"))

    repeated = K.repeated(packed.groupBy("bucket").applyInArrow(ask, K.REQUEST), m_parts)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return K.rows_of([], [], [], ("part", "bucket"))
        ids, buf, off, doc, start, n_win, anchor, prints, first, _ = _candidates(table, replies, m_parts, window, gram)
        to, bodies = [], []
        in_shard = K.part_of(anchor[first], shards).astype(np.int64)
        edges = np.searchsorted(in_shard, SHARDS * np.arange(m_parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            f = first[edges[p] : edges[p + 1]]
            counts = np.bincount(in_shard[edges[p] : edges[p + 1]] - SHARDS * p, minlength=SHARDS).astype(np.int32)
            lens = n_win[f] + window - 1
            g, k = K.spread(lens)
            to.append(p)
            bodies.append(counts.tobytes() + K.squeeze(b"".join(x.tobytes() for x in (prints[f], ids[doc[f]], lens.astype(np.int32), buf[start[f][g] + k]))))
        return K.rows_of(to, [table["bucket"][0].as_py()] * len(to), bodies, ("part", "bucket"))

    strings = packed.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(send, K.REQUEST)

    def shard(table: pa.Table) -> pa.Table:
        sent = []
        for x in table["body"]:
            x = x.as_buffer()
            at = np.concatenate([[0], np.cumsum(np.frombuffer(x, np.int32, SHARDS))])
            m, raw = int(at[-1]), K.unsqueeze(x[4 * SHARDS :])
            lens = np.frombuffer(raw, np.int32, m, 16 * m).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(lens)])
            sent.append((at, np.frombuffer(raw, U, m), np.frombuffer(raw, np.int64, m, 8 * m), lens, off, np.frombuffer(raw, np.uint8, -1, 20 * m)))
        replies = [[] for _ in sent]
        for k in range(SHARDS):
            some = [(i, int(x[0][k]), int(x[0][k + 1])) for i, x in enumerate(sent) if x[0][k] < x[0][k + 1]]
            if not some:
                continue
            prints, owner, lens = (np.concatenate([sent[i][c][a:b] for i, a, b in some]) for c in (1, 2, 3))
            buf = np.concatenate([sent[i][5][sent[i][4][a] : sent[i][4][b]] for i, a, b in some])
            which, n_runs, run_len, run_low = string_owners(prints, owner, lens, buf, window)
            run_at = np.cumsum(n_runs) - n_runs
            for (i, _, _), w in zip(some, np.split(which, np.cumsum([b - a for _, a, b in some])[:-1])):
                g, j = K.spread(n_runs[w])
                r = run_at[w][g] + j
                replies[i].append((n_runs[w].astype(np.int32), run_len[r].astype(np.int32), run_low[r]))
        bodies = []
        for x in replies:
            n_runs, run_len, run_low = (np.concatenate(y) for y in zip(*x))
            bodies.append(b"".join((len(n_runs).to_bytes(8, "little"), len(run_low).to_bytes(8, "little"), K.squeeze(n_runs.tobytes() + run_len.tobytes() + run_low.tobytes()))))
        return K.rows_of(table["bucket"].to_pylist(), table["part"].to_pylist(), bodies, ("bucket", "part"))

    # Ranges are few and large: a task takes one, where a hash of their numbers would give it several.
    owners = strings.repartitionById(m_parts, F.col("part")).groupBy("part").applyInArrow(shard, K.REPLY)
    # Both replies of a bucket come back in one table; the part of a bitmap is stored as is, of owners as ~part.
    both = repeated.unionByName(owners.selectExpr("bucket", "~part AS part", "body"))

    def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return K.beside(_empty(code), None, names)
        part = np.asarray(replies["part"])
        ids, buf, off, doc, start, n_win, anchor, _, first, unique_of = _candidates(table, replies.filter(pa.array(part >= 0)), m_parts, window, gram)
        late = replies.filter(pa.array(part < 0)).sort_by([("part", "descending")])
        runs, lens, low = [], [], []
        for x in late["body"].to_pylist():
            m, r = int.from_bytes(x[:8], "little"), int.from_bytes(x[8:16], "little")
            raw = K.unsqueeze(x[16:])
            runs.append(np.frombuffer(raw, np.int32, m))
            lens.append(np.frombuffer(raw, np.int32, r, 4 * m))
            low.append(np.frombuffer(raw, np.int64, r, 4 * m + 4 * r))
        edge = np.zeros(len(buf) + 1, np.int32)
        if runs:
            low = np.repeat(np.concatenate(low), np.concatenate(lens))  # by distinct string, by window
            at = np.cumsum(n_win[first]) - n_win[first]
            g, k = K.spread(n_win)
            hit = low[at[unique_of][g] + k] < ids[doc[g]]
            where = (start[g] + k)[hit]
            np.add.at(edge, where, 1)
            np.add.at(edge, where + window, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        return K.beside(_digest(ids, buf, off, gone, code, characters), K.carried(table) if carry else None, names)

    return packed.groupBy("bucket").cogroup(both.groupBy("bucket")).applyInArrow(cover, OUT + carried)


def trim_edges(buf: np.ndarray, off: np.ndarray, edge: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which bytes of texts (from off) belong to a character that was cut at one of the edges (ascending, with their rows).

    Before an edge, a lead byte and what follows it go if they are fewer than the lead byte asks for; behind it, the
    continuation bytes up to the first other byte.  Neither looks beyond the next edge or the text's end."""
    gone = np.zeros(len(buf), bool)
    lead = np.select([buf >= 0xF0, buf >= 0xE0, buf >= 0xC0], [4, 3, 2], 1)
    tail = (buf & 0xC0) == 0x80
    same = row[1:] == row[:-1]
    low, high = off[row].copy(), off[row + 1].copy()
    low[1:][same] = edge[:-1][same]
    high[:-1][same] = edge[1:][same]
    for step, end in ((-1, low), (1, high)):
        at = np.arange(len(edge))
        for k in range(1, 4):
            place = edge[at] - k if step < 0 else edge[at] + k - 1
            inside = place >= end[at] if step < 0 else place < end[at]
            at, place = at[inside], place[inside]
            if step > 0:
                at, place = at[tail[place]], place[tail[place]]
                gone[place] = True
            else:
                cut = lead[place] > k
                for j in range(k):
                    gone[place[cut] + j] = True
                at = at[tail[place]]
    return gone


def _empty(code: K.Ids) -> pa.Table:
    return _digest(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool), code)


def _digest(ids: np.ndarray, buf: np.ndarray, off: np.ndarray, gone: np.ndarray, code: K.Ids, characters: bool = False) -> pa.Table:
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    rise[first] |= gone[first]
    fall = gone.copy()
    fall[:-1] &= ~gone[1:]
    last = first[first > 0] - 1
    fall[last] |= gone[last]
    rise, fall = np.flatnonzero(rise), np.flatnonzero(fall) + 1
    span_off = np.searchsorted(rise, off)
    base = np.repeat(off[:-1], np.diff(span_off))
    kept = buf[~gone]
    before = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
    removed = before[off].astype(np.int64)
    kept_off = off - removed
    if characters:
        cut = trim_edges(kept, kept_off, rise - before[rise], np.repeat(np.arange(len(ids)), np.diff(span_off)))
        kept, kept_off = kept[~cut], kept_off - np.concatenate([[0], np.cumsum(cut)])[kept_off]
    kept = kept.tobytes()
    pieces = [kept[a:b] for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist())]
    spans = pa.ListArray.from_arrays(
        pa.array(span_off, pa.int32()),
        pa.StructArray.from_arrays([pa.array(rise - base, pa.int64()), pa.array(fall - base, pa.int64())], names=["start", "end"]),
    )
    return pa.table({
        "doc_id": code.back(ids), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()),
        "n_spans": pa.array(np.diff(span_off), pa.int64()), "kept": pa.array(pieces, pa.binary()),
        "spans": spans,
    })


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_array_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, k, unnest(range(0, length(h) // 2)) AS i FROM d),
w AS (SELECT b.r, b.k, b.i, substr(d.h, 2 * b.i + 1, 100) AS s FROM b JOIN d USING (r) WHERE b.i + 50 <= length(d.h) // 2),
m AS (SELECT s, min(k) AS low FROM w GROUP BY s),
hit AS (SELECT w.r, w.i FROM w JOIN m USING (s) WHERE m.low < w.k),
c AS (SELECT b.r, b.i, max(hit.i) OVER (PARTITION BY b.r ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM b LEFT JOIN hit ON hit.r = b.r AND hit.i = b.i),
e AS (SELECT c.*, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS rise FROM c),
a AS (SELECT e.r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (rise) AS n_spans,
             string_agg(substr(d.h, 2 * e.i + 1, 2), '' ORDER BY e.i) FILTER (NOT gone) AS kept
      FROM e JOIN d USING (r) GROUP BY e.r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a USING (r)
"""
