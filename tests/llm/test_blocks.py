import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import blocks as K
from graphloom.llm import language_id, lm_score, media_jpeg, simhash, substring_dedup, suffix_dedup
from graphloom.llm import sentencepiece_backend as sp
from graphloom.llm import wordpiece_len as wp

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab \n", max_size=60)), max_size=6)


@settings(max_examples=60, deadline=None)
@given(texts)
def test_words(xs):
    buf, off = K.string_buffer(pa.array(xs, pa.string()))
    s, e, wo = K.word_spans(buf, off)
    for i, x in enumerate(xs):
        assert [buf[a:b].tobytes() for a, b in zip(s[wo[i] : wo[i + 1]], e[wo[i] : wo[i + 1]])] == WORD.findall((x or "").encode())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=25), min_size=1, max_size=5))
def test_suffix_array(strings):
    t = np.frombuffer("\0".join(strings).encode() + b"\0", np.uint8)
    seps = np.flatnonzero(t == 0)
    key = lambda i: (bytes(t[i : seps[seps >= i][0]]), int(seps[seps >= i][0]))
    assert suffix_dedup.suffix_array(t).tolist() == sorted(np.flatnonzero(t).tolist(), key=key)


def test_long_runs_and_prefixes():
    t = np.frombuffer(b"\1" * 300 + b"\0" + b"\1" * 200 + b"\2\0", np.uint8)
    sa = suffix_dedup.suffix_array(t)
    lcp = suffix_dedup.permuted_common_prefixes(t, sa, 50)
    for k in range(1, len(sa)):
        a, b = bytes(t[sa[k - 1] :]).split(b"\0")[0], bytes(t[sa[k] :]).split(b"\0")[0]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert a <= b and min(int(lcp[k]), n) == min(n, 50)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=90), st.integers(0, 2**64 - 1))
def test_xxh64(data, seed):
    buf = np.frombuffer(data + bytes(16), np.uint8)
    assert int(simhash.xxh64(buf, np.array([0]), len(data), seed)[0]) == xxhash.xxh64_intdigest(data, seed)


def test_majority_of_many():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 1000).astype(np.uint64)
    n = np.array([700, 0, 1, 299])
    got = simhash.majority(h, n)
    at = 0
    for k, g in zip(n, got):
        part = h[at : at + k].tolist()
        at += k
        assert int(g) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > k)


def test_forest_connects_like_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 63, 40).astype(np.uint64)), base ^ np.uint64(0b1010101)]))
    q = simhash._quarters(fp)
    fp = fp[np.lexsort((fp, *q.T[::-1]))]
    a, b = simhash.forest(fp, fp, 4, True)
    x, y = simhash.forest(fp[:50], fp[50:], 4, False)
    links = [(u, v) for u, v in zip(a.tolist(), b.tolist())]

    def groups(pairs, values):
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for u, v in pairs:
            root[find(u)] = find(v)
        return {frozenset(w for w in values if find(w) == find(v)) for v in values}

    values = fp.view(np.int64).tolist()
    every = [(u, v) for i, u in enumerate(values) for j, v in enumerate(values) if i < j and int(np.bitwise_count(fp[i] ^ fp[j])) <= 4]
    assert groups(links, values) == groups(every, values)
    cross = [(u, v) for u, v in every if (u in values[:50]) != (v in values[:50])]
    assert groups(list(zip(x.tolist(), y.tolist())), values) == groups(cross, values)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=1, max_size=5))
def test_jpeg_round_trip(xs):
    buf, off = K.string_buffer(pa.array(xs, pa.string()))
    stored = media_jpeg.encode_batch(buf, off)
    for x, m, r in zip(xs, stored, media_jpeg.decode_batch(stored)):
        data = x.encode()
        assert r[2].tobytes() == data + bytes(-len(data) % 64 if data else 64) and m[:2] == b"\xff\xd8"


_AC = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))))


def _jpeg(width, height, luma_dc, restart, rng):
    """Colour, 2x2 subsampled, with random alternating coefficients: what decoding has to skip."""
    dc, ac = media_jpeg._codes(media_jpeg._DC_LENGTHS, media_jpeg._DC_SYMBOLS), media_jpeg._codes(*_AC)
    bits = []

    def put(code, n):
        bits.extend((code >> i) & 1 for i in range(n - 1, -1, -1))

    def number(v, s):
        put(v if v >= 0 else v + (1 << s) - 1, s)

    def block(d):
        s = abs(d).bit_length()
        put(*dc[s])
        number(d, s)
        k = 1
        while k < 64 and rng.random() < 0.7:
            run = int(rng.integers(0, 20))
            while run > 15 and k + 16 < 64:
                put(*ac[0xF0])
                k, run = k + 16, run - 16
            run = min(run, 15, 63 - k)
            v = int(rng.integers(1, 200)) * (1 if rng.random() < 0.5 else -1)
            s = abs(v).bit_length()
            put(*ac[run << 4 | s])
            number(v, s)
            k += run + 1
        if k < 64:
            put(*ac[0])

    scan = b""
    across, down = -(-width // 16), -(-height // 16)
    last = [0, 0, 0]
    for m in range(across * down):
        if restart and m and m % restart == 0:
            bits.extend([1] * (-len(bits) % 8))
            scan += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits.clear()
            last = [0, 0, 0]
        my, mx = divmod(m, across)
        for y in range(2):
            for x in range(2):
                v = int(luma_dc[2 * my + y, 2 * mx + x])
                block(v - last[0])
                last[0] = v
        for c in (1, 2):
            v = int(rng.integers(-300, 300))
            block(v - last[c])
            last[c] = v
    bits.extend([1] * (-len(bits) % 8))
    scan += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")
    seg = media_jpeg._segment
    frame = bytes([8, height >> 8, height & 255, width >> 8, width & 255, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    tables = b"".join(seg(0xC4, bytes([k]) + bytes(t[0]) + bytes(t[1])) for k, t in ((0, (media_jpeg._DC_LENGTHS, media_jpeg._DC_SYMBOLS)), (0x10, _AC)))
    return b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, b"\0" + bytes([16] * 64) + b"\1" + bytes([9] * 64)) + seg(0xC0, frame) + tables + (seg(0xDD, bytes([0, restart])) if restart else b"") + seg(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + scan + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_jpeg_with_colour_and_alternating_coefficients(restart):
    rng = np.random.default_rng(2)
    files, want = [], []
    for w, h in ((33, 50), (16, 16), (7, 100)):
        dc = rng.integers(-60, 60, (2 * -(-h // 16), 2 * -(-w // 16)))
        files.append(_jpeg(w, h, dc, restart, rng))
        want.append(np.clip((dc * 16 + 4 >> 3) + 128, 0, 255)[: -(-h // 8), : -(-w // 8)])
    for (w, h, t), x, f in zip(media_jpeg.decode_batch(files), want, files):
        assert np.array_equal(t, x)
    broken = files[0][:-40] + b"\xff\xd9"
    assert [r is None for r in media_jpeg.decode_batch([files[0], broken, b"", None, files[1][:20], files[2]])] == [False, True, True, True, True, False]


def test_wordpieces_against_greedy():
    first, rest = wp.vocabulary()
    auto = wp.Automaton.build(first, rest)
    a, b = set(first), set(rest)

    def greedy(w):
        n = at = 0
        while at < len(w):
            end = next((e for e in range(len(w), at, -1) if w[at:e] in (b if at else a)), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    words = ["the", "unbelievable,", "x" * 3000, "日本語", "é" * 9, "\x00", "thetion" * 400, "a▁b", "fooé漢bar", "ationation"]
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w.encode()) for w in words])
    start = np.concatenate([[0], end[:-1]])
    assert auto.lengths(buf, start, end).tolist() == [greedy(w) for w in words]


def test_toy_automaton():
    auto = wp.Automaton.build(["a", "abcdx"], ["b", "c", "cdy", "dz"])
    f = lambda w: auto.length(w.encode())
    assert (f("abcdz"), f("abcdx"), f("abcd"), f("z"), f("abcdy")) == (4, 1, 1, 1, 3)


def test_sentencepiece_parity():
    codec = sp.Codec(sp._read(sp.MODEL))
    xs = ["", " ", "a  b ", "  lead", "tab\tnew\n", "▁x ▁", "é漢😀\0", "<s> </s>", "w" * 5000, "The the THE."]
    flat, n, same, back = codec.encode(pa.array(xs))
    off = np.concatenate([[0], np.cumsum(n)])
    ids = [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
    assert ids == codec.reference.encode(xs) and same.all()
    assert codec.decode(ids) == back.to_pylist() == [x.replace("▁", " ") for x in xs]


@pytest.fixture(scope="module")
def codec():
    data = sp._read(sp.MODEL)
    out = sp.Codec(data, True, sp.build(sp.Model(data)).to_str())
    out.JOINED = 16
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("a b▁é\n", max_size=40)), max_size=8))
def test_words_are_put_together(codec, xs):
    flat, n, same, back = codec.encode(pa.array(xs, pa.string()))
    assert same.all() and back.to_pylist() == [(x or "").replace("▁", " ") for x in xs]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])][: len(xs)] == [codec.reference.encode(x or "") for x in xs]


def test_disparity_is_found_by_word(codec, monkeypatch):
    """A reference that disagrees about one word, and a decoder that loses one."""
    true, decode = codec.reference, codec.decode

    class Other:
        def encode(self, x, **options):
            wrong = lambda t, ids: [*ids, 7] if "zebra" in t else ids
            return wrong(x, true.encode(x)) if isinstance(x, str) else [wrong(t, ids) for t, ids in zip(x, true.encode(x))]

    monkeypatch.setattr(codec, "reference", Other())
    monkeypatch.setattr(codec, "decode", lambda ids: [x.replace("lion", "cat") for x in decode(ids)])
    xs = ["a lion and", "a zebra or", "plain words " * 20, "zebra"]
    flat, n, same, back = codec.encode(pa.array(xs))
    assert same.tolist() == [True, False, True, False] and back.to_pylist() == [x.replace("lion", "cat") for x in xs]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == true.encode(xs)


def test_rebuilt_unigram_model(tmp_path):
    """A hand-made unigram model file with byte fallback."""
    def field(k, data):
        return bytes([k << 3 | 2, len(data)]) + data

    def piece(text, score, kind=1):
        import struct

        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind]))

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -3, 1), ("▁a", -1, 1), ("b", -2, 1), ("ab", -1.5, 1), ("a", -2.5, 1)]
    trainer = b"\x18\x01" + b"\x98\x02\x01"  # model_type unigram, byte_fallback
    normal = field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01"
    data = b"".join(piece(*p) for p in pieces) + field(2, trainer) + field(3, normal)
    model = sp.Model(data)
    assert model.unigram and model.byte_fallback and model.by_word and not model.squeeze
    codec = sp.Codec(data)
    xs = ["ab a", "bbé", " a  b", "aab"]
    flat, n, same, back = codec.encode(pa.array(xs))
    assert same.all() and back.to_pylist() == codec.decode(codec.reference.encode(xs)) and codec.reference.encode(xs) == [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def test_levels():
    assert substring_dedup.levels_of(13) == [4, 8, 13] and substring_dedup.levels_of(50, 4) == [4, 8, 16, 32, 50] and substring_dedup.levels_of(1) == [1]


def thue_morse(n, flip=False):
    return bytes(97 + ((i.bit_count() + flip) & 1) for i in range(n))


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096])
def test_no_structured_collisions(n):
    """Words that collide under every polynomial modulo 2**64, as bytes and as sequences of words."""
    a, b = thue_morse(n), thue_morse(n, True)
    buf = np.frombuffer(a + b, np.uint8)
    s, e = np.array([0, n]), np.array([n, 2 * n])
    for seed in (0, 1):
        h = K.hash_spans(buf, s, e, seed)
        assert h[0] != h[1]
    words = K.hash_spans(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    values = words[np.array([x - 97 for x in a + b])]
    h = K.hash_windows(values, s, n)
    assert h[0] != h[1]


def test_spans_hash_by_content():
    text = b"abcdefgh" * 80 + b"\0" * 30
    buf = np.frombuffer(text + b"xyz" + text, np.uint8)
    for k in (0, 1, 7, 8, 9, 16, 255, 256, 257, 600):
        h = K.hash_spans(buf, np.array([0, len(text) + 3]), np.array([k, len(text) + 3 + k]))
        assert h[0] == h[1]
    n = np.arange(1, 30)
    assert len(set(K.hash_spans(np.zeros(40, np.uint8), 0 * n, n).tolist())) == len(n)


def test_trigrams_stay_inside_documents():
    buf, off = K.string_buffer(pa.array(["abc", "", "x", "de fg"]))
    bins, n = language_id.trigrams(buf, off)
    assert n.tolist() == [1, 0, 0, 2] and len(bins) == 3


def test_squeeze():
    for x in (b"", b"abc" * 1000):
        assert K.unsqueeze(K.squeeze(x)) == x
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    for x in (keys, keys[:1], keys[:0]):
        assert (K.unsqueeze_keys(K.squeeze_keys(x)) == x).all()
    assert K.apart(K.together(b"", b"ab", b"c")) == [b"", b"ab", b"c"]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
