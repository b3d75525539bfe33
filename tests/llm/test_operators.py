"""Every operator on rows with nulls, empty and long texts, ties, repeats, clashing columns, and no rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.llm import blocks as K
from graphloom.llm import pipeline as corpus_pipeline
from graphloom.llm import components, decontaminate, language_id, lm_score, media_jpeg, sentencepiece_backend, sharding, simhash, substring_dedup, suffix_dedup, wordpiece_len

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
NO = 2**63 - 1
SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
ROWS = [
    (3, f"alpha beta {SHARED} gamma delta"), (1, f"{SHARED} and then something quite different follows here, in words"), (2, None), (None, f"x {SHARED}"), (5, ""),
    (3, f"alpha beta {SHARED} gamma delta"), (9, "é" * 70 + " " + "tail words " * 30), (8, "z" * 300), (4, "  \t\n "), (7, "é" * 70 + " other"), (6, "z" * 120), (None, None),
    (10, ("lorem ipsum dolor sit amet " * 400) + SHARED), (11, "Short"), (12, f"Alpha beta {SHARED} gamma delta"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, fp string, score double, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "de", None][k % 3], None if k % 4 == 0 else "hot", None, 1, "x", None, None) for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return NO if i is None else i


def brute_windows(rows, units, window):
    low = {}
    for i, t in rows:
        u = units(t)
        for k in range(len(u) - window + 1):
            w = tuple(u[k : k + window])
            low[w] = min(low.get(w, NO), key(i))
    out = []
    for i, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - window + 1):
            if low[tuple(u[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        out.append((i, u, gone))
    return out


@pytest.mark.parametrize("window,gram,buckets", [(50, 16, 6), (50, 16, 1), (20, 8, 3), (6, 4, 3)])
def test_suffix_array_dedup(docs, none, window, gram, buckets):
    got = suffix_dedup.suffix_array_dedup(docs, window=window, gram=gram, buckets=buckets, carry=("source", "kept")).collect()
    assert "kept_kept" in got[0] and "source" in got[0]
    want = []
    for i, u, gone in brute_windows(ROWS, lambda t: list((t or "").encode()), window):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want.append((str(i), len(u), sum(gone), spans, bytes(b for b, g in zip(u, gone) if not g)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffix_dedup.suffix_array_dedup(none).count() == 0


@pytest.mark.parametrize("window,first,buckets", [(13, 4, 6), (13, 3, 2), (13, 2, 2), (4, 1, 1), (1, 4, 2), (3, 7, 1)])
def test_substring_dedup(docs, none, window, first, buckets):
    got = substring_dedup.substring_dedup(docs, window=window, first=first, buckets=buckets).collect()
    want = []
    for i, u, gone in brute_windows(ROWS, lambda t: WORD.findall((t or "").encode()), window):
        want.append((str(i), len(u), sum(gone), b" ".join(w for w, g in zip(u, gone) if not g).decode()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in got)
    assert substring_dedup.substring_dedup(none).count() == 0


@pytest.mark.parametrize("order,out,least", [(1, True, 1), (2, True, 1), (3, True, 1), (2, False, 2), (3, False, 1)])
def test_lm_score(docs, none, order, out, least):
    words = [(i, WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))) for i, t in ROWS]
    grams = lambda w: Counter(tuple(w[k - n : k]) for n in range(1, order + 1) for k in range(n, len(w) + 1))
    corpus = sum((grams(w) for _, w in words), Counter())
    total = sum(len(w) for _, w in words)

    def score(w):
        counts = corpus - grams(w) if out else corpus
        every = max(total - len(w) * out, 1)

        def log(k):
            n, penalty = min(order, k), 0.0
            while n > 1 and counts[tuple(w[k - n : k])] < least:
                n, penalty = n - 1, penalty + math.log(0.4)
            if n == 1:
                return penalty + math.log((counts[(w[k - 1],)] if counts[(w[k - 1],)] >= least else 0.4) / every)
            return penalty + math.log(counts[tuple(w[k - n : k])] / counts[tuple(w[k - n : k - 1])])

        return sum(log(k) for k in range(1, len(w) + 1))

    want = sorted((str(i), len(w), round(score(w), 6)) for i, w in words)
    got = lm_score.lm_score(docs, order=order, leave_one_out=out, min_count=least, buckets=3).collect()
    assert sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in got) == want
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    assert lm_score.lm_score(none).count() == 0


LEAST = -(2**63)


@pytest.mark.parametrize("ids", [(NO, None), (LEAST, NO, None), (LEAST, LEAST + 1, 5, NO, None), (NO, 4), (None, None)])
def test_extreme_ids(spark, ids):
    """The largest long beside null: each sorts where it should and comes back as it was."""
    t = "one two three four five six seven eight nine ten eleven twelve thirteen and some more bytes"
    df = spark.createDataFrame([(i, t) for i in ids] * 2, "doc_id long, text string")
    kept = sorted(2 * [(i is None, i or 0) for i in ids])[0]
    for out in (substring_dedup.substring_dedup(df, buckets=2), suffix_dedup.suffix_array_dedup(df, buckets=2)):
        got = out.collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, ids + ids))
        assert all((r.n_removed == 0) == ((r.doc_id is None, r.doc_id or 0) == kept) for r in got)
    assert sorted(str(r.doc_id) for r in lm_score.lm_score(df, buckets=2).collect()) == sorted(map(str, ids + ids))


def test_passages_take_few_rows(spark, monkeypatch):
    """A range of hashes serves several buckets, so that rows between buckets and ranges are not the square of the buckets."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = [text(70) for _ in range(40)]
    rows = [(i, text(900) + rng.choice(common) + text(900)) for i in range(300)]
    seen, repeated = [], K.repeated
    monkeypatch.setattr(K, "repeated", lambda requests, parts: seen.append((requests, parts)) or repeated(requests, parts))
    got = suffix_dedup.suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string"), buckets=64).collect()
    requests, parts = seen[0]
    assert parts == 8 and requests.count() <= 64 * 8
    for r in got:
        mine = dict(rows)[r.doc_id].encode()
        smaller = {t.encode()[k : k + 50] for i, t in rows if i < r.doc_id for k in range(len(t) - 49)}
        gone = {k + j for k in range(len(mine) - 49) if mine[k : k + 50] in smaller for j in range(50)}
        assert r.kept == bytes(c for k, c in enumerate(mine) if k not in gone)


def test_texts_longer_than_a_bucket(spark):
    """Texts of up to 130 KB, in buckets of 4 KB; as media they take several images."""
    import random

    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh\u00e9", k=rng.randint(1, 9))) for _ in range(900)]
    long = " ".join(rng.choices(vocabulary, k=20000))
    rows = [(1, long[5000:9000]), (2, long), (3, "x" * 60000), (4, "x" * 400), (5, long[80000:81000] + " y"), (6, "w" * 700 + " z " + "w" * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.suffix_array_dedup(df, bucket_bytes=4096).collect()}
    want = {i: (len(u), bytes(b for b, g in zip(u, gone) if not g)) for i, u, gone in brute_windows(rows, lambda t: list(t.encode()), 50)}
    assert {i: (r.n_bytes, bytes(r.kept)) for i, r in got.items()} == want
    got = {r.doc_id: (r.n_words, r.kept) for r in substring_dedup.substring_dedup(df, bucket_bytes=4096).collect()}
    words = brute_windows(rows, lambda t: WORD.findall(t.encode()), 13)
    assert got == {i: (len(u), b" ".join(w for w, g in zip(u, gone) if not g).decode()) for i, u, gone in words}
    assert {r.doc_id: r.n_words for r in lm_score.lm_score(df, bucket_bytes=4096).collect()} == {i: len(t.split()) for i, t in rows}
    media = {r.doc_id: r for r in media_jpeg.media_columns(df.unionByName(spark.createDataFrame([(7, "q" * 1_200_000)], "doc_id long, text string"))).collect()}
    assert all(bytes(media[i].thumbnail).rstrip(b"\0") == t.encode() for i, t in [*rows, (7, "q" * 1_200_000)])
    import xxhash

    fp = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()}
    assert fp[6] == xxhash.xxh64_intdigest(rows[5][1], 42)


def test_words_that_fool_polynomials(spark):
    a = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    tail = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{a.translate({97: 98, 98: 97})} {tail}")], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.substring_dedup(df).collect()] == [0, 0]


def test_rows_without_ids_spread(spark):
    """Half of the rows have no id, a quarter one id: no bucket holds much more than its share."""
    from graphloom.llm import blocks as K

    df = spark.range(4000).selectExpr("CASE WHEN id % 2 = 0 THEN null WHEN id % 4 = 1 THEN 7 ELSE id END AS doc_id", "concat('text of ', id) AS text")
    sizes = [r[0] for r in K.pack(df, 8, K.Ids(df)).selectExpr("octet_length(ids) / 8 AS n", "bucket").groupBy("bucket").sum("n").select("sum(n)").collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_simhash(docs, none):
    import xxhash

    def fp(t):
        w = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sh = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fp(t)) for i, t in ROWS]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    low = {g: min((i for (i, _), h in zip(prints, group) if h == g and i is not None), default=None) for g in group}
    got = simhash.simhash_dedup(docs).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == sorted((str(i), f, str(low[g])) for (i, f), g in zip(prints, group))
    assert simhash.simhash_dedup(none).count() == 0


def test_components(spark):
    rows = [(1, 2), (2, 3), (2, 3), (7, 7), (None, 4), (9, 8)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 600 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {n: got[n] for n in (1, 2, 3, 8, 9, 140, 649)} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 140: 100, 649: 500} and 7 not in got


def test_sharding(docs, none):
    got = sharding.shard_by_bytes(docs, shards=4).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in ROWS)
    rows = sorted(((key(i), zlib.crc32((t or "").encode()), size(t)) for i, t in ROWS))
    total, at, want = sum(r[2] for r in rows), 0, []
    for k, _, s in rows:
        want.append((k, min(3, (2 * at + s) * 4 // (2 * total))))
        at += s
    assert sorted((key(r.doc_id), r.shard) for r in got) == sorted(want)
    both = [(None, "a"), (NO, "b"), (None, "c"), (NO, "d")]
    got_ = sharding.shard_by_bytes(docs.sparkSession.createDataFrame(both, "doc_id long, text string"), shards=1).orderBy("slot").collect()
    assert [r.doc_id for r in got_] == [NO, NO, None, None]
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_by_bytes(none).count() == 0


def test_overfull_ranges_are_cut(spark):
    """One key with most of the rows."""
    df = spark.range(3000).selectExpr("CASE WHEN id < 2000 THEN 5 ELSE id END AS doc_id", "repeat('x', CAST(id % 50 AS INT)) AS text")
    sums = [r[1] for r in sharding.shard_by_bytes(df, shards=8).groupBy("shard").sum("size").collect()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 102


@pytest.mark.parametrize("one", ["5", "null"])
def test_one_row_many_times_is_subdivided(spark, one):
    """All rows equal, or without an id: ranges stay small, and the shards come out even."""
    df = spark.range(4000).selectExpr(f"CAST({one} AS BIGINT) AS doc_id", "'same text' AS text")
    ranges = [r[1] for r in sharding._placed(df, "doc_id", "text", 4, None).groupBy("range").count().collect()]
    assert len(ranges) > 16 and max(ranges) < 400
    assert sorted(r[1] for r in sharding.shard_by_bytes(df, shards=4).groupBy("shard").count().collect()) == [1000] * 4


def test_media(docs, none):
    got = media_jpeg.media_columns(docs).collect()
    for r in got:
        assert len(r.thumbnail) % 64 == 0 and (r.width, r.height) == (512, len(r.thumbnail) // 8)
    pad = lambda t: (t or "").encode() + bytes(-len((t or "").encode()) % 64 if t else 64)
    assert sorted((str(r.doc_id), bytes(r.thumbnail)) for r in got) == sorted((str(i), pad(t)) for i, t in ROWS)
    again = media_jpeg.decode_column(media_jpeg.media_columns(docs).select("doc_id", "media"), keep=("doc_id",)).collect()
    assert sorted(str(r.thumbnail_hash) for r in again) == sorted(r.thumbnail_hash for r in got)
    assert media_jpeg.media_columns(none).count() == 0


def test_token_counts(docs, none):
    got = wordpiece_len.token_counts(docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len(WORD.findall((t or "").encode()))) for i, t in ROWS)
    assert all(r.n_tokens >= r.n_words for r in got) and wordpiece_len.token_counts(none).count() == 0
    first, rest = map(set, wordpiece_len.vocabulary())
    longest = max(map(len, first | rest))

    def pieces(word):
        """Greedy longest match, piece by piece."""
        at = n = 0
        while at < len(word):
            known = rest if at else first
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in known), None)
            if end is None:
                return 1
            at, n = end, n + 1
        return n

    texts = [*(t for _, t in ROWS), "unbelievably internationalisation \u6f22\u5b57 qqqq\U0001f600x caf\u00e9s " + "long" * 700]
    if os.path.isdir("/root/testdata/sf0.001"):
        texts += [r[0] for r in docs.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = docs.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: sum(pieces(w.decode()) for w in WORD.findall((t or "").encode())) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in wordpiece_len.token_counts(df).collect()} == want


def test_sentencepiece(docs, none):
    out = sentencepiece_backend.sentencepiece_encode(docs.withColumn("ids", F.lit(1)))
    assert out.columns == [*docs.columns, "ids", "parity", "decoded"]
    assert all(r.parity and r.decoded == (r.text or "") and (not r.text) == (not r.ids) for r in out.collect())
    assert sentencepiece_backend.sentencepiece_encode(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, SHARED), (2, "ALPHA, beta one two"), (3, None), (4, ""), (5, "short"), (1, "not in there at all, no"), (6, "lorem ipsum dolor sit amet")], "item_id long, text string")
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sh = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    want = []
    for i, t in ROWS:
        for j, x in items.collect():
            w = words(x)
            k = min(5, len(w))
            if k and len(sh(w, k) & sh(words(t), k)) >= 0.8 * len(sh(w, k)):
                want.append((str(i), j, len(sh(w, k) & sh(words(t), k)), len(sh(w, k))))
    for block in (1 << 25, 20):  # broadcast, and joined
        got = decontaminate.decontaminate(docs, items, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.item_id, r.n_shared, r.n_shingles) for r in got) == sorted(want)
    assert decontaminate.decontaminate(none, items).count() == 0 == decontaminate.decontaminate(docs, items.limit(0)).count()


def test_large_benchmark_stays_off_the_driver(spark, docs):
    """100 MB of items, none of which the driver could collect."""
    items = spark.range(1600).selectExpr("id AS item_id", "concat('item ', id, ' ', repeat(concat('word', id % 7, ' '), 9000)) AS text").unionByName(spark.createDataFrame([(-1, SHARED)], "item_id long, text string"))
    got = decontaminate.decontaminate(docs, items).collect()
    assert {r.item_id for r in got} == {-1} and len(got) == sum(SHARED in (t or "") for _, t in ROWS)
    from graphloom.llm import decontaminate as D

    calls = []
    real = D.Items
    try:
        D.Items = lambda ids, *a: calls.append(len(ids)) or real(ids, *a)
        D.decontaminate(docs, items)
    finally:
        D.Items = real
    assert not calls


def test_language_id(spark, docs, none):
    model = language_id.fit(spark.createDataFrame([("der die das und nicht " * 9, "de"), ("the and of to in " * 9, "en"), (None, "en"), ("x", None)], "text string, lang string"))
    rows = spark.createDataFrame([(1, "the house of the king", None, "com", "a.b.com"), (2, "", "de", "de", "b.de"), (3, None, None, None, None), (4, "und das haus", "de", "de", None), (4, "und das haus", "de", "de", "b.de"), (None, "of the", "en", "com", "a.b.com")], "doc_id long, text string, d string, s string, h string")
    got = {(r.doc_id, k): r for k, r in enumerate(language_id.language_id(rows, model, ("doc_id",), "text", "d", "s", "h").orderBy("doc_id").collect())}
    assert {(k[0], r.lang) for k, r in got.items() if r.accepted} == {(1, "en"), (4, "de"), (None, "en")}
    assert {k[0] for k, r in got.items() if not r.accepted} == {2, 3} and all(0 < r.probability <= 1 for r in got.values())
    assert not language_id.fit(none).languages and language_id.language_id(none, model).count() == 0
    assert [r.accepted for r in language_id.language_id(rows.limit(1), language_id.fit(none)).collect()] == [False]


def test_one_odd_row_does_not_speak_for_a_language(spark):
    """A key seen once, with an English row, says nothing for German."""
    model = language_id.fit(spark.createDataFrame([("der die das und nicht " * 9, "de"), ("the and of to in " * 9, "en")], "text string, lang string"))
    rows = spark.range(3000).selectExpr("id AS lang", "concat('the end of the ', id) AS text", "IF(id = 0, 'qq', 'en') AS d", "IF(id = 0, 'zz', 'com') AS s").unionByName(
        spark.sql("SELECT -1L AS lang, '' AS text, 'qq' AS d, 'zz' AS s"))
    got = language_id.language_id(rows, model, ("lang",), "text", "d", "s")
    assert got.columns == ["lang_kept", "lang", "probability", "accepted"]
    odd = got.where("lang_kept = -1").first()
    assert odd["lang"] == "en" and odd["probability"] > 0.9


def test_fusion_equals_plain_bayes(spark):
    import numpy as np
    import pyarrow as pa

    from graphloom.llm import blocks as K

    words = {"en": "the of and to in is that".split(), "de": "der die und das ist nicht ein".split(), "fr": "le la les des est une pas".split()}
    rng = np.random.default_rng(3)
    model = language_id.fit(spark.createDataFrame([(" ".join(rng.choice(w, 60)), k) for k, w in words.items()], "text string, lang string"))
    rows = []
    for i in range(240):
        lang = str(rng.choice(["en", "en", "de", "fr"]))
        text = " ".join(rng.choice(words[str(rng.choice([lang] * 9 + ["en"]))], rng.integers(1, 4))) if rng.random() < 0.9 else [None, "", "123"][i % 3]
        host = [None, f"{lang}.a.com", "www.mixed.org", f"x{i % 5}.mixed.org"][int(rng.integers(4))]
        rows.append((i if i % 50 else None, text, str(rng.choice([lang, "xx", "en"])) if rng.random() < 0.5 else None, [None, "com", "de", "rare" if i == 7 else "fr"][int(rng.integers(4))], host))
    langs = model.languages
    buf, off = K.string_buffer(pa.array([r[1] for r in rows], pa.string()))
    score, n = model.score(buf, off)
    guess = score.argmax(axis=1)
    known = [i for i in range(len(rows)) if n[i]]
    corpus = [(sum(guess[i] == k for i in known) + 1) / (len(known) + len(langs)) for k in range(len(langs))]
    site = lambda h: ".".join(h.split(".")[-2:])

    def smoothed(have, parent, weight):
        return [(sum(guess[i] == k for i in have) + weight * parent[k]) / (len(have) + weight) for k in range(len(langs))]

    want = []
    for i, (d, _, *keys, host) in enumerate(rows):
        s = list(score[i])
        for c, key in zip((2, 3), keys):
            if key is not None:
                held = [j for j in known if rows[j][c] is not None]
                share = language_id.KEY_WEIGHT * sum(rows[j][c] == key for j in held) / len(held)
                for k in range(len(langs) * (share > 0)):
                    s[k] += math.log((sum(rows[j][c] == key and guess[j] == k for j in held) + share) / (sum(guess[j] == k for j in held) + language_id.KEY_WEIGHT))
        prior = corpus
        if host is not None and any(rows[j][4] == host for j in known):
            prior = smoothed([j for j in known if rows[j][4] and site(rows[j][4]) == site(host)], corpus, language_id.SITE_WEIGHT)
            prior = smoothed([j for j in known if rows[j][4] == host], prior, language_id.HOST_WEIGHT)
        s = np.array(s) + np.log(prior)
        p = np.exp(s - s.max())
        want.append((str(d), langs[int(s.argmax())], round(float(1 / p.sum()), 6), bool(n[i] > 0 and 1 / p.sum() >= 0.5)))
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, s string, h string").repartition(3)
    got = language_id.language_id(df, model, ("doc_id",), "text", "d", "s", "h").collect()
    assert sorted((str(r.doc_id), r.lang, round(r.probability, 6), r.accepted) for r in got) == sorted(want)


def test_address_parts(spark):
    row = spark.createDataFrame([("https://user@WWW.Foo.example.org:80/en/1?x", '<!DOCTYPE html><html class="a" lang="De-AT"><script>var t="</p>"</script><p>Hi &amp; you</p>')], "url string, html string")
    r = row.select(language_id.host_of(F.col("url")), language_id.site_of(language_id.host_of(F.col("url"))), language_id.suffix_of(F.col("url")), language_id.declared_of(F.col("html")), language_id.visible_text(F.col("html"))).first()
    assert tuple(r[:4]) == ("www.foo.example.org", "example.org", "org", "de") and r[4].split() == ["Hi", "you"]


def test_held_out_accuracy(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(d.where("doc_id % 2 = 1"), language_id.fit(d.where("doc_id % 2 = 0"), train_rows=200), ("doc_id",), host=None)
    assert out.join(d, "doc_id").agg(F.avg((out["lang"] == d["lang"]).cast("double"))).first()[0] > 0.98


def test_pipeline_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start, n in ((docs, len(ROWS)), (none, 0)):
        d = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == d.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}-{n}")
            d = spark.read.parquet(f"{tmp_path}/{name}-{n}")
        kept = {r.doc_id for r in d.collect()}
        assert (10 not in kept and {1, 7, 11} <= kept) if n else not kept


def test_pipeline_run(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("parity AND decoded = text").count() > 5
