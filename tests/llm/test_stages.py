"""Each deciding stage of the pipeline against a brute-force version on a small fixture."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import blocks as K
from graphloom.llm import pipeline as corpus_pipeline
from graphloom.llm import near_copies, simhash
from tests.llm.test_operators import ROWS

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in WORD.findall((text or "").encode())]
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def linked(n, near):
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if group[a] != group[b] and near(a, b):
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    return group


def corpus():
    """Texts, copies with edits at both sides of the threshold, and a passage that all of them share."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = [None, "", " \t", "one two", "One two", "one two three", "a b c d e", "A b  c d e"]
    common = " ".join(word() for _ in range(12))
    for size in (30, 88, 88, 300):
        base = [word() for _ in range(size)]
        out.append(" ".join(base) + " " + common)
        for edits in (1, 2, 3, 6, size // 9):
            w = list(base)
            for at in rng.sample(range(size), edits):
                w[at] = word()
            out.append(" ".join(w) + " " + common)
    return out


@pytest.mark.parametrize("frequent", [near_copies.FREQUENT, 10**6])
def test_near_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    texts = corpus() + [t for _, t in ROWS]
    sets = [shingles(t) for t in texts]
    group = linked(len(texts), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8 - 1e-9)
    low = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = {r.key: r.group for r in near_copies.near_copies(df, "i").collect()}
    assert got == {i: low[g] for i, g in enumerate(group)} and len(set(group)) < len(texts)
    assert near_copies.near_copies(df.limit(0), "i").count() == 0


def families():
    """Edited copies of two texts, at both sides of the threshold, and of one text between them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for size in (60, 90):
        base = [word() for _ in range(size)]
        for _ in range(70):
            w = list(base)
            for at in rng.sample(range(size), rng.choice([0, 1, 1, 2, 2, 3, 4, 8])):
                w[at] = word()
            out.append(" ".join(w))
    return out + [" ".join(out[0].split()[:30] + out[70].split()[:30])]


def test_families_of_near_copies(spark, monkeypatch):
    """Families in several blocks, compared with columns of a matrix and without, link like all pairs."""
    texts = families() + corpus()
    sets = [shingles(t) for t in texts]
    group = linked(len(texts), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8 - 1e-9)
    low = {g: min(i for i, x in enumerate(group) if x == g) for g in group}
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    for least, block, columns in ((4, 16, 8), (32, 1024, 1024)):
        monkeypatch.setattr(near_copies, "FAMILY", least)
        monkeypatch.setattr(near_copies, "BLOCK_SETS", block)
        monkeypatch.setattr(near_copies, "COLUMNS", columns)
        got = {r.key: r.group for r in near_copies.near_copies(df, "i").collect()}
        assert got == {i: low[g] for i, g in enumerate(group)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=12), min_size=2, max_size=24), st.integers(1, 24), st.integers(2, 5))
def test_compared_blocks_link_like_all_pairs(xs, left, dense):
    left = min(left, len(xs))
    h = np.concatenate([np.array(sorted(v), np.uint64) for v in xs])
    before, near_copies.DENSE = near_copies.DENSE, dense
    try:
        links = list(zip(*near_copies.compared(h, np.array([len(v) for v in xs]), left, 0.5)))
    finally:
        near_copies.DENSE = before
    side = lambda i: left == len(xs) or i < left
    want = linked(len(xs), lambda a, b: (left == len(xs) or side(a) != side(b)) and jaccard(xs[a], xs[b]) >= 0.5 - 1e-9)
    got = linked(len(xs), lambda a, b: (a, b) in links or (b, a) in links)
    assert [got.index(g) for g in got] == [want.index(g) for g in want]


def test_meetings_of_many_are_bounded(monkeypatch):
    """Sets of one family do not meet, and what others give is handed out in pieces."""
    monkeypatch.setattr(near_copies, "PAIRS", 1 << 10)
    m = 300
    h, key, n = np.zeros(m, np.uint64), np.arange(1, m + 1).astype(np.uint64), np.full(m, 9)
    family = np.where(np.arange(m) < 200, 7, key).astype(np.uint64)
    pieces = list(near_copies._meetings(h, key, n, family, 0.8))
    assert max(p.shape[1] for p in pieces) <= 2 << 10
    met = {(a, b) for p in pieces for a, b in zip(p[0].tolist(), p[1].tolist())}
    assert met == {(a, b) for a in range(1, m + 1) for b in range(max(a, 200) + 1, m + 1)}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=90), st.sets(st.integers(0, 400), max_size=30))
def test_bitmaps_bound_what_is_shared(a, b):
    x, y = (K.mix(np.array(sorted(v), np.uint64)) for v in (a, b))
    most = near_copies.most_shared(near_copies.bitmap(x), near_copies.bitmap(y), len(a), len(b))
    assert len(a & b) <= most <= min(len(a), len(b))
    assert near_copies.most_shared(near_copies.bitmap(x), near_copies.bitmap(x), len(a), len(a)) == len(a)


def test_rows_keep_their_numbers(spark, tmp_path):
    """Over several files and uses with other columns and filters."""
    spark.range(5000).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(7).write.parquet(f"{tmp_path}/d")
    rows = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/d"))
    assert "ExistingRDD" not in rows._jdf.queryExecution().toString() and rows.select("__row").distinct().count() == 5000
    both = rows.select("__row", "doc_id").join(rows.where("text LIKE '%7%'").select(F.col("__row"), F.col("text")), "__row")
    assert both.count() > 1000 and both.where("text <> concat('t', doc_id)").count() == 0


def test_near_duplicates_keeps_one_of_each_component(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    prints = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(df).collect()}
    close = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    group = linked(len(texts), lambda a, b: close(a, b) or jaccard(sets[a], sets[b]) >= 0.8 - 1e-9)
    assert len(set(group)) < len(set(linked(len(texts), close)))  # the radius alone keeps more
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert got == sorted(min(i for i, x in enumerate(group) if x == g) for g in set(group))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: what goes and what stays is decided row by row."""
    english, german = "the house of the king and the queen in the town", "der Mann und die Frau und das Kind in der Stadt"
    leak = "alpha beta gamma delta epsilon zeta eta theta iota"
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make = lambda rows: spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS).repartition(2)
    d = make([(1, english * 9, "en"), (2, german * 9, "de"), (None, "12 34 !", None), (7, "99 00", None), (7, english, "en"), (None, german, "de")])
    assert rows_of(corpus_pipeline.language(spark, d, str(tmp_path))) == sorted([("1", english * 9), ("2", german * 9), ("7", english), ("None", german)])
    d = make([(5, english, None), (5, english, None), (None, english, None), (4, german, None), (5, leak, None), (None, "only here and nowhere else at all", None), (None, "only here and nowhere else at all", None), (3, english, None)])
    want = [("3", english), ("4", german), ("5", leak), ("None", "only here and nowhere else at all")]
    assert rows_of(corpus_pipeline.near_duplicates(spark, d, str(tmp_path))) == sorted(want)
    d = make([(None, f"x {leak} y", None), (None, german, None), (8, leak, None), (8, english, None)])
    assert rows_of(corpus_pipeline.benchmark_leaks(spark, d, str(tmp_path))) == sorted([("None", german), ("8", english)])


def test_passages_leave_other_bytes_alone(spark):
    """Replacement characters of the text stay; of cut characters no byte stays, also where two halves would fit together."""
    a, b = "\u00e9\u4e2d\U0001f600" * 3, "x" * 60
    same = "\u0169" + "q" * 60 + "\u0161"  # c5 a9 ... c5 a1
    rows = [
        (1, f"a {b} b"), (2, f"\ufffd {a} {b} {a} \ufffd"), (3, same), (4, "\u0129" + "q" * 60 + "\u0163" + " z\ufffd"), (5, "no cut \ufffd"),
        (6, "\u4e29" + "w" * 60 + "\u4e2d"), (7, "\u5e29" + "w" * 60 + "\u4e3d\ufffd"),
    ]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    raw = {i: t.encode() for i, t in rows}
    for i, t in rows:
        gone, u = [False] * len(raw[i]), raw[i]
        for k in range(len(u) - 49):
            if any(j < i and u[k : k + 50] in raw[j] for j in raw):
                gone[k : k + 50] = [True] * 50
        at, kept = 0, []
        for c in t:
            size = len(c.encode())
            if not any(gone[at : at + size]):
                kept.append(c)
            at += size
        assert (got[i].text, got[i].n_chars) == ("".join(kept), len(kept)), i


def test_stages_start_with_small_heaps(spark):
    """Executors collect their garbage before each stage; here they are the driver."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    done = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    before = done()
    dict(corpus_pipeline.STAGES)["language_id"](spark, docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("x")), "")
    assert done() > before
