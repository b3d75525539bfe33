"""Language identification by Bayesian evidence fusion.

Each row has a text and, where known, a declared markup language, an address suffix and a host.  With
l for a language and evidence taken as independent given l:

    log P(l | row) = text(l) + log P(declared | l) + log P(suffix | l) + log P(l | host) + const

* text(l): byte-trigram log likelihood (letters only, lower-cased), its mean times min(n, EFFECTIVE) so
  that dependent trigrams do not count as independent.  The trigram table is fitted on a bounded sample of
  labelled rows: at most ``train_rows`` distinct texts, the same quota for each label, so that every label of
  the table is in the model (with one text at least); whole texts are counted on the executors, and the driver gets
  one vector of BINS counts a label.  Whole texts are scored.
* The other terms come from grouped aggregation over all rows, with each row counted under the language of
  its text alone.  P(key | l) = (c(key, l) + KEY_WEIGHT P(key)) / (c(l) + KEY_WEIGHT), where c(l) counts the rows that
  have such a key and P(key) is its share of all languages' rows, so that the terms of a language sum to one and a
  language without rows takes those of all; a key that only rows without trigrams have says nothing.  The prior is
  smoothed towards its parents likewise, host <- site <- corpus.

Evidence keys are aggregated before anything is joined.  Keys with over 1 / HOT of all rows (fewer than HOT) are
known to the driver; rows meet their evidence on (key, salt), where hot keys have SALT salts and others one.

Defined cases: null or empty text: text(l) = 0 for all l; missing declared, suffix or host: no such term (no
host: the corpus prior); a text without trigrams is not accepted; null and repeated ids keep their rows;
an empty table gives no rows; without any labelled row there is no model: lang and probability are null, nothing is
accepted.  Columns to keep may have any names; of those named lang, probability or accepted, the result has
``<name>_kept``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as K
from .components import checkpointed


TRAIN_ROWS = 4000
BINS = 1 << 16
EFFECTIVE = 40
SITE_WEIGHT, HOST_WEIGHT, KEY_WEIGHT = 20.0, 10.0, 5.0
SALT, HOT = 32, 1000
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each document's byte trigrams with a letter in the middle, and their number by document."""
    b = _FOLD[buf].astype(np.uint32)
    n = np.diff(off)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bins = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    use = np.zeros(len(b), bool)
    use[:-2] = b[1:-1] != 32
    for cut in (off[1:] - 1, off[1:] - 2):  # a trigram does not cross documents
        cut = cut[(cut >= 0)]
        use[cut] = False
    counts = np.diff(np.concatenate([[0], np.cumsum(use)])[off])
    return bins[use[:-2]], counts


class TextModel:
    """counts: a vector of BINS trigram counts for each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.table = np.empty((BINS, len(counts)), np.float32)
        for i, lang in enumerate(self.languages):
            c = counts[lang] + 0.5
            self.table[:, i] = np.log(c / c.sum())

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """text(l) by document and language, and trigrams by document."""
        bins, n = trigrams(buf, off)
        out = np.zeros((len(n), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            cut = (np.cumsum(n) - n)[some]
            for i in range(out.shape[1]):
                out[some, i] = np.add.reduceat(self.table[:, i][bins].astype(np.float64), cut) / n[some] * np.minimum(n[some], EFFECTIVE)
        return out - out.max(axis=1, keepdims=True), n


def sample(labelled: DataFrame, text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(t, l): of each label the distinct texts with the smallest hashes, the same number at most for every label.

    At most train_rows rows, or one a label where there are more labels.  Texts are told apart by a 64-bit hash."""
    rows = labelled.select(F.col(text).cast("string").alias("t"), F.col(label).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL AND t <> ''")
    rows = rows.withColumn("h", F.xxhash64("t", F.lit(3)))
    keys = checkpointed(rows.select("l", "h").distinct())
    quota = max(1, train_rows // max(keys.select("l").distinct().count(), 1))
    # Spark cuts each task's part of a label to the quota before the exchange.
    drawn = keys.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("k") <= quota).select("l", "h")
    return rows.join(F.broadcast(drawn), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).select("t", "l")


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", train_rows: int = TRAIN_ROWS) -> TextModel:
    """Fits the text model on a sample of distinct texts of every label."""

    def partial(batches):
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), object)
            buf, off = K.string_buffer(batch.column(0))
            bins, n = trigrams(buf, off)
            doc = np.repeat(np.arange(len(n)), n)
            for lang in dict.fromkeys(labels.tolist()):
                c = np.bincount(bins[(labels == lang)[doc]], minlength=BINS)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([K.squeeze(c.astype(np.int64))], pa.binary())], names=["l", "counts"])

    def added(table: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(K.unsqueeze(x), np.int64) for x in table["counts"].to_pylist())
        return pa.table({"l": table["l"].slice(0, 1), "counts": pa.array([K.squeeze(c)], pa.binary())})

    counts = K.small_batches(sample(labelled, text, label, train_rows)).mapInArrow(K.tidy(partial), "l string, counts binary").groupBy("l").applyInArrow(added, "l string, counts binary")
    # Driver-side: one vector a label.
    return TextModel({r[0]: np.frombuffer(K.unsqueeze(bytes(r[1])), np.int64) for r in counts.collect()})


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def suffix_of(url: Column) -> Column:
    """The address's top-level domain."""
    return F.nullif(F.regexp_extract(host_of(url), r"\.([^.]+)$", 1), F.lit(""))


def declared_of(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def _smoothed(rows: DataFrame, key: str, parent: DataFrame | Column, weight: float, n: int) -> DataFrame:
    """(key, prior array): counts of guess by key, smoothed towards the parent's prior: one for all keys, or
    that of the host's site."""
    counts = rows.where(f"{key} IS NOT NULL").groupBy(key, "guess").agg(F.count("*").alias("c"))
    counts = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("guess", "c"))).alias("m"), F.sum("c").alias("all"))  # at most n entries
    if isinstance(parent, Column):
        counts = counts.withColumn("parent", parent)
    else:
        counts = counts.withColumn("site", site_of(F.col(key))).join(parent.select("site", F.col("prior").alias("parent")), "site")
    each = [(F.coalesce(F.col("m")[i], F.lit(0)) + weight * F.col("parent")[i]) / (F.col("all") + F.lit(weight)) for i in range(n)]
    return counts.select(F.col(key), F.array(*each).alias("prior"))


def language_id(rows: DataFrame, model: TextModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", declared: str | None = None, suffix: str | None = None, host: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns to keep, with lang, probability and accepted (a text that has trigrams, at the threshold)."""
    langs, n = model.languages, len(model.languages)
    back = [(f"__keep{i}", c) for i, c in enumerate(K.kept_names(keep, "lang string, probability double, accepted boolean"))]
    kept = [F.col(c).alias(h) for c, (h, _) in zip(keep, back)]
    if not n:
        return rows.select(*[F.col(c).alias(o) for c, (_, o) in zip(keep, back)], F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(False).alias("accepted"))
    col = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    slim = rows.select(*kept, col(text).alias("__t"), col(declared).alias("declared"), col(suffix).alias("suffix"), col(host).alias("host"))
    at = len(keep)
    data = rows.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__t")

    def run(batches):
        m = data.value
        for batch in batches:
            buf, off = K.string_buffer(batch.column(at))
            scores, counts = [], []
            for i, j in K.chunks(off):
                s, c = m.score(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                scores.append(s)
                counts.append(c)
            s = np.concatenate(scores) if scores else np.zeros((0, n))
            c = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            rest = [x for k, x in enumerate(batch.columns) if k != at]
            names = [x for k, x in enumerate(batch.schema.names) if k != at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * n, pa.int32()), pa.array(s.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(c, pa.int64()), pa.array(s.argmax(axis=1) if len(s) else [], pa.int32())], names=[*names, "score", "n", "guess"])

    # The texts are read and scored once; what follows moves scores and keys only.
    scored = checkpointed(K.small_batches(slim).mapInArrow(K.tidy(run), schema + ", score array<double>, n long, guess int"))
    known = scored.where("n > 0")
    # Driver-side, one small row a language: the corpus prior, and the tables of declared languages and suffixes.
    totals = {r[0]: r[1:] for r in known.groupBy("guess").agg(F.count("*"), F.count("declared"), F.count("suffix")).collect()}
    every = sum(t[0] for t in totals.values())
    root = F.array(*[F.lit((totals.get(i, (0,))[0] + 1) / (every + n)) for i in range(n)])

    def likelihood(key: str) -> DataFrame:
        """(key, add): log P(key | l)."""
        counts = known.where(f"{key} IS NOT NULL").groupBy(key, "guess").agg(F.count("*").alias("c"))
        counts = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("guess", "c"))).alias("m"), F.sum("c").alias("all"))  # at most n entries
        rows_ = [totals.get(i, (0, 0, 0))[1 if key == "declared" else 2] for i in range(n)]
        share = KEY_WEIGHT * F.col("all") / F.lit(float(max(sum(rows_), 1)))
        logs = [F.log((F.coalesce(F.col("m")[i], F.lit(0)) + share) / F.lit(rows_[i] + KEY_WEIGHT)) for i in range(n)]
        return counts.select(key, F.array(*logs).alias(f"add_{key}"))

    size = scored.count()

    def salted(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
        # Driver-side: fewer than HOT keys.
        hot = [r[0] for r in scored.where(f"{key} IS NOT NULL").groupBy(key).count().where(F.col("count") > size / HOT).select(key).collect()]
        spread = F.col(key).isin(hot) if hot else F.lit(False)
        table = table.withColumn("salt", F.explode(F.when(spread, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))))
        salt = F.when(spread, F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).otherwise(F.lit(0))
        return left.withColumn("salt", salt).join(table, [key, "salt"], "left").drop("salt")

    out = scored.withColumn("row", F.monotonically_increasing_id())
    zero = F.array(*[F.lit(0.0)] * n)
    terms = [F.col("score")]
    for key, used in (("declared", declared), ("suffix", suffix)):
        if used:
            out = salted(out, likelihood(key), key)
            terms.append(F.coalesce(f"add_{key}", zero))
    if host:
        sites = _smoothed(known.withColumn("site", site_of(F.col("host"))), "site", root, SITE_WEIGHT, n)
        hosts = _smoothed(known, "host", sites, HOST_WEIGHT, n)
        out = salted(out, hosts, "host")
        terms.append(F.transform(F.coalesce("prior", root), lambda p: F.log(p)))
    else:
        terms.append(F.transform(root, lambda p: F.log(p)))
    sums = F.array(*[sum((t[i] for t in terms[1:]), terms[0][i]) for i in range(n)])
    out = out.withColumn("s", sums).withColumn("best", F.array_max("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(
        *[F.col(h).alias(o) for h, o in back], names[F.array_position("s", F.col("best")).cast("int") - 1].alias("lang"), (1 / total).alias("probability"),
        ((F.col("n") > 0) & (1 / total >= threshold)).alias("accepted"),
    )


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """All documents (host: their source) and all pages (with markup language, address suffix and host)."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))
    web = pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", visible_text(F.col("html")).alias("text"), declared_of(F.col("html")).alias("declared"),
        suffix_of(F.col("url")).alias("suffix"), host_of(F.col("url")).alias("host"),
    )
    out = language_id(rows.unionByName(web), fit(docs), ("doc_id", "page_id"), "text", "declared", "suffix", "host")
    return out.select("doc_id", "page_id", "lang", F.round("probability", 4).alias("probability"), "accepted")
