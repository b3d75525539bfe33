"""From raw documents to encoded, deduplicated, decontaminated ones: five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages the rows are written as Parquet, so each works on all that its predecessor
kept and a lost executor costs at most one stage.

Language ID, near copies and leaks are decided by row: each of these stages numbers the rows of its input, so
rows without an id and rows that repeat one are judged like all others.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.tables import shared_folder
from . import decontaminate as _bench
from . import language_id as _lang
from . import near_copies as _near
from . import sentencepiece_backend as _pieces
from . import simhash as _simhash
from . import suffix_dedup as _suffix
from .components import checkpointed, components

#: Rows to drop are broadcast up to this number (8 bytes each); beyond it they meet the rows in a shuffle.
BROADCAST_IDS = 1_000_000


def small_heaps(spark: SparkSession) -> None:
    """Has the executors collect their garbage: a heap gives memory back to the system only then, and what one stage has
    left of it unused would stand beside the Python workers of the next."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("x")).write.format("noop").mode("overwrite").save()


def _with_small_heaps(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, the same wherever it is used: files that are read as they are give the same rows in
    the same order each time; anything else is written once."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    files_alone = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return rows if files_alone else checkpointed(rows)


def _without(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """Numbered rows but those whose numbers (the first column of drop) are given, without numbers."""
    drop = checkpointed(drop.select(F.col(drop.columns[0]).alias("__drop")).distinct())
    small = drop.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(drop) if small else drop.hint("merge"), rows["__row"] == drop["__drop"], "left_anti").drop("__row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or none that is more likely than all others together.

    Without labelled documents there is no model, and none is rejected."""
    model = _lang.fit(docs)
    if not model.languages:
        return docs
    rows = _numbered(docs)
    judged = _lang.language_id(rows, model, ("__row",), text="text", host="source")
    return _without(rows, judged.where("NOT accepted").select("__row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each component of near copies (null ids last, one row of equal ids).

    Two documents are near copies if op8's fingerprints are within its radius, or if the Jaccard similarity of
    their five-word shingles is at least 0.8, which a radius does not decide."""
    rows = _numbered(docs)
    members = checkpointed(_components(rows, "__row").join(rows.select("__row", "doc_id"), "__row"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    return _without(rows, members.join(first, "component_id").where("__row <> first.__row").select("__row"))


def _components(docs: DataFrame, key: str) -> DataFrame:
    """(key, component_id) over links of fingerprints and of shingle sets; component_id is the smallest key."""
    prints = _simhash.simhash_dedup(docs, key).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    sets = _near.near_copies(docs, key).select(F.col("key").alias("a"), F.col("group").alias("b"))
    found = components(prints.unionByName(sets).where("a <> b"))
    return found.select(F.col("node").alias(key), F.col("root").alias("component_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes of 50-byte strings that documents with smaller ids hold; documents left empty by it go.

    A character that a cut leaves incomplete goes too, and nothing else; n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    hidden = tuple(f"__{i}" for i in range(len(others)))  # no clash with the operator's columns
    rows = docs.select("doc_id", "text", *[F.col(c).alias(h) for c, h in zip(others, hidden)])
    out = _suffix.suffix_array_dedup(rows, carry=hidden, characters=True).where("NOT (n_bytes > 0 AND n_removed = n_bytes)")
    out = out.select("doc_id", F.col("kept").cast("string").alias("text"), *[F.col(h).alias(c) for c, h in zip(others, hidden)])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain at least 0.8 of a benchmark item's shingles."""
    rows = _numbered(docs)
    leaks = _bench.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__row")
    return _without(rows, leaks.select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with parity and the decoded text."""
    return _pieces.sentencepiece_encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("sentencepiece", encode),
]
STAGES = [(name, _with_small_heaps(stage)) for name, stage in STAGES]
#: SimHash needs XXH64 and language ID a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written and read again; a stage's table goes when the next one
    is written, the last one stays, since the result is read from it."""
    folder = files.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.remove(spark, before)
        before = f"{folder}/{name}"
    return docs
