"""Shards by sampled splitters.

Rows are ordered by key and cut into shards of nearly equal bytes:

1. A size-weighted sample of rows (a row of s bytes is drawn with probability s * samples / total, by a
   hash of the row) gives quantile boundaries; rows are range-partitioned by them.
2. Exact bytes and rows of every range are added up.  A range over twice its share is subdivided at the
   quantiles of a finer sample of its own, until none is left or a round brings no new boundary (a single row
   may be larger).
3. A row's place is the sum of the ranges before it plus a running sum inside its range; its shard is the
   one that holds the middle of the row.  So shards differ from an equal share by less than one row,
   whatever the sample was, and the result depends on the rows alone.

Boundaries are whole rows: key, checksum, size and a salt that is drawn once and written, so a key with a third of
all rows, and one row with as many copies, are subdivided like all others.  The driver holds samples, boundaries and
one total per range (a range has some ROWS rows), never all rows.

Defined cases: a null text has size 1 and the checksum of an empty text; rows with a null key come last;
rows that repeat a key are ordered by checksum and size (equal ones may swap places); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import checkpointed

SHARDS = 16
#: Rows of a range, about; sampled rows for each; ranges for each shard at least; rounds of subdividing.
ROWS, SAMPLES, RANGES, ROUNDS = 500_000, 32, 8, 6
_KEY = ("none", "k", "crc", "size", "salt")


def _packed(none, k, crc, size, salt) -> np.ndarray:
    """Rows' keys as byte strings that sort as the rows do."""
    out = np.empty((len(k), 33), np.uint8)
    out[:, 0] = none
    for i, x in enumerate((k, crc, size, salt)):
        flipped = np.asarray(x).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1 + 8 * i : 9 + 8 * i] = flipped.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S33").ravel() if len(out) else np.zeros(0, "S33")


def _in_ranges(df: DataFrame, splitters: np.ndarray) -> DataFrame:
    """df with the range of each row: the number of splitters at or below it."""
    data = df.sparkSession.sparkContext.broadcast(splitters)  # 33 bytes a range

    def run(batches):
        for batch in batches:
            key = _packed(*(np.asarray(batch.column(batch.schema.get_field_index(c)).cast(pa.int64())) for c in _KEY))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(data.value, key, side="right"), pa.int32())], names=[*batch.schema.names, "range"])

    return df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", range int")


def _sample(df: DataFrame, rate: float) -> np.ndarray:
    """Rows drawn with probability min(1, size * rate), repeated by their weight where that is above one."""
    draw = F.pmod(F.xxhash64("k", "crc", "size", "salt", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = df.where(draw < F.col("size") * F.lit(rate)).select(*_KEY, F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(rate))).cast("long").alias("w")).toArrow()
    *key, weight = (np.asarray(rows[c].cast(pa.int64())) for c in (*_KEY, "w"))
    return np.sort(np.repeat(_packed(*key), weight))


def _quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts]) if len(keys) else keys


def shard_by_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, in key order over the shards.

    ranges: how many ranges to aim at, from the number of rows unless given."""
    at = checkpointed(_placed(docs, doc_id, text, shards, ranges))
    first = F.broadcast(at.groupBy("shard").agg(F.min("place").alias("first")))  # one row a shard
    return at.join(first, "shard").select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).alias("slot"))


def _placed(docs: DataFrame, doc_id: str, text: str, shards: int, ranges: int | None) -> DataFrame:
    """Every row with its range, its shard and its place in the order of all rows."""
    utf8 = F.coalesce(F.col(text).cast("string"), F.lit(""))
    spark = docs.sparkSession
    slim = checkpointed(docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_id).isNull().cast("int").alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k"),
        (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8.cast("binary")).alias("crc"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    ))
    total, count = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = ranges or max(RANGES * shards, -(-count // ROWS))
    rate = SAMPLES * ranges / max(total, 1)
    splitters = _quantiles(_sample(slim, rate), ranges)
    for round_ in range(ROUNDS):
        placed = _in_ranges(slim, splitters)
        totals = {r[0]: (r[1], r[2]) for r in placed.groupBy("range").agg(F.sum("size"), F.count("*")).collect()}
        over = {r: t for r, (t, _) in totals.items() if t > 2 * total / ranges}
        if not over or round_ == ROUNDS - 1:
            break
        finer = _sample(placed.where(F.col("range").isin(list(over))), rate * 4 ** (round_ + 1))
        where = np.searchsorted(splitters, finer, side="right")
        more = [_quantiles(finer[where == r], 2 * int(-(-t * ranges // max(total, 1)))) for r, t in over.items()]
        wider = np.unique(np.concatenate([splitters, *more]))
        if len(wider) == len(splitters):
            break
        splitters = wider
    before, rows, offsets = 0, 0, []
    for r in sorted(totals):
        offsets.append((r, before, rows))
        before, rows = before + totals[r][0], rows + totals[r][1]
    # One row a range: bounded by the number of splitters.
    base = F.broadcast(spark.createDataFrame(offsets or [(0, 0, 0)], "range int, before long, rows_before long"))
    w = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.withColumn("sum", F.sum("size").over(w)).withColumn("nth", F.row_number().over(w)).join(base, "range")
    shard = F.expr(f"CAST(least({shards - 1}, ((2 * (before + sum) - size) * {shards}) DIV {max(2 * total, 1)}) AS INT)")
    return at.select("doc_id", "size", "crc", "range", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of the text's bytes, by its table.
_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = _i >> 1 ^ (0xEDB88320 if _i & 1 else 0)
    _TABLE.append(_i)
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
             CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
                                  lambda a, b: xor(a >> 8, (CAST({_TABLE} AS BIGINT[]))[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS BIGINT) AS text_crc32 FROM d),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total,
             row_number() OVER (ORDER BY doc_id NULLS LAST, text_crc32, size) AS n FROM c),
t AS (SELECT *, CAST(least(15, ((2 * upto - size) * 16) // (2 * total)) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(n - min(n) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t
"""
