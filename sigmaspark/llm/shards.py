"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows are put in one global order. They are dealt to range partitions of it, each partition's
bytes and rows are added up, and the running sums of these totals say where a partition begins in
the whole. Inside a partition a running window gives each row its place. With ``T`` bytes in all
and ``n`` shards, a row goes to the shard in which the middle of its bytes falls, when ``[0, T)``
is cut into ``n`` equal parts: shards are contiguous, and each cut misses its target by half a row
at most.

The default order is that of the texts' checksum and then the id, so that equal texts stand side
by side and share a shard unless a cut falls among them, and shards don't take over an order by
time or source. Ties are broken by a number of the stored row, so a key that holds a third of all
rows, or one row repeated many times, is spread over as many partitions as its rows need.

What passes through one task is a row for each range partition (the prefix sums) and one for each
shard; both are broadcast, as their numbers don't depend on the table. Rows are narrow where the
caller wants no text: ``place`` carries the columns it is given and nothing else.

Defined results: a null text has no bytes and the checksum of the empty text; a null id sorts
first; repeated rows get slots of their own; an empty table gives no rows; shards may stay empty
when there are fewer rows than shards. Extra columns are passed on, but for those added, which
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, stored

SHARDS = 24
OVERHEAD = 8  # bytes that a row takes besides its text
ADDED = ("size", "text_crc32", "shard", "slot")


def sized(df: DataFrame, text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """``df`` with ``size`` (UTF-8 bytes of the text and ``overhead``) and ``text_crc32``."""
    data = F.coalesce(F.col(f"`{text}`").cast("string").cast("binary"), F.lit(b""))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in ADDED[:2]), (F.octet_length(data).cast("long") + overhead).alias("size"), F.crc32(data).alias("text_crc32"))


def place(df: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("text_crc32", "doc_id"), size: str = "size", path: str | None = None) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (a row's number in its shard, from 0), stored."""
    path = path or shared_dir(df.sparkSession)
    names = [c for c in df.columns if c not in ADDED[2:]]
    rows = stored(df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), F.col(f"`{size}`").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie")), f"{path}/rows")
    keys = [*(f"k{i}" for i in range(len(order))), "tie"]
    ranged = stored(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), f"{path}/ranged")
    totals = ranged.groupBy("part").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    starts = totals.select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("b").over(every).alias("total"))
    within = W.partitionBy("part").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranged.withColumns({"upto": F.sum("bytes").over(within), "nth": F.count("*").over(within)}).join(F.broadcast(starts), "part")
    # The middle of the row, doubled to stay whole: its last byte's end minus half its bytes.
    middle = (F.col("b0") + F.col("upto")) * 2 - F.col("bytes")
    placed = placed.select("row", F.least(_div(middle * shards, F.col("total") * 2), F.lit(shards - 1)).cast("int").alias("shard"), (F.col("n0") + F.col("nth") - 1).alias("index"))
    placed = stored(placed, f"{path}/placed")
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    out = placed.join(F.broadcast(firsts), "shard")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "shard", (F.col("index") - F.col("first")).alias("slot"))


def _div(a: Column, b: Column) -> Column:
    """Whole division; 0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, b))


def write(df: DataFrame, path: str, shards: int = SHARDS, text: str = "text", key: str = "doc_id") -> None:
    """``df`` as Parquet under ``path``, a folder ``shard=k`` for each shard; its files together hold the slots in any order."""
    place(sized(df, text), shards, ("text_crc32", key)).write.partitionBy("shard").parquet(path)


def report(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot and grown_shard (null: this law has no such promise)."""
    out = place(sized(df.select("doc_id", "text")).drop("text"), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The checksum byte by byte, with the polynomial of crc32 reflected.
_STEP = "xor(c >> 1, (c & 1) * 3988292384)"
_TABLE = "list_transform(range(256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: " + _STEP + "))"
SQL = f"""
WITH t AS (SELECT {_TABLE} AS tab),
b AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents
), s AS (
  SELECT doc_id, len(bytes)::BIGINT + {OVERHEAD} AS size,
         xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM b, t
), p AS (
  SELECT *, sum(size) OVER (ORDER BY text_crc32, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM s
), q AS (SELECT *, least((2 * upto - size) * {SHARDS} // (2 * total), {SHARDS - 1})::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY text_crc32, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM q
"""
