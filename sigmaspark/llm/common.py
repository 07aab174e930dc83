"""Helpers shared by the training-data operators: tables, shared storage, connected components."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and every executor can reach.

    It lies under ``spark.checkpoint.dir``, which the cluster sets. Where that is unset, a local
    session, as in tests, gets a temporary folder; any other fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_local_shared_dir", None)
        if base is None:
            base = spark._local_shared_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    made_dirs(spark).append(path)
    return path


def made_dirs(spark: SparkSession) -> list[str]:
    """The folders that ``shared_dir`` has named in this session."""
    if not hasattr(spark, "_made_dirs"):
        spark._made_dirs = []
    return spark._made_dirs


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet into a shared folder and read it again: a cut of lineage that survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HOT_SHARE, HOT_LEAST, SALTS = 1000, 1000, 64
HOT_ROWS = 100_000  # rows of hot keys that may be broadcast; beyond that they are salted


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """Of ``counts`` (keys and ``_m``, their rows), the keys that hold over 1/HOT_SHARE of all rows and over HOT_LEAST.

    They are at most HOT_SHARE however much a table grows; None if there are none.
    """
    if total <= HOT_LEAST:
        return None
    found = counts.where(F.col("_m") > max(total // HOT_SHARE, HOT_LEAST)).select(*keys).collect()
    return counts.sparkSession.createDataFrame(found, counts.select(*keys).schema) if found else None


def spread_join(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner", weight: str | None = None, salt: str | None = None, many: bool = False, total: int | None = None) -> DataFrame:
    """Join on keys that may be hot in ``left``: rows of hot keys stay where they are and meet a broadcast.

    ``left`` is read more than once, so it should be a stored table. The hot keys are at most
    HOT_SHARE, and ``right`` has one row a key, so what is broadcast is bounded; where it may have
    ``many``, the hot keys' rows are counted, and beyond HOT_ROWS dealt too.
    ``weight`` names a column of ``right`` with the number of rows of ``left`` under its key;
    without it they are counted; ``total`` is the sum of these numbers, if it is known. Where rows of ``right`` are large, ``salt`` names a column of
    ``left`` by which hot keys are dealt instead, to ``SALTS`` copies of their rows of ``right``.
    ``how``: inner or left.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if weight:
        total = (right.agg(F.sum(weight)).first()[0] or 0) if total is None else total
        hot = hot_keys(right.select(*keys, F.col(weight).alias("_m")), keys, total)
    else:
        hot = hot_keys(left.groupBy(*keys).agg(F.count("*").alias("_m")), keys, left.count())
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    much, few = left.join(hot, keys, "left_semi"), right.join(hot, keys, "left_semi")
    if salt or many and few.limit(HOT_ROWS + 1).count() > HOT_ROWS:
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = much.withColumn("_salt", F.pmod(F.xxhash64(salt) if salt else F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(few, [*keys, "_salt"], how).drop("_salt")
    else:
        spread = much.join(F.broadcast(few), keys, how)
    return spread.unionByName(left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys, how))


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """Bound what one Arrow batch holds, as texts can be very long."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return df


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, path: str) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: rows (node, component), the smallest reachable node.

    Alternates large-star and small-star contraction; edges of a node of very many stay spread, so
    that no node gathers its component in one task, and a chain of length n needs about log n rounds; every round is written to the
    shared folder, and the one before it is removed. It ends when a round changes nothing. Nodes without an edge to another node do not appear.
    """
    spark = edges.sparkSession
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur = stored(cur, f"{path}/e0")
    state, size = None, cur.count()
    for i in itertools.count(1):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))
        large = spread_join(both, low, "u", weight="degree", total=2 * size).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(cur.select("u", "v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stored(small.where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct(), f"{path}/e{i}")
        forget(spark, f"{path}/e{i - 1}")
        total = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == state:
            break
        state, size = total, total[0]
    roots = cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("component").alias("node"), "component").distinct()).distinct()
