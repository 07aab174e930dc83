"""Where jobs put files that the driver and all executors must reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the cluster sets; a local session without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_shared_base", None)
        if base is None:
            base = spark._shared_base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


BATCH_BYTES = 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bound the bytes of an Arrow batch, a setting of the session: pieces and frames are large, and batches are counted in rows otherwise."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet into a shared folder and read it again: what is read twice is worked out once, and lost executors cost their tasks only."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
