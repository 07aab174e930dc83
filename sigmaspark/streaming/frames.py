"""Frame streams with Structured Streaming: bounded batches, filters whose state crosses batches, idle images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigmaspark.operators.fir import byte_tables, runs_to_pcm


def frame_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """Frames from a folder of Parquet files; a batch takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def decimate_stream(frames: DataFrame, by: list[str], coef: list[float], step: int) -> DataFrame:
    """``pcm`` of each frame of a stream of (``by``, frame_no, payload) that comes in order of frames.

    The state of a track is the bytes that the next frame's filter looks back on.
    """
    h = np.asarray(coef, np.float64)
    need, tables = -(-(len(h) - 1) // 8), byte_tables(h)
    fields = ", ".join(f"{n} {t}" for n, t in frames.select(*by).dtypes)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = state.get[0] if state.exists else b""
        rows = pd.concat(list(parts)).sort_values("frame_no")
        payloads = rows["payload"].tolist()
        out = [x.tolist() for x in runs_to_pcm([(past, payloads)], [(h, step)], tables)[0]]  # a batch's frames of a track at once
        state.update(((past + b"".join(payloads))[-need:] if need else b"",))
        yield pd.DataFrame({**{n: [k] * len(out) for n, k in zip(by, key)}, "frame_no": rows["frame_no"].to_numpy(), "pcm": out})

    shape = f"{fields}, frame_no long, pcm array<double>"
    return frames.groupBy(*by).applyInPandasWithState(run, shape, "history binary", "append", GroupStateTimeout.NoTimeout)


def idle_stream(uses: DataFrame, image: str, ts: str, idle: str = "5 minutes", late: str = "1 minute") -> DataFrame:
    """Spans of use of each image, given once it has been idle for a time."""
    return uses.withWatermark(ts, late).groupBy(image, F.session_window(ts, idle)).agg(F.count("*").alias("uses")).select(image, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "uses")
