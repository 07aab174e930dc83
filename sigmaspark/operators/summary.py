"""Counts, progress, spans of use, gaps to fill and reads from a place on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmaspark.functions import audio


def totals(tracks: DataFrame, by: list[str], album: str, frames: Column) -> DataFrame:
    """``tracks``, ``albums``, ``frames`` and ``seconds`` of each group."""
    n = F.sum(frames)
    return tracks.groupBy(*by).agg(F.count("*").alias("tracks"), F.countDistinct(album).alias("albums"), n.alias("frames"), F.round(n / F.lit(float(audio.FRAMES_PER_SECOND)), 4).alias("seconds"))


def progress(frames: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """``done`` so far and its ``percent`` of the whole, for each frame."""
    w = Window.partitionBy(*by)
    out = frames.withColumn("done", F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("percent", F.round(F.lit(100.0) * F.col("done") / F.sum(size).over(w), 4))


def spans_of_use(uses: DataFrame, by: list[str], ts: str, at: str, idle: str) -> DataFrame:
    """Spans in which an image stays mounted: ``opened``, ``used`` (last) and ``uses``; it goes after it has been idle."""
    return uses.groupBy(*by, F.session_window(ts, idle)).agg(F.min(at).alias("opened"), F.max(at).alias("used"), F.count("*").alias("uses")).drop("session_window")


def fill_silence(frames: DataFrame, by: list[str], number: str, payload: str, upto: DataFrame, silence: Column) -> DataFrame:
    """Every frame from 1 to ``upto`` (``by`` and ``last``); those that are missing get ``silence``."""
    slots = upto.select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))).alias(number))
    return slots.join(frames, [*by, number], "left").withColumn(payload, F.coalesce(payload, silence))


def distinct_names(names: DataFrame, *cols: str) -> DataFrame:
    return names.select(*cols).distinct()


def read_from(frames: DataFrame, by: list[str], order: list[str], offset: int, count: int, origin: str = "start") -> DataFrame:
    """A bounded read of each track: ``count`` frames from ``offset`` on, with ``place`` from 0; with ``origin`` ``end`` the offset counts back from the end.

    An offset before the start reads from the start, one past the end reads nothing.
    """
    w = Window.partitionBy(*by)
    out = frames.withColumn("place", (F.row_number().over(w.orderBy(*order)) - 1).cast("long"))
    begin = F.lit(max(offset, 0)) if origin == "start" else F.greatest(F.count("*").over(w) - offset, F.lit(0))
    out = out.withColumn("_begin", begin)
    return out.where((F.col("place") >= F.col("_begin")) & (F.col("place") < F.col("_begin") + count)).drop("_begin")


def index_intervals(tracks: DataFrame, by: list[str], starts: str = "starts", length: str = "length") -> DataFrame:
    """Index points of tracks as intervals: ``index`` (0 is the gap before the track), ``start`` and ``end``, both counted in.

    ``starts`` is the array of index starts. An index ends before the next one; the last one is
    as long as the track, counted from its own start.
    """
    rows = tracks.select(*by, length, F.col(starts).alias("_starts"), F.posexplode(starts).alias("index", "start"))
    end = F.coalesce(F.get("_starts", F.col("index") + 1) - 1, F.col("start") + F.col(length) - 1)
    return rows.select(*by, "index", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))


def pauses(tracks: DataFrame, by: list[str], starts: str = "starts", length: str = "length") -> DataFrame:
    """``pause``: frames of a track's index 0; a track without index points has one frame, from 0 to 0."""
    first = F.get(F.col(starts), F.lit(0))
    end = F.coalesce(F.get(F.col(starts), F.lit(1)) - 1, first + F.col(length) - 1)
    return tracks.select(*by, F.when(F.size(starts) > 0, end + 1 - first).otherwise(F.lit(1)).cast("long").alias("pause"))


def delete_index(rows: DataFrame, by: list[str], idx: str, gone: DataFrame) -> DataFrame:
    """A marker or comment list without the entries that ``gone`` (``by`` and ``idx``) names, numbered anew; an index that isn't there is no error."""
    left = rows.join(gone.select(*by, idx).distinct(), [*by, idx], "left_anti")
    return left.withColumn(idx, (F.row_number().over(Window.partitionBy(*by).orderBy(idx)) - 1).cast("int"))


def append_index(rows: DataFrame, by: list[str], idx: str, new: DataFrame) -> DataFrame:
    """New entries at the end of each list, in the order of their own ``idx``."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn(idx, (F.row_number().over(Window.partitionBy(*by).orderBy("_new", idx)) - 1).cast("int")).drop("_new")
