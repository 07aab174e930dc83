"""Disc images seen as folders of DSF files: what is listed, how large it is, and which bytes a read touches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaspark.functions import audio, text
from sigmaspark.sinks.audio import _tracks, dsf_blocks, dsf_header
from sigmaspark.sources.files import put
from sigmaspark.sources.sacd import Image, disc
from sigmaspark.sources.shared import bounded_batches

FOLDERS = {"stereo": "Stereo", "multichannel": "Multi-channel"}


@F.pandas_udf(T.BooleanType())
def _is_disc(path: pd.Series) -> pd.Series:
    def look(p: str) -> bool:
        try:
            with Image(p) as img:
                disc(img)
                return True
        except (ValueError, OSError):
            return False

    return path.map(look)


def catalogue(spark: SparkSession, folder: str, check: bool = False) -> DataFrame:
    """Files under a folder: path, size, name, is_image and shown_name, with names told apart in the order of paths.

    Only the files' metadata are read. Images become folders of their own name; the tag files
    beside them are left out. With ``check`` the tables of contents of images are read too, and
    files that only have an image's ending are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    name = text.basename(F.col("path"))
    files = files.withColumn("name", name).where(~F.lower("name").endswith(".iso.xml"))
    files = files.withColumn("is_image", F.lower("name").endswith(".iso"))
    if check:
        files = files.where(F.when(F.col("is_image"), _is_disc("path")).otherwise(True))
    shown = F.when(F.col("is_image"), F.regexp_replace("name", r"(?i)\.iso$", "")).otherwise(F.col("name"))
    files = files.withColumns({"folder": text.dirname(F.col("path")), "shown": shown})
    n = F.row_number().over(Window.partitionBy("folder", "shown").orderBy("path"))
    return files.select("path", F.col("length").alias("size"), "name", "is_image", F.when(n == 1, F.col("shown")).otherwise(F.format_string("%s (%d)", "shown", n)).alias("shown_name"))


def visible_areas(areas: DataFrame, hidden: list[str]) -> DataFrame:
    """Areas that are shown: those not hidden, and an image's only area in any case."""
    alone = F.count("*").over(Window.partitionBy("path")) == 1
    return areas.withColumn("_alone", alone).where(F.col("_alone") | ~F.col("area").isin(hidden)).drop("_alone")


def entries(tracks: DataFrame, areas: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """One row per track file: path, area, track, file_path and the sizes of its layout. ``tracks`` may have ``tag_bytes``."""
    t = tracks if "tag_bytes" in tracks.columns else tracks.withColumn("tag_bytes", F.lit(0).cast("long"))
    t = t.join(visible_areas(areas, hidden or []).select("path", "area", "channels"), ["path", "area"])
    folder = F.when(F.col("area") == "stereo", FOLDERS["stereo"]).otherwise(FOLDERS["multichannel"])
    name = F.concat(text.track_filename(F.col("track"), F.col("title"), F.col("performer")), F.lit(".dsf"))
    return t.select("path", "area", "track", F.concat_ws("/", folder, name).alias("file_path"), "frames", "channels", "tag_bytes", *(c.alias(k) for k, c in audio.dsf_layout(F.col("frames"), F.col("channels"), F.col("tag_bytes"), virtual=True).items()))


def regions(files: DataFrame) -> DataFrame:
    """Header, audio and tag of each file of ``entries``: region, begin, stop."""
    head = F.lit(audio.DSF_HEADER).cast("long")
    rows = F.array(
        F.struct(F.lit("header").alias("region"), F.lit(0).cast("long").alias("begin"), head.alias("stop")),
        F.struct(F.lit("audio").alias("region"), head.alias("begin"), (F.col("audio_bytes") + head).alias("stop")),
        F.struct(F.lit("tag").alias("region"), (F.col("audio_bytes") + head).alias("begin"), F.col("total").alias("stop")),
    )
    return files.select("path", "area", "track", F.explode(rows).alias("r")).select("path", "area", "track", "r.*").where("stop > begin")


def read_ranges(region_rows: DataFrame, offset: int, size: int) -> DataFrame:
    """Parts of the regions that a read of ``size`` bytes at ``offset`` touches: region, from, bytes (within the region)."""
    a, b = F.greatest("begin", F.lit(offset)), F.least("stop", F.lit(offset + size))
    return region_rows.where((F.col("begin") < offset + size) & (F.col("stop") > offset)).select("path", "area", "track", "region", (a - F.col("begin")).alias("from"), (b - a).alias("bytes"))


SILENCE = bytes([audio.SILENCE])
GROUP = 128  # frames of 4704 bytes a channel that make up whole blocks


def file_bytes(files: DataFrame, frames: DataFrame, rate: int = 2822400) -> DataFrame:
    """The bytes of each virtual file, in pieces: path, area, track, begin, data.

    ``files`` as from ``entries``, with the tag's bytes in ``tag`` (null or empty: none);
    ``frames``: path, area, track, frame_no (from 0 in each track) and payload; where they end
    before a file's sound does, silence follows. A piece holds
    the header, the blocks of ``GROUP`` frames, or the tag, so no block crosses two pieces.
    """
    key = ["path", "area", "track"]

    @F.pandas_udf("binary")
    def head(channels: pd.Series, frames: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series([dsf_header(int(c), rate, int(n) * audio.FRAME_BYTES * 8, -(-int(n) * audio.FRAME_BYTES // audio.DSF_BLOCK) * audio.DSF_BLOCK * int(c), int(t), virtual=True) for c, n, t in zip(channels, frames, tag)])

    def blocks(batches: Iterator[pa.RecordBatch]):
        for slot, own in _tracks(batches):
            rows = own("piece")
            next(rows)
            if slot["no"] >= 0:  # frames past the end of the file's sound
                for _ in rows:
                    pass
                continue
            piece, channels = slot["piece"], slot["channels"]
            sound = b"".join(dsf_blocks((r["payload"] for r in rows), channels))
            size = -(-slot["wanted"] * audio.FRAME_BYTES // audio.DSF_BLOCK) * audio.DSF_BLOCK * channels
            data = sound + SILENCE * (size - len(sound))  # a disc whose sound ends before its contents say
            begin = piece["group"] * GROUP * audio.FRAME_BYTES * channels + audio.DSF_HEADER
            columns = [pa.array([piece["path"]], pa.string()), pa.array([piece["area"]], pa.string()), *(pa.array([v], pa.int64()) for v in (piece["track"], begin)), pa.array([data], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "area", "track", "begin", "data"])

    tag = F.coalesce("tag", F.lit(b""))
    files = files.withColumn("tag", tag)
    heads = files.select(*key[:2], F.col("track").cast("long").alias("track"), F.lit(0).cast("long").alias("begin"), head(F.col("channels"), F.col("frames"), F.octet_length("tag")).alias("data"))
    tails = files.where(F.octet_length("tag") > 0).select(*key[:2], F.col("track").cast("long").alias("track"), (F.col("audio_bytes") + audio.DSF_HEADER).cast("long").alias("begin"), F.col("tag").alias("data"))
    piece = F.struct(*key[:2], F.col("track").cast("long").alias("track"), F.col("group")).alias("piece")
    slots = files.where("frames > 0").select(*key, "channels", F.col("frames").cast("long").alias("frames"), F.explode(F.sequence(F.lit(0).cast("long"), audio.quotient(F.col("frames") - 1, GROUP))).alias("group"))
    wanted = F.least(F.lit(GROUP), F.col("frames") - F.col("group") * GROUP)
    # What a piece needs comes before its frames, and these are streamed: no list of them is held.
    first = slots.select(piece, F.lit(-1).cast("long").alias("no"), F.col("channels").cast("int").alias("channels"), wanted.cast("int").alias("wanted"), F.lit(None).cast("binary").alias("payload"))
    none = F.lit(None).cast("int")
    rows = frames.withColumn("group", audio.quotient(F.col("frame_no"), GROUP)).select(piece, F.col("frame_no").cast("long").alias("no"), none.alias("channels"), none.alias("wanted"), "payload")
    # By a fixed number: partitions are merged by their compressed bytes otherwise, and sound may compress a hundredfold.
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(rows).repartition(n, "piece").sortWithinPartitions("piece", "no", "payload")
    sound = bounded_batches(dealt).mapInArrow(blocks, "path string, area string, track long, begin long, data binary")
    return heads.unionByName(sound).unionByName(tails)


def read_bytes(pieces: DataFrame, offset: int, size: int) -> DataFrame:
    """What a read of ``size`` bytes at ``offset`` gives from each file: its pieces (path, area, track, begin, data), cut to the range."""
    end = F.col("begin") + F.octet_length("data")
    low, high = F.greatest("begin", F.lit(offset)), F.least(end, F.lit(offset + size))
    cut = F.substring("data", (low - F.col("begin") + 1).cast("int"), (high - low).cast("int"))
    return pieces.where((F.col("begin") < offset + size) & (end > offset)).select("path", "area", "track", low.alias("begin"), cut.alias("data"))


def write_views(pieces: DataFrame, folder: str) -> DataFrame:
    """Virtual files as real ones, streamed piece by piece: rows (file, bytes)."""
    named = bounded_batches(pieces).withColumn("file", F.concat_ws("-", "path", "area", F.col("track").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]):
        for first, own in _tracks(batches):
            path = f"{folder}/{first['file']}.dsf"
            size = put(path, (r["data"] for r in own("file")))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["file", "bytes"])

    return named.select("file", "begin", "data").repartition("file").sortWithinPartitions("file", "begin").mapInArrow(run, "file string, bytes long")


def apply_writes(writes: DataFrame, files: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Writes to virtual files: ``accepted`` bytes (all are) and the ``tag`` that the file has after them, null if no write reached it.

    ``writes``: keys, ``seq``, offset and data; ``files``: keys and ``tag_begin``. Bytes before
    the tag's place are dropped; those behind it go to a buffer that starts empty, gaps are
    filled with zeros, later writes cover earlier ones.
    """
    at = F.greatest(F.col("offset") - F.col("tag_begin"), F.lit(0)).cast("int")
    skip = F.greatest(F.col("tag_begin") - F.col("offset"), F.lit(0)).cast("int")
    kept = F.when(skip < F.octet_length("data"), F.expr("substring(data, cast(greatest(tag_begin - offset, 0) as int) + 1)"))
    rows = writes.join(files.select(*keys, "tag_begin"), keys).select(*keys, F.octet_length("data").alias("size"), F.struct(F.col(seq).alias("seq"), at.alias("at"), kept.alias("data")).alias("w"))
    per = rows.groupBy(*keys).agg(F.sum("size").cast("long").alias("accepted"), F.array_sort(F.collect_list(F.when(F.octet_length("w.data") > 0, F.col("w")))).alias("writes"))

    def write(tag, w):
        gap = F.rpad(tag, F.greatest(w["at"], F.octet_length(tag)), F.lit(b"\0"))
        end = w["at"] + F.octet_length(w["data"])
        return F.concat(F.substring(gap, F.lit(1), w["at"]), w["data"], F.when(F.octet_length(gap) > end, F.substring(gap, end + 1, F.octet_length(gap) - end)).otherwise(F.lit(b"")))

    tag = F.aggregate("writes", F.lit(b""), write)
    return per.select(*keys, "accepted", F.when(F.size("writes") > 0, tag).alias("tag"))
