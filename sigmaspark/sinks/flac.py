"""FLAC files, one per track, from rows of samples.

Source frames are put together to blocks of equal length by their number alone, so blocks are
coded in parallel, whatever track they belong to. Coded blocks and plain samples are stored once;
a track's digest and its totals come from that table, and its file is streamed in the order of
blocks, head first. A task that runs again replaces its own files.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmaspark.functions import flac
from sigmaspark.sources.files import patch_head, put
from sigmaspark.sources.shared import shared_dir, stored

from .audio import _tracks

DEFAULT_BITS, DEFAULT_LEVEL = 24, 5


def integers(samples: np.ndarray, bits: int) -> np.ndarray:
    """Samples of full scale 1 as integers: scaled, clamped, cut towards zero. The least one is reached, as in the format's range."""
    top = 2 ** (bits - 1) - 1
    return np.trunc(np.clip(samples * top, -top - 1, top)).astype(np.int64)


def packed(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian integers, over which a stream's digest is taken."""
    return np.ascontiguousarray(samples.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()


def vorbis_comments(album: dict[str, Column], track: dict[str, Column]) -> Column:
    """Comments of a track (array of key and value) from columns by the names below; empty values are left out."""

    def of(number: str, total: str, source: dict[str, Column]) -> Column:
        if number not in source:
            return F.lit(None).cast("string")
        n, t = source[number], source.get(total, F.lit(None).cast("int"))
        return F.when(n > 0, F.when(t > 0, F.concat_ws("/", n.cast("string"), t.cast("string"))).otherwise(n.cast("string")))

    none = F.lit(None).cast("string")
    year = album["year"] if "year" in album else none
    # Names of the comments, in the order in which they are written.
    pairs = [
        ("ALBUM", album.get("title", none)), ("ALBUMARTIST", album.get("artist", none)), ("GENRE", album.get("genre", none)), ("PUBLISHER", album.get("publisher", none)),
        ("COPYRIGHT", album.get("copyright", none)), ("DATE", F.when(year > 0, year.cast("string"))), ("TITLE", track.get("title", none)), ("ARTIST", track.get("performer", none)),
        ("COMPOSER", track.get("composer", none)), ("ARRANGER", track.get("arranger", none)), ("LYRICIST", track.get("songwriter", none)), ("COMMENT", track.get("message", none)),
        ("ISRC", track.get("isrc", none)), ("TRACKNUMBER", of("number", "total", track)), ("DISCNUMBER", of("disc", "discs", album)),
    ]
    every = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return F.filter(every, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def output_rate(rate: int) -> int:
    """A rate of 1-bit sound stands for the sample rate that it is converted to."""
    return rate // 32 if rate > 100_000 else rate


def blocks(pcm: DataFrame, bits: int, level: int, per: int, track: str = "track", order: str = "frame_no", samples: str = "pcm") -> DataFrame:
    """Coded blocks of ``per`` source frames each: track, block, frames, n (samples a channel), coded, plain, channels, rate."""

    @F.pandas_udf("struct<n:int,coded:binary,plain:binary>")
    def code(no: pd.Series, parts: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.DataFrame:
        rows = []
        for b, p, ch, r in zip(no, parts, channels, rate, strict=True):
            x = integers(np.concatenate([np.asarray(y, np.float64) for y in p]), bits).reshape(-1, ch)
            rows.append((len(x), flac.encode_frame(x.T, b, output_rate(r), bits, level) if len(x) else b"", packed(x.ravel(), bits)))
        return pd.DataFrame(rows, columns=["n", "coded", "plain"])

    block = F.floor(F.col(order) / per).cast("long")
    got = pcm.groupBy(F.col(track).alias("track"), block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(samples).alias("x")))).alias("parts"), F.first("channels").alias("channels"), F.first("rate").alias("rate"), F.count("*").alias("frames")
    )
    coded = got.select("track", "block", "frames", "channels", "rate", code("block", F.transform("parts", lambda x: x["x"]), "channels", "rate").alias("c"))
    return coded.select("track", "block", "frames", "channels", "rate", "c.*").where("n > 0")


def write_flac(path: str, sound: Iterator, channels: int, rate: int, bits: int = DEFAULT_BITS, level: int = DEFAULT_LEVEL, tags: list[tuple[str, str]] | None = None, block: int = 4096) -> int:
    """One file from pieces of interleaved samples, block after block; samples a channel. Its head is known at the end and set by copying."""
    held, n, no, sizes, md5 = np.empty(0, np.int64), 0, 0, [], hashlib.md5()
    said = flac.comments(tags or [])

    def head() -> bytes:
        return flac.stream_head(flac.stream_info(block, min(sizes, default=0), max(sizes, default=0), output_rate(rate), channels, bits, n, md5.digest() if sizes else bytes(16)), said)

    def coded(x: np.ndarray) -> bytes:
        nonlocal n, no
        md5.update(packed(x, bits))
        data = flac.encode_frame(x.reshape(-1, channels).T, no, output_rate(rate), bits, level)
        sizes.append(len(data))
        n, no = n + len(x) // channels, no + 1
        return data

    def chunks():
        nonlocal held
        yield head()
        for piece in sound:
            held = np.concatenate([held, integers(np.asarray(piece, np.float64), bits)])
            while len(held) >= block * channels:
                yield coded(held[: block * channels])
                held = held[block * channels :]
        if len(held):
            yield coded(held)

    put(path, chunks())
    patch_head(path, head())
    return n


def write_flacs(pcm: DataFrame, folder: str, bits: int = DEFAULT_BITS, level: int = DEFAULT_LEVEL, per: int = 4, track: str = "track", order: str = "frame_no", samples: str = "pcm", tags: DataFrame | None = None, scratch: str | None = None) -> DataFrame:
    """One file per track from rows (track, frame_no from 0, channels, rate, pcm as interleaved samples): rows (track, path, samples, written).

    All source frames of a track but the last must have the same length. ``tags``: track and
    ``comments`` (array of key and value, see ``vorbis_comments``). Word lengths other than 16 and
    24 count as 24, levels outside 0 to 8 as 5. The result writes when it is evaluated; evaluate it once.
    """
    bits = bits if bits in (16, 24) else DEFAULT_BITS
    level = level if 0 <= level <= 8 else DEFAULT_LEVEL
    scratch = scratch or shared_dir(pcm.sparkSession)
    ready = stored(blocks(pcm, bits, level, per, track, order, samples), f"{scratch}/blocks")
    ends = ready.groupBy("track").agg(F.max("block").alias("_last"))
    whole = ready.join(ends, "track")
    size = F.octet_length("coded")
    totals = whole.groupBy("track").agg(
        F.sum("n").cast("long").alias("_samples"), F.max("n").alias("_block"), F.min(F.when(F.col("block") < F.col("_last"), F.col("n"))).alias("_least"),
        F.count("*").alias("_count"), F.max("_last").alias("_end"), F.min(size).alias("_small"), F.max(size).alias("_large"), F.countDistinct("channels", "rate").alias("_kinds"),
    )

    def digest(batches):
        for first, own in _tracks(batches):
            md5 = hashlib.md5()
            for r in own("track"):
                md5.update(r["plain"])
            yield pa.RecordBatch.from_arrays([pa.array([str(first["track"])]), pa.array([md5.digest()], pa.binary())], names=["key", "_md5"])

    key = F.col("track").cast("string")
    digests = ready.select(key.alias("track"), "block", "plain").repartition("track").sortWithinPartitions("track", "block").mapInArrow(digest, "key string, _md5 binary")
    heads = totals.withColumn("key", key).join(digests, "key").drop("key")
    if tags is not None:
        heads = heads.join(tags.select(F.col(track).alias("track"), F.col("comments").alias("_tags")), "track", "left")
    else:
        heads = heads.withColumn("_tags", F.array().cast("array<struct<key:string,value:string>>"))
    dealt = ready.drop("plain").repartition("track").join(heads, "track").sortWithinPartitions("track", "block")

    def write(batches):
        for first, own in _tracks(batches):
            if first["_kinds"] > 1 or first["_count"] != first["_end"] + 1 or (first["_least"] or first["_block"]) != first["_block"]:
                raise ValueError(f"track {first['track']}: frames of different kinds or lengths, or missing ones")
            info = flac.stream_info(max(first["_block"], 16), first["_small"], first["_large"], output_rate(first["rate"]), first["channels"], bits, first["_samples"], first["_md5"])
            path = f"{folder}/{first['track']}.flac"

            def chunks(info=info, first=first, own=own):
                yield flac.stream_head(info, flac.comments([(t["key"], t["value"]) for t in first["_tags"] or []]))
                for r in own("track"):
                    yield r["coded"]

            written = put(path, chunks())
            yield pa.RecordBatch.from_arrays([pa.array([str(first["track"])]), pa.array([path]), pa.array([first["_samples"]], pa.int64()), pa.array([written], pa.int64())], names=["track", "path", "samples", "written"])

    return dealt.mapInArrow(write, "track string, path string, samples long, written long")
