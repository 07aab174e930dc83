"""Writers of audio files, one per track: DSF, DSDIFF and WAV.

Sizes are added up per track first; frames are then dealt by track and sorted, and each task
streams its tracks to the store, header first, so a track is neither held in memory nor written
twice. A task that runs again replaces its own files.
"""

from __future__ import annotations

import inspect
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sigmaspark.sources.files import REVERSED, Bytes, patch_head, put
from sigmaspark.sources.shared import bounded_batches, stored

BLOCK = 4096
START, STOP, PROGRAM_START = 0, 1, 2  # fixed values: kinds of markers
CHANNEL_TYPES = {1: 1, 2: 2, 3: 3, 4: 4, 5: 6, 6: 7}
CHANNEL_IDS = {1: ["C"], 2: ["SLFT", "SRGT"], 3: ["MLFT", "MRGT", "C"], 4: ["MLFT", "MRGT", "LS", "RS"], 5: ["MLFT", "MRGT", "C", "LS", "RS"], 6: ["MLFT", "MRGT", "C", "LFE", "LS", "RS"]}


def dsf_header(channels: int, rate: int, samples: int, audio: int, tag: int, virtual: bool = False) -> bytes:
    """A virtual file's header tells where a tag goes even if there is none yet."""
    total = 92 + audio + tag
    return (
        b"DSD " + struct.pack("<QQQ", 28, total, 92 + audio if tag or virtual else 0)
        + b"fmt " + struct.pack("<QIIIIIIQII", 52, 1, 0, CHANNEL_TYPES[channels], channels, rate, 1, samples, BLOCK, 0)
        + b"data" + struct.pack("<Q", audio + 12)
    )


def dsf_blocks(payloads: Iterator[bytes], channels: int) -> Iterator[bytes]:
    """Interleaved bytes as blocks per channel, bits reversed, the last ones filled with zeros."""
    held = np.empty((0, channels), np.uint8)
    for p in payloads:
        held = np.concatenate([held, np.frombuffer(p, np.uint8).reshape(-1, channels)])
        whole = len(held) // BLOCK
        if whole:
            part = REVERSED[held[: whole * BLOCK]]
            yield np.ascontiguousarray(part.reshape(whole, BLOCK, channels).transpose(0, 2, 1)).tobytes()
            held = held[whole * BLOCK :]
    if len(held):
        last = np.zeros((BLOCK, channels), np.uint8)
        last[: len(held)] = REVERSED[held]
        yield np.ascontiguousarray(last.T).tobytes()


@dataclass(frozen=True)
class Sizes:
    """What a track's payloads come to: their bytes, the bytes of chunks that hold one each, and how many there are."""

    bytes: int
    chunked: int
    count: int


def _put_headed(path: str, head: Callable[[Sizes], bytes], body: Callable[[Iterator[bytes]], Iterator[bytes]], payloads: Iterator[bytes], sizes: Sizes | None) -> Sizes:
    """Write head and body; without sizes the head is set once they are known, which copies the file."""
    n = [0, 0, 0]

    def counted():
        for p in payloads:
            n[0], n[1], n[2] = n[0] + len(p), n[1] + 12 + len(p) + len(p) % 2, n[2] + 1
            yield p

    def chunks():
        yield head(sizes or Sizes(0, 0, 0))
        yield from body(counted())

    put(path, chunks())
    got = Sizes(*n)
    if sizes is None:
        patch_head(path, head(got))
    elif sizes != got:
        raise ValueError(f"{path}: {got} written, {sizes} announced")
    return got


def write_dsf(path: str, payloads: Iterator[bytes], channels: int, rate: int, tag: bytes = b"", sizes: Sizes | None = None) -> int:
    """One DSF file; the number of samples per channel."""

    def head(n: Sizes) -> bytes:
        per = n.bytes // channels
        return dsf_header(channels, rate, per * 8, -(-per // BLOCK) * BLOCK * channels, len(tag))

    def body(p: Iterator[bytes]) -> Iterator[bytes]:
        yield from dsf_blocks(p, channels)
        yield tag

    return _put_headed(path, head, body, payloads, sizes).bytes // channels * 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return kind + struct.pack(">Q", len(data)) + data + b"\0" * (len(data) % 2)


def marker(position: int, rate: int, mark: int, text: str = "", offset: int = 0, channel: int = 0, flags: int = 0) -> bytes:
    seconds, samples = divmod(position, rate)
    raw = text.encode()
    return chunk(b"MARK", struct.pack(">HBBIiHHHI", seconds // 3600, seconds // 60 % 60, seconds % 60, samples, offset, mark, channel, flags, len(raw)) + raw)


def _dsdiff_head(channels: int, rate: int, compression: bytes) -> bytes:
    ids = b"".join(c.encode().ljust(4) for c in CHANNEL_IDS[channels])
    names = {b"DSD ": b"not compressed", b"DST ": b"DST Encoded"}[compression]
    prop = b"SND " + chunk(b"FS  ", struct.pack(">I", rate)) + chunk(b"CHNL", struct.pack(">H", channels) + ids) + chunk(b"CMPR", compression + bytes([len(names)]) + names)
    return b"DSD " + chunk(b"FVER", bytes([1, 5, 0, 0])) + chunk(b"PROP", prop)


def diin(markers: list[bytes] | None = None, artist: str | None = None, title: str | None = None) -> bytes:
    lines = b"".join(chunk(k, struct.pack(">I", len(v.encode())) + v.encode()) for k, v in ((b"DIAR", artist), (b"DITI", title)) if v)
    return chunk(b"DIIN", lines + b"".join(markers or [])) if lines or markers else b""


def write_dsdiff(path: str, payloads: Iterator[bytes], channels: int, rate: int, markers: list[bytes] | None = None, artist: str | None = None, title: str | None = None, dst: bool = False, sizes: Sizes | None = None, tail: Callable[[], bytes] | None = None, tail_bytes: int = 0) -> int:
    """One DSDIFF file of raw or DST frames; bytes of audio (raw) or number of frames (DST).

    ``tail`` gives chunks that are known after the sound only, ``tail_bytes`` their size.
    """
    start = _dsdiff_head(channels, rate, b"DST " if dst else b"DSD ")
    end = diin(markers, artist, title)

    def head(n: Sizes) -> bytes:
        sound = 18 + n.chunked if dst else n.bytes
        rest = (12 + 12 * n.count if dst else n.bytes % 2) + len(end) + tail_bytes
        out = b"FRM8" + struct.pack(">Q", len(start) + 12 + sound + rest) + start + (b"DST " if dst else b"DSD ") + struct.pack(">Q", sound)
        return out + (chunk(b"FRTE", struct.pack(">IH", n.count, 75)) if dst else b"")

    def body(payloads: Iterator[bytes]) -> Iterator[bytes]:
        at, index, n = 12 + len(start) + 12 + 18, [], 0
        for p in payloads:
            n += len(p)
            if dst:
                index.append((at + 12, len(p)))
                at += 12 + len(p) + len(p) % 2
            yield chunk(b"DSTF", p) if dst else p
        if dst:
            yield chunk(b"DSTI", b"".join(struct.pack(">QI", *x) for x in index))
        elif n % 2:
            yield b"\0"
        yield end
        if tail:
            yield tail()

    got = _put_headed(path, head, body, payloads, sizes)
    return got.count if dst else got.bytes


def write_dsdiff_dst(path: str, payloads: Iterator[bytes], channels: int, rate: int, sizes: Sizes | None = None) -> int:
    """``write_dsdiff`` of DST frames."""
    return write_dsdiff(path, payloads, channels, rate, dst=True, sizes=sizes)


def pack_pcm(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian integers of samples of full scale 1: scaled, clamped, cut towards zero."""
    top = 2 ** (bits - 1) - 1
    v = np.trunc(np.clip(samples * top, -top - (bits == 16), top)).astype("<i4")
    return v.astype("<i2").tobytes() if bits == 16 else v.tobytes() if bits == 32 else v.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def write_wav(path: str, payloads: Iterator[np.ndarray], channels: int, rate: int, bits: int = 24, info: dict[str, str] | None = None, samples: int | None = None) -> int:
    """One WAV file from interleaved samples, whose number over all channels is ``samples``; ``info``: four-letter keys of its LIST chunk."""
    size = 0

    def listed() -> bytes:
        items = b"".join(k.encode() + struct.pack("<I", len(v.encode()) + 1) + v.encode() + b"\0" * (1 + (len(v.encode()) + 1) % 2) for k, v in (info or {}).items() if v)
        return b"LIST" + struct.pack("<I", len(items) + 4) + b"INFO" + items if items else b""

    align, extra = channels * bits // 8, listed()

    def head(size: int) -> bytes:
        total = 44 + size + size % 2 + len(extra)
        return b"RIFF" + struct.pack("<I", total - 8) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * align, align, bits) + b"data" + struct.pack("<I", size)

    def chunks():
        nonlocal size
        yield head((samples or 0) * bits // 8)
        for p in payloads:
            data = pack_pcm(np.asarray(p, np.float64), bits)
            size += len(data)
            yield data
        yield b"\0" * (size % 2) + extra

    put(path, chunks())
    if samples is None:
        patch_head(path, head(size))
    elif size != samples * bits // 8:
        raise ValueError(f"{path}: {size} bytes written, {samples} samples announced")
    return size


def write_wavs(pcm: DataFrame, folder: str, bits: int = 24, track: str = "track", order: str = "frame_no", samples: str = "pcm", info: dict[str, str] | None = None) -> DataFrame:
    """One WAV file per track from rows of interleaved samples (array<double>), channels and rate: rows (track, path, written)."""
    totals = pcm.groupBy(track).agg(F.sum(F.size(samples)).alias("_samples"))
    # Dealt before the join: a shuffle after it, by the same key, is left out, and a join that turns into a broadcast reads its own shuffle in other parts.
    dealt = pcm.repartition(track).join(totals, track).select(track, samples, "channels", "rate", "_samples", order).sortWithinPartitions(track, order)

    def run(batches):
        for first, own in _tracks(batches):
            path = f"{folder}/{first[track]}.wav"
            written = write_wav(path, (r[samples] for r in own(track)), first["channels"], first["rate"], bits, info, first["_samples"])
            yield pa.RecordBatch.from_arrays([pa.array([str(first[track])]), pa.array([path]), pa.array([written], pa.int64())], names=["track", "path", "written"])

    return dealt.mapInArrow(run, "track string, path string, written long")


def _dealt(frames: DataFrame, track: str, order: list[str], more: list[str]) -> DataFrame:
    """Frames dealt by track and sorted, each with the sizes of its track."""
    size = F.octet_length("payload").cast("long")
    sizes = frames.groupBy(track).agg(F.sum(size).alias("_bytes"), F.sum(size + size % 2 + 12).alias("_chunked"), F.count("*").alias("_count"))
    rows = frames.repartition(track).join(sizes, track).select(track, "payload", "channels", "rate", "_bytes", "_chunked", "_count", *order, *more)
    return rows.sortWithinPartitions(track, *order)


def _tracks(batches: Iterator[pa.RecordBatch]):
    """(first row, its rows) of each track; the rows of one must be used up before the next."""
    rows = (dict(zip(b.schema.names, r)) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    row = next(rows, None)
    while row is not None:
        first = row

        def own(key: str):
            nonlocal row
            while row is not None and row[key] == first[key]:
                yield row
                row = next(rows, None)

        yield first, own


def write_tracks(frames: DataFrame, folder: str, write: Callable[..., int], ending: str, track: str = "track", order: str = "frame_no", more: list[str] | None = None) -> DataFrame:
    """Write one file per track from ``track``, ``order``, channels, rate and payload: rows (track, path, written).

    ``write`` is called with path, payloads, channels, rate, the track's own values of the columns
    ``more``, by name, and ``sizes`` if it takes them. The result writes when it is evaluated;
    evaluate it once.
    """
    more = more or []
    sized = "sizes" in inspect.signature(write).parameters

    def run(batches):
        for first, own in _tracks(batches):
            path = f"{folder}/{first[track]}{ending}"
            sizes = Sizes(first["_bytes"], first["_chunked"], first["_count"])
            written = write(path, (r["payload"] for r in own(track)), first["channels"], first["rate"], **{k: first[k] for k in more}, **({"sizes": sizes} if sized else {}))
            yield pa.RecordBatch.from_arrays([pa.array([str(first[track])]), pa.array([path]), pa.array([written], pa.int64())], names=["track", "path", "written"])

    return _dealt(frames, track, [order], more).mapInArrow(run, "track string, path string, written long")


PART = 1024  # frames of a track that are written as one part of an album


def _parts(frames: DataFrame, folder: str, by: list[str], order: str, more: list[str]) -> DataFrame:
    """Frames written in parts of ``PART`` numbers: rows (``by``, _block, ``more``, _part, _sizes, _bytes, _chunked, _count), so that an album's frames are never sorted in one task."""
    rows = frames.select(*by, F.floor(F.col(order) / PART).cast("long").alias("_block"), order, "payload", *more)
    key = [*by, "_block"]
    shape = rows.select(*key, *more).schema.add("_part", "string").add("_sizes", T.ArrayType(T.IntegerType())).add("_bytes", "long").add("_chunked", "long").add("_count", "long")

    def run(batches):
        held: list[dict] = []

        def flush():
            sizes = [len(r["payload"]) for r in held]
            path = f"{folder}/{uuid.uuid4().hex}.part"
            put(path, (r["payload"] for r in held))
            own = {c: held[0][c] for c in [*key, *more]}
            row = own | {"_part": path, "_sizes": sizes, "_bytes": sum(sizes), "_chunked": sum(n + n % 2 + 12 for n in sizes), "_count": len(sizes)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(shape))

        for b in batches:
            for r in b.to_pylist():
                if held and any(held[0][c] != r[c] for c in key):
                    yield flush()
                held.append(r)
        if held:
            yield flush()

    dealt = rows.repartition(*key).sortWithinPartitions(*key, order)
    return stored(bounded_batches(dealt).mapInArrow(run, shape), f"{folder}/rows")


def write_edit_masters(frames: DataFrame, folder: str, album: str = "album", position: str = "position", order: str = "frame_no", name: str | None = None) -> DataFrame:
    """One DSDIFF file per album with all its selected tracks in the order of ``position``: rows (album, path, tracks, written).

    The file has a program start at 0 and a start (with the track's ``title``) and a stop for each
    track, at a running count of samples. Each track's ``tag`` is stored in that order. Columns:
    ``album``, ``position``, ``frame_no``, channels, rate, payload, title, tag; ``name`` names a
    column with the file's name, else it is the album's. Frames are first written in parts beside the
    files, under ``_parts``; an album's task streams them into its file, part by part.
    """
    starts = frames.groupBy(album, position).agg(F.first("title").alias("_title"), F.first("tag").alias("_tag"))
    text = F.octet_length(F.coalesce("_title", F.lit("")))
    tag = F.octet_length("_tag")
    # Two markers of 34 bytes and the title, padded to even, and a padded chunk for the tag.
    extra = F.lit(68) + text + text % 2 + F.when(tag > 0, tag + tag % 2 + 12).otherwise(0)
    tails = starts.groupBy(album).agg((F.sum(extra) + 46).alias("_tail"))
    more = ["title", "tag"] + ([name] if name else [])
    parts = _parts(frames, f"{folder}/_parts", [album, position], order, ["channels", "rate", *more])
    sums = parts.groupBy(album).agg(F.sum("_bytes").alias("_bytes"), F.sum("_chunked").alias("_chunked"), F.sum("_count").alias("_count"))
    # Dealt before the joins, as in ``write_wavs``.
    rows = parts.select(album, position, "_block", "_part", "_sizes", "channels", "rate", *more).repartition(album).join(sums, album).join(tails, album)

    def run(batches):
        for first, own in _tracks(batches):
            path = f"{folder}/{first[name] if name else first[album]}.dff"
            per, marks, tags, at, now = first["channels"], [marker(0, first["rate"], PROGRAM_START)], [], 0, None

            def payloads():
                nonlocal at, now
                for r in own(album):
                    if r[position] != now:
                        if now is not None:
                            marks.append(marker(at, first["rate"], STOP))
                        now = r[position]
                        marks.append(marker(at, first["rate"], START, r["title"] or ""))
                        if r["tag"]:
                            tags.append(chunk(b"ID3 ", r["tag"]))
                    with Bytes(r["_part"]) as b:
                        whole = b.at(0, b.size)
                    at += len(whole) // per * 8
                    begin = 0
                    for size in r["_sizes"]:
                        yield whole[begin : begin + size]
                        begin += size
                marks.append(marker(at, first["rate"], STOP))

            sizes = Sizes(first["_bytes"], first["_chunked"], first["_count"])
            written = write_dsdiff(path, payloads(), per, first["rate"], sizes=sizes, tail=lambda: diin(marks) + b"".join(tags), tail_bytes=first["_tail"])
            yield pa.RecordBatch.from_arrays([pa.array([str(first[album])]), pa.array([path]), pa.array([len(marks) // 2], pa.int64()), pa.array([written], pa.int64())], names=["album", "path", "tracks", "written"])

    dealt = rows.sortWithinPartitions(album, position, "_block")
    return dealt.mapInArrow(run, "album string, path string, tracks long, written long")
