"""DSDIFF files as tables: ``spark.read.format("dsdiff")``.

Option ``table``: ``frames`` (default; raw or DST payloads as stored), ``info``, ``markers``,
``tags`` (``idx`` null for the file's own tag, else the track's from 0) ``places`` of frames, or ``chunks``, the tree of
a file's chunks whatever is wrong with them.
Files are read in shares that are planned from their sizes alone; each task walks the chunk tree,
which reads chunk headers only. DST frames are found by their index; in a file without one the
first share walks the frames' headers, and table ``places`` with ``read_places`` spreads the reading.
``crc`` is what the checksum chunk behind a DST frame holds.
Sample counts are bits per channel throughout.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource

from .files import Bytes, Span, share_of
from .pushdown import Pushing, TableReader, reader_of

INFO = "path string, version long, compression string, channels int, channel_ids array<string>, rate int, samples long, frames long, frame_rate int, artist string, title string, emid string, loudspeakers int, start_time struct<hours:int,minutes:int,seconds:int,samples:long>, manufacturer binary, error string"
TAGS = "path string, idx int, tag binary"
FRAMES = "path string, frame_no long, sample_offset long, is_first boolean, is_last boolean, channels int, rate int, format string, payload binary, crc binary"
CHUNKS = "path string, seq int, parent int, depth int, kind string, offset long, size long, file_size long, head binary"
PLACES = "path string, frame_no long, offset long, size long"
MARKERS = "path string, idx int, hours int, minutes int, seconds int, samples long, offset int, mark_type int, mark_channel int, flags int, text string, pos long"


@dataclass
class File:
    version: int = 0
    compression: str = "DSD "
    channels: list[str] = field(default_factory=list)
    rate: int = 0
    data: tuple[int, int] = (0, 0)
    dst_frames: int = 0
    frame_rate: int = 75
    index: list[tuple[int, int]] = field(default_factory=list)
    markers: list[tuple] = field(default_factory=list)
    artist: str | None = None
    title: str | None = None
    emid: str | None = None
    loudspeakers: int | None = None
    start_time: tuple[int, int, int, int] | None = None
    manufacturer: bytes | None = None
    tags: list[tuple[int, int]] = field(default_factory=list)

    @property
    def frame_bytes(self) -> int:
        return self.rate // 75 // 8 * len(self.channels)

    @property
    def frames(self) -> int:
        return self.dst_frames if self.compression == "DST " else -(-self.data[1] // max(self.frame_bytes, 1))

    @property
    def samples(self) -> int:
        if self.compression == "DST ":
            return self.dst_frames * (self.rate // self.frame_rate)
        return self.data[1] // max(len(self.channels), 1) * 8


def chunks(f: Bytes, at: int, end: int):
    """(id, offset of the data, size) of each chunk; sizes are padded to even."""
    while at + 12 <= end:
        head = f.at(at, 12)
        size = int.from_bytes(head[4:], "big")
        yield head[:4], at + 12, size
        at += 12 + size + size % 2


def parse(f: Bytes) -> File:
    head = f.at(0, 16)
    if head[:4] != b"FRM8" or head[12:16] not in (b"DSD ",):
        raise ValueError("not a DSDIFF file")
    out = File()
    for kind, at, size in chunks(f, 16, min(f.size, 12 + int.from_bytes(head[4:12], "big"))):
        if kind == b"FVER":
            out.version = int.from_bytes(f.at(at, 4), "big")
        elif kind == b"PROP" and f.at(at, 4) == b"SND ":
            for k, a, n in chunks(f, at + 4, at + size):
                if k == b"FS  ":
                    out.rate = int.from_bytes(f.at(a, 4), "big")
                elif k == b"CHNL":
                    raw = f.at(a, n)
                    out.channels = [raw[2 + 4 * i : 6 + 4 * i].decode("latin-1").strip() for i in range(int.from_bytes(raw[:2], "big"))]
                elif k == b"CMPR":
                    out.compression = f.at(a, 4).decode("latin-1")
                elif k == b"LSCO":
                    out.loudspeakers = int.from_bytes(f.at(a, 2), "big")
                elif k == b"ABSS":
                    out.start_time = struct.unpack(">HBBI", f.at(a, 8))
        elif kind == b"DSD ":
            out.data = (at, size)
        elif kind == b"DST ":
            out.data = (at, size)
            for k, a, n in chunks(f, at, at + 18):
                if k == b"FRTE":
                    out.dst_frames, out.frame_rate = struct.unpack(">IH", f.at(a, 6))
                break
        elif kind == b"DSTI":
            raw = f.at(at, size)
            out.index = [struct.unpack_from(">QI", raw, 12 * i) for i in range(size // 12)]
        elif kind == b"ID3 ":
            out.tags.append((at, size))
        elif kind == b"MANF":
            out.manufacturer = f.at(at, size)
        elif kind == b"DIIN":
            for k, a, n in chunks(f, at, at + size):
                if k == b"MARK":
                    h, m, s, samples, offset, mark, channel, flags, length = struct.unpack(">HBBIiHHHI", f.at(a, 22))
                    text = f.at(a + 22, length).decode("utf-8", "replace") if length else None
                    out.markers.append((h, m, s, samples, offset, mark, channel, flags, text))
                elif k == b"EMID":
                    out.emid = f.at(a, n).decode("utf-8", "replace")
                elif k in (b"DIAR", b"DITI"):
                    length = int.from_bytes(f.at(a, 4), "big")
                    setattr(out, "artist" if k == b"DIAR" else "title", f.at(a + 4, length).decode("utf-8", "replace"))
    if not out.rate or not out.channels or out.compression not in ("DSD ", "DST "):
        raise ValueError("sound properties are missing or not supported")
    return out


def walked(f: Bytes, info: File):
    """(offset, size) of each DST frame's payload, from the frames' own heads."""
    return ((a, n) for k, a, n in chunks(f, info.data[0], sum(info.data)) if k == b"DSTF")


def checksum(f: Bytes, at: int, size: int) -> bytes | None:
    """What a checksum chunk behind a DST frame holds, if there is one."""
    head = f.at(at + size + size % 2, 16)
    return head[12:] if head[:4] == b"DSTC" else None


HEAD = 64  # bytes of a chunk's data that table ``chunks`` shows
HOLDERS = {b"FRM8": 4, b"PROP": 4, b"DIIN": 0, b"DST ": 0}  # chunks that hold others, after so many bytes


def tree(f: Bytes):
    """(seq, parent, depth, kind, offset, size) of every chunk, also where sizes are wrong; of DST frames only the first chunk, which is their head."""
    seq = 0

    def walk(at: int, end: int, parent: int | None, depth: int, most: int | None = None):
        nonlocal seq
        for kind, offset, size in islice(chunks(f, at, end), most):
            me, seq = seq, seq + 1
            yield me, parent, depth, kind.decode("latin-1"), offset, size
            if depth < 3 and kind in HOLDERS:
                yield from walk(offset + HOLDERS[kind], min(offset + size, end, f.size), me, depth + 1, 1 if kind == b"DST " else None)

    yield from walk(0, f.size, None, 0, 1)


class Reader(TableReader):
    endings = (".dff", ".dsdiff")

    def read(self, part):
        if not part.path:
            return
        with Bytes(part.path) as f:
            if self.table == "chunks":
                for seq, parent, depth, kind, at, size in tree(f):
                    yield self.row(path=part.path, seq=seq, parent=parent, depth=depth, kind=kind, offset=at, size=size, file_size=f.size, head=f.at(at, min(size, HEAD, max(f.size - at, 0))))
                return
            try:
                info = parse(f)
            except ValueError as e:
                if self.table != "info":
                    raise
                yield self.broken(part.path, e)
                return
            if self.table == "info":
                yield self.row(
                    path=part.path, version=info.version, compression=info.compression.strip(), channels=len(info.channels), channel_ids=info.channels, rate=info.rate, samples=info.samples, frames=info.frames, frame_rate=info.frame_rate,
                    artist=info.artist, title=info.title, emid=info.emid, loudspeakers=info.loudspeakers, start_time=info.start_time, manufacturer=info.manufacturer, error=None,
                )
            elif self.table == "tags":
                for i, (at, n) in enumerate(info.tags):
                    yield self.row(path=part.path, idx=i - 1 if i else None, tag=f.at(at, n) if self.has("tag") else None)
            elif self.table == "markers":
                names = ("hours", "minutes", "seconds", "samples", "offset", "mark_type", "mark_channel", "flags", "text")
                for i, m in enumerate(info.markers):
                    yield self.row(path=part.path, idx=i, **dict(zip(names, m, strict=True)), pos=((m[0] * 60 + m[1]) * 60 + m[2]) * info.rate + m[3] + m[4])
            elif self.table == "places":
                for no, (at, n) in enumerate(self._all(f, info)):
                    if self.wanted.allows("frame_no", no):
                        yield self.row(path=part.path, frame_no=no, offset=at, size=n)
            else:
                yield from self._frames(f, part, info)

    @staticmethod
    def _all(f: Bytes, info: File):
        if info.compression == "DST ":
            return info.index or walked(f, info)
        return ((info.data[0] + a, min(info.frame_bytes, info.data[1] - a)) for a in range(0, info.data[1], info.frame_bytes))

    def _frames(self, f: Bytes, part: Span, info: File):
        dst = info.compression == "DST "
        total = len(info.index) if info.index else info.frames
        low, high = self.wanted.range("frame_no", total)
        if dst and not info.index:
            # Places are known only to who walks the file from its start: the first share does, once.
            if part.share:
                return
            places = ((no, *x) for no, x in enumerate(islice(walked(f, info), high)) if no >= low)
        else:
            numbers = range(*(low + x for x in share_of(high - low, part.share, part.of)))
            size = info.frame_bytes
            places = ((no, *info.index[no]) for no in numbers) if dst else ((no, info.data[0] + no * size, min(size, info.data[1] - no * size)) for no in numbers)
        per = info.rate // (info.frame_rate if dst else 75)
        for no, at, n in places:
            yield self.row(
                path=part.path, frame_no=no, sample_offset=no * per, is_first=no == 0, is_last=no == info.frames - 1, channels=len(info.channels), rate=info.rate, format=info.compression.strip(),
                payload=f.at(at, n) if self.has("payload") else None, crc=checksum(f, at, n) if dst and self.has("crc") else None,
            )


class Pushed(Pushing, Reader):
    pass


class DsdiffSource(DataSource):
    @classmethod
    def name(cls):
        return "dsdiff"

    def schema(self):
        return {"info": INFO, "markers": MARKERS, "tags": TAGS, "places": PLACES, "chunks": CHUNKS}.get(self.options.get("table", "frames"), FRAMES)

    def reader(self, schema):
        return reader_of(Reader, Pushed, self.options, schema)

    def writer(self, schema, overwrite):
        from sigmaspark.sinks.writer import writer_of  # sinks use this module

        return writer_of("dsdiff", self.options, overwrite)


def read_places(places: DataFrame) -> DataFrame:
    """``places`` (path, frame_no, offset, size) with ``payload``: frames of files without an index, read wherever the places are dealt to."""
    schema = T.StructType([*places.schema.fields, T.StructField("payload", T.BinaryType())])

    def run(batches):
        path, f = None, None
        for b in batches:
            out = []
            for p, at, n in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
                if p != path:
                    if f:
                        f.file.close()
                    path, f = p, Bytes(p)
                out.append(f.at(at, n))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "payload"])
        if f:
            f.file.close()

    return places.mapInArrow(run, schema)
