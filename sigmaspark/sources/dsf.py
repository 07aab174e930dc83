"""DSF files as tables: ``spark.read.format("dsf")``.

Option ``table``: ``frames`` (default; one row per 1/75 s, bytes interleaved by channel, the first
bit in time highest), ``info`` or ``tags`` (one row per file, the latter for files with a metadata
block), or ``chunks`` (the file's parts, whatever is wrong with them). A file is read in shares of some
megabytes, which are planned from its size alone. Frames are clipped by the sample count, so block padding is
never audio; the last frame may be short. A file that isn't DSF fails the scan, or gives an
``error`` in the info table.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource

from .files import REVERSED, Bytes, Span, share_of
from .pushdown import Pushing, TableReader, reader_of

BLOCK, HEADER = 4096, 92
INFO = "path string, version int, format_id int, channel_type int, channels int, rate int, bits int, samples long, block_size int, audio_bytes long, metadata_offset long, seconds double, error string"
TAGS = "path string, tag binary"
CHUNKS = "path string, seq int, parent int, depth int, kind string, offset long, size long, file_size long, head binary"
FRAMES = "path string, frame_no long, sample_offset long, is_first boolean, is_last boolean, channels int, rate int, payload binary"


@dataclass
class Head:
    version: int
    format_id: int
    channel_type: int
    channels: int
    rate: int
    bits: int
    samples: int
    block_size: int
    audio_bytes: int
    metadata_offset: int

    @property
    def frame_bytes(self) -> int:
        """Bytes of one channel in a frame."""
        return self.rate // 75 // 8

    @property
    def frames(self) -> int:
        return -(-self.samples // (self.frame_bytes * 8))


def parse(head: bytes) -> Head:
    """The fixed header; raises ValueError where it breaks the format."""
    if len(head) < HEADER or head[:4] != b"DSD " or head[28:32] != b"fmt " or head[80:84] != b"data":
        raise ValueError("not a DSF file")
    size, _, metadata = struct.unpack_from("<QQQ", head, 4)
    fmt_size, version, format_id, kind, channels, rate, bits, samples, block, _ = struct.unpack_from("<QIIIIIIQII", head, 32)
    (data,) = struct.unpack_from("<Q", head, 84)
    for ok, what in ((size == 28, "header size"), (fmt_size == 52, "format size"), (version == 1, "version"), (format_id == 0, "format"), (1 <= kind <= 7, "channel type"), (1 <= channels <= 6, "channel count"), (rate >= 44100 and rate % 600 == 0, "rate"), (bits in (1, 8), "bits"), (block == BLOCK, "block size"), (data >= 12, "data size")):
        if not ok:
            raise ValueError(f"bad {what}")
    return Head(version, format_id, kind, channels, rate, bits, samples, block, data - 12, metadata)


def frames_of(data: bytes, head: Head, first: int, count: int) -> list[bytes]:
    """Frames from the blocks that hold them; ``data`` starts at the block group of frame ``first``."""
    per = head.frame_bytes
    groups = len(data) // (BLOCK * head.channels)
    planes = np.frombuffer(data, np.uint8, groups * BLOCK * head.channels).reshape(groups, head.channels, BLOCK).transpose(1, 0, 2).reshape(head.channels, -1)
    if head.bits == 1:
        planes = REVERSED[planes]
    skip = first * per % BLOCK
    total = -(-head.samples // 8)
    return [np.ascontiguousarray(planes[:, skip + k * per : skip + min((k + 1) * per, total - first * per)].T).tobytes() for k in range(count)]


class Reader(TableReader):
    endings = (".dsf",)

    def read(self, part):
        if not part.path:
            return
        with Bytes(part.path) as f:
            if self.table == "chunks":
                for seq, (at, most) in enumerate(((0, 28), (28, 52), (80, 12))):
                    raw = f.at(at, most)
                    yield self.row(path=part.path, seq=seq, parent=None, depth=0, kind=raw[:4].decode("latin-1"), offset=at + 12, size=int.from_bytes(raw[4:12], "little"), file_size=f.size, head=raw[12:])
                return
            try:
                h = parse(f.at(0, HEADER))
            except ValueError as e:
                if self.table != "info":
                    raise
                yield self.broken(part.path, e)
                return
            if self.table == "info":
                yield self.row(
                    path=part.path, version=h.version, format_id=h.format_id, channel_type=h.channel_type, channels=h.channels, rate=h.rate, bits=h.bits, samples=h.samples,
                    block_size=h.block_size, audio_bytes=h.audio_bytes, metadata_offset=h.metadata_offset, seconds=h.samples / h.rate, error=None,
                )
            elif self.table == "tags":
                if h.metadata_offset:
                    yield self.row(path=part.path, tag=f.at(h.metadata_offset, f.size - h.metadata_offset) if self.has("tag") else None)
            else:
                yield from self._frames(f, part, h)

    def _frames(self, f: Bytes, part: Span, h: Head):
        low, high = self.wanted.range("frame_no", h.frames)
        first, end = (low + x for x in share_of(high - low, part.share, part.of))
        if first >= end:
            return
        group, sound = BLOCK * h.channels, self.has("payload")
        a = first * h.frame_bytes // BLOCK
        b = -(-(end * h.frame_bytes) // BLOCK)
        data = f.at(HEADER + a * group, min((b - a) * group, h.audio_bytes - a * group)) if sound else b""
        step = 64 if sound else 1 << 16
        for at in range(first, end, step):
            n = min(step, end - at)
            no = np.arange(at, at + n)
            # Whole frames of one batch; the blocks stay in memory for the share only.
            rows = frames_of(data[(at * h.frame_bytes // BLOCK - a) * group :], h, at, n) if sound else None
            columns = {
                "path": lambda n=n: pa.array([part.path] * n), "frame_no": lambda no=no: pa.array(no), "sample_offset": lambda no=no: pa.array(no * h.frame_bytes * 8), "is_first": lambda no=no: pa.array(no == 0),
                "is_last": lambda no=no: pa.array(no == h.frames - 1), "channels": lambda n=n: pa.array([h.channels] * n, pa.int32()), "rate": lambda n=n: pa.array([h.rate] * n, pa.int32()), "payload": lambda rows=rows: pa.array(rows, pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([columns[c]() for c in self.columns], names=list(self.columns))


class Pushed(Pushing, Reader):
    pass


class DsfSource(DataSource):
    @classmethod
    def name(cls):
        return "dsf"

    def schema(self):
        return {"info": INFO, "tags": TAGS, "chunks": CHUNKS}.get(self.options.get("table", "frames"), FRAMES)

    def reader(self, schema):
        return reader_of(Reader, Pushed, self.options, schema)

    def writer(self, schema, overwrite):
        from sigmaspark.sinks.writer import writer_of  # sinks use this module

        return writer_of("dsf", self.options, overwrite)
