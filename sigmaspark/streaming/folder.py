"""Frames of audio files that are still being written, as a stream: ``spark.readStream.format("audio_folder")``.

The stream's rows are ranges of frames (path, kind, first, count), so the driver, which lists the
folder, handles a few bytes for many frames; ``read_ranges`` reads their sound in the tasks. An
offset says how many frames of each file are taken. A batch takes at most ``frames_per_batch``
frames, file by file in the order of names, and only whole frames that are there; a file's short
last frame comes when the file is complete. A query that is started again goes on in the middle
of a file: what lies between two offsets is the same each time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from sigmaspark.sources import dsdiff, dsf
from sigmaspark.sources.files import Bytes, Span, sized

RANGES = "path string, kind string, first long, count long"
FRAMES = "path string, frame_no long, is_last boolean, channels int, rate int, payload binary"
KINDS = {".dsf": "dsf", ".dff": "dsdiff", ".dsdiff": "dsdiff"}
STEP = 64  # frames of a range


def whole_frames(path: str, size: int, kind: str) -> int:
    """Frames of a file that are there as a whole; 0 while its head isn't."""
    with Bytes(path) as f:
        try:
            if kind == "dsf":
                h = dsf.parse(f.at(0, dsf.HEADER))
                there = (size - dsf.HEADER) // (dsf.BLOCK * h.channels) * dsf.BLOCK
                return h.frames if size >= dsf.HEADER + h.audio_bytes else min(there // h.frame_bytes, h.samples // (8 * h.frame_bytes))
            info = dsdiff.parse(f)
        except (ValueError, IndexError):
            return 0
        if info.compression != "DSD ":
            return info.frames if info.index else 0  # coded frames are found when the index is written
        there = size - info.data[0]
        return info.frames if there >= info.data[1] else max(there, 0) // info.frame_bytes


class FolderStream(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("frames_per_batch", "10000"))
        if self.most < 1:
            raise ValueError("frames_per_batch must be positive")

    def initialOffset(self) -> dict:
        return {"taken": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        taken, left = json.loads(start["taken"]), self.most
        for path, size in sized(self.path, tuple(KINDS)):
            if left <= 0:
                break
            done = taken.get(path, 0)
            n = min(max(whole_frames(path, size, self._kind(path)) - done, 0), left)
            if n:
                taken[path] = done + n
                left -= n
        end = {"taken": json.dumps(taken, sort_keys=True)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        before, after = json.loads(start["taken"]), json.loads(end["taken"])
        return iter([(path, self._kind(path), at, min(STEP, n - at)) for path, n in sorted(after.items()) for at in range(before.get(path, 0), n, STEP)])

    @staticmethod
    def _kind(path: str) -> str:
        return KINDS["." + path.rsplit(".", 1)[1].lower()]


class FolderSource(DataSource):
    @classmethod
    def name(cls):
        return "audio_folder"

    def schema(self):
        return RANGES

    def simpleStreamReader(self, schema):
        return FolderStream(self.options)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """The frames of a stream or table of ranges: path, frame_no, is_last, channels, rate and payload."""
    schema = StructType.fromDDL(FRAMES)

    def run(batches):
        for b in batches:
            for path, kind, first, count in zip(*(b.column(c).to_pylist() for c in ("path", "kind", "first", "count")), strict=True):
                module = dsf if kind == "dsf" else dsdiff
                reader = module.Reader({"path": path}, schema)
                reader.wanted.bounds["frame_no"] = (first, first + count - 1)
                rows = list(reader.read(Span(path)))
                if kind == "dsf":
                    yield from rows
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()))], names=schema.names)

    return ranges.mapInArrow(run, FRAMES)
