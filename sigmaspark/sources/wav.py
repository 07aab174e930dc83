"""WAV files of PCM as tables: ``spark.read.format("wav")``.

One row per ``BLOCK`` samples of all channels together, in the order of the file: ``at`` is the place of
the first, ``samples`` holds signed integers, channel by channel in turn. Where a block lies is arithmetic, so a file is
read in shares. A data chunk that is longer than its file is an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from .files import Bytes, Span, share_of, shares

SAMPLES = "path string, channels int, rate int, bits int, at long, samples array<int>"
BLOCK = 4096


def head(f: Bytes) -> tuple[int, int, int, int, int]:
    """Channels, rate, bits, and the data chunk's place and size."""
    riff = f.at(0, 12)
    if riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while len(chunk := f.at(at, 8)) == 8:
        kind, size = chunk[:4], int.from_bytes(chunk[4:], "little")
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", f.at(at + 8, 16))
        elif kind == b"data":
            if form is None or form[0] != 1 or form[5] not in (16, 24, 32):
                raise ValueError("not PCM of 16, 24 or 32 bits")
            if at + 8 + size > f.size:
                raise ValueError("the data chunk is longer than the file")
            return form[1], form[2], form[5], at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def unpack_pcm(raw: bytes, bits: int) -> np.ndarray:
    """Little-endian signed integers of ``bits``."""
    if bits != 24:
        return np.frombuffer(raw, f"<i{bits // 8}").astype(np.int32)
    wide = np.zeros((len(raw) // 3, 4), np.uint8)
    wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    return wide.view("<i4").ravel() >> 8


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [Span(*x) for x in shares(self.path, (".wav",), False)] or [Span("")]

    def read(self, part):
        if not part.path:
            return
        with Bytes(part.path) as f:
            try:
                channels, rate, bits, begin, size = head(f)
            except ValueError as e:
                raise ValueError(f"{part.path}: {e}") from e
            width = bits // 8
            first, end = share_of(size // width, part.share, part.of, BLOCK)
            for at in range(first, end, BLOCK):
                x = unpack_pcm(f.at(begin + at * width, min(BLOCK, end - at) * width), bits)
                samples = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
                columns = [pa.array([part.path]), *(pa.array([v], pa.int32()) for v in (channels, rate, bits)), pa.array([at]), samples]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "channels", "rate", "bits", "at", "samples"])


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return SAMPLES

    def reader(self, schema):
        return Reader(self.options["path"])
