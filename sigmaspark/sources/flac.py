"""FLAC files as tables: ``spark.read.format("flac")``.

Option ``table``: ``info`` (default; a file's properties), ``comments`` or ``blocks`` (samples by
channel). A file's frames say their length only when they are decoded, so a task reads a whole
file, block by block; checksums and the digest over all samples must hold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader

from sigmaspark.functions import flac

from .files import Bytes, Span, shares

INFO = "path string, block int, rate int, channels int, bits int, samples long, md5 string, vendor string, error string"
COMMENTS = "path string, idx int, key string, value string"
BLOCKS = "path string, block long, sample_offset long, pcm array<array<int>>"
PIECE = 1 << 20


def head(f: Bytes) -> tuple[dict, list[tuple[str, str]], str | None, int]:
    """Properties, comments, vendor, and where the frames begin."""
    if f.at(0, 4) != b"fLaC":
        raise ValueError("not a FLAC file")
    at, last, info, tags, vendor = 4, False, None, [], None
    while not last:
        h = f.at(at, 4)
        last, kind, n = bool(h[0] & 0x80), h[0] & 0x7F, int.from_bytes(h[1:], "big")
        data = f.at(at + 4, n) if kind in (0, 4) else b""
        if kind == 0:
            x = int.from_bytes(data[10:18], "big")
            info = {"block": int.from_bytes(data[:2], "big"), "rate": x >> 44, "channels": (x >> 41 & 7) + 1, "bits": (x >> 36 & 31) + 1, "samples": x & (1 << 36) - 1, "md5": data[18:34].hex(), "largest": int.from_bytes(data[7:10], "big")}
        elif kind == 4:
            p = 4 + int.from_bytes(data[:4], "little")
            vendor = data[4:p].decode("utf-8", "replace")
            count, p = int.from_bytes(data[p : p + 4], "little"), p + 4
            for _ in range(count):
                n2 = int.from_bytes(data[p : p + 4], "little")
                k, _, v = data[p + 4 : p + 4 + n2].decode("utf-8", "replace").partition("=")
                tags.append((k, v))
                p += 4 + n2
        at += 4 + n
    if info is None:
        raise ValueError("no properties of the stream")
    return info, tags, vendor, at


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def partitions(self):
        return [Span(*x) for x in shares(self.path, (".flac",), True)] or [Span("")]

    def read(self, part):
        if not part.path:
            return
        with Bytes(part.path) as f:
            try:
                info, tags, vendor, at = head(f)
            except ValueError as e:
                if self.table != "info":
                    raise
                yield (part.path, *[None] * 7, str(e))
                return
            if self.table == "info":
                yield (part.path, *(info[k] for k in ("block", "rate", "channels", "bits", "samples", "md5")), vendor, None)
            elif self.table == "comments":
                for i, (k, v) in enumerate(tags):
                    yield (part.path, i, k, v)
            else:
                yield from self._blocks(f, part.path, info, at)

    def _blocks(self, f: Bytes, path: str, info: dict, at: int):
        data, begin, done, md5 = b"", at, 0, hashlib.md5()
        most = info["largest"] or (1 << 22)
        while done < info["samples"]:
            if at - begin + most > len(data):
                begin, data = at, f.at(at, PIECE + most)
            no, x, end = flac.decode_frame(data, at - begin, info["rate"], info["bits"])
            at = begin + end
            md5.update(np.ascontiguousarray(x.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : info["bits"] // 8].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([no]), pa.array([done]), pa.array([x.tolist()], pa.list_(pa.list_(pa.int32())))], names=["path", "block", "sample_offset", "pcm"])
            done += x.shape[1]
        if info["md5"].strip("0") and md5.hexdigest() != info["md5"]:
            raise ValueError(f"{path}: digest of the samples does not hold")


class FlacSource(DataSource):
    @classmethod
    def name(cls):
        return "flac"

    def schema(self):
        return {"comments": COMMENTS, "blocks": BLOCKS}.get(self.options.get("table", "info"), INFO)

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("table", "info"))

    def writer(self, schema, overwrite):
        from sigmaspark.sinks.writer import writer_of  # sinks use this module

        return writer_of("flac", self.options, overwrite)
