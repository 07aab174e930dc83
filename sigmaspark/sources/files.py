"""Byte access to files of any store that pyarrow knows, for data sources and writers."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition

#: Each byte with its bits in reverse order.
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it; names of local files may hold any character."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if ":/" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(quote(path, safe="/:@%?&=+,;~!$'()*[]"))


def sized(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Files with one of the endings under a folder, or the file itself, in the order of their names, with their sizes; none is opened."""
    fs, p = resolve(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    head = path[: len(path) - len(p)] if path.endswith(p) else ""
    found = fs.get_file_info(pafs.FileSelector(p, recursive=True, allow_not_found=True))
    return sorted((head + i.path, i.size) for i in found if i.type == pafs.FileType.File and i.path.lower().endswith(endings))


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    return [p for p, _ in sized(path, endings)]


SPLIT_BYTES = 8 << 20


def shares(path: str, endings: tuple[str, ...], whole: bool) -> list[tuple[str, int, int]]:
    """(file, share, of): each file in shares of about SPLIT_BYTES, or whole. Only sizes are looked at, so planning opens no file; what a share holds is worked out by the task that reads it."""
    return [(p, i, n) for p, size in sized(path, endings) for n in (1 if whole else max(-(-size // SPLIT_BYTES), 1),) for i in range(n)]


class Span(InputPartition):
    """One share of a file."""

    def __init__(self, path: str, share: int = 0, of: int = 1):
        self.path, self.share, self.of = path, share, of


def share_of(total: int, i: int, n: int, step: int = 1) -> tuple[int, int]:
    """Begin and end of the i-th of n shares of ``total`` items, in whole steps."""
    steps = -(-total // step)
    return min(steps * i // n * step, total), min(steps * (i + 1) // n * step, total)


class Bytes:
    """Random reads of one file."""

    def __init__(self, path: str):
        fs, p = resolve(path)
        self.size = fs.get_file_info(p).size
        self.file = fs.open_input_file(p)

    def at(self, offset: int, n: int) -> bytes:
        return self.file.read_at(n, offset)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def put(path: str, chunks) -> int:
    """Write a file under a temporary name and move it into place, so that a repeated task replaces it; its size."""
    fs, p = resolve(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    tmp, size = f"{p}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(tmp, compression=None) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    fs.move(tmp, p)
    return size


def patch_head(path: str, head: bytes) -> None:
    """Rewrite the first bytes of a file by copying it; for stores without in-place writes."""
    fs, p = resolve(path)
    tmp = f"{p}.{uuid.uuid4().hex}"
    with fs.open_input_stream(p) as src, fs.open_output_stream(tmp, compression=None) as out:
        src.read(len(head))
        out.write(head)
        while block := src.read(1 << 20):
            out.write(block)
    fs.move(tmp, p)
