"""Edits of audio files by copying: a changed file is written beside the old one and moved over it."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sigmaspark.sources import dsdiff, dsf
from sigmaspark.sources.files import Bytes, put

from .audio import chunk, dsf_header

STEP = 1 << 20


def _copy(f: Bytes, at: int, n: int) -> Iterator[bytes]:
    for a in range(at, at + n, STEP):
        yield f.at(a, min(STEP, at + n - a))


def read_dsf_tag(path: str) -> bytes | None:
    """The metadata block of a DSF file, if any."""
    with Bytes(path) as f:
        h = dsf.parse(f.at(0, dsf.HEADER))
        return f.at(h.metadata_offset, f.size - h.metadata_offset) if h.metadata_offset else None


def write_dsf_tag(path: str, tag: bytes | None, out: str | None = None) -> None:
    """Set, replace or (None) remove the metadata block."""
    with Bytes(path) as f:
        h = dsf.parse(f.at(0, dsf.HEADER))

        def chunks():
            yield dsf_header(h.channels, h.rate, h.samples, h.audio_bytes, len(tag or b""))
            yield from _copy(f, dsf.HEADER, h.audio_bytes)
            yield tag or b""

        put(out or path, chunks())


ORDERED = ({"SLFT", "SRGT"}, {"MLFT", "MRGT", "C", "LS", "RS"}, {"MLFT", "MRGT", "C", "LFE", "LS", "RS"})


def check_channels(ids: list[str], count: int) -> None:
    """A file keeps its number of channels; those of a standard layout stand in its order."""
    from .audio import CHANNEL_IDS

    if len(ids) != count:
        raise ValueError(f"{count} channels expected")
    names = set(ids)
    if names in ORDERED and len(names) == count and ids != CHANNEL_IDS[count] or count == 2 and ids not in (CHANNEL_IDS[2],) and names <= ORDERED[0]:
        raise ValueError("the channels of a standard layout in another order")


def _prop(f: Bytes, at: int, size: int, old: dsdiff.File, channel_ids: list[str] | None, loudspeakers: int | None, timecode: tuple[int, int, int, int] | None) -> bytes:
    """The sound properties with new parts; start time and loudspeakers can only be changed where there are some."""
    if channel_ids is not None:
        check_channels(channel_ids, len(old.channels))
    parts, seen = f.at(at, 4), set()
    for k, a, n in dsdiff.chunks(f, at + 4, at + size):
        data = f.at(a, n)
        if k == b"CHNL" and channel_ids is not None:
            data = struct.pack(">H", len(channel_ids)) + b"".join(c.encode().ljust(4) for c in channel_ids)
        elif k == b"LSCO" and loudspeakers is not None:
            data = struct.pack(">H", loudspeakers)
        elif k == b"ABSS" and timecode is not None:
            data = struct.pack(">HBBI", *normal_timecode(timecode, old.rate))
        seen.add(k)
        parts += chunk(k, data)
    for k, wanted in ((b"LSCO", loudspeakers), (b"ABSS", timecode)):
        if wanted is not None and k not in seen:
            raise ValueError(f"the file has no {k.decode()} chunk to change")
    return parts


def normal_timecode(t: tuple[int, int, int, int], rate: int) -> tuple[int, int, int, int]:
    """Hours, minutes, seconds and samples, each below its limit."""
    h, m, s, samples = t
    s, samples = s + samples // rate, samples % rate
    m, s = m + s // 60, s % 60
    return h + m // 60, m % 60, s, samples


def edit_dsdiff(
    path: str, out: str | None = None, *, artist: str | None = None, title: str | None = None, markers: list[bytes] | None = None, tag: bytes | None = None, comments: list[tuple] | None = None,
    channel_ids: list[str] | None = None, loudspeakers: int | None = None, timecode: tuple[int, int, int, int] | None = None, emid: str | None = None, manufacturer: tuple[bytes, bytes] | None = None,
    track_tags: dict[int, bytes | None] | None = None,
) -> None:
    """Replace the given parts of a DSDIFF file and keep all others; sound is copied as it is.

    ``markers``: MARK chunks; ``comments``: (year, month, day, hour, minute, type, reference, text);
    ``manufacturer``: its four-byte id and data; ``track_tags``: tags by track index from 0, None
    removes one. The first tag of a file is its own, those after it are the tracks'.
    """
    with Bytes(path) as f:
        old = dsdiff.parse(f)
        parts = list(dsdiff.chunks(f, 16, f.size))
        prop = channel_ids is not None or loudspeakers is not None or timecode is not None
        gone = {b"DIIN", b"ID3 "} | ({b"COMT"} if comments is not None else set()) | ({b"MANF"} if manufacturer is not None else set())
        kept = [(k, a, n) for k, a, n in parts if k not in gone]
        names = [(b"EMID", emid), (b"DIAR", artist if artist is not None else old.artist), (b"DITI", title if title is not None else old.title)]
        detail = b"".join(chunk(k, v.encode() if k == b"EMID" else struct.pack(">I", len(v.encode())) + v.encode()) for k, v in names if v)
        for k, a, n in parts:
            if k == b"DIIN":
                for k2, a2, n2 in dsdiff.chunks(f, a, a + n):
                    if k2 not in (b"DIAR", b"DITI") and (k2 != b"MARK" or markers is None) and (k2 != b"EMID" or emid is None):
                        detail += chunk(k2, f.at(a2, n2))
        detail += b"".join(markers or [])
        tail = [chunk(b"DIIN", detail)] if detail else []
        if comments is not None:
            rows = b""
            for *when, kind, ref, text in comments:
                raw = text.encode()
                rows += struct.pack(">HBBBBHHI", *when, kind, ref, len(raw)) + raw + b"\0" * (len(raw) % 2)
            tail.append(chunk(b"COMT", struct.pack(">H", len(comments)) + rows))
        tags = [f.at(a, n) for k, a, n in parts if k == b"ID3 "]
        own, per = tag if tag is not None else tags[0] if tags else None, dict(enumerate(tags[1:])) | (track_tags or {})
        if own is None and any(per.values()):
            raise ValueError("a file with tags of tracks needs a tag of its own")
        tail += [chunk(b"ID3 ", x) for x in (own, *(per[i] for i in sorted(per))) if x]
        if manufacturer is not None:
            tail.append(chunk(b"MANF", manufacturer[0].ljust(4)[:4] + manufacturer[1]))
        changed = {a: chunk(k, _prop(f, a, n, old, channel_ids, loudspeakers, timecode)) for k, a, n in kept if k == b"PROP" and prop}
        if old.index and any(len(c) != 12 + n + n % 2 for _, a, n in kept if (c := changed.get(a)) is not None):
            raise ValueError("the frame index would no longer hold")
        size = 4 + sum(len(changed[a]) if a in changed else 12 + n + n % 2 for _, a, n in kept) + sum(map(len, tail))

        def chunks():
            yield b"FRM8" + struct.pack(">Q", size) + f.at(12, 4)
            for k, a, n in kept:
                if a in changed:
                    yield changed[a]
                    continue
                yield k + struct.pack(">Q", n)
                yield from _copy(f, a, n)
                if n % 2:
                    yield b"\0"
            yield from tail

        put(out or path, chunks())


def edit_all(edits: DataFrame, edit: Callable[..., None], path: str = "path") -> DataFrame:
    """Edit many files at once: ``edit`` is called with each row's ``path`` and, by name, its other columns that are not null. Rows (path, error)."""

    def run(batches):
        for b in batches:
            done = []
            for row in b.to_pylist():
                where = row.pop(path)
                try:
                    edit(where, **{k: v for k, v in row.items() if v is not None})
                    done.append((where, None))
                except ValueError as e:
                    done.append((where, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["path", "error"])

    return edits.mapInArrow(run, "path string, error string")


def comments(path: str) -> list[tuple]:
    """Comments of a DSDIFF file, as ``edit_dsdiff`` takes them."""
    out = []
    with Bytes(path) as f:
        for k, a, n in dsdiff.chunks(f, 16, f.size):
            if k == b"COMT":
                raw, at = f.at(a, n), 2
                for _ in range(int.from_bytes(raw[:2], "big")):
                    *fields, size = struct.unpack_from(">HBBBBHHI", raw, at)
                    out.append((*fields, raw[at + 14 : at + 14 + size].decode("utf-8", "replace")))
                    at += 14 + size + size % 2
    return out
