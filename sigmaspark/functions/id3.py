"""ID3v2 tags: parsed to maps and rendered from them, a tag per row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmaspark.functions import text

ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _safe(raw: bytes) -> int:
    return sum((b & 127) << 7 * (3 - i) for i, b in enumerate(raw))


def _unsafe(n: int) -> bytes:
    return bytes(n >> 7 * (3 - i) & 127 for i in range(4))


def _text(raw: bytes) -> str:
    if not raw:
        return ""
    coding = ENCODINGS[raw[0]] if raw[0] < 4 else "latin-1"
    return raw[1:].decode(coding, "replace")


def parse(tag: bytes | None) -> dict[str, str] | None:
    """Text and link frames by id, ``TXXX:description`` and ``COMM``; None for what is no tag."""
    if not tag or len(tag) < 10 or tag[:3] != b"ID3" or tag[3] not in (2, 3, 4):
        return None
    version, flags, end = tag[3], tag[5], min(10 + _safe(tag[6:10]), len(tag))
    data = tag[10:end]
    if flags & 0x80 and version < 4:
        data = data.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version > 2 and len(data) >= 4:
        at = _safe(data[:4]) if version == 4 else 4 + int.from_bytes(data[:4], "big")
    id_size, head = (3, 6) if version == 2 else (4, 10)
    out: dict[str, str] = {}
    while at + head <= len(data) and data[at : at + 1] != b"\0":
        name = data[at : at + id_size].decode("latin-1")
        raw = data[at + id_size : at + id_size + (3 if version == 2 else 4)]
        size = _safe(raw) if version == 4 else int.from_bytes(raw, "big")
        body = data[at + head : at + head + size]
        at += head + size
        if name in ("TXXX", "TXX"):
            text = _text(body)
            key, _, value = text.partition("\0")
            out[f"TXXX:{key}"] = value.lstrip("﻿").strip("\0")
        elif name in ("COMM", "COM") and len(body) > 4:
            out["COMM"] = _text(body[:1] + body[4:]).partition("\0")[2].lstrip("﻿").strip("\0")
        elif name.startswith("T"):
            out[name] = "; ".join(x for x in _text(body).strip("\0").split("\0"))
        elif name.startswith("W"):
            out[name] = body.decode("latin-1").strip("\0")
    return out


def render(tags: dict[str, str] | None) -> bytes | None:
    """A version 2.4 tag in UTF-8, frames in the order of their keys; None without any."""
    frames = b""
    for key, value in sorted((tags or {}).items()):
        if value is None or value == "":
            continue
        name, _, rest = key.partition(":")
        if name == "TXXX":
            body = b"\3" + rest.encode() + b"\0" + value.encode()
        elif name == "COMM":
            body = b"\3eng\0" + value.encode()
        elif name.startswith("W"):
            body = value.encode("latin-1", "replace")
        else:
            body = b"\3" + value.encode()
        frames += name.encode()[:4].ljust(4) + _unsafe(len(body)) + b"\0\0" + body
    return b"ID3\4\0\0" + _unsafe(len(frames)) + frames if frames else None


def typed(tags: Column) -> dict[str, Column]:
    """The fields of a tag map that have a meaning of their own: texts, numbers with their totals (0 where unknown) and the date's parts."""
    get = lambda *names: F.coalesce(*(text.present(F.element_at(tags, F.lit(n))) for n in names))
    year, month, day = text.parse_date(F.coalesce(get("TDRC", "TYER"), F.lit("")))
    track, tracks = text.parse_of(F.coalesce(get("TRCK"), F.lit("")))
    disc, discs = text.parse_of(F.coalesce(get("TPOS"), F.lit("")))
    texts = {"title": "TIT2", "performer": "TPE1", "album_artist": "TPE2", "album": "TALB", "composer": "TCOM", "songwriter": "TEXT", "genre": "TCON", "isrc": "TSRC", "publisher": "TPUB", "copyright": "TCOP", "message": "COMM", "arranger": "TXXX:Arranger"}
    out = {k: get(v) for k, v in texts.items()}
    return out | {"year": year, "month": month, "day": day, "track": track, "tracks": tracks, "disc": disc, "discs": discs}


def _parse_all(tag: pd.Series) -> pd.Series:
    return tag.map(parse)


def _render_all(tags: pd.Series) -> pd.Series:
    return tags.map(lambda m: render(dict(m)) if m is not None else None)


parse_tag = F.pandas_udf(_parse_all, T.MapType(T.StringType(), T.StringType()))
render_tag = F.pandas_udf(_render_all, T.BinaryType())
