"""Plain disc images from frames: what the ``sacd`` source reads, one image per disc.

An image has a master table of contents with the disc's texts and genres, and up to two areas, each
with its own table of contents (tracks, codes, genres, index points, texts in several text channels)
before its sound: three frames to 14 or 16 sectors, or DST frames as packets. An area of DST sound
has an access list. Where each of its frames begins follows from running sums of their sizes, taken
interval by interval, so no disc is summed up by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmaspark.sources.files import put
from sigmaspark.sources.sacd import AREAS, CHARSETS, FIXED, LSN, SECTOR, TEXTS, WIDE

from .audio import _tracks

FIRST_AREA = 540
AHEAD = 60  # sectors from an area's table of contents to its sound; more for DST, as it has an access list
AHEAD_DST = 100
PACKET = 2000  # bytes of a frame in a sector
STEP = 10  # frames between entries of the access list
LANGUAGES = {1: "en", 2: "de", 3: "ja", 4: "ko", 5: "zh", 6: "zh", 7: "fr"}
KINDS = {v: k for k, v in TEXTS.items()}


def _pad(raw: bytes, n: int = SECTOR) -> bytes:
    if len(raw) > n:
        raise ValueError(f"{len(raw)} bytes where {n} have room")
    return raw + bytes(n - len(raw))


def _msf(frames: int) -> bytes:
    return bytes([frames // 4500, frames // 75 % 60, frames % 75])


def _text(value: str, charset: int) -> bytes:
    return value.encode(CHARSETS[charset], "replace") + b"\0" * (2 if charset in WIDE else 1)


def _channels(charsets: list[int]) -> bytes:
    return bytes([len(charsets)]) + bytes(7) + b"".join(LANGUAGES[c].encode() + bytes([c, 0]) for c in charsets) + bytes(4 * (8 - len(charsets)))


def _genres(codes: list[tuple[int, int]], n: int) -> bytes:
    for table, number in codes[:n]:
        if not 0 <= number <= 0xFFFF:
            raise ValueError(f"genre {number} of table {table} has no room in sixteen bits")
    return b"".join(struct.pack(">BxH", *c) for c in codes[:n]) + bytes(4 * max(n - len(codes), 0))


def master(titles: list[dict[str, str]], charsets: list[int], catalog: str | None, areas: dict[str, tuple[int, int]], genres: list[tuple[int, int]]) -> bytes:
    """Ten sectors: the master table, the disc's texts in each text channel, and an empty one of the maker. ``areas``: first sector and length of their tables."""
    stereo, multi = areas.get("stereo", (0, 0)), areas.get("multichannel", (0, 0))
    toc = b"SACDMTOC" + bytes([1, 20]) + bytes(6) + struct.pack(">HH4x16s", 1, 1, (catalog or "").encode("ascii", "replace")[:16]) + _genres(genres, 4) + bytes(8)
    toc += struct.pack(">IIII", stereo[0], 0, multi[0], 0) + bytes(4) + struct.pack(">HH16s", stereo[1], multi[1], b"") + _genres(genres, 4) + struct.pack(">HBB4x", 0, 0, 0) + _channels(charsets)
    pages = b""
    for said, charset in zip(titles, charsets, strict=True):
        texts, ptr = b"", [0] * 16
        for i, k in ((0, "title"), (1, "artist")):
            if said.get(k):
                ptr[i] = 64 + len(texts)
                texts += _text(said[k], charset)
        pages += _pad(b"SACDText" + bytes(8) + struct.pack(">16H", *ptr) + bytes(16) + texts)
    return _pad(_pad(toc) + _pad(pages, 8 * SECTOR) + _pad(b"SACDManu"), 10 * SECTOR)


def _index_list(tracks: list[dict]) -> bytes:
    ptrs, body = b"", b""
    for t in tracks:
        marks = t["indexes"]
        ptrs += struct.pack(">H", 524 + len(body) if marks else 0)
        body += bytes([len(marks)]) + b"".join(map(_msf, marks)) if marks else b""
    return _pad(b"SACD_Ind" + ptrs, 524) + body if body else b""


def _text_list(tracks: list[dict], charsets: list[int]) -> bytes:
    at = 8 + 2 * len(tracks) * len(charsets)
    at += -at % 4
    ptrs, body = b"", b""
    for c, charset in enumerate(charsets):
        for t in tracks:
            said = [(KINDS[k], v) for k, v in (t["texts"][c] if c < len(t["texts"]) else {}).items() if v]
            ptrs += struct.pack(">H", at + len(body) if said else 0)
            if said:
                body += bytes([len(said), 0, 0, 0])
            for kind, value in said:
                item = bytes([kind, 0x20]) + _text(value, charset)
                body += item + bytes(-len(item) % 4)
    return _pad(b"SACDTTxt" + ptrs, at) + body if body else b""


def area(name: str, kind: int, channels: int, tracks: list[dict], charsets: list[int], frames: int, start: int, end: int, access: list[tuple[int, int]]) -> bytes:
    """An area's table of contents. ``tracks``: first sector, start, frames, isrc, genre, indexes and texts of each; ``access``: first sector and margin of each entry."""
    texts, indexes = _text_list(tracks, charsets), _index_list(tracks)
    listed = struct.pack(">HB5x", len(access), STEP) + b"".join(struct.pack(">HBH", m & 0x7FFF, a >> 16, a & 0xFFFF) for a, m in access)
    parts, at, where = [], 5, []
    for raw, size in ((texts, -(-len(texts) // SECTOR)), (indexes, -(-len(indexes) // SECTOR)), (b"SACD_ACC" + listed if access else b"", max(32, -(-(8 + len(listed)) // SECTOR)) if access else 0)):
        where.append(at if size else 0)
        parts.append(_pad(raw, size * SECTOR))
        at += size
    speakers = {2: 0, 5: 3, 6: 4}[channels]
    head = AREAS[name] + bytes([1, 20]) + struct.pack(">H4xI", at, 705600) + bytes([4, kind]) + bytes(10) + bytes([channels, speakers << 3, channels, 0]) + bytes(28)
    head += _msf(frames) + bytes(2) + bytes([len(tracks)]) + bytes(2) + struct.pack(">II", start, end) + _channels(charsets) + bytes(8) + struct.pack(">HHH", *where)
    first = b"SACDTRL1" + _pad(b"".join(struct.pack(">I", t["lsn"]) for t in tracks), 1020) + b"".join(struct.pack(">I", 1) for _ in tracks)
    second = b"SACDTRL2" + _pad(b"".join(_msf(t["start"]) + b"\0" for t in tracks), 1020) + b"".join(_msf(t["frames"]) + bytes([0x80 if t["indexes"] else 0]) for t in tracks)
    codes = [(t["isrc"] or "").encode("ascii", "replace")[:12].ljust(12, b"\0") for t in tracks]
    more = _pad(b"".join(codes[170:]), 1024) + _genres([t["genre"] or (0, 0) for t in tracks], len(tracks))
    return _pad(head) + _pad(first) + _pad(second) + _pad(b"SACD_IGL" + b"".join(codes[:170])) + _pad(more) + b"".join(parts)


def plain_sound(frames: Iterator[bytes], kind: int) -> Iterator[bytes]:
    """Runs of three frames in 14 or 16 sectors."""
    sectors, head, payload = FIXED[kind]
    held: list[bytes] = []

    def run() -> bytes:
        data = _pad(b"".join(held), sectors * payload)
        return b"".join(bytes(head) + data[i * payload : (i + 1) * payload] for i in range(sectors))

    for f in frames:
        held.append(f)
        if len(held) == 3:
            yield run()
            held.clear()
    if held:
        yield run()


def dst_sound(frames: Iterator[bytes]) -> Iterator[bytes]:
    """A sector for each ``PACKET`` bytes of a frame, with a packet of supplementary data beside it."""
    for no, f in enumerate(frames):
        for at in range(0, max(len(f), 1), PACKET):
            part, first = f[at : at + PACKET], at == 0
            head = bytes([2 << 5 | int(first) << 2 | 1]) + struct.pack(">HH", int(first) << 15 | 2 << 11 | len(part), 3 << 11 | 4)
            yield _pad(head + (_msf(no) + b"\0" if first else b"") + part + b"more")


def frame_sectors(frames: DataFrame, by: list[str], order: str = "frame_no") -> DataFrame:
    """(``by``, entry, frame, at, next, total): the first sector of each DST frame, counted from the area's, and those of its interval and the next one."""
    parts = F.ceil(F.greatest(F.octet_length("payload"), F.lit(1)) / PACKET).cast("long")
    sized = frames.select(*by, F.col(order).alias("frame"), F.floor(F.col(order) / STEP).cast("long").alias("entry"), parts.alias("parts"))
    whole = Window.partitionBy(*by)
    sums = sized.groupBy(*by, "entry").agg(F.sum("parts").alias("n"))
    upto = F.sum("n").over(whole.orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select(*by, "entry", (upto - F.col("n")).alias("begin"), upto.alias("next"), F.sum("n").over(whole).alias("total"))
    within = F.sum("parts").over(Window.partitionBy(*by, "entry").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")
    return sized.withColumn("within", within).join(sums, [*by, "entry"]).select(*by, "entry", "frame", (F.col("begin") + F.col("within")).alias("at"), "begin", "next", "total")


def _access(placed: DataFrame, by: list[str]) -> DataFrame:
    """Entries of the access lists as arrays (32 sectors of them an area, more for more than 131,040 frames): first sector, and the margin that makes every guess between two entries come early enough."""
    last = F.max("entry").over(Window.partitionBy(*by))
    count = F.max("frame").over(Window.partitionBy(*by)) + 1
    p = placed.withColumns({"last": last, "frames": count})
    # The last interval is measured to the area's last sector.
    stop = F.when(F.col("entry") < F.col("last"), F.col("next")).otherwise(F.col("total") - 1)
    over = F.when(F.col("entry") < F.col("last"), F.lit(STEP)).otherwise(F.col("frames") - F.col("entry") * STEP)
    guess = F.col("begin") + F.floor((F.col("frame") - F.col("entry") * STEP) * (stop - F.col("begin")) / over)
    entries = p.groupBy(*by, "entry").agg(F.min("begin").alias("at"), F.greatest(F.max(guess - F.col("at")), F.lit(0)).cast("int").alias("margin"))
    return entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("entry", "at", "margin"))).alias("access"))



TRACK = "struct<start:bigint,frames:bigint,isrc:string,genre:struct<table:int,index:int>,indexes:array<bigint>,texts:array<map<string,string>>>"


def write_images(frames: DataFrame, folder: str, kind: int | dict[str, int] = 2, disc: str = "disc", order: str = "frame_no") -> DataFrame:
    """One image per disc from (disc, frame_no, payload, title, artist, catalog, tracks): rows (disc, path, frames).

    ``kind``: 2 or 3 for plain sound (stereo frames of 9408 bytes), 0 for DST, or one for each
    area; column ``area`` (``stereo`` if there is none) tells which a frame belongs to, ``channels`` how
    many it has (2). ``tracks``: array of (start, frames) with a title, or with ``texts`` (a map for each text
    channel), isrc, genre (table, index) and ``indexes`` (first frames of index points 2 and on). Character sets of text channels:
    column ``charsets`` ([2]); ``genres``: the disc's. Sizes are added up first, so an image is written in one pass.
    """
    kinds = kind if isinstance(kind, dict) else {"stereo": kind, "multichannel": kind}
    of = frames.columns
    named = F.col(disc).alias("disc")
    f = frames.withColumns({"area": F.coalesce("area", F.lit("stereo")) if "area" in of else F.lit("stereo"), "channels": F.col("channels") if "channels" in of else F.lit(2)})
    fields = frames.schema["tracks"].dataType.elementType.names

    def track(t: Column) -> Column:
        texts = t["texts"] if "texts" in fields else F.array(F.create_map(F.lit("title"), t["title"]))
        more = [(t[c] if c in fields else F.lit(None)).alias(c) for c in ("isrc", "genre", "indexes")]
        return F.struct(t["start"].alias("start"), t["frames"].alias("frames"), *more, texts.alias("texts")).cast(TRACK)

    heads = f.groupBy(named, "area").agg(
        F.count("*").alias("n"), F.first("channels").alias("channels"), F.first(F.transform("tracks", track)).alias("tracks"), F.first("title").alias("title"), F.first("artist").alias("artist"), F.first("catalog").alias("catalog"),
        F.first(F.col("charsets") if "charsets" in of else F.array(F.lit(2))).alias("charsets"), F.first(F.col("genres") if "genres" in of else F.lit(None).cast("array<struct<table:int,index:int>>")).alias("genres"),
    )
    dst = [a for a, k in kinds.items() if k == 0]
    placed = frame_sectors(f.where(F.col("area").isin(dst)).select(named, "area", F.col(order), "payload"), ["disc", "area"], order)
    begins = heads.select("disc", "area", F.explode("tracks.start").alias("frame")).distinct().join(placed, ["disc", "area", "frame"]).groupBy("disc", "area").agg(F.collect_list(F.struct("frame", "at")).alias("begins"))
    totals = placed.groupBy("disc", "area").agg(F.max("total").alias("packets"))
    heads = heads.join(totals, ["disc", "area"], "left").join(_access(placed, ["disc", "area"]), ["disc", "area"], "left").join(begins, ["disc", "area"], "left")
    rank = F.when(F.col("area") == "stereo", 1).otherwise(2)
    per_disc = heads.groupBy("disc").agg(F.collect_list(F.struct(rank.alias("rank"), *heads.columns[1:])).alias("areas"))
    first = per_disc.select("disc", F.lit(0).alias("rank"), F.lit(-1).cast("long").alias("no"), F.lit(None).cast("binary").alias("payload"), "areas")
    rows = f.select(named, rank.alias("rank"), F.col(order).cast("long").alias("no"), "payload", F.lit(None).cast(first.schema["areas"].dataType).alias("areas"))
    # By a hash of the disc: a shuffle by ``disc`` itself is left out where both sides already lie by it, and then their partitions are merged apart from each other.
    dealt = first.unionByName(rows).repartition(F.xxhash64("disc")).sortWithinPartitions("disc", "rank", "no")

    def run(batches):
        for top, own in _tracks(batches):
            rows = own("disc")
            areas, path = sorted(next(rows)["areas"], key=lambda a: a["rank"]), f"{folder}/{top['disc']}.iso"
            tocs, lsn = {}, FIRST_AREA
            for a in areas:
                k, n = kinds[a["area"]], a["n"]
                sectors = a["packets"] if k == 0 else -(-n // 3) * FIXED[k][0]
                start = lsn + (AHEAD_DST if k == 0 else AHEAD)
                at = {b["frame"]: b["at"] for b in a["begins"] or []}
                tracks = [
                    {
                        "lsn": start + (at.get(t["start"], 0) if k == 0 else t["start"] // 3 * FIXED[k][0]), "start": t["start"], "frames": t["frames"], "isrc": t["isrc"],
                        "genre": t["genre"] and (t["genre"]["table"], t["genre"]["index"]), "indexes": t["indexes"] or [], "texts": [dict(m or ()) for m in t["texts"] or []],
                    }
                    for t in a["tracks"]
                ]
                access = [(start + e["at"], e["margin"]) for e in a["access"] or []]
                toc = area(a["area"], k, a["channels"], tracks, a["charsets"], n, start, start + sectors - 1, access)
                tocs[a["rank"]] = lsn, start, start + sectors, k, toc
                lsn = start + sectors
            said = areas[0]
            where = {a["area"]: (tocs[a["rank"]][0], len(tocs[a["rank"]][4]) // SECTOR) for a in areas}
            titles = [{"title": said["title"], "artist": said["artist"]}] * len(said["charsets"])

            def chunks(rows=rows, tocs=tocs, said=said, where=where, titles=titles):
                yield bytes(LSN * SECTOR)
                yield _pad(master(titles, said["charsets"], said["catalog"], where, [(g["table"], g["index"]) for g in said["genres"] or []]), (FIRST_AREA - LSN) * SECTOR)
                row = next(rows, None)
                for rank in sorted(tocs):
                    lsn, start, _, k, toc = tocs[rank]

                    def payloads(rank=rank):
                        nonlocal row
                        while row is not None and row["rank"] == rank:
                            yield row["payload"]
                            row = next(rows, None)

                    yield _pad(toc, (start - lsn) * SECTOR)
                    yield from dst_sound(payloads()) if k == 0 else plain_sound(payloads(), k)

            put(path, chunks())
            total = sum(a["n"] for a in areas)
            yield pa.RecordBatch.from_arrays([pa.array([str(top["disc"])]), pa.array([path]), pa.array([total], pa.int64())], names=["disc", "path", "frames"])

    return dealt.mapInArrow(run, "disc string, path string, frames long")
