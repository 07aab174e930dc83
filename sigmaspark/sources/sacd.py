"""Plain disc images as tables: ``spark.read.format("sacd")``.

Option ``table``: ``disc``, ``areas``, ``tracks``, ``texts`` (of all text channels), ``access`` (the
access list), ``frames`` (default) or ``packets``. Option ``area``: ``stereo`` (default for the last
two), ``multichannel`` or ``all``; option ``text_channel``: the one that titles come from, 1 unless
given. Images have sectors of 2048, 2054 or 2064 bytes, found by looking for the master table of
contents. Plain sound lies in runs of three frames to 14 or 16 sectors, so a frame's place is
arithmetic. DST sound lies in packets: a share reads the frames that start in its sectors, told by
their time codes, and a range of frames is looked up in the access list first. Should the list be
wrong, the whole area is searched. ``frames_from_packets`` puts frames together from a table of packets.

Index points are taken where the index list points for their track.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from .files import Bytes, Span, share_of
from .pushdown import Pushing, TableReader, reader_of

LSN, SECTOR = 510, 2048
#: Sector sizes with the bytes before the data, in the order in which they are tried.
SECTORS = ((2064, 12), (2054, 6), (2048, 0))
#: By frame format: sectors in a run of three frames, header bytes, payload bytes.
FIXED = {2: (14, 32, 2016), 3: (16, 284, 1764)}
PACKET_SECTORS = 4096
AREAS = {"stereo": b"TWOCHTOC", "multichannel": b"MULCHTOC"}
# Character sets by their code, and the kinds of track texts.
WIDE = (3, 4, 5, 6)
CHARSETS = {0: "ascii", 1: "ascii", 2: "latin-1", 3: "shift_jis", 4: "euc_kr", 5: "gb2312", 6: "big5", 7: "latin-1"}
TEXTS = {1: "title", 2: "performer", 3: "songwriter", 4: "composer", 5: "arranger", 6: "message"}

GENRE = "struct<table:int,index:int>"
DISC = f"path string, album_catalog string, disc_catalog string, set_size int, sequence int, hybrid boolean, year int, month int, day int, album_title string, album_artist string, disc_title string, disc_artist string, album_publisher string, album_copyright string, album_genres array<{GENRE}>, disc_genres array<{GENRE}>, error string"
AREA = "path string, area string, frame_format string, channels int, max_byte_rate int, track_count int, play_frames long, start_lsn long, end_lsn long, loudspeakers int, extra_settings int, mute_flags int, track_offset int, access_step int, text_channels array<struct<language:string,charset:int>>"
TRACKS = f"path string, area string, track int, start_lsn long, sectors long, start_frame long, frames long, title string, performer string, isrc string, texts map<string,string>, genre {GENRE}, mode int, flags int, index_starts array<long>"
TEXTS_TABLE = "path string, area string, track int, channel int, language string, charset int, kind string, value string"
ACCESS = "path string, area string, entry int, lsn long, margin int"
FRAMES = "path string, area string, frame_no long, channels int, rate int, payload binary, format string"
PACKETS = "path string, area string, lsn long, seq int, data_type int, frame_start boolean, timecode long, data binary"
RATE = 2822400


class Image(Bytes):
    def __init__(self, path: str):
        super().__init__(path)
        for size, skip in SECTORS:
            if self.at(LSN * size + skip, 8) == b"SACDMTOC":
                break
        self.sector_size, self.skip = size, skip

    def sectors(self, lsn: int, n: int) -> bytes:
        raw = self.at(lsn * self.sector_size, n * self.sector_size)
        if self.sector_size == SECTOR:
            return raw
        return b"".join(raw[i + self.skip : i + self.skip + SECTOR] for i in range(0, len(raw) - self.skip, self.sector_size))


def _string(raw: bytes, at: int, charset: int) -> str | None:
    if not at or at >= len(raw):
        return None
    end = raw.find(b"\0", at)
    return raw[at : end if end >= 0 else len(raw)].decode(CHARSETS.get(charset & 7, "latin-1"), "replace").strip() or None


def _frames(raw: bytes) -> int:
    return (raw[0] * 60 + raw[1]) * 75 + raw[2]


def _genres(raw: bytes) -> list[tuple[int, int]]:
    """Table and number of each genre that is set."""
    codes = [struct.unpack_from(">BxH", raw, 4 * i) for i in range(len(raw) // 4)]
    return [c for c in codes if c[0]]


@dataclass
class Track:
    start: int  # first sector
    time: int  # first frame
    frames: int
    mode: int
    flags: int  # from the lowest bit: four flags of management, and whether there are index points
    isrc: str
    genre: tuple[int, int] | None
    texts: list[dict[str, str]]  # of each text channel
    indexes: list[int]  # first frames of index points 2 and on


@dataclass
class Area:
    name: str
    frame_format: int
    channels: int
    max_byte_rate: int
    play_frames: int
    start: int
    end: int
    loudspeakers: int
    extra: int
    mute: int
    track_offset: int
    languages: list[tuple[str, int]]  # language and character set of each text channel
    step: int
    access: list[tuple[int, int]]  # first sector and margin of each entry
    tracks: list[Track]

    def span(self, frame: int) -> tuple[int, int]:
        """First and last sector in which to look for the start of a frame: from its place between two entries, less the margin, to the next entry."""
        if not self.step or not self.access:
            return self.start, self.end
        i = min(frame // self.step, len(self.access) - 1)
        lsn, margin = self.access[i]
        more = i + 1 < len(self.access)
        stop = self.access[i + 1][0] if more else self.end
        over = self.step if more else self.play_frames - i * self.step
        guess = lsn + (frame % self.step * (stop - lsn) // over if over > 0 else 0)
        low = max(guess - margin, lsn) if over > 0 and guess > margin else lsn
        return max(low, self.start), min(stop, self.end)


@dataclass
class Disc:
    fields: dict
    areas: dict[str, tuple[int, int]]  # name: (first sector, sectors) of its table of contents


def disc(img: Image, channel: int = 1) -> Disc:
    """The master table of contents, its texts from the text channel of that number."""
    toc = img.sectors(LSN, 10)
    if toc[:8] != b"SACDMTOC":
        raise ValueError("no master table of contents")
    set_size, sequence = struct.unpack_from(">HH", toc, 16)
    stereo, _, multi, _ = struct.unpack_from(">IIII", toc, 64)
    stereo_len, multi_len = struct.unpack_from(">HH", toc, 84)
    year, month, day = struct.unpack_from(">HBB", toc, 120)
    text = lambda a: toc[a : a + 16].decode("ascii", "replace").strip("\0 ") or None
    titles: list[str | None] = [None] * 16
    page = toc[channel * SECTOR : (channel + 1) * SECTOR]
    if channel <= toc[128] and page[:8] == b"SACDText" and (charset := toc[134 + 4 * channel]):
        titles = [_string(page, p, charset) for p in struct.unpack_from(">16H", page, 16)]
    areas = {n: (lsn, size) for n, lsn, size in (("stereo", stereo, stereo_len), ("multichannel", multi, multi_len)) if lsn}
    return Disc(
        {
            "album_catalog": text(24), "disc_catalog": text(88), "set_size": set_size, "sequence": sequence, "hybrid": bool(toc[80] & 0x80), "year": year, "month": month, "day": day,
            "album_title": titles[0], "album_artist": titles[1], "disc_title": titles[8], "disc_artist": titles[9], "album_publisher": titles[2], "album_copyright": titles[3],
            "album_genres": _genres(toc[40:56]), "disc_genres": _genres(toc[104:120]),
        },
        areas,
    )


def _part(toc: bytes, pointer: int, kind: bytes, most: int) -> bytes:
    """A part of an area's table of contents by the sector that points to it; empty if there is none."""
    if not pointer:
        return b""
    raw = toc[pointer * SECTOR : (pointer + most) * SECTOR]
    if raw[:8] != kind:
        raise ValueError(f"no {kind.decode()} where the table of contents says so")
    return raw


def _texts(raw: bytes, at: int, charset: int) -> dict[str, str]:
    """Texts of one track and channel: items that follow each other, each padded to four bytes."""
    out: dict[str, str] = {}
    if not at or at >= len(raw):
        return out
    count, p = raw[at], at + 4
    for _ in range(count):
        if p + 2 >= len(raw):
            break
        value = _string(raw, p + 2, charset)
        if value:
            out[TEXTS.get(raw[p], f"text{raw[p]}")] = value
        p = raw.find(b"\0", p + 2) + 1
        if not p:
            break
        if charset in WIDE and raw[p : p + 1] == b"\0":  # two-byte characters end with two zeros
            p += 1
        p += -p % 4
    return out


def area(img: Image, name: str, place: tuple[int, int]) -> Area:
    toc = img.sectors(*place)
    if toc[:8] != AREAS[name]:
        raise ValueError(f"no table of contents of the {name} area")
    n = toc[69]
    lists = [toc[k * SECTOR : (k + 1) * SECTOR] for k in range(1, 5)]
    for raw, kind in zip(lists, (b"SACDTRL1", b"SACDTRL2", b"SACD_IGL"), strict=False):
        if raw[:8] != kind:
            raise ValueError(f"no {kind.decode()} in the {name} area")
    first, second, codes, more = lists
    start, end = struct.unpack_from(">II", toc, 72)
    text_at, index_at, access_at = struct.unpack_from(">HHH", toc, 128)
    texts, indexes = _part(toc, text_at, b"SACDTTxt", 32), _part(toc, index_at, b"SACD_Ind", 10)
    languages = [(toc[88 + 4 * c : 90 + 4 * c].decode("ascii", "replace"), toc[90 + 4 * c]) for c in range(toc[80] if toc[80] <= 8 else 0)]
    step, access = 0, []
    if raw := _part(toc, access_at, b"SACD_ACC", place[1]):
        count, step = struct.unpack_from(">HB", raw, 8)
        entries = [struct.unpack_from(">HBH", raw, 16 + 5 * i) for i in range(min(count, (len(raw) - 16) // 5))]
        access = [(high << 16 | low, flags & 0x7FFF) for flags, high, low in entries]
    tracks = []
    for i in range(n):
        isrc = codes[8 + 12 * i : 20 + 12 * i] if i < 170 else more[12 * (i - 170) : 12 * (i - 169)]
        genre = struct.unpack_from(">BxH", more, 1024 + 4 * i)
        at = struct.unpack_from(">H", indexes, 8 + 2 * i)[0] if indexes else 0
        marks = [_frames(indexes[at + 1 + 3 * k : at + 4 + 3 * k]) for k in range(indexes[at])] if at and at + 1 + 3 * indexes[at] <= len(indexes) else []
        spoken = [
            _texts(texts, struct.unpack_from(">H", texts, 8 + 2 * (c * n + i))[0], charset) if texts and charset and language.strip("\0") else {} for c, (language, charset) in enumerate(languages)
        ]
        (lsn,) = struct.unpack_from(">I", first, 8 + 4 * i)
        when, long = second[8 + 4 * i : 12 + 4 * i], second[1028 + 4 * i : 1032 + 4 * i]
        tracks.append(Track(lsn, _frames(when), _frames(long), when[3], long[3] >> 3, isrc.decode("ascii", "replace").strip("\0 "), genre if genre[0] else None, spoken, marks))
    (byte_rate,) = struct.unpack_from(">I", toc, 16)
    return Area(name, toc[21] & 15, toc[32], byte_rate, _frames(toc[64:67]), start, end, toc[33] >> 3, toc[33] & 7, toc[35], toc[68], languages, step, access, tracks)


def fixed_frame(data: bytes, index: int, run: tuple[int, int, int], size: int = 9408) -> bytes:
    """Frame ``index`` of the runs in ``data``."""
    sectors, head, payload = run
    at, parts = index % 3 * size, []
    base = index // 3 * sectors
    left = size
    while left:
        s, off = divmod(at, payload)
        n = min(payload - off, left)
        begin = (base + s) * SECTOR + head + off
        parts.append(data[begin : begin + n])
        at, left = at + n, left - n
    return b"".join(parts)


def packets(sector: bytes):
    """(data type, frame start, time code or None, data) of each packet of a sound sector."""
    info, dst = sector[0], sector[0] & 1
    count, starts = info >> 5, info >> 2 & 7
    at = 1 + 2 * count
    step = 4 if dst else 3
    times = [_frames(sector[at + step * k : at + step * k + 3]) for k in range(starts)]
    begin = at + step * starts
    seen = 0
    for k in range(count):
        (word,) = struct.unpack_from(">H", sector, 1 + 2 * k)
        size, first = word & 2047, bool(word >> 15)
        yield word >> 11 & 7, first, times[seen] if first and seen < starts else None, sector[begin : begin + size]
        seen += first
        begin += size


def dst_frames(img: Image, a: Area, first: int, end: int, low: int, high: int):
    """(number, payload) of DST frames whose start lies in the sectors ``first`` to ``end`` - 1 and whose number in ``low`` to ``high`` - 1.

    A frame that starts in the last of them is read on into the next ones.
    """
    now, parts, s, n = None, [], first, 0
    while (s := s + n) <= a.end:
        n = min(64 if s + 64 <= end else max(end - s, 4), a.end + 1 - s)  # at the end only what the last frame still needs
        raw = img.sectors(s, n)
        for k in range(n):
            for kind, starts, time, data in packets(raw[k * SECTOR : (k + 1) * SECTOR]):
                if kind != 2:
                    continue
                if starts:
                    if now is not None and low <= now < high:
                        yield now, b"".join(parts)
                    now, parts = time, []
                    if s + k >= end or now is None or now >= high:
                        return
                if now is not None:
                    parts.append(data)
    if now is not None and low <= now < high:
        yield now, b"".join(parts)


def first_start(img: Image, lsn: int, end: int) -> int | None:
    """Number of the first frame that starts at ``lsn`` or after it."""
    for s in range(lsn, end + 1):
        for kind, starts, time, _ in packets(img.sectors(s, 1)):
            if kind == 2 and starts:
                return time
    return None


def sector_span(img: Image, a: Area, low: int, high: int) -> tuple[int, int]:
    """Begin and end of the sectors in which frames ``low`` to ``high`` - 1 start, by the access list; the whole area if it proves wrong."""
    if low <= 0 and high >= a.play_frames:
        return a.start, a.end + 1
    begin, stop = a.span(low)[0], a.span(high - 1)[1]
    found = first_start(img, begin, a.end)
    after = first_start(img, stop + 1, a.end) if stop < a.end else None
    if (found is not None and found > low) or (after is not None and after < high):
        return a.start, a.end + 1
    return begin, stop + 1


class Reader(TableReader):
    endings = (".iso", ".sacd")
    shared = ("frames", "packets")

    def read(self, part):
        if not part.path:
            return
        channel = int(self.options.get("text_channel", "1"))
        with Image(part.path) as img:
            try:
                d = disc(img, channel)
            except ValueError as e:
                if self.table != "disc":
                    raise
                yield self.broken(part.path, e)
                return
            if self.table == "disc":
                yield self.row(path=part.path, **d.fields, error=None)
                return
            chosen = self.options.get("area", "stereo" if self.table in self.shared else "all")
            for name, place in d.areas.items():
                if chosen in ("all", name) and self.wanted.allows("area", name):
                    yield from self._area(img, part, area(img, name, place), channel)

    def _area(self, img: Image, part: Span, a: Area, channel: int):
        base = {"path": part.path, "area": a.name}
        if self.table == "areas":
            yield self.row(
                **base, frame_format={0: "DST", 2: "DSD 3 in 14", 3: "DSD 3 in 16"}.get(a.frame_format, "unknown"), channels=a.channels, max_byte_rate=a.max_byte_rate, track_count=len(a.tracks), play_frames=a.play_frames,
                start_lsn=a.start, end_lsn=a.end, loudspeakers=a.loudspeakers, extra_settings=a.extra, mute_flags=a.mute, track_offset=a.track_offset, access_step=a.step, text_channels=a.languages,
            )
        elif self.table == "tracks":
            before = 0
            for i, t in enumerate(a.tracks):
                # Stored lengths are not used: a track runs up to and including the next one's first sector.
                stop = a.tracks[i + 1].start if i + 1 < len(a.tracks) else a.end
                texts = t.texts[channel - 1] if channel <= len(t.texts) else {}
                yield self.row(
                    **base, track=i + 1, start_lsn=t.start, sectors=stop - t.start + 1, start_frame=t.time, frames=t.frames, title=texts.get("title"), performer=texts.get("performer"), isrc=t.isrc or None, texts=texts,
                    genre=t.genre, mode=t.mode, flags=t.flags, index_starts=[before, t.time, *t.indexes],
                )
                before = t.time + t.frames
        elif self.table == "texts":
            for i, t in enumerate(a.tracks):
                for c, ((language, charset), texts) in enumerate(zip(a.languages, t.texts, strict=True)):
                    for kind, value in texts.items():
                        yield self.row(**base, track=i + 1, channel=c + 1, language=language, charset=charset, kind=kind, value=value)
        elif self.table == "access":
            for i, (lsn, margin) in enumerate(a.access):
                yield self.row(**base, entry=i, lsn=lsn, margin=margin)
        elif self.table == "packets":
            first, end = share_of(a.end + 1 - a.start, part.share, part.of)
            for s in range(a.start + first, a.start + end, 64):
                n = min(64, a.start + end - s)
                raw = img.sectors(s, n)
                for k in range(n):
                    for seq, (kind, start, time, data) in enumerate(packets(raw[k * SECTOR : (k + 1) * SECTOR])):
                        yield self.row(**base, lsn=s + k, seq=seq, data_type=kind, frame_start=start, timecode=time, data=data)
        else:
            yield from self._frames(img, part, a, base)

    def _frames(self, img: Image, part: Span, a: Area, base: dict):
        low, high = self.wanted.range("frame_no", a.play_frames)
        if low >= high:
            return
        more = {"channels": a.channels, "rate": RATE}
        if a.frame_format in FIXED:
            run, sound = FIXED[a.frame_format], self.has("payload")
            low -= low % 3
            first, end = (low + x for x in share_of(high - low, part.share, part.of, 3))
            for f in range(first, end, 30):
                n = min(30, end - f)
                raw = img.sectors(a.start + f // 3 * run[0], -(-n // 3) * run[0]) if sound else b""
                for k in range(n):
                    yield self.row(**base, **more, frame_no=f + k, payload=fixed_frame(raw, k, run) if sound else None, format="DSD")
        elif a.frame_format == 0:
            begin, stop = sector_span(img, a, low, high)
            first, end = share_of(stop - begin, part.share, part.of)
            if first < end:
                for no, payload in dst_frames(img, a, begin + first, begin + end, low, high):
                    yield self.row(**base, **more, frame_no=no, payload=payload, format="DST")
        else:
            raise ValueError(f"{part.path}: unknown frame format {a.frame_format}")


class Pushed(Pushing, Reader):
    pass


class SacdSource(DataSource):
    @classmethod
    def name(cls):
        return "sacd"

    def schema(self):
        tables = {"disc": DISC, "areas": AREA, "tracks": TRACKS, "texts": TEXTS_TABLE, "access": ACCESS, "packets": PACKETS}
        return tables.get(self.options.get("table", "frames"), FRAMES)

    def reader(self, schema):
        return reader_of(Reader, Pushed, self.options, schema)


def frames_from_packets(packet_rows: DataFrame) -> DataFrame:
    """DST frames (path, area, frame_no, timecode, payload): sound packets from one frame start to the next, in order.

    Starts are counted for each span of ``PACKET_SECTORS`` sectors, so frames are numbered span
    by span and a disc is never sorted as one; a frame that crosses into the next span has the
    same number there. A frame spans at most sixteen sectors, so what is gathered for it is small.
    """
    audio = packet_rows.where(F.col("data_type") == 2).withColumn("span", ((F.col("lsn") - F.col("lsn") % PACKET_SECTORS) / PACKET_SECTORS).cast("long"))
    first = F.col("frame_start").cast("long")
    spans = audio.groupBy("path", "area", "span").agg(F.sum(first).alias("starts"))
    before = Window.partitionBy("path", "area").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("path", "area", "span", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("path", "area", "span").orderBy("lsn", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = audio.withColumn("started", F.sum(first).over(within)).join(spans, ["path", "area", "span"])
    numbered = numbered.withColumn("frame_no", F.col("before") + F.col("started") - 1).where("frame_no >= 0")
    got = numbered.groupBy("path", "area", "frame_no").agg(F.max("timecode").alias("timecode"), F.array_sort(F.collect_list(F.struct("lsn", "seq", "data"))).alias("parts"))
    return got.select("path", "area", "frame_no", "timecode", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("payload"))


def join_tracks(frames: DataFrame, tracks: DataFrame, frame: str = "frame_no") -> DataFrame:
    """Frames with their ``track``: a disc area has one sorted array of track starts, and a frame looks for its place there."""
    starts = F.array_sort(F.collect_list(F.struct("start_frame", (F.col("start_frame") + F.col("frames")).alias("stop_frame"), "track")))
    t = tracks.groupBy("path", "area").agg(starts.alias("_tracks"))
    at = F.size(F.filter("_tracks", lambda x: x["start_frame"] <= F.col(frame)))
    found = frames.join(t, ["path", "area"]).withColumn("_at", F.get("_tracks", at - 1))
    return found.where(F.col(frame) < F.col("_at.stop_frame")).withColumn("track", F.col("_at.track")).drop("_tracks", "_at")
