"""The disc source on images made here."""

import struct

import pytest

from sigmaspark.sources import sacd
from sigmaspark.sources.sacd import SECTOR

START = 600


def pad(b, n=SECTOR):
    return b + bytes(n - len(b))


def msf(frames):
    return bytes([frames // 4500, frames // 75 % 60, frames % 75])


def master(stereo_lsn, stereo_len):
    text = b"Album\0Artist \xe9\0Disc\0"
    toc = b"SACDMTOC" + bytes([1, 20]) + bytes(6) + struct.pack(">HH4x16s16x8x", 2, 1, b"CAT-1") + struct.pack(">IIII", stereo_lsn, 0, 0, 0)
    toc += bytes([0x80, 0, 0, 0]) + struct.pack(">HH16s16xHBB4x", stereo_len, 0, b"DISC-1", 2003, 4, 5) + bytes([1]) + bytes(7) + b"en" + bytes([2, 0])
    ptr = [64, 70, 0, 0, 0, 0, 0, 0, 79, 0, 0, 0, 0, 0, 0, 0]
    page = b"SACDText" + bytes(8) + struct.pack(">16H", *ptr) + bytes(16) + text
    return pad(toc) + pad(page) + pad(b"SACDManu")


def area_toc(fmt, tracks, play, start, end):
    head = b"TWOCHTOC" + bytes([1, 20]) + struct.pack(">H4xI", 5, 705600) + bytes([4, fmt]) + bytes(10) + bytes([2, 0, 2, 0]) + bytes(12) + bytes(16) + msf(play) + bytes(2) + bytes([len(tracks)]) + bytes(2) + struct.pack(">II", start, end)
    head += bytes([1]) + bytes(7) + b"en" + bytes([2, 0]) + bytes(28) + bytes(8) + struct.pack(">HHH", 5, 0, 0)
    trl1 = b"SACDTRL1" + pad(b"".join(struct.pack(">I", t[0]) for t in tracks), 1020) + pad(b"".join(struct.pack(">I", 1) for _ in tracks), 1020)
    trl2 = b"SACDTRL2" + pad(b"".join(msf(t[1]) + b"\0" for t in tracks), 1020) + pad(b"".join(msf(t[2]) + b"\0" for t in tracks), 1020)
    isrc = b"SACD_IGL" + b"".join(f"USAAA0100{i:03d}".encode() for i in range(len(tracks)))
    ptrs, body, at = b"", b"", 8 + 2 * len(tracks)
    at += -at % 4
    for i in range(len(tracks)):
        ptrs += struct.pack(">H", at + len(body))
        item = bytes([2, 0, 0, 0])
        for kind, text in ((1, f"Song {i}"), (2, "Me")):
            item += bytes([kind, 0]) + text.encode() + b"\0"
            item += bytes(-len(item) % 4)
        body += item
    text = pad(b"SACDTTxt" + ptrs, at) + body
    return pad(head) + pad(trl1) + pad(trl2) + pad(isrc) + pad(b"") + pad(text)


def image(sound, toc, sector=2048, skip=0):
    data = bytes(510 * SECTOR) + master(540, 6)
    data = pad(data, 540 * SECTOR) + toc
    data = pad(data, START * SECTOR) + sound
    if sector == 2048:
        return data
    return b"".join(bytes(skip) + data[i : i + SECTOR] + bytes(sector - SECTOR - skip) for i in range(0, len(data), SECTOR))


def fixed_sound(frames, fmt):
    sectors, head, payload = sacd.FIXED[fmt]
    out = b""
    for a in range(0, len(frames), 3):
        run = pad(b"".join(frames[a : a + 3]), sectors * payload)
        out += b"".join(bytes(head) + run[i * payload : (i + 1) * payload] for i in range(sectors))
    return out


@pytest.fixture(scope="module", autouse=True)
def source(spark):
    spark.dataSource.register(sacd.SacdSource)


@pytest.mark.parametrize(("fmt", "sector", "skip"), [(2, 2048, 0), (3, 2064, 12), (2, 2054, 6)])
def test_plain_sound(spark, tmp_path, fmt, sector, skip):
    frames = [bytes((i * 13 + k * 7) % 251 for k in range(9408)) for i in range(7)]
    sound = fixed_sound(frames, fmt)
    toc = area_toc(fmt, [(START, 0, 4), (START + 20, 4, 3)], 7, START, START + len(sound) // SECTOR - 1)
    (tmp_path / "a.iso").write_bytes(image(sound, toc, sector, skip))
    load = lambda t: spark.read.format("sacd").option("table", t).load(str(tmp_path))
    assert [bytes(r.payload) for r in load("frames").orderBy("frame_no").collect()] == frames
    d = load("disc").first()
    assert (d.album_title, d.album_artist, d.disc_title, d.year, d.month, d.day, d.hybrid, d.album_catalog, d.disc_catalog, d.set_size, d.error) == ("Album", "Artist é", "Disc", 2003, 4, 5, True, "CAT-1", "DISC-1", 2, None)
    a = load("areas").first()
    assert (a.area, a.channels, a.track_count, a.play_frames) == ("stereo", 2, 2, 7)
    t = load("tracks").orderBy("track").collect()
    assert [(r.start_lsn, r.sectors, r.start_frame, r.frames, r.title, r.performer, r.isrc) for r in t] == [(START, 21, 0, 4, "Song 0", "Me", "USAAA0100000"), (START + 20, a.end_lsn - START - 20 + 1, 4, 3, "Song 1", "Me", "USAAA0100001")]
    by = {(r.frame_no, r.track) for r in sacd.join_tracks(load("frames"), load("tracks")).select("frame_no", "track").collect()}
    assert by == {(i, 1 if i < 4 else 2) for i in range(7)}


def test_packets_become_frames(spark, tmp_path):
    frames = [bytes([i]) * n for i, n in enumerate((900, 3000, 50, 4100), 1)]
    flat = [(i, k == 0, f[k : k + 700]) for i, f in enumerate(frames) for k in range(0, len(f), 700)]
    sound, todo = b"", list(flat)
    while todo:
        now, todo = todo[:2], todo[2:]
        starts = [i for i, first, _ in now if first]
        head = bytes([(len(now) + 1) << 5 | len(starts) << 2 | 1])
        words = b"".join(struct.pack(">H", first << 15 | 2 << 11 | len(d)) for _, first, d in now) + struct.pack(">H", 3 << 11 | 4)
        sound += pad(head + words + b"".join(msf(i) + b"\0" for i in starts) + b"".join(d for _, _, d in now) + b"junk")
    toc = area_toc(0, [(START, 0, 4)], 4, START, START + len(sound) // SECTOR - 1)
    (tmp_path / "d.iso").write_bytes(image(sound, toc))
    p = spark.read.format("sacd").option("table", "packets").load(str(tmp_path))
    got = sacd.frames_from_packets(p).orderBy("frame_no").collect()
    assert [(r.frame_no, r.timecode, bytes(r.payload)) for r in got] == [(i, i, f) for i, f in enumerate(frames)]


def test_no_disc(spark, tmp_path):
    (tmp_path / "x.iso").write_bytes(bytes(600 * SECTOR))
    assert spark.read.format("sacd").option("table", "disc").load(str(tmp_path)).first().error == "no master table of contents"


def test_long_access_list():
    """More than 65,500 frames, and more than 32 sectors of entries, are read as they are written."""
    from sigmaspark.sinks import image as sink

    for n in (6551, 13105, 20000):
        entries = [(1000 + 7 * i, i % 9) for i in range(n)]
        toc = sink.area("stereo", 0, 2, [], [2], n * 10, 640, 900000, entries)

        class Toc:
            def sectors(self, lsn, count, toc=toc):
                return toc[: count * SECTOR]

        assert sacd.area(Toc(), "stereo", (540, len(toc) // SECTOR)).access == entries


def test_discs_of_large_labels(spark, tmp_path):
    """Labels whose genre no table has, and that have no room in sixteen bits."""
    from pyspark.sql import functions as F

    from sigmaspark.plans import media

    e = spark.createDataFrame([(i, i % 3 * 500_000 + 7) for i in range(36)], "vec_id long, label int")
    e.withColumn("embedding", F.array(F.lit(0.5).cast("float"))).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = media.disc_tracks(spark, str(tmp_path)).where("area = 'stereo'").collect()
    assert len(rows) == 12
    assert {(r.disc, r.track) for r in rows if r.genre} == {("7", 1), ("7", 2), ("7", 3)}


def test_heads_are_dealt_with_their_frames(spark, monkeypatch):
    """The row with a disc's areas must be shuffled together with its frames, also where both already lie by disc."""
    from pyspark.sql import functions as F

    from sigmaspark.sinks import image as sink

    monkeypatch.setattr(sink, "put", lambda path, chunks: sum(map(len, chunks)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = spark.range(60).select((F.col("id") % 5).alias("disc"), F.floor(F.col("id") / 5).alias("frame_no"), F.lit(b"abc").alias("payload"))
        tracks = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(12).cast("long").alias("frames"), F.lit("t").alias("title")))
        album = f.groupBy("disc").agg(F.lit("t").alias("title"), F.lit("a").alias("artist"), F.lit("c").alias("catalog")).withColumn("tracks", tracks)
        out = sink.write_images(f.join(album, "disc"), str("x"), 0)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_COL" in plan.split("Union")[0]
    assert sorted(r.disc for r in out.collect()) == list("01234")
