"""Virtual folders of images."""

import re

from pyspark.sql import functions as F

from sigmaspark.functions.genre import genre_name
from sigmaspark.operators import virtual
from sigmaspark.sinks import audio as sink


def test_catalogue(spark, tmp_path):
    for n in ("a/X.iso", "a/X.iso.xml", "a/X", "a/note.txt", "b/X.ISO"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"12345")
    got = sorted((r.path.split("/", 1)[1][-8:], r.is_image, r.shown_name, r.size) for r in virtual.catalogue(spark, str(tmp_path)).collect())
    assert sorted((i, s) for _, i, s, _ in got) == [(False, "X"), (False, "note.txt"), (True, "X"), (True, "X (2)")]


def test_entries_and_reads(spark):
    areas = spark.createDataFrame([("p", "stereo", 2), ("p", "multichannel", 6), ("q", "multichannel", 6)], "path string, area string, channels int")
    tracks = spark.createDataFrame([("p", "stereo", 1, 75, "Song", "Me", 256), ("p", "multichannel", 1, 75, None, None, 0), ("q", "multichannel", 2, 75, "T", None, 0)], "path string, area string, track int, frames long, title string, performer string, tag_bytes long")
    e = virtual.entries(tracks, areas, ["multichannel"])
    assert sorted((r.path, r.file_path, r.total) for r in e.collect()) == [("p", "Stereo/01 - Me - Song.dsf", 713052), ("q", "Multi-channel/02 - T.dsf", 92 + 87 * 4096 * 6)]
    r = virtual.regions(e.where("path = 'p'"))
    assert sorted((x.region, x.begin, x.stop) for x in r.collect()) == [("audio", 92, 712796), ("header", 0, 92), ("tag", 712796, 713052)]
    assert sorted((x.region, x["from"], x.bytes) for x in virtual.read_ranges(r, 90, 10).collect()) == [("audio", 0, 8), ("header", 90, 2)]


def test_genres(spark):
    d = spark.createDataFrame([(1, 5), (2, 0), (0, 3), (1, 99)], "t int, n int").select(genre_name(F.col("t"), F.col("n")).alias("g"))
    assert [r.g for r in d.collect()] == ["Classical", "音楽：演歌", None, None]


def test_catalogue_checks_images(spark, tmp_path):
    from sigmaspark.sinks import image

    frames = spark.createDataFrame([("X", i, bytes(9408), "T", "A", "C", [(0, 4, "One")]) for i in range(4)], "disc string, frame_no long, payload binary, title string, artist string, catalog string, tracks array<struct<start:long,frames:long,title:string>>")
    image.write_images(frames, str(tmp_path)).collect()
    (tmp_path / "fake.iso").write_bytes(b"12345")
    (tmp_path / "X").write_bytes(b"1")
    got = sorted((r.name, r.is_image, r.shown_name) for r in virtual.catalogue(spark, str(tmp_path), check=True).collect())
    assert got == [("X", False, "X"), ("X.iso", True, "X (2)")] and virtual.catalogue(spark, str(tmp_path)).count() == 3


def test_bytes_of_virtual_files(spark, tmp_path):

    frames = [bytes((i * 7 + k) % 253 for k in range(9408)) for i in range(300)]
    f = spark.createDataFrame([("p", "stereo", 1, i, x) for i, x in enumerate(frames)], "path string, area string, track int, frame_no long, payload binary")
    areas = spark.createDataFrame([("p", "stereo", 2)], "path string, area string, channels int")
    t = spark.createDataFrame([("p", "stereo", 1, 300, "T", None, 9)], "path string, area string, track int, frames long, title string, performer string, tag_bytes long")
    files = virtual.entries(t, areas).withColumn("tag", F.lit(b"ID3 bytes"))
    pieces = virtual.file_bytes(files, f)
    sink.write_dsf(f"{tmp_path}/a.dsf", iter(frames), 2, 2822400, b"ID3 bytes")
    want = (tmp_path / "a.dsf").read_bytes()
    assert b"".join(bytes(r.data) for r in pieces.orderBy("begin").collect()) == want
    for offset, size in ((0, 100), (90, 5), (1_204_300, 9000), (len(want) - 12, 50), (len(want), 5)):
        assert b"".join(bytes(r.data) for r in virtual.read_bytes(pieces, offset, size).orderBy("begin").collect()) == want[offset : offset + size]


def test_silence_where_sound_ends_early(spark):
    frames = [bytes((i + k) % 251 for k in range(9408)) for i in range(300)]
    areas = spark.createDataFrame([("p", "stereo", 2)], "path string, area string, channels int")
    t = spark.createDataFrame([("p", "stereo", 1, 300, "T", None)], "path string, area string, track int, frames long, title string, performer string")
    files = virtual.entries(t, areas).withColumn("tag", F.lit(None).cast("binary"))
    for kept in (0, 1, 128, 200, 300):
        f = spark.createDataFrame([("p", "stereo", 1, i, x) for i, x in enumerate(frames[:kept])], "path string, area string, track int, frame_no long, payload binary")
        whole = b"".join(bytes(r.data) for r in virtual.file_bytes(files, f).orderBy("begin").collect())
        sound = -(-kept * 4704 // 4096) * 8192
        audio = -(-300 * 4704 // 4096) * 8192
        assert len(whole) == 92 + audio == int.from_bytes(whole[20:28], "little")
        assert whole[92 + sound :] == b"\x96" * (audio - sound)
        assert whole[92 : 92 + sound] == b"".join(sink.dsf_blocks(iter(frames[:kept]), 2))


def test_writes_to_virtual_files(spark):
    w = spark.createDataFrame([("a", 1, 0, b"0123"), ("a", 2, 8, b"abcdef"), ("a", 3, 13, b"XY"), ("a", 4, 20, b"end"), ("b", 1, 3, b"zz"), ("c", 1, 12, b"Q")], "f string, seq int, offset long, data binary")
    files = spark.createDataFrame([(x, 10) for x in "abc"], "f string, tag_begin long")
    got = {r.f: (r.accepted, None if r.tag is None else bytes(r.tag)) for r in virtual.apply_writes(w, files, ["f"]).collect()}
    assert got == {"a": (15, b"cdeXY\0\0\0\0\0end"), "b": (2, None), "c": (1, b"\0\0Q")}


def test_pieces_are_streamed_from_their_frames(spark):
    """No list of a piece's frames is held, and frames in groups past a file's end are left out."""
    frames = [bytes((i * 3 + k) % 249 for k in range(9408)) for i in range(400)]
    f = spark.createDataFrame([("p", "stereo", 1, i, x) for i, x in enumerate(frames)], "path string, area string, track int, frame_no long, payload binary")
    areas = spark.createDataFrame([("p", "stereo", 2)], "path string, area string, channels int")
    t = spark.createDataFrame([("p", "stereo", 1, 256, "T", None)], "path string, area string, track int, frames long, title string, performer string")
    pieces = virtual.file_bytes(virtual.entries(t, areas).withColumn("tag", F.lit(None).cast("binary")), f)
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and re.search(r"RepartitionByExpression \[piece#\d+\], \d+", plan)
    whole = b"".join(bytes(r.data) for r in pieces.orderBy("begin").collect())
    assert whole[92:] == b"".join(sink.dsf_blocks(iter(frames[:256]), 2))


def test_silence_keeps_no_pieces(spark, sf, monkeypatch):
    """Pieces are summed up as they are made, not stored and read again many at a time; sound is made from vectors that are in order already."""
    from sigmaspark.plans import media

    kept = []
    monkeypatch.setattr(media, "stored", lambda df, path: kept.append(path) or df)
    plan = media.virtual_silence(spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {k: [len(x) - len(x.lstrip(" :+-")) for x in plan if k in x] for k in ("rpad", "Window [")}
    assert not kept and max(depth["rpad"]) < min(depth["Window ["])
