"""What sources read when filters and columns are pushed down, and seeks by access lists."""

import struct

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigmaspark.operators import lookup
from sigmaspark.sinks import audio, image
from sigmaspark.sources import dsdiff, dsf, sacd
from sigmaspark.sources.files import Bytes
from sigmaspark.sources.pushdown import Wanted, open_source

RATE = 2822400


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    for s in (dsf.DsfSource, dsdiff.DsdiffSource, sacd.SacdSource):
        spark.dataSource.register(s)


def frames(spark, count=120, channels=2, disc=False):
    rows = [(1, i, channels, RATE, bytes((i * 7 + k) % 251 for k in range(4704 * channels))) for i in range(count)]
    return spark.createDataFrame(rows, f"{'disc' if disc else 'track'} int, frame_no long, channels int, rate int, payload binary")


def counted(monkeypatch, reader):
    """Rows of a reader, and the bytes that it reads."""
    n = [0]
    plain = Bytes.at

    def at(self, offset, size):
        got = plain(self, offset, size)
        n[0] += len(got)
        return got

    monkeypatch.setattr(Bytes, "at", at)
    rows = []
    for part in reader.partitions():
        for x in reader.read(part):
            rows += x.to_pylist() if hasattr(x, "to_pylist") else [x]
    monkeypatch.setattr(Bytes, "at", plain)
    return rows, n[0]


def between(a, b):
    return [ds.IsNotNull(("frame_no",)), ds.GreaterThanOrEqual(("frame_no",), a), ds.LessThan(("frame_no",), b)]


def schema(text):
    return StructType.fromDDL(text)


def test_wanted():
    w = Wanted()
    w.take([ds.GreaterThan(("n",), 4), ds.LessThanOrEqual(("n",), 9), ds.In(("n",), (3, 6, 8)), ds.EqualTo(("area",), "stereo"), ds.Not(ds.EqualTo(("n",), 6)), ds.EqualTo(("a", "b"), 1), ds.EqualTo(("f",), 1.5)])
    assert w.range("n", 100) == (5, 9) and w.range("n", 7) == (5, 7) and w.range("n", 3) == (3, 3) and w.range("other", 5) == (0, 5)
    assert w.allows("n", 8) and not w.allows("n", 3) and not w.allows("n", 7)
    assert w.allows("area", "stereo") and not w.allows("area", "multichannel") and w.allows("path", "x")


@pytest.mark.parametrize(("kind", "module", "write"), [("dsf", dsf, audio.write_dsf), ("dff", dsdiff, audio.write_dsdiff)])
def test_frames_that_are_not_asked_for_are_not_read(spark, tmp_path, monkeypatch, kind, module, write):
    src = frames(spark)
    audio.write_tracks(src, str(tmp_path), write, f".{kind}").collect()
    name = "dsf" if kind == "dsf" else "dsdiff"
    whole = schema(module.FRAMES)
    options = {"path": str(tmp_path), "push": "true"}
    rows, everything = counted(monkeypatch, module.Reader(options, whole))
    assert len(rows) == 120 and everything > 120 * 9408
    part = module.Pushed(options, whole)
    filters = between(40, 50)
    assert list(part.pushFilters(filters)) == filters
    rows, some = counted(monkeypatch, part)
    assert len(rows) == 10 and some < 14 * 9408
    rows, heads = counted(monkeypatch, module.Reader(options, schema("frame_no long, path string")))
    assert len(rows) == 120 and heads < 1000
    back = open_source(spark, name, str(tmp_path)).where("frame_no BETWEEN 40 AND 49").orderBy("frame_no")
    assert [bytes(r.payload) for r in back.collect()] == [bytes(r.payload) for r in src.where("frame_no BETWEEN 40 AND 49").orderBy("frame_no").collect()]
    assert open_source(spark, name, str(tmp_path), "frame_no long").count() == 120
    assert open_source(spark, name, str(tmp_path)).where(F.col("path") == "nowhere").count() == 0


def test_other_files_are_not_planned(spark, tmp_path):
    for k in ("a", "b"):
        audio.write_dsf(f"{tmp_path}/{k}.dsf", iter([bytes(9408)] * 3), 2, RATE)
    r = dsf.Pushed({"path": str(tmp_path)}, schema(dsf.FRAMES))
    list(r.pushFilters([ds.EqualTo(("path",), f"{tmp_path}/b.dsf")]))
    assert [p.path for p in r.partitions()] == [f"{tmp_path}/b.dsf"]


def without_index(path):
    raw = path.read_bytes()
    at = raw.index(b"DSTI")
    path.write_bytes(raw[:at] + b"JUNK" + raw[at + 4 :])


def test_files_without_an_index_are_walked_once(spark, tmp_path, monkeypatch):
    from sigmaspark.sources import files

    rows = [(1, i, 2, RATE, bytes([i % 256]) * (500 + i)) for i in range(90)]
    src = spark.createDataFrame(rows, "track int, frame_no long, channels int, rate int, payload binary")
    audio.write_tracks(src, str(tmp_path), audio.write_dsdiff_dst, ".dff").collect()
    without_index(tmp_path / "1.dff")
    monkeypatch.setattr(files, "SPLIT_BYTES", 4000)
    reader = dsdiff.Reader({"path": str(tmp_path)}, schema(dsdiff.FRAMES))
    assert len(reader.partitions()) > 10
    got, n = counted(monkeypatch, reader)
    assert [r[-2] for r in got] == [r[4] for r in rows] and n < 1.5 * (tmp_path / "1.dff").stat().st_size + 2000 * len(reader.partitions())
    places = spark.read.format("dsdiff").option("table", "places").load(str(tmp_path)).repartition(4)
    assert sorted((r.frame_no, bytes(r.payload)) for r in dsdiff.read_places(places).collect()) == [(r[1], r[4]) for r in rows]


def test_checksums_of_dst_frames(spark, tmp_path):
    body = audio.chunk(b"DSTF", b"abc") + audio.chunk(b"DSTC", b"\1\2\3\4") + audio.chunk(b"DSTF", b"de")
    audio.write_dsdiff(f"{tmp_path}/x.dff", iter([b"abc", b"de"]), 2, RATE, dst=True)
    raw = (tmp_path / "x.dff").read_bytes()
    old = audio.chunk(b"DSTF", b"abc") + audio.chunk(b"DSTF", b"de")
    at = raw.index(old)
    raw = raw[:at] + body + raw[at + len(old) :]
    sound = raw.index(b"DST \0")
    raw = raw[: sound + 4] + struct.pack(">Q", int.from_bytes(raw[sound + 4 : sound + 12], "big") + 16) + raw[sound + 12 :]
    (tmp_path / "x.dff").write_bytes(raw.replace(b"DSTI", b"JUNK"))
    got = spark.read.format("dsdiff").load(str(tmp_path)).orderBy("frame_no").collect()
    assert [(bytes(r.payload), r.crc and bytes(r.crc)) for r in got] == [(b"abc", b"\1\2\3\4"), (b"de", None)]


@pytest.fixture(scope="module")
def dst_disc(spark, tmp_path_factory):
    """A disc of 400 DST frames whose sizes grow and shrink, with tracks that start in the middle of intervals."""
    folder = tmp_path_factory.mktemp("disc")
    rows = [("d", i, bytes([i % 256]) * (1 + (i * 977) % 9000), "T", "A", "C", [(0, 133, "one"), (133, 267, "two")]) for i in range(400)]
    f = spark.createDataFrame(rows, "disc string, frame_no long, payload binary, title string, artist string, catalog string, tracks array<struct<start:long,frames:long,title:string>>").repartition(6)
    image.write_images(f, str(folder), 0).collect()
    return folder, [r[2] for r in rows]


def test_a_seek_reads_its_span_only(spark, dst_disc, monkeypatch):
    folder, want = dst_disc
    options = {"path": str(folder)}
    reader = sacd.Reader(options, schema(sacd.FRAMES))
    rows, everything = counted(monkeypatch, reader)
    assert [(r[2], r[5], r[6]) for r in rows] == [(i, x, "DST") for i, x in enumerate(want)] and everything > sum(map(len, want))
    for a in (0, 7, 133, 200, 391):
        part = sacd.Pushed(options, schema(sacd.FRAMES))
        list(part.pushFilters(between(a, a + 9)))
        rows, some = counted(monkeypatch, part)
        assert [(r[2], r[5]) for r in rows] == [(i, want[i]) for i in range(a, min(a + 9, 400))]
        assert some < 0.25 * everything
    tracks = spark.read.format("sacd").option("table", "tracks").load(str(folder)).orderBy("track").collect()
    packets = spark.read.format("sacd").option("table", "packets").load(str(folder))
    starts = {r.timecode: r.lsn for r in packets.where("frame_start").collect()}
    assert [t.start_lsn for t in tracks] == [starts[0], starts[133]]


def test_shares_of_a_disc_cover_its_frames_once(dst_disc, monkeypatch):
    from sigmaspark.sources import files

    folder, want = dst_disc
    monkeypatch.setattr(files, "SPLIT_BYTES", 50_000)
    reader = sacd.Pushed({"path": str(folder)}, schema(sacd.FRAMES))
    assert len(reader.partitions()) > 20
    rows, _ = counted(monkeypatch, reader)
    assert [(r[2], r[5]) for r in rows] == list(enumerate(want))
    list(reader.pushFilters(between(100, 300)))
    rows, _ = counted(monkeypatch, reader)
    assert [(r[2], r[5]) for r in rows] == [(i, want[i]) for i in range(100, 300)]


@pytest.mark.parametrize("how", ["late", "early end", "none"])
def test_wrong_access_lists_are_not_trusted(dst_disc, tmp_path, monkeypatch, how):
    folder, want = dst_disc
    raw = bytearray((folder / "d.iso").read_bytes())
    at = raw.index(b"SACD_ACC") + 16
    if how == "none":
        toc = raw.index(b"TWOCHTOC")
        raw[toc + 132 : toc + 134] = b"\0\0"
    else:
        for i in range(40):
            flags, high, low = struct.unpack_from(">HBH", raw, at + 5 * i)
            lsn = (high << 16 | low) + (60 if how == "late" else -60 if i else 0)
            struct.pack_into(">HBH", raw, at + 5 * i, flags, lsn >> 16, lsn & 0xFFFF)
    (tmp_path / "d.iso").write_bytes(raw)
    part = sacd.Pushed({"path": str(tmp_path)}, schema(sacd.FRAMES))
    list(part.pushFilters(between(203, 209)))
    rows, _ = counted(monkeypatch, part)
    assert [(r[2], r[5]) for r in rows] == [(i, want[i]) for i in range(203, 209)]


def test_spans_of_many_discs_equal_the_readers(spark, dst_disc):
    folder, _ = dst_disc
    load = lambda t: spark.read.format("sacd").option("table", t).load(str(folder))
    areas = load("areas").select("path", "start_lsn", "end_lsn", "play_frames", F.col("access_step").alias("step"))
    ask = areas.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(420).cast("long"))).alias("frame"))
    ask = ask.unionByName(ask.limit(1).withColumn("path", F.lit("no list")))
    areas = areas.unionByName(areas.withColumns({"path": F.lit("no list"), "step": F.lit(0)}))
    got = {(r.path, r.frame): (r.from_lsn, r.to_lsn) for r in lookup.access_spans(ask, load("access"), areas, ["path"]).collect()}
    with sacd.Image(f"{folder}/d.iso") as img:
        a = sacd.area(img, "stereo", sacd.disc(img).areas["stereo"])
    assert got.pop(("no list", 0)) == (a.start, a.end)
    assert {k[1]: v for k, v in got.items()} == {i: a.span(i) for i in range(421)}


def test_text_channels_and_areas(spark, tmp_path):
    texts = [{"title": "Zwölf"}, {"title": "日本", "message": "a"}, {"title": "가나다"}, {"performer": "中国"}, {"title": "臺灣"}]
    track = (0, 3, "DEA000000001", (1, 14), [1, 2], texts)
    kind = "array<struct<start:long,frames:long,isrc:string,genre:struct<table:int,index:int>,indexes:array<long>,texts:array<map<string,string>>>>"
    rows = [("d", area, i, ch, bytes(ch), "T", "A", "C", [track], [2, 3, 4, 5, 6]) for area, ch in (("stereo", 2), ("multichannel", 6)) for i in range(3)]
    f = spark.createDataFrame(rows, f"disc string, area string, frame_no long, channels int, payload binary, title string, artist string, catalog string, tracks {kind}, charsets array<int>")
    image.write_images(f.withColumn("payload", F.when(F.col("area") == "stereo", F.rpad(F.lit(b""), 9408, F.lit(b"x"))).otherwise(F.col("payload"))), str(tmp_path), {"stereo": 2, "multichannel": 0}).collect()
    load = lambda t, **o: spark.read.format("sacd").options(table=t, **o).load(str(tmp_path))
    said = {(r.area, r.channel, r.kind): r.value for r in load("texts").collect()}
    assert said == {(a, c + 1, k): v for a in ("stereo", "multichannel") for c, m in enumerate(texts) for k, v in m.items()}
    assert load("tracks", text_channel="3").where("area = 'stereo'").first().title == "가나다"
    t = load("tracks", area="multichannel").first()
    assert (t.index_starts, tuple(t.genre), t.flags, t.isrc) == ([0, 0, 1, 2], (1, 14), 16, "DEA000000001")
    areas = {r.area: r for r in load("areas").collect()}
    assert (areas["stereo"].frame_format, areas["multichannel"].frame_format, areas["multichannel"].channels) == ("DSD 3 in 14", "DST", 6)
    assert [c.charset for c in areas["stereo"].text_channels] == [2, 3, 4, 5, 6]
    assert load("frames", area="all").groupBy("area", "format").count().count() == 2
    d = load("disc").first()
    assert d.album_title == "T" and d.album_genres == []
