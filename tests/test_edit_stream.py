"""Edits by copying, the tag sidecar, and frame streams."""

import numpy as np
from pyspark.sql import functions as F

from sigmaspark.operators import fir
from sigmaspark.sinks import audio, edit
from sigmaspark.sources import dsdiff, sidecar
from sigmaspark.sources.files import Bytes
from sigmaspark.streaming import frames as stream


def test_dsf_tag(tmp_path):
    path = f"{tmp_path}/a.dsf"
    audio.write_dsf(path, iter([bytes(range(256)) * 36 + bytes(192)] * 3), 2, 2822400)
    assert edit.read_dsf_tag(path) is None
    with Bytes(path) as f:
        before = f.at(92, f.size)
    for tag in (b"ID3first", b"longer second tag", None):
        edit.write_dsf_tag(path, tag)
        assert edit.read_dsf_tag(path) == tag
        with Bytes(path) as f:
            assert f.at(92, len(before)) == before


def test_dsdiff_edit(tmp_path):
    path = f"{tmp_path}/a.dff"
    audio.write_dsdiff(path, iter([b"\x55" * 9408]), 2, 2822400, [audio.marker(5, 2822400, 0)], "Old", "Same")
    edit.edit_dsdiff(path, artist="New artist", markers=[audio.marker(7, 2822400, 0, "x"), audio.marker(9, 2822400, 1)], comments=[(2001, 2, 3, 4, 5, 0, 0, "odd")], tag=b"ID3x")
    with Bytes(path) as f:
        d = dsdiff.parse(f)
        assert (d.artist, d.title, [m[3] for m in d.markers]) == ("New artist", "Same", [7, 9])
        assert f.at(*d.data) == b"\x55" * 9408 and f.size == 12 + int.from_bytes(f.at(4, 8), "big")
    assert edit.comments(path) == [(2001, 2, 3, 4, 5, 0, 0, "odd")]
    edit.edit_dsdiff(path, title="T2")
    with Bytes(path) as f:
        d = dsdiff.parse(f)
    assert (d.artist, d.title, len(d.markers)) == ("New artist", "T2", 2) and len(edit.comments(path)) == 1


def test_sidecar(spark, tmp_path):
    rows = [("stereo", 1, bytearray(b"ID3a")), ("stereo", 2, bytearray(b"\0\xff")), ("multichannel", 1, bytearray(b"z"))]
    sidecar.save(spark.createDataFrame(rows, "area string, track int, tag binary"), f"{tmp_path}/tags.xml")
    assert sorted((r.area, r.track, bytearray(r.tag)) for r in sidecar.load(spark, f"{tmp_path}/tags.xml").collect()) == sorted(rows)


def test_stream_keeps_filter_history(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = [rng.integers(0, 256, 40, dtype=np.uint8).tobytes() for _ in range(6)]
    schema = "track string, frame_no long, payload binary"
    for k in range(3):
        spark.createDataFrame([("t", i, data[i]) for i in (2 * k, 2 * k + 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        __import__("time").sleep(1.1)
    coef = fir.windowed_sinc(25, 1 / 16)
    out = stream.decimate_stream(stream.frame_stream(spark, f"{tmp_path}/in", schema, 1), ["track"], coef, 8)
    q = out.writeStream.format("memory").queryName("pcm").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [y for r in spark.table("pcm").orderBy("frame_no").collect() for y in r.pcm]
    batch = spark.createDataFrame([("t", i, d) for i, d in enumerate(data)], schema)
    want = [y for r in fir.decimate_frames(batch, ["track"], coef, 8).orderBy("frame_no").collect() for y in r.pcm]
    assert np.allclose(got, want) and len(got) == 240


def test_idle_spans(spark):
    e = spark.createDataFrame([("a", 0), ("a", 100), ("a", 1000), ("b", 50)], "image string, s int").select("image", F.timestamp_seconds("s").alias("ts"))
    assert sorted((r.image, r.uses) for r in stream.idle_stream(e, "image", "ts").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_dsdiff_edit_of_every_part(tmp_path):
    import pytest

    path = f"{tmp_path}/a.dff"
    audio.write_dsdiff(path, iter([b"\x55" * 9408]), 2, 2822400, title="T")
    with Bytes(path) as f:
        raw = f.at(0, f.size)
    at = raw.index(b"CMPR")  # a file with a start time and a loudspeaker layout
    more = audio.chunk(b"ABSS", bytes(8)) + audio.chunk(b"LSCO", bytes(2))
    prop = raw.index(b"PROP")
    raw = raw[:at] + more + raw[at:]
    raw = raw[:4] + (int.from_bytes(raw[4:12], "big") + len(more)).to_bytes(8, "big") + raw[12 : prop + 4] + (int.from_bytes(raw[prop + 4 : prop + 12], "big") + len(more)).to_bytes(8, "big") + raw[prop + 12 :]
    (tmp_path / "a.dff").write_bytes(raw)
    edit.edit_dsdiff(path, channel_ids=["C", "LFE"], loudspeakers=3, timecode=(1, 59, 59, 2822401), emid="E1", manufacturer=(b"ACME", b"data"), tag=b"own", track_tags={0: b"first", 1: b"second"})
    with Bytes(path) as f:
        d = dsdiff.parse(f)
        assert (d.channels, d.loudspeakers, d.start_time, d.emid, d.manufacturer, d.title) == (["C", "LFE"], 3, (2, 0, 0, 1), "E1", b"ACMEdata", "T")
        assert [f.at(*x) for x in d.tags] == [b"own", b"first", b"second"] and f.at(*d.data) == b"\x55" * 9408
    edit.edit_dsdiff(path, track_tags={0: None, 2: b"third"})
    with Bytes(path) as f:
        assert [f.at(*x) for x in dsdiff.parse(f).tags] == [b"own", b"second", b"third"]
    for wrong in ({"channel_ids": ["C"]}, {"channel_ids": ["SRGT", "SLFT"]}):
        with pytest.raises(ValueError):
            edit.edit_dsdiff(path, **wrong)
    audio.write_dsdiff(path, iter([b"\x55" * 9408]), 2, 2822400)
    for wrong in ({"timecode": (0, 0, 0, 0)}, {"loudspeakers": 0}, {"track_tags": {0: b"x"}}):
        with pytest.raises(ValueError):
            edit.edit_dsdiff(path, **wrong)


def test_conversion_by_quality(spark):
    import pytest

    rng = np.random.default_rng(9)
    data = [rng.integers(0, 256, 4704, dtype=np.uint8).tobytes() for _ in range(3)]
    src = spark.createDataFrame([("t", i, d) for i, d in enumerate(data)], "track string, frame_no long, payload binary")
    x = np.unpackbits(np.frombuffer(b"".join(data), np.uint8)) * 2.0 - 1
    for quality, rate in (("fast", None), ("normal", None), ("high", 176400)):
        got = np.array([y for r in fir.convert(src, ["track"], 2822400, rate, quality).orderBy("frame_no").collect() for y in r.pcm])
        y = x
        for h, k in fir.stages(2822400, rate, quality):
            y = np.convolve(np.concatenate([np.zeros(len(h) - 1), y]), h, "valid")[::k]
        assert len(got) == len(y) == 3 * (rate or 88200) // 75 and np.allclose(got[100:], y[100:])
    for wrong in ((2822400, 100000, "fast"), (2822400, 2822400, "fast"), (2822400, None, "best")):
        with pytest.raises(ValueError):
            fir.stages(*wrong)


def test_filters_that_look_back_further_than_a_frame(spark):
    rng = np.random.default_rng(10)
    data = rng.integers(0, 256, 8 * 10, dtype=np.uint8).tobytes()
    src = spark.createDataFrame([("t", i, data[8 * i : 8 * i + 8]) for i in range(10)], "track string, frame_no long, payload binary")
    coef = fir.windowed_sinc(161, 1 / 20)
    got = [y for r in fir.decimate_frames(src, ["track"], coef, 8, frame_bytes=8).orderBy("frame_no").collect() for y in r.pcm]
    x = np.concatenate([np.zeros(160), np.unpackbits(np.frombuffer(data, np.uint8)) * 2.0 - 1])
    assert np.allclose(got, np.convolve(x, coef, "valid")[::8])
