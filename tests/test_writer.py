"""Writing through ``df.write``: what is committed, what a failed job leaves, and several sinks at once."""

import pytest
from pyspark.sql import functions as F

from sigmaspark.sinks import writer
from sigmaspark.sinks.writer import Feeder, Sink, TrackWriter, Written
from sigmaspark.sources import dsdiff, dsf
from sigmaspark.sources import flac as flac_source

RATE = 2822400


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    for s in (dsf.DsfSource, dsdiff.DsdiffSource, flac_source.FlacSource, writer.WavSource, writer.SinksSource):
        spark.dataSource.register(s)


def frames(spark, tracks=3, count=40):
    rows = [(f"t{t}", i, 2, RATE, bytes((t * 31 + i * 7 + k) % 256 for k in range(9408)), [((t + i * k) % 200 - 100) / 128 for k in range(2 * 1176)]) for t in range(tracks) for i in range(count)]
    return spark.createDataFrame(rows, "track string, frame_no long, channels int, rate int, payload binary, pcm array<double>").repartition(7)


def names(path):
    return sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file())


@pytest.mark.parametrize(("kind", "source", "ending"), [("dsf", "dsf", ".dsf"), ("dsdiff", "dsdiff", ".dff")])
def test_round_trip(spark, tmp_path, kind, source, ending):
    src = frames(spark).drop("pcm")
    writer.save(src, kind, str(tmp_path))
    assert names(tmp_path) == [f"t{i}{ending}" for i in range(3)]
    back = spark.read.format(source).load(str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.frame_no): bytes(r.payload) for r in back.collect()}
    assert got == {(f"{r.track}{ending}", r.frame_no): bytes(r.payload) for r in src.collect()}


def test_without_sizes(spark, tmp_path):
    src = frames(spark, 1).drop("pcm").coalesce(1).sortWithinPartitions("frame_no")
    src.write.format("dsf").mode("append").save(str(tmp_path))
    assert spark.read.format("dsf").load(str(tmp_path)).count() == 40


def test_overwrite_replaces_and_append_keeps(spark, tmp_path):
    src = frames(spark).drop("pcm")
    (tmp_path / "old.dsf").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x")
    writer.save(src.where("track = 't1'"), "dsf", str(tmp_path))
    assert names(tmp_path) == ["old.dsf", "other.txt", "t1.dsf"]
    writer.save(src.where("track <> 't1'"), "dsf", str(tmp_path), mode="overwrite")
    assert names(tmp_path) == ["other.txt", "t0.dsf", "t2.dsf"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = frames(spark).withColumn("payload", F.when((F.col("track") == "t2") & (F.col("frame_no") == 39), F.raise_error(F.lit("broken"))).otherwise(F.col("payload")))
    sinks = [Sink("dsf", f"{tmp_path}/a"), Sink("flac", f"{tmp_path}/b", 16)]
    with pytest.raises(Exception, match="broken"):
        writer.fan_out(bad, sinks)
    assert names(tmp_path) == []
    with pytest.raises(Exception):
        writer.save(bad.drop("pcm"), "dsdiff", f"{tmp_path}/c")
    assert names(tmp_path) == []
    writer.fan_out(frames(spark), sinks)
    assert len(names(tmp_path)) == 6


def test_rows_that_are_not_dealt_are_refused(spark, tmp_path):
    src = frames(spark, 1).drop("pcm")
    with pytest.raises(Exception, match="more than one place"):
        src.repartition(4).write.format("dsf").mode("append").save(str(tmp_path))
    assert names(tmp_path) == []


def test_only_committed_attempts_count(tmp_path):
    w = TrackWriter([Sink("dsf", str(tmp_path))], False)
    for attempt in ("first", "second"):
        folder = tmp_path / "_temporary" / w.job / attempt
        folder.mkdir(parents=True)
        (folder / "a.dsf").write_text(attempt)
    w.commit([Written([(0, "a.dsf", f"{tmp_path}/_temporary/{w.job}/second/a.dsf")]), None])
    assert names(tmp_path) == ["a.dsf"] and (tmp_path / "a.dsf").read_text() == "second"


def test_fan_out(spark, tmp_path):
    src = frames(spark).withColumn("coded", F.concat(F.lit(b"\0"), "payload"))
    sinks = [Sink("dsf", f"{tmp_path}/a"), Sink("dsdiff", f"{tmp_path}/b"), Sink("dsdiff", f"{tmp_path}/c", dst=True), Sink("flac", f"{tmp_path}/d", 16), Sink("wav", f"{tmp_path}/e", 16), Sink("wav", f"{tmp_path}/f", 32)]
    writer.fan_out(src, sinks)
    want = sorted((r.track, r.frame_no, bytes(r.payload)) for r in src.collect())
    for kind, folder in (("dsf", "a"), ("dsdiff", "b"), ("dsdiff", "c")):
        got = spark.read.format(kind).load(f"{tmp_path}/{folder}").collect()
        assert sorted((r.path.rsplit("/", 1)[1].split(".")[0], r.frame_no, bytes(r.payload)[folder == "c" :]) for r in got) == want
    info = spark.read.format("flac").load(f"{tmp_path}/d").collect()
    assert [(r.samples, r.rate, r.bits) for r in info] == [(40 * 1176, 88200, 16)] * 3
    blocks = spark.read.format("flac").option("table", "blocks").load(f"{tmp_path}/d/t1.flac").orderBy("block").collect()
    left = [x for r in blocks for x in r.pcm[0]]
    whole = [v for r in src.where("track = 't1'").orderBy("frame_no").collect() for v in r.pcm]
    assert left == [int(v * 32767) for v in whole[0::2]]
    raw = (tmp_path / "e" / "t1.wav").read_bytes()
    assert int.from_bytes(raw[40:44], "little") == 40 * 1176 * 4 and raw[44:46] == int(whole[0] * 32767).to_bytes(2, "little", signed=True)
    assert int.from_bytes((tmp_path / "f" / "t2.wav").read_bytes()[34:36], "little") == 32


@pytest.mark.parametrize(
    "make",
    [
        lambda: Sink("mp3", "/x"), lambda: Sink("dsf", ""), lambda: Sink("wav", "/x", 20), lambda: Sink("flac", "/x", 32), lambda: Sink("flac", "/x", 16, 9), lambda: Sink("dsf", "/x", dst=True),
        lambda: TrackWriter([], False), lambda: TrackWriter([Sink("dsf", f"/x{i}") for i in range(9)], False), lambda: TrackWriter([Sink("dsf", "/x"), Sink("dsf", "/x/")], False),
    ],
)
def test_bad_options_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_missing_columns_and_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="pcm"):
        writer.fan_out(frames(spark, 1).drop("pcm"), [Sink("wav", str(tmp_path), 16)])
    with pytest.raises(Exception, match="no name of a file"):
        writer.save(frames(spark, 1).withColumn("track", F.lit("../x")).drop("pcm"), "dsf", str(tmp_path))


def test_a_feeder_tells_errors():
    def work(items):
        next(items)
        raise KeyError("inside")

    f = Feeder(work)
    with pytest.raises(KeyError):
        for i in range(1000):
            f.put(i)
    got = []
    f = Feeder(got.extend)
    for i in range(100):
        f.put(i)
    f.end()
    assert got == list(range(100))
