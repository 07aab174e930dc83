"""Round trips of the container formats on generated files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.operators import fir
from sigmaspark.sinks import audio
from sigmaspark.sources import dsdiff, dsf
from sigmaspark.sources import fir as fir_file
from sigmaspark.sources.files import REVERSED, Bytes


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    spark.dataSource.register(dsf.DsfSource)
    spark.dataSource.register(dsdiff.DsdiffSource)


def frames(spark, tracks=2, count=150, channels=2):
    rows = [(t, i, channels, 2822400, bytes((t * 31 + i * 7 + k) % 256 for k in range(4704 * channels))) for t in range(1, tracks + 1) for i in range(count)]
    return spark.createDataFrame(rows, "track int, frame_no long, channels int, rate int, payload binary")


def test_reversed():
    assert REVERSED[0b00000001] == 0b10000000 and REVERSED[0xA3] == 0xC5 and (REVERSED[REVERSED] == np.arange(256)).all()


@pytest.mark.parametrize("channels", [1, 2, 6])
def test_dsf_round_trip(spark, tmp_path, channels):
    src = frames(spark, 2, 130, channels)
    done = audio.write_tracks(src, f"{tmp_path}/dsf", audio.write_dsf, ".dsf").collect()
    assert {r.track for r in done} == {"1", "2"} and all(r.written == 130 * 37632 for r in done)
    back = spark.read.format("dsf").load(f"{tmp_path}/dsf")
    got = {(r.path.rsplit("/", 1)[1], r.frame_no): bytes(r.payload) for r in back.collect()}
    assert got == {(f"{r.track}.dsf", r.frame_no): bytes(r.payload) for r in src.collect()}
    info = spark.read.format("dsf").option("table", "info").load(f"{tmp_path}/dsf").collect()
    assert [(r.channels, r.rate, r.samples, r.error) for r in info] == [(channels, 2822400, 130 * 37632, None)] * 2


def test_dsf_layout_of_75_frames(tmp_path):
    path = f"{tmp_path}/a.dsf"
    audio.write_dsf(path, iter([bytes(9408)] * 75), 2, 2822400, tag=b"x" * 256)
    with Bytes(path) as f:
        raw = f.at(0, f.size)
    assert len(raw) == 713052 and struct.unpack_from("<QQ", raw, 12) == (713052, 712796) and raw[-256:] == b"x" * 256


def test_dsf_rejects_other_files(spark, tmp_path):
    (tmp_path / "bad.dsf").write_bytes(b"RIFF" + bytes(200))
    info = spark.read.format("dsf").option("table", "info").load(str(tmp_path)).collect()
    assert info[0].error == "not a DSF file"


def test_dsdiff_round_trip(spark, tmp_path):
    src = frames(spark, 1, 100)
    marks = [audio.marker(0, 2822400, 0, "One"), audio.marker(3723 * 2822400 + 4, 2822400, 1)]
    audio.write_tracks(src, f"{tmp_path}/dff", lambda p, it, c, r: audio.write_dsdiff(p, it, c, r, marks, "Artist", "Títle"), ".dff").collect()
    load = lambda t: spark.read.format("dsdiff").option("table", t).load(f"{tmp_path}/dff")
    assert [bytes(r.payload) for r in load("frames").orderBy("frame_no").collect()] == [bytes(r.payload) for r in src.orderBy("frame_no").collect()]
    i = load("info").first()
    assert (i.compression, i.channels, i.channel_ids, i.samples, i.frames, i.artist, i.title) == ("DSD", 2, ["SLFT", "SRGT"], 100 * 37632, 100, "Artist", "Títle")
    m = load("markers").orderBy("idx").collect()
    assert (m[0].text, m[0].mark_type, m[0].pos) == ("One", 0, 0)
    assert (m[1].hours, m[1].minutes, m[1].seconds, m[1].samples, m[1].mark_type) == (1, 2, 3, 4, 1)


def test_dst_frames(spark, tmp_path):
    path = f"{tmp_path}/two.dff"
    audio.write_dsdiff(path, iter([b"\x66" * 1024, b"\x77" * 513]), 2, 2822400, dst=True)
    rows = spark.read.format("dsdiff").load(path).orderBy("frame_no").collect()
    assert [bytes(r.payload) for r in rows] == [b"\x66" * 1024, b"\x77" * 513]
    assert [(r.format, r.is_first, r.is_last, r.sample_offset) for r in rows] == [("DST", True, False, 0), ("DST", False, True, 37632)]


def test_wav(tmp_path):
    path = f"{tmp_path}/a.wav"
    audio.write_wav(path, iter([np.array([0.0, 1.0, -1.0, 2.0]), np.array([0.5, -0.5])]), 2, 88200, 16, {"INAM": "Title"})
    with Bytes(path) as f:
        raw = f.at(0, f.size)
    assert raw[:4] == b"RIFF" and struct.unpack_from("<I", raw, 4)[0] == len(raw) - 8 and b"INAMTitle" not in raw and b"Title\0" in raw
    assert struct.unpack_from("<6h", raw, 44) == (0, 32767, -32767, 32767, 16383, -16383)
    assert audio.pack_pcm(np.array([-1.0]), 24) == (-8388607 & 0xFFFFFF).to_bytes(3, "little")


@pytest.mark.parametrize("binary", [False, True])
def test_fir_files(tmp_path, binary):
    f = fir_file.Fir([0.5, -0.25, 1e-9], 16, "low pass")
    fir_file.save(f, f"{tmp_path}/f.fir", binary)
    assert fir_file.load(f"{tmp_path}/f.fir") == f


def test_fir_over_frames_equals_one_pass(spark):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 64 * 5, dtype=np.uint8).tobytes()
    coef = fir.windowed_sinc(33, 1 / 20)
    src = spark.createDataFrame([("t", i, data[64 * i : 64 * i + 64]) for i in range(5)], "track string, frame_no long, payload binary")
    got = [y for r in fir.decimate_frames(src, ["track"], coef, 8).orderBy("frame_no").collect() for y in r.pcm]
    x = np.concatenate([np.zeros(32), np.unpackbits(np.frombuffer(data, np.uint8)) * 2.0 - 1])
    want = [float(np.dot(coef, x[n * 8 + 32 - np.arange(33)])) for n in range(64 * 5)]
    assert np.allclose(got, want)


def test_fir_expression_equals_numpy(spark):
    x = np.sin(np.arange(40.0))
    coef = [0.25, 0.5, 0.25]
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(fir.decimate_array(F.col("x"), coef, 4).alias("y"))
    want = [sum(c * (x[n * 4 - k] if n * 4 >= k else 0) for k, c in enumerate(coef)) for n in range(10)]
    assert np.allclose(df.first().y, want)


def test_shares_cover_a_file_once(spark, tmp_path, monkeypatch):
    from sigmaspark.sources import files

    for total, n, step in ((10, 3, 1), (0, 2, 1), (7, 10, 3), (301, 4, 3)):
        parts = [files.share_of(total, i, n, step) for i in range(n)]
        assert [x for a, b in parts for x in range(a, b)] == list(range(total)) and all(a % step == 0 for a, _ in parts if a < total)
    src = frames(spark, 1, 130)
    audio.write_tracks(src, f"{tmp_path}/a", audio.write_dsf, ".dsf").collect()
    audio.write_tracks(src, f"{tmp_path}/b", audio.write_dsdiff, ".dff").collect()
    monkeypatch.setattr(files, "SPLIT_BYTES", 100_000)
    want = [bytes(r.payload) for r in src.orderBy("frame_no").collect()]
    for kind, folder in (("dsf", "a"), ("dsdiff", "b")):
        back = spark.read.format(kind).load(f"{tmp_path}/{folder}")
        assert len({s.share for s in (dsf if kind == "dsf" else dsdiff).Reader({"path": f"{tmp_path}/{folder}"}, back.schema).partitions()}) == 13
        assert [bytes(r.payload) for r in back.orderBy("frame_no").collect()] == want


@pytest.mark.parametrize("taps", [1, 2, 8, 9, 40, 97])
@pytest.mark.parametrize("step", [8, 16, 32])
def test_byte_tables_equal_the_definition(taps, step):
    rng = np.random.default_rng(taps + step)
    h = rng.normal(size=taps)
    raw = rng.integers(0, 256, 48, dtype=np.uint8).tobytes()
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(float) * 2 - 1
    want = [sum(h[k] * bits[n - k] for k in range(taps) if n - k >= 0) for n in range(0, len(bits), step)]
    per = 16
    for cut in (0, 16, 32):
        got = fir.bits_to_pcm(raw[cut : cut + per], raw[:cut], h, step)
        assert np.allclose(got, want[cut * 8 // step : (cut + per) * 8 // step])


@pytest.mark.parametrize("chain", [[(24, 8), (12, 2)], [(40, 8), (21, 2), (15, 2)], [(9, 4), (7, 2)], [(30, 16), (5, 3)]])
def test_chains_equal_their_one_filter(chain):
    rng = np.random.default_rng(len(chain))
    stages = [(rng.normal(size=n), k) for n, k in chain]
    step = int(np.prod([k for _, k in chain]))
    h = np.array(fir.combined([(c.tolist(), k) for c, k in stages]))
    raw = rng.integers(0, 256, 6 * step, dtype=np.uint8).tobytes()
    bits = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(float) * 2 - 1
    whole = [float(h[: n + 1] @ bits[n::-1][: len(h)]) if n < len(h) else float(h @ bits[n - len(h) + 1 : n + 1][::-1]) for n in range(0, len(bits), step)]
    size = 2 * step
    for cut in range(0, len(raw), size):
        got = fir.chain_to_pcm(raw[cut : cut + size], raw[:cut], stages)
        # Filters before the first sound give nothing, as the chain's single ones do.
        assert np.allclose(got, whole[cut * 8 // step : (cut + size) * 8 // step])


def test_names_with_spaces_and_marks(spark, tmp_path):
    folder = tmp_path / "My Music #1 (50%)"
    folder.mkdir()
    for name in ("a b", "c#d", "e%20f", "g?h", "ü 音"):
        audio.write_dsf(f"{folder}/{name}.dsf", iter([bytes(9408)] * 2), 2, 2822400)
    got = spark.read.format("dsf").load(str(folder)).select("path").distinct().collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in got) == sorted(f"{n}.dsf" for n in ("a b", "c#d", "e%20f", "g?h", "ü 音"))
    assert spark.read.format("dsf").load(f"file://{folder}").count() == 10


def test_edit_master_in_parts(spark, tmp_path, monkeypatch):
    """An album's frames are written in parts, and only these are put in order by its task."""
    from pyspark.sql import functions as F

    from sigmaspark.sinks import audio
    from sigmaspark.sources import dsdiff

    monkeypatch.setattr(audio, "PART", 4)
    f = spark.range(22).select(F.lit("a").alias("album"), (F.lit(2) - F.floor(F.col("id") / 11)).cast("int").alias("position"), (F.col("id") % 11).alias("frame_no"), F.lit(1).alias("channels"), F.lit(2822400).alias("rate"), F.rpad(F.lit(""), 4704, F.concat(F.col("id").cast("string"), F.lit(":"))).cast("binary").alias("payload"), F.lit("t").alias("title"), F.lit(b"tag").alias("tag"))
    out = audio.write_edit_masters(f, str(tmp_path))
    assert "payload" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.tracks) for r in out.collect()] == [2] and len(list((tmp_path / "_parts").glob("*.part"))) == 6
    spark.dataSource.register(dsdiff.DsdiffSource)
    got = [bytes(r.payload).split(b":")[0] for r in spark.read.format("dsdiff").load(str(tmp_path)).orderBy("frame_no").collect()]
    assert got == [b"%d" % i for i in [*range(11, 22), *range(11)]]


def test_an_edit_master_is_written_by_one_task(spark, tmp_path, monkeypatch):
    """Sums that turn out small are broadcast in the middle of the job, and the parts' shuffle may then be read map by map."""
    from pyspark.sql import functions as F

    from sigmaspark.sinks import audio

    monkeypatch.setattr(audio, "PART", 4)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        f = spark.range(88).select((F.col("id") % 2).cast("string").alias("album"), F.floor(F.col("id") / 22).cast("int").alias("position"), F.floor(F.col("id") % 22 / 2).alias("frame_no"), F.lit(1).alias("channels"), F.lit(2822400).alias("rate"), F.rpad(F.lit(""), 4704, F.concat(F.col("id").cast("string"), F.lit(":"))).cast("binary").alias("payload"), F.lit("t").alias("title"), F.lit(b"tag").alias("tag"))
        done = audio.write_edit_masters(f, str(tmp_path)).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted((r.album, r.tracks, r.written) for r in done) == [("0", 4, 44 * 4704), ("1", 4, 44 * 4704)]
