"""FLAC coding and files: round trips, checksums, comments, and a decoder written for the test."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.functions import flac
from sigmaspark.sinks import flac as sink
from sigmaspark.sources.flac import FlacSource


def slow_crc(data, width, polynomial):
    c = 0
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c >> (width - 1) & 1 else c << 1) & ((1 << width) - 1)
    return c


def signal(kind, bits, channels, n=4704):
    rng, t, top = np.random.default_rng(n + channels), np.arange(n), 2 ** (bits - 1) - 1
    return {
        "noise": rng.integers(-top - 1, top + 1, (channels, n)),
        "sine": np.stack([(np.sin(t / (20 + c)) * top * 0.9).astype(int) for c in range(channels)]),
        "constant": np.full((channels, n), -5),
        "quiet": rng.integers(-3, 4, (channels, n)),
        "mixed": np.stack([(np.sin(t / 50) * top * 0.5 + rng.normal(0, top * 0.01, n)).astype(int) + c for c in range(channels)]),
        "extreme": np.where(rng.random((channels, n)) < 0.5, top, -top - 1),
    }[kind]


def plain_decode(data, bits):
    """A decoder bit by bit, of frames as this module's encoder makes them; samples by channel."""
    s = "".join(f"{b:08b}" for b in data)
    at = 0

    def take(n, signed=False):
        nonlocal at
        v = int(s[at : at + n] or "0", 2)
        at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    assert take(16) == 0xFFF8
    take(4), take(4)
    assignment = take(4)
    take(4)
    lead = take(8)
    while lead & 0x40 and lead & 0x80:
        lead = (lead << 1) & 0xFF
        take(8)
    n = take(16) + 1
    take(8)
    out = []
    for ch in range(2 if assignment > 7 else assignment + 1):
        width = bits + (assignment in (8, 10) and ch == 1) + (assignment == 9 and ch == 0)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            out.append([take(width, True)] * n)
            continue
        if kind == 1:
            out.append([take(width, True) for _ in range(n)])
            continue
        order = kind - 31 if kind >= 32 else kind - 8
        x = [take(width, True) for _ in range(order)]
        coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else [], 0
        if kind >= 32:
            precision, shift = take(4) + 1, take(5)
            coef = [take(precision, True) for _ in range(order)]
        wide = take(2)
        parts = 1 << take(4)
        for p in range(parts):
            k = take(5 if wide else 4)
            for _ in range(n // parts - (order if p == 0 else 0)):
                q = s.index("1", at) - at
                at += q + 1
                u = q << k | take(k)
                e = -(u >> 1) - 1 if u & 1 else u >> 1
                x.append(e + (sum(c * v for c, v in zip(coef, x[::-1])) >> shift))
        out.append(x)
    if assignment == 8:
        out[1] = [a - b for a, b in zip(*out)]
    elif assignment == 9:
        out[0] = [a + b for a, b in zip(*out)]
    elif assignment == 10:
        pairs = [((2 * m | d & 1) + d, (2 * m | d & 1) - d) for m, d in zip(*out)]
        out = [[a >> 1 for a, _ in pairs], [b >> 1 for _, b in pairs]]
    return np.array(out)


def test_checksums():
    for d in (b"", b"\1", b"hello", bytes(range(256)) * 3 + b"x"):
        assert flac.crc(d, 8) == slow_crc(d, 8, 0x07) and flac.crc(d, 16) == slow_crc(d, 16, 0x8005)
    assert flac.crc(b"123456789", 8) == 0xF4 and flac.crc(b"123456789", 16) == 0xFEE8


@pytest.mark.parametrize("bits", [16, 24])
@pytest.mark.parametrize("kind", ["noise", "sine", "constant", "quiet", "mixed", "extreme"])
def test_frames_round_trip(bits, kind):
    for channels in (1, 2, 6):
        for level in (0, 2, 5, 8):
            for n in (4704, 1, 3, 7, 100):
                x = signal(kind, bits, channels)[:, :n]
                d = flac.encode_frame(x, 70_000 + n, 88200, bits, level)
                no, y, end = flac.decode_frame(b"zz" + d + b"tail", 2, 88200, bits)
                assert (no, end) == (70_000 + n, len(d) + 2) and np.array_equal(x, y)
        short = signal(kind, bits, channels)[:, :300]
        assert np.array_equal(plain_decode(flac.encode_frame(short, 5, 88200, bits, 8), bits), short)


def test_better_levels_are_smaller():
    x = signal("mixed", 24, 2)
    sizes = [len(flac.encode_frame(x, 0, 88200, 24, k)) for k in (0, 5, 8)]
    assert sizes[0] > sizes[1] >= sizes[2] and sizes[0] < 4704 * 6
    loud = signal("sine", 16, 2)
    loud[1] = loud[0] + 3  # near equal channels cost little more than one
    assert len(flac.encode_frame(loud, 0, 88200, 16, 5)) < 1.2 * len(flac.encode_frame(loud[:1], 0, 88200, 16, 5))


@pytest.mark.parametrize("n", [0, 127, 128, 2047, 2048, 65_535, 65_536, 2**20, 2**21, 2**26, 2**31])
def test_frame_numbers(n):
    d = flac.encode_frame(np.arange(16)[None], n, 88200, 16)
    assert flac.decode_frame(d, 0, 88200, 16)[0] == n


def test_damage_is_noticed():
    d = flac.encode_frame(signal("mixed", 16, 2)[:, :500], 0, 88200, 16)
    for at in (2, 7, 20, len(d) // 2, len(d) - 1):
        bad = d[:at] + bytes([d[at] ^ 4]) + d[at + 1 :]
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode_frame(bad, 0, 88200, 16)
    with pytest.raises(flac.FlacError):
        flac.encode_frame(np.zeros((9, 4), int), 0, 88200, 16)


def rows_of(spark, tracks, per=588):
    """(track, frame_no, pcm): ``tracks`` maps a name to (channel, sample) floats."""
    rows = [(k, i // per, x.shape[0], 44100, x[:, i : i + per].T.ravel().tolist()) for k, x in tracks.items() for i in range(0, x.shape[1], per)]
    return spark.createDataFrame(rows, "track string, frame_no long, channels int, rate int, pcm array<double>").repartition(5)


def test_files(spark, tmp_path):
    spark.dataSource.register(FlacSource)
    rng = np.random.default_rng(4)
    tracks = {"a": rng.normal(0, 0.4, (2, 588 * 11 + 17)), "b": np.sin(np.arange(588 * 3) / 30)[None], "c": rng.uniform(-2, 2, (6, 588))}
    pcm = rows_of(spark, tracks)
    tags = spark.createDataFrame([("a", [("TITLE", "Ä = b"), ("X", "")]), ("b", None)], "track string, comments array<struct<key:string,value:string>>")
    out = sink.write_flacs(pcm, str(tmp_path), 16, 8, 4, tags=tags, scratch=str(tmp_path / "scratch")).collect()
    assert {r.track: r.samples for r in out} == {k: x.shape[1] for k, x in tracks.items()}
    for k, x in tracks.items():
        want = sink.integers(x, 16)
        raw = (tmp_path / f"{k}.flac").read_bytes()
        info = spark.read.format("flac").load(str(tmp_path / f"{k}.flac")).first()
        assert (info.rate, info.channels, info.bits, info.samples, info.block) == (44100, len(x), 16, x.shape[1], min(588 * 4, x.shape[1])) and raw[:4] == b"fLaC"
        assert info.md5 == hashlib.md5(np.ascontiguousarray(want.T.astype("<i2")).tobytes()).hexdigest()
        got = spark.read.format("flac").option("table", "blocks").load(str(tmp_path / f"{k}.flac")).orderBy("block").collect()
        assert np.array_equal(np.concatenate([np.array(r.pcm) for r in got], 1), want)
    said = spark.read.format("flac").option("table", "comments").load(str(tmp_path)).collect()
    assert sorted((r.idx, r.key, r.value) for r in said) == [(0, "TITLE", "Ä = b"), (1, "X", "")]


def test_missing_and_uneven_frames_fail(spark, tmp_path):
    pcm = rows_of(spark, {"a": np.zeros((1, 588 * 12))})
    for i, bad in enumerate((pcm.where("frame_no not between 4 and 7"), pcm.withColumn("pcm", F.when(F.col("frame_no") == 1, F.slice("pcm", 1, 9)).otherwise(F.col("pcm"))), pcm.withColumn("rate", F.when(F.col("frame_no") > 7, 48000).otherwise(F.col("rate"))))):
        with pytest.raises(Exception, match="missing ones"):
            sink.write_flacs(bad, str(tmp_path / str(i)), 16, scratch=str(tmp_path / f"s{i}")).collect()
        assert not list((tmp_path / str(i)).glob("*.flac"))


def test_a_damaged_file_is_reported(spark, tmp_path):
    spark.dataSource.register(FlacSource)
    (tmp_path / "x.flac").write_bytes(b"fLaX" + bytes(60))
    assert "not a FLAC file" in spark.read.format("flac").load(str(tmp_path)).first().error


def test_options(spark):
    df = spark.createDataFrame([("T", 3, 12, None, 0)], "title string, n int, of int, genre string, year int")
    got = df.select(sink.vorbis_comments({"genre": F.col("genre"), "year": F.col("year"), "title": F.lit("")}, {"title": F.col("title"), "number": F.col("n"), "total": F.col("of"), "isrc": F.lit("X1")})).first()[0]
    assert [tuple(x) for x in got] == [("TITLE", "T"), ("ISRC", "X1"), ("TRACKNUMBER", "3/12")]
    assert sink.output_rate(2822400) == 88200 and sink.output_rate(48000) == 48000
