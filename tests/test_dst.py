"""DST decoding against an encoder written for the test."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.functions import dst


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n - 1, -1, -1)]


def encode(sound, channels, rate, filters, tables, half, seed_bit=0):
    """One frame: ``sound`` as (channel, sample) bits; each channel has its own filter and table."""
    w = Writer()
    w.put(0b1111, 4)  # coded; one segmentation for all
    w.put(1, 1)  # tables are mapped as filters are
    if channels == 1 or len(filters) == 1:
        w.put(1, 1)
    else:
        w.put(0, 1)
        for ch in range(1, channels):
            w.put(ch, ch.bit_length())
    for h in half:
        w.put(h, 1)
    for f in filters:
        w.put(len(f) - 1, 7)
        w.put(0, 1)
        for c in f:
            w.put(c & 511, 9)
    for t in tables:
        w.put(len(t) - 1, 6)
        w.put(0, 1)
        for p in t:
            w.put(p - 1, 7)
    w.put(0, 1)
    low, a, shifts = 0, 4095, 0

    def code(bit, p):
        nonlocal low, a, shifts
        q = ((a >> 8) | (a >> 7 & 1)) * p
        if bit:
            a -= q
        else:
            low += a - q
            a = q
        while a < 2048:
            a, low, shifts = a << 1, low << 1, shifts + 1

    code(seed_bit, int(f"{filters[0][0] & 127:07b}"[::-1], 2) + 1)
    past = [[-1 if k % 2 == 0 else 1 for k in range(128)] for _ in range(channels)]
    for i in range(dst.samples_per_frame(rate)):
        for ch in range(channels):
            k = ch if len(filters) > 1 else 0
            f, t = filters[k], tables[k]
            x = sum(c * past[ch][j] for j, c in enumerate(f))
            p = 128 if half[ch] and i < len(f) else t[min(abs(x) >> 3, len(t) - 1)]
            v = int(sound[ch][i])
            code((x < 0) ^ v, p)
            past[ch] = [1 if v else -1, *past[ch][:127]]
    w.put(low, 12 + shifts)
    w.bits += [0] * (-len(w.bits) % 8)
    return np.packbits(np.array(w.bits, np.uint8)).tobytes()


def plain(sound):
    return np.ascontiguousarray(np.packbits(np.asarray(sound, np.uint8), axis=1).T).tobytes()


@pytest.mark.parametrize("channels", [1, 2])
def test_coded_frames(spark, channels):
    rng = np.random.default_rng(channels)
    rows = []
    for k in range(5):
        filters = [rng.integers(-60, 60, rng.integers(1, 40)).tolist() for _ in range(channels if k % 2 else 1)]
        tables = [rng.integers(1, 120, rng.integers(1, 20)).tolist() for _ in filters]
        sound = rng.integers(0, 2, (channels, 1176))
        rows.append((k, channels, 88200, encode(sound, channels, 88200, filters, tables, rng.integers(0, 2, channels).tolist()), plain(sound)))
    rows.append((9, channels, 88200, b"\0" + plain(sound), plain(sound)))
    df = spark.createDataFrame([*rows, (10, channels, 88200, None, None)], "k int, channels int, rate int, payload binary, want binary")
    got = df.withColumn("got", dst.decode_dst("payload", "channels", "rate"))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0 and got.count() == 7


def test_predicted_coefficients():
    w = Writer()
    w.put(3, 7), w.put(1, 1), w.put(0, 2), w.put(-5 & 511, 9), w.put(2, 3)
    for zeros, low, sign in ((0, 3, 0), (1, 1, 1), (0, 0, None)):
        w.put(1, zeros + 1), w.put(low, 2)
        if sign is not None:
            w.put(sign, 1)
    r = dst.BitReader(np.packbits(np.array(w.bits + [0] * 16, np.uint8)).tobytes())
    # guesses: x = -8 * last, so the last value itself
    assert dst._coefficients(r, 1, 7, 9, True, dst.FILTER_PREDICTION) == [[-5, -5 + 3, -2 - 5, -7]]


@pytest.mark.parametrize("bad", [b"", b"\x80", b"\x21\0\0", b"\x80\0\0\0"])
def test_broken_frames(bad):
    with pytest.raises(dst.DstError):
        dst.decode([bad], 2, 88200)


@pytest.mark.parametrize("channels", [1, 2, 6])
def test_encoder_round_trip(channels):
    rng = np.random.default_rng(3)
    size = dst.samples_per_frame(88200) // 8 * channels
    frames = [(b"12345:" * 300)[:size], rng.integers(0, 256, size, dtype=np.uint8).tobytes(), b"\x69" * size, bytes(size)]
    coded = dst.encode(frames, channels, 88200)
    assert dst.decode(coded, channels, 88200) == frames
    assert coded[1] == b"\0" + frames[1] and len(coded[3]) < size  # noise is stored as it is
    with pytest.raises(dst.DstError):
        dst.encode([b"short"], channels, 88200)


def test_modulated_tone_shrinks():
    """A tone through a modulator of second order, as 1-bit sound is made."""
    x, v, w, bits = np.sin(np.arange(37632) / 300) * 0.5, 0.0, 0.0, []
    for s in x:
        v += s - (1 if bits and bits[-1] else -1)
        w += v
        bits.append(1 if w > 0 else 0)
    plain_frame = np.packbits(bits).tobytes()
    coded = dst.encode([plain_frame], 1, 2822400)
    assert len(coded[0]) < 0.5 * len(plain_frame) and dst.decode(coded, 1, 2822400) == [plain_frame]


def test_batches_end_with_their_first_error(spark):
    size = dst.samples_per_frame(88200) // 8
    good = dst.encode([bytes(size)], 1, 88200)[0]
    payloads = [good] * 40
    payloads[5], payloads[3], payloads[20] = b"\x21\0\0", b"\x80\0", b""
    df = spark.createDataFrame([("t", i, 1, 88200, p) for i, p in enumerate(payloads)] + [("u", 0, 1, 88200, None)], "track string, frame_no long, channels int, rate int, payload binary").repartition(3)
    got = {(r.track, r.frame_no): r for r in dst.decode_batches(df, ["track"]).collect()}
    assert {k: (r.batch, r.error) for k, r in got.items() if r.track == "t"} == {("t", i): (i // 16, {0: "segmentation is not supported", 1: "empty frame"}.get(i // 16)) for i in range(40)}
    assert all((got["t", i].payload is None) == (i < 32) for i in range(40)) and got["u", 0].payload is None
    tried = df.select("frame_no", dst.try_decode_dst("payload", "channels", "rate").alias("x")).where("frame_no = 4").first()
    assert bytes(tried.x.payload) == bytes(size)


def test_many_frames_in_step(spark):
    """Frames are coded in step by the thousand, from partitions of that size however few files they come from."""
    size = dst.samples_per_frame(88200) // 8
    frames = [(b"%d:" % i * size)[:size] for i in range(dst.FITTED * 2 + 3)]
    coded = dst.encode(frames, 1, 88200)
    assert [dst.encode([f], 1, 88200)[0] for f in frames] == coded and dst.decode(coded, 1, 88200) == frames
    df = spark.createDataFrame([(i, 1, 88200, c) for i, c in enumerate(coded)], "frame_no int, channels int, rate int, payload binary").coalesce(1)
    out = dst.dealt(df, 5000, "frame_no")
    assert out.rdd.getNumPartitions() == 6 and dst.SIDE > 900
    assert {bytes(r.x) for r in out.select(dst.decode_dst("payload", "channels", "rate").alias("x")).collect()} == set(frames)
