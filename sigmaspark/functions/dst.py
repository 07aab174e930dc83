"""DST coding (ISO/IEC 14496-3, part 3, subpart 10): compressed frames to 1-bit audio and back.

Each frame stands alone, but inside it every bit depends on the ones before. So frames are
decoded side by side: a batch moves through its samples in step, and each step is a handful of
array operations over all its frames. Frames whose sound is stored plainly are copied. The encoder fits one linear
predictor and one table of probabilities to each channel of a frame.

As usual for discs, one segmentation for all channels is expected; other frames, and broken
ones, raise DstError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the standard: weights by which coded coefficients are predicted from those before.
FILTER_PREDICTION = ((-8,), (-16, 8), (-9, -5, 6))
TABLE_PREDICTION = ((-8,), (-16, 8), (-24, 24, -8))
HISTORY = 128
START = np.where(np.arange(HISTORY) % 2 == 0, 1, -1)  # what comes before a frame; the newest is -1


class DstError(ValueError):
    pass


def samples_per_frame(rate: int) -> int:
    return 588 * (rate // 44100)


def seed_probability(coefficient: int) -> int:
    """Of the first bit that is coded: seven bits of the first coefficient in reverse order."""
    return int(f"{coefficient & 127:07b}"[::-1], 2) + 1


class BitReader:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def read(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise DstError("frame ends early")
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v - (1 << n) if v >> n - 1 else v

    def rice(self, k: int) -> int:
        """Zeros up to a one, then k bits; a sign unless that is 0."""
        zeros = 0
        while not self.read(1):
            zeros += 1
        v = zeros << k | self.read(k)
        return -v if v and self.read(1) else v


@dataclass
class Header:
    filters: list[list[int]]
    tables: list[list[int]]
    filter_of: list[int]  # by channel
    table_of: list[int]
    half: list[int]
    at: int  # first bit of the coded sound


def _mapping(r: BitReader, channels: int) -> tuple[list[int], int]:
    if r.read(1):
        return [0] * channels, 1
    out, count = [0], 1
    for _ in range(1, channels):
        which = r.read(count.bit_length())
        if which > count:
            raise DstError("bad mapping")
        count += which == count
        out.append(which)
    return out, count


def _coefficients(r: BitReader, count: int, length_bits: int, bits: int, signed: bool, prediction) -> list[list[int]]:
    plain = (lambda: r.signed(bits)) if signed else (lambda: r.read(bits) + 1)
    out = []
    for _ in range(count):
        size = r.read(length_bits) + 1
        if not r.read(1):
            out.append([plain() for _ in range(size)])
            continue
        method = r.read(2)
        if method == 3:
            raise DstError("bad prediction method")
        weights = prediction[method]
        row = [plain() for _ in weights]
        low = r.read(3)
        while len(row) < size:
            x = sum(w * row[-1 - k] for k, w in enumerate(weights))
            guess = -((x + 4) // 8) if x >= 0 else (3 - x) // 8
            row.append(r.rice(low) + guess)
            if not signed and not 1 <= row[-1] <= 1 << bits:
                raise DstError("bad probability")
        out.append(row[:size])
    return out


def header(data: bytes, channels: int) -> Header:
    r = BitReader(data)
    r.read(1)
    if (r.read(1), r.read(1), r.read(1)) != (1, 1, 1):
        raise DstError("segmentation is not supported")
    same = r.read(1)
    filter_of, filters = _mapping(r, channels)
    table_of, tables = (filter_of, filters) if same else _mapping(r, channels)
    half = [r.read(1) for _ in range(channels)]
    f = _coefficients(r, filters, 7, 9, True, FILTER_PREDICTION)
    t = _coefficients(r, tables, 6, 7, False, TABLE_PREDICTION)
    if r.read(1):
        raise DstError("bad arithmetic code")
    return Header(f, t, filter_of, table_of, half, r.at)


# By an interval of 12 bits: what a probability is multiplied by, and the shift that brings it back to 12 bits.
SCALE = np.array([a >> 8 | a >> 7 & 1 for a in range(4096)], np.int32)
SHIFT = np.array([12 - max(a, 1).bit_length() if a < 2048 else 0 for a in range(4096)], np.int32)


class Coder:
    """Arithmetic decoders of many frames, in step."""

    def __init__(self, frames: list[bytes], starts: list[int]):
        n = len(frames)
        longest = max(len(f) for f in frames) * 8 + 32
        bits = np.zeros((n, longest), np.uint16)
        for i, (f, at) in enumerate(zip(frames, starts)):
            b = np.unpackbits(np.frombuffer(f, np.uint8))[at:]
            bits[i, : len(b)] = b
        w = np.zeros((n, longest - 12), np.uint16)  # the 12 bits from each place on; zeros follow the end
        for k in range(12):
            w |= bits[:, k : longest - 12 + k] << np.uint16(11 - k)
        self.window, self.base, self.last = w.ravel(), np.arange(n) * w.shape[1], w.shape[1] - 1
        self.c = w[:, 0].astype(np.int32)
        self.a = np.full(n, 4095, np.int32)
        self.pos = np.full(n, 12)

    def bit(self, p: np.ndarray) -> np.ndarray:
        a, c = self.a, self.c
        q = SCALE.take(a) * p
        low = a - q
        one = c < low
        a = np.where(one, low, q)
        c = np.where(one, c, c - low)
        n = SHIFT.take(a)
        more = self.window.take(self.base + np.minimum(self.pos, self.last)) >> (12 - n)
        self.a, self.c = a << n, (c << n) | more
        self.pos += n
        return one


BLOCK = 1024  # samples a channel that are kept as numbers at a time


def decode_each(frames: list[bytes], channels: int, rate: int) -> list[tuple[bytes | None, str | None]]:
    """(decoded frame, bytes interleaved by channel; None) or (None, what is wrong with it) for each frame, in the order given."""
    count = samples_per_frame(rate)
    size = count // 8 * channels
    out: list[tuple[bytes | None, str | None]] = [(None, None)] * len(frames)
    coded, heads = [], []
    for i, f in enumerate(frames):
        try:
            if len(f) <= 1:
                raise DstError("empty frame")
            if f[0] & 0x80:
                heads.append(header(f, channels))
                coded.append(i)
            elif f[0] & 0x3F:
                raise DstError("bad plain frame")
            else:
                out[i] = f[1 : 1 + size], None
        except DstError as e:
            out[i] = None, str(e)
    if not coded:
        return out
    n = len(coded)
    coder = Coder([frames[i] for i in coded], [h.at for h in heads])
    longest = max(len(f) for h in heads for f in h.filters)
    # Samples come first and frames last, so that each step works on whole rows. Sums wrap at sixteen bits.
    weight = np.zeros((longest, channels, n), np.int16)  # oldest first
    length = np.zeros((channels, n), np.int64)
    probs = np.zeros((channels, n, 64), np.int32)
    last = np.zeros((channels, n), np.int64)
    half = np.zeros((channels, n), bool)
    for j, h in enumerate(heads):
        for ch in range(channels):
            f, t = h.filters[h.filter_of[ch]], h.tables[h.table_of[ch]]
            weight[longest - len(f) :, ch, j] = np.array(f[::-1], np.int64).astype(np.int16)
            length[ch, j], last[ch, j], half[ch, j] = len(f), len(t) - 1, h.half[ch]
            probs[ch, j, : len(t)] = t
    line = np.empty((HISTORY + BLOCK, channels, n), np.int16)
    line[BLOCK:] = START[:, None, None]
    planes = []
    coder.bit(np.array([seed_probability(h.filters[0][0]) for h in heads], np.int32))
    flat, up, down = probs.ravel(), np.int16(1), np.int16(-1)
    base = np.arange(channels * n).reshape(channels, n) * probs.shape[2]
    for begin in range(0, count, BLOCK):
        line[:HISTORY] = line[BLOCK:]
        block = min(BLOCK, count - begin)
        for i in range(block):
            x = np.einsum("kcn,kcn->cn", line[i + HISTORY - longest : i + HISTORY], weight)
            p = flat.take(base + np.minimum(np.abs(x.astype(np.int32)) >> 3, last))
            if begin + i < longest:
                p = np.where(half & (begin + i < length), 128, p)
            under = x < 0
            for ch in range(channels):
                line[HISTORY + i, ch] = np.where(under[ch] ^ coder.bit(p[ch]), up, down)
        planes.append(np.packbits(line[HISTORY : HISTORY + block] > 0, axis=0))
    whole = np.concatenate(planes)  # byte, channel, frame
    for j, i in enumerate(coded):
        out[i] = whole[:, :, j].tobytes(), None
    return out


def decode(frames: list[bytes], channels: int, rate: int) -> list[bytes]:
    """Decoded frames in the order given; the first broken one's error is raised."""
    got = decode_each(frames, channels, rate)
    for _, error in got:
        if error:
            raise DstError(error)
    return [x for x, _ in got]


# ---- encoding


class BitWriter:
    def __init__(self):
        self.bits: list[int] = []

    def put(self, v: int, n: int) -> None:
        self.bits += [v >> k & 1 for k in range(n - 1, -1, -1)]


def fitted(sound: np.ndarray, order: int) -> np.ndarray:
    """Predictor of each line of ``sound`` (-1 and 1), by Levinson's recursion, as coefficients of nine bits, nearest sample first."""
    n = sound.shape[1]
    r = np.stack([np.einsum("ij,ij->i", sound[:, : n - k], sound[:, k:]) for k in range(order + 1)], 1).astype(np.float64)
    a, error = np.zeros((len(sound), order)), r[:, 0] * (1 + 1e-3)
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-6 * r[:, 0])
    return np.clip(np.rint(a * 200), -256, 255).astype(np.int64)


class Encoder:
    """Arithmetic coders of many frames, in step; sums are carried over at the end."""

    def __init__(self, n: int, most: int):
        self.a, self.pos, self.rows = np.full(n, 4095, np.int32), np.zeros(n, np.int64), np.arange(n)
        self._widen(np.zeros((n, most), np.int32))  # what is added at each place, in units of the bit twelve places on

    def _widen(self, sums: np.ndarray) -> None:
        self.sums, self.flat, self.base = sums, sums.ravel(), self.rows * sums.shape[1]
        self.room = sums.shape[1] - int(self.pos.max())

    def bit(self, one: np.ndarray, p: np.ndarray) -> None:
        if self.room <= 12:  # a bit moves on by less than twelve places
            self._widen(self.sums)
            if self.room <= 12:
                self._widen(np.concatenate([self.sums, np.zeros_like(self.sums)], 1))
        self.room -= 12
        q = SCALE.take(self.a) * p
        low = self.a - q
        at = self.base + self.pos
        self.flat[at] = self.flat.take(at) + np.where(one, 0, low)
        a = np.where(one, low, q)
        n = SHIFT.take(a)
        self.a = a << n
        self.pos += n

    def codes(self) -> list[np.ndarray]:
        """The bits of each frame's number."""
        most = int(self.pos.max()) + 13
        digits = np.zeros((len(self.rows), most), np.int64)
        width = min(self.sums.shape[1], most - 12)
        digits[:, 12 : 12 + width] = self.sums[:, :width]
        for k in range(most - 1, 0, -1):
            digits[:, k - 1] += digits[:, k] >> 1
            digits[:, k] &= 1
        return [d[1 : 13 + p].astype(np.uint8) for d, p in zip(digits, self.pos.tolist(), strict=True)]


FITTED = 8  # frames whose predictors are fitted at a time


def encode(frames: list[bytes], channels: int, rate: int, order: int = 32, bins: int = 32) -> list[bytes]:
    """Coded frames of plain ones (bytes interleaved by channel); a frame that coding doesn't shorten is stored plainly."""
    count, n = samples_per_frame(rate), len(frames)
    size = count // 8 * channels
    if any(len(f) != size for f in frames):
        raise DstError(f"frames have {size} bytes")
    if not n:
        return []
    filters = [np.zeros((n, order), np.int64) for _ in range(channels)]
    tables = [np.zeros((n, bins), np.int64) for _ in range(channels)]
    # By sample, channel and frame: whether the guess is right and with what probability it isn't.
    right, chance = np.empty((count, channels, n), bool), np.empty((count, channels, n), np.uint8)
    for begin in range(0, n, FITTED):
        some = frames[begin : begin + FITTED]
        m, end = len(some), begin + len(some)
        bytes_of = np.frombuffer(b"".join(some), np.uint8).reshape(m, count // 8, channels)
        sound = np.unpackbits(np.ascontiguousarray(bytes_of.transpose(2, 0, 1)), axis=2)  # channel, frame, sample
        for ch in range(channels):
            f = fitted(sound[ch].astype(np.float32) * 2 - 1, order)
            past = np.concatenate([np.tile(START.astype(np.int16), (m, 1)), sound[ch].astype(np.int16) * 2 - 1], 1)
            guess = np.zeros((m, count), np.int16)
            for k in range(order):
                guess += f[:, k, None].astype(np.int16) * past[:, HISTORY - 1 - k : HISTORY - 1 - k + count]
            wrong = (guess >= 0) != (sound[ch] == 1)
            level = np.minimum(np.abs(guess.astype(np.int32)) >> 3, bins - 1)
            key = (np.arange(m)[:, None] * bins + level).ravel()
            seen = np.bincount(key, minlength=m * bins).reshape(m, bins)
            missed = np.bincount(key[wrong.ravel()], minlength=m * bins).reshape(m, bins)
            filters[ch][begin:end] = f
            table = np.clip(np.rint(256 * (missed + 0.5) / (seen + 1)), 1, 128).astype(np.uint8)
            tables[ch][begin:end] = table
            chance[:, ch, begin:end] = table.ravel().take(key).reshape(m, count).T
            right[:, ch, begin:end] = ~wrong.T
    chance[:order] = 128
    coder = Encoder(n, count * channels // 8 + 64)
    coder.bit(np.zeros(n, bool), np.array([seed_probability(int(f[0])) for f in filters[0]], np.int32))
    for one, p in zip(right.reshape(-1, n), chance.reshape(-1, n)):
        coder.bit(one, p)
    out = []
    for j, code in enumerate(coder.codes()):
        w = BitWriter()
        w.put(0b11111, 5)  # coded; one segmentation for all; tables are mapped as filters are
        if channels == 1:
            w.put(1, 1)
        else:
            w.put(0, 1)
            for ch in range(1, channels):
                w.put(ch, ch.bit_length())
        w.put((1 << channels) - 1, channels)
        for f in filters:
            w.put(order - 1, 7)
            w.put(0, 1)
            for c in f[j].tolist():
                w.put(c & 511, 9)
        for t in tables:
            w.put(bins - 1, 6)
            w.put(0, 1)
            for p in t[j].tolist():
                w.put(p - 1, 7)
        w.put(0, 1)
        data = np.packbits(np.concatenate([np.array(w.bits, np.uint8), code])).tobytes()
        out.append(data if len(data) <= size else b"\0" + frames[j])
    return out


SIDE = 1024  # frames that move in step: a step costs little more for many than for a few


def dealt(frames: DataFrame, count: int, *key: str) -> DataFrame:
    """``frames``, ``count`` of them, in partitions of about ``SIDE``, however few bytes they are; a batch holds a partition."""
    spark = frames.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SIDE))
    return frames.repartition(max(spark.sparkContext.defaultParallelism, -(-count // (SIDE - 124))), *key)


def _by_kind(work, payload: pd.Series, channels: pd.Series, rate: pd.Series, empty) -> list:
    """``work`` over rows of the same channels and rate, ``SIDE`` at a time; null payloads give ``empty``."""
    out = [empty] * len(payload)
    groups: dict[tuple, list[int]] = {}
    for i, (x, key) in enumerate(zip(payload, zip(channels, rate, strict=True), strict=True)):
        if x is not None and not (isinstance(x, float) and np.isnan(x)):
            groups.setdefault((int(key[0]), int(key[1])), []).append(i)
    for (ch, r), rows in groups.items():
        for a in range(0, len(rows), SIDE):
            part = rows[a : a + SIDE]
            for i, got in zip(part, work([bytes(payload.iloc[i]) for i in part], ch, r), strict=True):
                out[i] = got
    return out


def _decode_all(payload: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(_by_kind(decode, payload, channels, rate, None), dtype=object)


def _decode_each(payload: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_by_kind(decode_each, payload, channels, rate, (None, None)), columns=["payload", "error"], dtype=object)


def _encode_all(payload: pd.Series, channels: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series(_by_kind(encode, payload, channels, rate, None), dtype=object)


#: Column function: (payload, channels, rate) of DST frames to their plain payload; a broken frame fails the query.
decode_dst = F.pandas_udf(_decode_all, T.BinaryType())
#: The same, as a struct of payload and error, one of which is null.
try_decode_dst = F.pandas_udf(_decode_each, T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())]))
#: Column function: (payload, channels, rate) of plain frames to DST frames.
encode_dst = F.pandas_udf(_encode_all, T.BinaryType())


def decode_batches(frames: DataFrame, by: list[str], order: str = "frame_no", batch: int = 16, payload: str = "payload") -> DataFrame:
    """``frames`` with ``payload`` decoded, ``batch`` (number from 0 in each track), and ``error``: that of the first broken frame of the batch in the order of frames, whose sound is then null for all.

    Frames are decoded side by side whatever batch they are in; ``order`` counts from 0, so a
    batch is found by arithmetic and one aggregation over its few frames settles the error.
    """
    tried = frames.withColumn("_tried", try_decode_dst(F.col(payload), F.col("channels"), F.col("rate"))).withColumn("batch", F.floor(F.col(order) / batch).cast("long"))
    every = Window.partitionBy(*by, "batch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    error = F.first("_tried.error", ignorenulls=True).over(every)
    return tried.withColumn("error", error).withColumn(payload, F.when(F.col("error").isNull(), F.col("_tried.payload"))).drop("_tried")
