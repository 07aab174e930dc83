"""FIR decimation of 1-bit audio and of sample arrays.

``y[n] = sum over k of h[k] * x[n * D - k]``, with x = +1 / -1 for bits and 0 before the track's
start; there is no flush, so the filter's tail is not emitted. A frame only needs the bits just
before it, which a window hands over from the frames before, so frames of a track run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed_sinc(taps: int, cutoff: float) -> list[float]:
    """A low-pass design of unit gain; ``cutoff`` as a share of the sampling rate."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff * n) * np.blackman(taps + 2)[1:-1]
    return (h / h.sum()).tolist()


def decimate_array(samples: Column, coef: list[float], step: int) -> Column:
    """The same over an array column, as expressions."""
    h = F.array(*(F.lit(float(c)) for c in coef))
    outs = F.sequence(F.lit(0), F.floor((F.size(samples) - 1) / step).cast("int"))

    def one(n: Column) -> Column:
        ks = F.sequence(F.lit(0), F.least(F.lit(len(coef) - 1), n * step))
        return F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.get(h, k) * F.get(samples, n * step - k).cast("double"))

    return F.transform(outs, one)


def _strided(x: np.ndarray, coef: np.ndarray, step: int) -> np.ndarray:
    """Every ``step``-th product of the filter with the samples, from the first that it covers."""
    if len(x) < len(coef):
        return np.empty(0)
    return np.lib.stride_tricks.sliding_window_view(x, len(coef))[::step] @ coef[::-1]


def history_bits(stages: list[tuple[np.ndarray, int]]) -> int:
    """Samples before a frame that the first output of a chain of filters looks back on."""
    need, step = 0, 1
    for coef, k in stages:
        need += (len(coef) - 1) * step
        step *= k
    return need


def combined(chain: list[tuple[list[float], int]]) -> list[float]:
    """The one filter that a chain of filters comes to."""
    out, step = np.ones(1), 1
    for coef, k in chain:
        spaced = np.zeros((len(coef) - 1) * step + 1)
        spaced[::step] = coef
        out, step = np.convolve(out, spaced), step * k
    return out.tolist()


def byte_tables(coef: np.ndarray) -> np.ndarray:
    """What each byte adds to an output by how many bytes it lies before the output's own: 256 sums of eight taps for each.

    An output stands on the first bit of its byte, so of that one only the first tap counts, and
    tap 8j - i meets bit i of the j-th byte before.
    """
    n = -(-(len(coef) - 1) // 8) + 1
    k = 8 * np.arange(n)[:, None] - np.arange(8)[None, :]
    taps = np.where((k >= 0) & (k < len(coef)), coef[np.clip(k, 0, len(coef) - 1)], 0.0)
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
    return taps @ signs.T


def _looked_up(data: np.ndarray, first: int, count: int, step: int, tables: np.ndarray) -> np.ndarray:
    """Outputs of a filter on packed bits, ``step`` bytes apart, the first on byte ``first``; bytes before the data are no sound."""
    at = first + step * np.arange(count)
    out = np.zeros(count)
    for j, t in enumerate(tables):
        k = at - j
        out += np.where(k >= 0, t[data[np.maximum(k, 0)]], 0.0) if first < j else t[data[k]]
    return out


def bits_to_pcm(payload: bytes, history: bytes, coef: np.ndarray, step: int) -> np.ndarray:
    """Samples of one channel's frame (first bit in time: the highest of each byte); ``history`` is what comes before it."""
    return chain_to_pcm(payload, history, [(np.asarray(coef, np.float64), step)])


def chain_to_pcm(payload: bytes, history: bytes, stages: list[tuple[np.ndarray, int]], tables: np.ndarray | None = None) -> np.ndarray:
    """The same through a chain of filters, each of which keeps every ``step``-th sample.

    The first filter works on packed bytes by tables, if its step is whole bytes; ``tables`` are
    its ``byte_tables``, worked out here unless given.
    """
    (coef, step), rest = stages[0], stages[1:]
    later = history_bits(rest) * step  # bits before the frame that the later filters look back on
    if step % 8 == 0:
        tables = byte_tables(coef) if tables is None else tables
        past = history[-(-(-(later + len(coef) - 1) // 8)) :] if later + len(coef) > 1 else b""
        data = np.frombuffer(past + payload, np.uint8)
        before = later // step
        count = before + -(-len(payload) * 8 // step)
        begin = len(past) - before * step // 8
        skip = max(-(begin * 8 // step), 0) if begin < 0 else 0  # outputs before the track's start
        x = np.concatenate([np.zeros(skip), _looked_up(data, begin + skip * step // 8, count - skip, step // 8, tables)])
    else:
        need = history_bits(stages)
        before_bits = np.unpackbits(np.frombuffer(history, np.uint8))[-need:].astype(np.float64) * 2 - 1 if need and history else np.empty(0)
        x = np.unpackbits(np.frombuffer(payload, np.uint8)).astype(np.float64) * 2 - 1
        x = np.concatenate([np.zeros(need - len(before_bits)), before_bits, x])
        x = _strided(x, coef, step)
    for coef, step in rest:
        x = _strided(x, coef, step)
    return x


FRAME_BYTES = 4704  # a channel's bytes in a frame of the lowest rate


NO_SOUND = 256  # beside the 256 bytes: what stands before a track


def runs_to_pcm(runs: list[tuple[bytes, list[bytes]]], stages: list[tuple[np.ndarray, int]], tables: np.ndarray | None = None) -> list[list[np.ndarray]]:
    """``chain_to_pcm`` over runs of frames that follow each other, each run with the bytes before it: all runs are filtered at once.

    Frames hold a whole number of the chain's output steps; if they don't, or the first filter's
    step isn't whole bytes, frames are filtered one by one.
    """
    total = int(np.prod([k for _, k in stages]))
    coef, step = stages[0]
    if step % 8 or any(len(p) * 8 % total for _, frames in runs for p in frames):
        need = -(-history_bits(stages) // 8)
        out = []
        for past, frames in runs:
            got = []
            for p in frames:
                got.append(chain_to_pcm(p, past, stages, tables))
                past = (past + p)[-need:] if need else b""
            out.append(got)
        return out
    tables = byte_tables(coef) if tables is None else tables
    tables = np.concatenate([tables, np.zeros((len(tables), 1))], 1)
    # Each run begins with as many bytes as the chain looks back on, in whole output steps, so all runs keep the steps' places.
    lead = -(-(-(-history_bits(stages) // 8)) // (total // 8)) * (total // 8)
    sizes = np.array([lead + sum(map(len, frames)) for _, frames in runs])
    data = np.full(sizes.sum(), NO_SOUND, np.uint16)
    at = np.cumsum(sizes) - sizes
    for begin, (past, frames) in zip(at.tolist(), runs):
        past = past[-lead:] if lead else b""
        raw = np.frombuffer(past + b"".join(frames), np.uint8)
        data[begin + lead - len(past) : begin + lead - len(past) + len(raw)] = raw
    n = len(tables) - 1
    data = np.concatenate([np.full(n, NO_SOUND, np.uint16), data])
    x = np.zeros(-(-(len(data) - n) // (step // 8)))
    for j, t in enumerate(tables):
        x += t[data[n - j : len(data) - j : step // 8]]
    for coef, step in stages[1:]:
        x = np.concatenate([np.zeros(len(coef) - 1), x])
        m = -(-(len(x) - len(coef) + 1) // step)
        y = np.zeros(m)
        for k, c in enumerate(coef):
            first = len(coef) - 1 - k
            y += c * x[first : first + (m - 1) * step + 1 : step]
        x = y
    out = []
    for begin, (_, frames) in zip(at.tolist(), runs):
        ends = (begin + lead + np.cumsum([0, *map(len, frames)])) * 8 // total
        out.append([x[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())])
    return out


def decimate_chains(frames: DataFrame, by: list[str], chains: list[list[tuple[list[float], int]]], order: str = "frame_no", payload: str = "payload", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``pcm`` (array<array<double>>) of each frame: its samples by each of the chains, from one look back; ``by`` names the track and channel.

    A frame looks back on as many frames as the filters reach, if each has ``frame_bytes``;
    where frames before a frame are too short for that, an error tells so. Frames of a batch that
    follow each other are filtered as one run, which looks back on the frames before its first.
    """
    chains_ = [[(np.asarray(h, np.float64), k) for h, k in c] for c in chains]
    need = max(-(-history_bits(c) // 8) for c in chains_)
    tables = [byte_tables(c[0][0]) if c[0][1] % 8 == 0 else None for c in chains_]
    reach = max(-(-need // frame_bytes), 1)

    @F.pandas_udf("array<array<double>>")
    def run(now: pd.Series, before: pd.Series, place: pd.Series, first: pd.Series) -> pd.Series:
        runs: list[tuple[bytes, list[bytes]]] = []
        held, last, size = [], None, 0
        for i, (p, b, n, f) in enumerate(zip(now, before, place, first)):
            if n > reach + 1 and need and sum(len(x) for x in b if x is not None) < need:
                raise ValueError(f"frames of fewer than {frame_bytes} bytes before a filter that looks back {need}")
            if p is None:
                last = None
                continue
            if last is None or n != last[0] + 1 or f != last[1]:
                runs.append((b"".join(x for x in b if x is not None)[-need:] if need else b"", []))
            runs[-1][1].append(p)
            held.append(i)
            last = n, f
        out: list = [None] * len(now)
        if runs:
            got = [[x for part in runs_to_pcm(runs, c, t) for x in part] for c, t in zip(chains_, tables)]
            for i, *each in zip(held, *got, strict=True):
                out[i] = each
        return pd.Series(out)

    w = Window.partitionBy(*by).orderBy(order)
    tail = F.substring(F.col(payload), F.greatest(F.octet_length(payload) - need + 1, F.lit(1)), F.lit(need)) if need else F.lit(b"")
    before = F.collect_list(F.coalesce(tail, F.lit(b""))).over(w.rowsBetween(-reach, -1))
    # Frames of one track have the same mark; neighbours in a batch with the same mark whose places follow are one run.
    with_past = frames.withColumns({"_before": before, "_place": F.row_number().over(w), "_of": F.to_json(F.struct(*by))})
    return with_past.withColumn("pcm", run(payload, "_before", "_place", "_of")).drop("_before", "_place", "_of")


def decimate_chain(frames: DataFrame, by: list[str], stages: list[tuple[list[float], int]], order: str = "frame_no", payload: str = "payload", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``decimate_chains`` with one chain: ``pcm`` (array<double>) of each frame."""
    return decimate_chains(frames, by, [stages], order, payload, frame_bytes).withColumn("pcm", F.get("pcm", F.lit(0)))


def decimate_frames(frames: DataFrame, by: list[str], coef: list[float], step: int, order: str = "frame_no", payload: str = "payload", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``decimate_chain`` with one filter."""
    return decimate_chain(frames, by, [(coef, step)], order, payload, frame_bytes)


def stages(rate: int, pcm_rate: int | None = None, quality: str = "normal") -> list[tuple[list[float], int]]:
    """Filters from a 1-bit rate to a sample rate, which is 1/32 of it unless given.

    ``fast`` is one filter; ``normal`` and ``high`` are a chain that divides by 8 first and by 2
    after that, each with a filter as steep as its own rate needs. The designs are this module's.
    """
    pcm_rate = pcm_rate or rate // 32
    factor = rate // pcm_rate
    if rate % pcm_rate or factor < 8 or factor & (factor - 1):
        raise ValueError(f"no filters from {rate} to {pcm_rate}")
    if quality not in ("fast", "normal", "high"):
        raise ValueError(f"unknown quality {quality!r}")
    if quality == "fast":
        return [(windowed_sinc(12 * factor, 0.45 / factor), factor)]
    halves = (factor // 8).bit_length() - 1
    return [(windowed_sinc(96, 1 / 20), 8)] + [(windowed_sinc(48, 0.22), 2)] * halves


def convert(frames: DataFrame, by: list[str], rate: int, pcm_rate: int | None = None, quality: str = "normal", order: str = "frame_no", payload: str = "payload", frame_bytes: int | None = None) -> DataFrame:
    """1-bit frames of single channels as samples at ``pcm_rate``; frames have 1/75 s unless their size is given."""
    return decimate_chain(frames, by, stages(rate, pcm_rate, quality), order, payload, frame_bytes or rate // 75 // 8)
