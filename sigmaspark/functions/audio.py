"""Time codes, frame layout and sample formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAMES_PER_SECOND = 75
DSF_BLOCK, DSF_HEADER = 4096, 92
FRAME_BYTES = 4704  # a channel's bytes in a frame of DSD64
SILENCE = 0x96


def quotient(a: Column, b: int) -> Column:
    """Quotient of a non-negative integer, exact in integers."""
    return ((a - a % b) / b).cast("long")


def timecode_to_samples(hours: Column, minutes: Column, seconds: Column, samples: Column, rate: int) -> Column:
    return ((hours.cast("long") * 60 + minutes) * 60 + seconds) * rate + samples


def samples_to_timecode(position: Column, rate: int) -> dict[str, Column]:
    seconds = quotient(position, rate)
    return {"hours": quotient(seconds, 3600), "minutes": quotient(seconds, 60) % 60, "seconds": seconds % 60, "samples": position % rate}


def two_digits(number: Column) -> Column:
    """``%02d``, without a format to be parsed for each row."""
    digits = number.cast("string")
    return F.coalesce(F.when(number.between(0, 9), F.concat(F.lit("0"), digits)).otherwise(digits), F.lit("null"))


def frames_to_msf(frames: Column) -> Column:
    """``mm:ss:ff`` with 75 frames a second."""
    seconds = quotient(frames, FRAMES_PER_SECOND)
    return F.concat(two_digits(quotient(seconds, 60)), F.lit(":"), two_digits(seconds % 60), F.lit(":"), two_digits(frames % FRAMES_PER_SECOND))


def dsf_layout(frames: Column, channels: Column, tag_bytes: Column, virtual: bool = False) -> dict[str, Column]:
    """Sizes of the file that holds a track: whole blocks per channel, then the tag.

    Virtual files always say where a tag goes, as one can be written there later.
    """
    blocks = quotient(frames.cast("long") * FRAME_BYTES + (DSF_BLOCK - 1), DSF_BLOCK)
    audio = blocks * DSF_BLOCK * channels
    return {
        "audio_bytes": audio,
        "padding": audio - frames.cast("long") * FRAME_BYTES * channels,
        "metadata_offset": audio + DSF_HEADER if virtual else F.when(tag_bytes > 0, audio + DSF_HEADER).otherwise(F.lit(0).cast("long")),
        "total": audio + DSF_HEADER + tag_bytes,
    }


def quantize(value: Column, bits: int) -> Column:
    """A sample of full scale 1.0 as an integer: scaled, clamped, cut towards zero."""
    top = float(2 ** (bits - 1) - 1)
    return F.least(F.greatest(value * top, F.lit(-top - (1 if bits == 16 else 0))), F.lit(top)).cast("int")


def widen(value: Column, bits: int, to: int) -> Column:
    """An integer sample at another word length: shifted up or down."""
    return F.shiftleft(value, to - bits) if to >= bits else F.shiftright(value, bits - to)


def dst_max_frame(channels: Column, rate: Column, frame_rate: Column) -> Column:
    samples = F.floor(rate / frame_rate)
    return channels * F.floor(samples / 8) + 1


def deinterleave(samples: Column, channels: int) -> Column:
    """An array of interleaved samples as an array of (channel, at, sample)."""
    return F.transform(samples, lambda x, i: F.struct((i % channels).cast("long").alias("channel"), quotient(i, channels).alias("at"), x.alias("sample")))
