"""Tracks from markers, track selection, and what follows from the order of tracks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, STOP = 0, 1
SPACE = " \t\n\v\f\r"
DIGITS = re.compile("[0-9]+")


class SelectionError(ValueError):
    """A track specification that can't be used; ``kind`` is ``empty``, ``invalid`` or ``not_found``."""

    def __init__(self, kind: str, spec: str):
        super().__init__(f"{kind}: {spec!r}")
        self.kind = kind


def parse_selection(spec: str, last: int) -> list[int]:
    """Track numbers of ``all`` or a list of ``n`` and ``a-b``: in order, each once; ranges may run backwards.

    White space may stand around numbers, dashes and commas, but not within a number; ``all`` is
    in lower case; a comma may follow the last entry. Entries are read from the left, and the
    first error counts: a number that isn't on the disc before later bad syntax.
    """
    text = (spec or "").strip(SPACE)
    if not text:
        raise SelectionError("empty", spec)
    if text == "all":
        return list(range(1, last + 1))
    out: dict[int, None] = {}
    entries = text.split(",")
    if not entries[-1].strip(SPACE) and len(entries) > 1:
        entries.pop()
    for entry in entries:
        ends = [x.strip(SPACE) for x in entry.split("-", 1)]
        numbers = []
        for x in ends:
            digits = DIGITS.match(x)
            if not digits:
                raise SelectionError("invalid", spec)
            if not 0 < int(digits[0]) <= last:
                raise SelectionError("not_found", spec)
            if digits.end() < len(x):
                raise SelectionError("invalid", spec)
            numbers.append(int(digits[0]))
        a, b = numbers[0], numbers[-1]
        out |= dict.fromkeys(range(a, b + 1) if a <= b else range(a, b - 1, -1))
    return list(out)


def select_tracks(tracks: DataFrame, spec: str, last: int, track: str = "track") -> DataFrame:
    """The selected tracks, with ``sel_pos``, their place in the selection."""
    chosen = parse_selection(spec, last)
    place = F.array_position(F.array(*map(F.lit, chosen)), F.col(track).cast("int"))
    return tracks.where(F.col(track).isin(chosen)).withColumn("sel_pos", place)


def sort_markers(markers: DataFrame, by: list[str], pos: str, kind: str, idx: str) -> DataFrame:
    """``place`` of each marker of a file: by position, starts first, then as given."""
    order = Window.partitionBy(*by).orderBy(pos, F.col(kind) != START, idx)
    return markers.withColumn("place", F.row_number().over(order).cast("long"))


def pair_markers(markers: DataFrame, by: list[str], pos: str = "pos", kind: str = "kind", idx: str = "idx", total: str = "total") -> DataFrame:
    """Track intervals of each file: ``by``, track, start, end.

    A track runs from its start marker to the last given stop that lies after its start and not
    after the next one, else to the file's end. A file without starts is one track. The stop's
    track is the last start before it, so one sorted pass over each file's markers is enough:
    one shuffle by file, no range join.
    """
    ordered = Window.partitionBy(*by).orderBy(pos, F.col(kind) == START, idx)
    numbered = markers.withColumn("track", F.count(F.when(F.col(kind) == START, 1)).over(ordered))
    per = numbered.groupBy(*by, "track").agg(
        F.max(F.when(F.col(kind) == START, F.col(pos))).alias("start"),
        F.max_by(pos, F.when(F.col(kind) == STOP, F.col(idx))).alias("stop"),
        F.max(total).alias("total"),
        F.max("track").alias("t"),
    )
    files = Window.partitionBy(*by)
    per = per.withColumn("tracks", F.max("t").over(files))
    whole = F.col("tracks") == 0
    return per.where((F.col("track") > 0) | whole).select(
        *by,
        F.when(whole, 1).otherwise(F.col("track")).cast("long").alias("track"),
        F.when(whole, 0).otherwise(F.col("start")).cast("long").alias("start"),
        F.when(whole, F.col("total")).otherwise(F.coalesce("stop", "total")).cast("long").alias("end"),
    )


def contiguous_length(tracks: DataFrame, by: list[str], start: str, area_end: Column) -> DataFrame:
    """``length``: up to the next track's start, or the area's end, both counted in."""
    order = Window.partitionBy(*by).orderBy(start)
    return tracks.withColumn("length", F.coalesce(F.lead(start).over(order), area_end) - F.col(start) + 1)


def gaps(tracks: DataFrame, by: list[str], order: list[str], start: str, duration: str) -> DataFrame:
    """``previous_end`` (0 before the first) and ``gap``: whether the track starts after it."""
    w = Window.partitionBy(*by).orderBy(*order)
    end = F.coalesce(F.lag(F.col(start) + F.col(duration)).over(w), F.lit(0).cast("long"))
    return tracks.withColumn("previous_end", end).withColumn("gap", F.col(start) > F.col("previous_end"))


def edit_master(tracks: DataFrame, by: list[str], order: list[str], samples: str) -> DataFrame:
    """Places in one running file: ``number``, ``start`` and ``stop`` of each selected track."""
    w = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(samples).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tracks.withColumns({"number": F.row_number().over(w).cast("long"), "start": upto - F.col(samples), "stop": upto})


def redistribute(frames: DataFrame, by: list[str], order: list[str], size: str, total: Column) -> DataFrame:
    """``share`` of a batch's output for each frame: in proportion to its input, rounded down; the last takes the rest."""
    batch, w = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(*order)
    product = total.cast("long") * F.col(size).cast("long")
    whole = F.sum(F.col(size).cast("long")).over(batch)
    part = ((product - product % whole) / whole).cast("long")
    last = F.lead(F.lit(1)).over(w).isNull()
    frames = frames.withColumns({"_part": part, "_last": last, "_total": total.cast("long")})
    before = F.coalesce(F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return frames.withColumn("share", F.when(F.col("_last"), F.col("_total") - before).otherwise(F.col("_part"))).drop("_part", "_last", "_total")


def frame_offsets(frames: DataFrame, by: list[str], order: list[str], samples: Column) -> DataFrame:
    """``sample_offset`` in the track and whether a frame is its first or last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumns({
        "sample_offset": F.coalesce(F.sum(samples).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        "is_first": F.lag(F.lit(1)).over(w).isNull(),
        "is_last": F.lead(F.lit(1)).over(w).isNull(),
    })


def unique_names(entries: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """``unique_name``: a name that is taken gets `` (n)``, counting from 2."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return entries.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def chunk_offsets(frames: DataFrame, by: list[str], order: list[str], size: str, head: int = 12) -> DataFrame:
    """``at``: where each frame's payload lies in a run of chunks, each with a header and padded to an even size."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    even = F.col(size) + F.col(size) % 2
    return frames.withColumn("at", F.sum(even + head).over(w) - even)
