"""Join-shaped lookups: access lists, overlays, mounts, sinks and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DSD, DST, PCM = 1, 2, 4
AUDIO, SUPPLEMENTARY, PADDING = 2, 3, 7


def access_entry(frame: Column, step: int, entries: Column | int) -> Column:
    """Which entry of an access list covers a frame; frames past the list use the last."""
    return F.least(((frame - frame % step) / step).cast("long"), F.lit(entries) - 1)


def access_lsn(frames: DataFrame, access: DataFrame, step: int, entries: Column | int, area_end: Column | int, frame: str = "frame") -> DataFrame:
    """``lsn`` of the access entry that covers each frame. ``access``: entry, lsn; ``entries`` and ``area_end`` may be scalar subqueries."""
    keyed = frames.withColumn("entry", access_entry(F.col(frame), step, entries))
    return keyed.join(access.select("entry", "lsn"), "entry").withColumn("lsn", F.least("lsn", F.lit(area_end)))


def access_range(frames: DataFrame, access: DataFrame, step: int, entries: Column | int, play_frames: Column | int, area: tuple[Column | int, Column | int], frame: str = "frame") -> DataFrame:
    """Sector range ``from_lsn``..``to_lsn`` to search for each frame. ``access``: entry, lsn, margin.

    The start is estimated between the entry and the next one (or the area's end, for the last),
    less the entry's margin, but never before the entry; both ends stay in the area.
    """
    start, end = area
    ends = access.select("entry", "lsn", "margin").join(access.select((F.col("entry") - 1).alias("entry"), F.col("lsn").alias("next")), "entry", "left")
    keyed = frames.withColumn("entry", access_entry(F.col(frame), step, entries)).join(ends, "entry")
    last = F.col("next").isNull()
    room = F.when(last, F.lit(end)).otherwise(F.col("next")) - F.col("lsn")
    over = F.when(last, F.lit(play_frames) - F.col("entry") * step).otherwise(F.lit(step))
    ahead = F.when(over > 0, (F.col(frame) % step) * room)
    guess = F.col("lsn") + F.coalesce(((ahead - ahead % over) / over).cast("long"), F.lit(0))
    low = F.when((over > 0) & (guess > F.col("margin")), F.greatest(guess - F.col("margin"), "lsn")).otherwise(F.col("lsn"))
    high = F.when(last, F.lit(end)).otherwise(F.col("next"))
    return keyed.select(*frames.columns, F.greatest(low, F.lit(start)).cast("long").alias("from_lsn"), F.least(high, F.lit(end)).cast("long").alias("to_lsn"))


def access_spans(frames: DataFrame, access: DataFrame, areas: DataFrame, by: list[str], frame: str = "frame") -> DataFrame:
    """``access_range`` over many discs at once: each disc's own list, step and area.

    ``access``: ``by``, entry, lsn, margin; ``areas``: ``by``, step, play_frames, start_lsn, end_lsn. A
    disc without a list is searched from end to end. Entries meet frames by an equi-join on the disc and the entry.
    """
    of_disc = Window.partitionBy(*by)
    listed = access.select(*by, "entry", "lsn", "margin", F.lead("lsn").over(of_disc.orderBy("entry")).alias("next"), F.count("*").over(of_disc).alias("entries"))
    sizes = access.groupBy(*by).agg(F.count("*").alias("_n"))
    known = areas.join(sizes, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    keyed = frames.join(known, by).withColumn("entry", F.when((F.col("_n") > 0) & (F.col("step") > 0), access_entry(F.col(frame), F.col("step"), F.col("_n"))).cast("int"))
    found = keyed.join(listed.drop("entries"), [*by, "entry"], "left")
    stop = F.coalesce("next", "end_lsn")
    over = F.when(F.col("next").isNull(), F.col("play_frames") - F.col("entry") * F.col("step")).otherwise(F.col("step"))
    ahead = F.when(over > 0, F.col(frame) % F.col("step") * (stop - F.col("lsn")))
    guess = F.col("lsn") + F.coalesce(F.floor(ahead / over), F.lit(0))
    low = F.when((over > 0) & (guess > F.col("margin")), F.greatest(guess - F.col("margin"), "lsn")).otherwise(F.col("lsn"))
    return found.select(*frames.columns, F.greatest(F.coalesce(low, "start_lsn"), "start_lsn").cast("long").alias("from_lsn"), F.least(F.when(F.col("lsn").isNull(), F.col("end_lsn")).otherwise(stop), "end_lsn").cast("long").alias("to_lsn"))


def overlay(base: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """User edits win over generated values; keys without an edit keep theirs. ``edited`` tells which."""
    e = edits.select(*keys, F.col(value).alias("_edit"), F.lit(True).alias("_has"))
    out = base.join(e, keys, "left")
    return out.withColumn(value, F.when(F.col("_has"), F.col("_edit")).otherwise(F.col(value))).withColumn("edited", F.coalesce("_has", F.lit(False))).drop("_edit", "_has")


def clear_overlay(edits: DataFrame, cleared: DataFrame, keys: list[str]) -> DataFrame:
    return edits.join(cleared.select(*keys), keys, "left_anti")


def upsert_overlay(edits: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return clear_overlay(edits, new, keys).unionByName(new)


def routes(frames: DataFrame, sinks: list[tuple[str, int]], fmt: str = "format") -> DataFrame:
    """One row per frame and sink that accepts its format; a run has at most eight sinks."""
    accepted = F.array(*(F.when(F.col(fmt).bitwiseAND(F.lit(caps)) != 0, F.lit(name)) for name, caps in sinks))
    return frames.withColumn("sink", F.explode(F.array_compact(accepted)))


def mount_of(paths: DataFrame, mounts: DataFrame, path: str = "path", mount: str = "mount") -> DataFrame:
    """The longest mount that equals the path or is a parent folder of it: an equi-join on the path's own prefixes. Each row keeps its own result."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    rows = paths.select(F.struct(*paths.columns).alias("_row"), F.monotonically_increasing_id().alias("_id"), F.array_distinct(prefixes).alias("_prefixes"))
    rows = rows.select("_row", "_id", F.explode("_prefixes").alias("_prefix"))
    found = rows.join(mounts.select(F.col(mount).alias("_prefix"), F.col(mount).alias("mount")).distinct(), "_prefix")
    best = found.groupBy("_id").agg(F.first("_row").alias("_row"), F.max_by("mount", F.length("mount")).alias("mount"))
    return best.select("_row.*", "mount")


def frames_from_packets(packets: DataFrame, by: list[str], order: list[str], data_type: str = "data_type", frame_start: str = "frame_start", size: str = "size") -> DataFrame:
    """Frames of a packet stream: a running count of frame starts numbers them; packets before the first start belong to none."""
    audio = packets.where(F.col(data_type) == AUDIO)
    no = F.sum(F.col(frame_start).cast("long")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return audio.withColumn("frame", no).where(F.col("frame") > 0).groupBy(*by, "frame").agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"))


FRAME_BYTES = 9408  # of both stereo channels
SECTOR_LAYOUT = {14: (32, 2016), 16: (284, 1764)}  # sectors in a run of three frames: header bytes, payload bytes


def fixed_sectors(frames: DataFrame, run: int, start_lsn: int, frame: str = "frame") -> DataFrame:
    """First sector and byte in it of frames stored three to a run of 14 or 16 sectors, and how many sectors they touch."""
    head, payload = SECTOR_LAYOUT[run]
    three = F.col(frame) % 3
    at = three * FRAME_BYTES
    into = at % payload
    return frames.withColumns({
        "lsn": ((F.col(frame) - three) / 3).cast("long") * run + ((at - into) / payload).cast("long") + start_lsn,
        "skip": into.cast("long") + head,
        "sectors": F.ceil((into + FRAME_BYTES) / payload).cast("long"),
    })
