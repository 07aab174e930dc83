"""Audio files as targets of ``df.write``: ``format("dsf")``, ``"dsdiff"``, ``"wav"``, ``"flac"``, and ``"audio_sinks"`` for several at once.

A task writes its tracks to a folder of its own attempt under ``_temporary``; what the job keeps
is told to the driver, which moves exactly those files into place when all tasks are done. A task
that fails and runs again, or runs twice, leaves nothing but its last files, and a job that fails
leaves none. Rows must come track by track, in order: ``dealt`` brings them there, with each
track's sizes, so that heads can be written first.

Several sinks are fed from one pass over the rows. Each has a thread and a short queue in the
task, so the fastest waits for the slowest and no track is held.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from queue import Full, Queue
from threading import Thread

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sigmaspark.operators.lookup import DSD, DST, PCM
from sigmaspark.sources.files import resolve

from . import audio, flac

MOST = 8  # sinks of a run
AHEAD = 16  # frames that a sink may lag behind
ENDINGS = {"dsf": ".dsf", "dsdiff": ".dff", "wav": ".wav", "flac": ".flac"}
ACCEPTS = {"dsf": DSD, "dsdiff": DSD, "wav": PCM, "flac": PCM}
COLUMNS = {DSD: "payload", DST: "coded", PCM: "pcm"}  # where a row holds its sound in each format


@dataclass(frozen=True)
class Sink:
    """One target: a folder, and how its files are written. Options that make no sense are refused."""

    kind: str
    path: str
    bits: int = 24
    level: int = 5
    dst: bool = False  # dsdiff: frames as coded, from column ``coded``
    tags: bool = True  # dsf: with the block of column ``tag``

    def __post_init__(self):
        if self.kind not in ENDINGS:
            raise ValueError(f"no sink {self.kind!r}")
        if not self.path:
            raise ValueError("a sink needs a path")
        if self.kind == "wav" and self.bits not in (16, 24, 32):
            raise ValueError(f"bit depth {self.bits} (must be 16, 24, or 32)")
        if self.kind == "flac" and self.bits not in (16, 24):
            raise ValueError(f"bit depth {self.bits} for FLAC (must be 16 or 24)")
        if not 0 <= self.level <= 8:
            raise ValueError(f"FLAC compression {self.level} (must be 0-8)")
        if self.dst and self.kind != "dsdiff":
            raise ValueError(f"{self.kind} files hold no DST frames")

    @property
    def column(self) -> str:
        return COLUMNS[DST if self.dst else ACCEPTS[self.kind]]

    def write(self, path: str, sound: Iterator, first: dict) -> None:
        channels, rate = first["channels"], first["rate"]
        sizes = audio.Sizes(first["_bytes"], first["_chunked"], first["_count"]) if first.get("_bytes") is not None and not self.dst else None
        if self.kind == "dsf":
            audio.write_dsf(path, sound, channels, rate, (first.get("tag") or b"") if self.tags else b"", sizes=sizes)
        elif self.kind == "dsdiff":
            audio.write_dsdiff(path, sound, channels, rate, artist=first.get("artist"), title=first.get("title"), dst=self.dst, sizes=sizes)
        elif self.kind == "wav":
            audio.write_wav(path, sound, channels, flac.output_rate(rate), self.bits)
        else:
            flac.write_flac(path, sound, channels, rate, self.bits, self.level, [(t["key"], t["value"]) for t in first.get("comments") or []])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, str]] = field(default_factory=list)  # sink, name, where it is staged


class Feeder:
    """Runs ``work`` on an iterator that another thread feeds."""

    END = object()

    def __init__(self, work: Callable[[Iterator], None]):
        self.queue: Queue = Queue(AHEAD)
        self.error: BaseException | None = None

        def run():
            try:
                work(iter(self.queue.get, Feeder.END))
            except BaseException as e:  # told to the feeding thread
                self.error = e

        self.thread = Thread(target=run, daemon=True)
        self.thread.start()

    def put(self, item) -> None:
        while self.thread.is_alive():
            try:
                return self.queue.put(item, timeout=1)
            except Full:
                continue
        if item is not Feeder.END:
            raise self.error or RuntimeError("a sink ended early")

    def end(self) -> None:
        self.put(Feeder.END)
        self.thread.join()
        if self.error:
            raise self.error


class TrackWriter(DataSourceArrowWriter):
    """Writes tracks to one or more sinks and commits all of them together."""

    def __init__(self, sinks: list[Sink], overwrite: bool):
        if not 1 <= len(sinks) <= MOST:
            raise ValueError(f"{len(sinks)} sinks (must be 1-{MOST})")
        if len({(s.path.rstrip("/"), ENDINGS[s.kind]) for s in sinks}) < len(sinks):
            raise ValueError("two sinks of one kind write to one folder")
        self.sinks, self.overwrite, self.job = sinks, overwrite, uuid.uuid4().hex

    def staging(self, sink: Sink) -> str:
        return f"{sink.path.rstrip('/')}/_temporary/{self.job}"

    def write(self, iterator) -> Written:
        attempt, out = uuid.uuid4().hex, Written()
        for first, own in audio._tracks(iterator):
            name = str(first["track"])
            if "/" in name or name in ("", ".", ".."):
                raise ValueError(f"{name!r} is no name of a file")
            feeders = []
            for no, sink in enumerate(self.sinks):
                if sink.column not in first:
                    raise ValueError(f"no column {sink.column!r} for {sink.kind} files")
                staged = f"{self.staging(sink)}/{attempt}/{name}{ENDINGS[sink.kind]}"
                out.files.append((no, f"{name}{ENDINGS[sink.kind]}", staged))
                feeders.append((sink.column, Feeder(lambda sound, s=sink, p=staged, f=first: s.write(p, sound, f))))
            try:
                for row in own("track"):
                    for column, f in feeders:
                        f.put(row[column])
            finally:
                errors = []
                for _, f in feeders:
                    try:
                        f.end()
                    except BaseException as e:
                        errors.append(e)
            if errors:
                raise errors[0]
        return out

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        seen: set[tuple[int, str]] = set()
        for no, name, _ in files:
            if (no, name) in seen:
                self.abort(messages)
                raise ValueError(f"rows of {name} came in more than one place; deal them by track first")
            seen.add((no, name))
        with ThreadPoolExecutor(16) as pool:
            if self.overwrite:
                for no, sink in enumerate(self.sinks):
                    fs, p = resolve(sink.path)
                    old = [i.path for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if i.type == pafs.FileType.File and i.path.endswith(ENDINGS[sink.kind]) and (no, i.base_name) not in seen]
                    list(pool.map(fs.delete_file, old))

            def move(file: tuple[int, str, str]) -> None:
                fs, target = resolve(f"{self.sinks[file[0]].path.rstrip('/')}/{file[1]}")
                fs.move(resolve(file[2])[1], target)

            list(pool.map(move, files))
        self.abort(messages)

    def abort(self, messages) -> None:
        """Removes what is staged; files that were moved into place are no longer there."""
        for sink in self.sinks:
            fs, p = resolve(self.staging(sink))
            if fs.get_file_info(p).type == pafs.FileType.Directory:
                fs.delete_dir(p)
            above = p.rpartition("/")[0]
            if fs.get_file_info(above).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(above)):
                fs.delete_dir(above)


def writer_of(kind: str, options, overwrite: bool) -> TrackWriter:
    """A writer of one sink from a source's options."""
    return TrackWriter([Sink(kind, options["path"], int(options.get("bits", "24")), int(options.get("level", "5")), options.get("dst", "false").lower() == "true", options.get("tags", "true").lower() == "true")], overwrite)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def writer(self, schema, overwrite):
        return writer_of("wav", self.options, overwrite)


class SinksSource(DataSource):
    @classmethod
    def name(cls):
        return "audio_sinks"

    def writer(self, schema, overwrite):
        return TrackWriter([Sink(**s) for s in json.loads(self.options["sinks"])], overwrite)


def dealt(frames: DataFrame, track: str = "track", order: str = "frame_no") -> DataFrame:
    """Rows by track and in order, ``track`` first, with the sizes of their track's payloads."""
    kept = [c for c in frames.columns if c not in (track, order)]
    rows = frames.select(F.col(track).cast("string").alias("track"), F.col(order).alias("_order"), *kept)
    if "payload" in kept:
        size = F.octet_length("payload").cast("long")
        sizes = rows.groupBy("track").agg(F.sum(size).alias("_bytes"), F.sum(size + size % 2 + 12).alias("_chunked"), F.count("*").alias("_count"))
        return rows.repartition("track").join(sizes, "track").sortWithinPartitions("track", "_order")
    return rows.repartition("track").sortWithinPartitions("track", "_order")


def save(frames: DataFrame, kind: str, path: str, mode: str = "append", track: str = "track", order: str = "frame_no", **options) -> None:
    """``frames`` as one file a track under ``path``."""
    frames.sparkSession.dataSource.register({"wav": WavSource}.get(kind) or _source(kind))
    dealt(frames, track, order).write.format(kind).options(**options).mode(mode).save(path)


def _source(kind: str) -> type:
    from sigmaspark.sources import dsdiff, dsf
    from sigmaspark.sources import flac as flac_source

    return {"dsf": dsf.DsfSource, "dsdiff": dsdiff.DsdiffSource, "flac": flac_source.FlacSource}[kind]


def fan_out(frames: DataFrame, sinks: list[Sink], mode: str = "append", track: str = "track", order: str = "frame_no") -> None:
    """``frames`` to up to eight sinks in one pass; either all their files appear or none.

    Sinks of 1-bit sound take column ``payload``, of coded frames ``coded``, of samples ``pcm``.
    """
    spark: SparkSession = frames.sparkSession
    TrackWriter(sinks, False)  # refuses bad lists before the job
    missing = {s.column for s in sinks} - set(frames.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)} for these sinks")
    spark.dataSource.register(SinksSource)
    dealt(frames, track, order).write.format("audio_sinks").option("sinks", json.dumps([asdict(s) for s in sinks])).mode(mode).save()
