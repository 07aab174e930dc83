"""Mounted images that go when they have been idle for a time, with state and timers.

An image is mounted by its first use. It is pinned while files of it are open, and goes once
nothing is open and its last use or opening is longer ago than ``idle``; an image that is still
pinned then goes at its last close. Closing is no use. An image's state is four numbers. Images
are dealt to groups by a hash, and a group's state is read and written once a batch, as calls of
the state store take far longer than events; a timer of event time wakes a group when the first of
its images is due, so other groups are not looked at. Times are the events' own; an event that
comes after the watermark is dropped, as in any stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN, USE, CLOSE = "open", "use", "close"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SPANS = "image string, opened long, evicted long, uses long"


def replay(state: tuple[int, int, int, int] | None, events: list[tuple[int, str]], idle: int) -> tuple[tuple[int, int, int, int] | None, list[tuple[int, int, int]]]:
    """State (opened, last use, open files, uses) of one image after events (time, kind) in order, and the spans (opened, evicted, uses) that end among them."""
    gone = []
    for t, kind in events:
        if state and state[2] <= 0 and t - state[1] > idle:
            gone.append((state[0], state[1] + idle, state[3]))
            state = None
        if kind == CLOSE:
            if state:
                opened, last, refs, uses = state
                state = opened, last, max(refs - 1, 0), uses
                if state[2] == 0 and refs > 0 and t - last > idle:
                    gone.append((opened, t, uses))
                    state = None
            continue
        opened, _, refs, uses = state or (t, t, 0, 0)
        state = opened, t, refs + (kind == OPEN), uses + 1
    return state, gone


class IdleImages(StatefulProcessor):
    """The images of one group."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("images", "images array<struct<image string, opened long, last long, refs long, uses long>>, timer long")

    def _held(self) -> tuple[dict, int]:
        held = self.state.get()
        return ({image: tuple(numbers) for image, *numbers in held[0]}, held[1]) if held else ({}, 0)

    def _due(self, state: tuple[int, int, int, int]) -> int:
        """When a timer finds the image idle; 0 while files are open."""
        return state[1] + self.idle + 1 if state[2] <= 0 else 0

    def _hold(self, images: dict, timer: int) -> None:
        due = min(filter(None, map(self._due, images.values())), default=0)
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        if images:
            self.state.update(([(image, *state) for image, state in images.items()], due))
        else:
            self.state.clear()

    def _rows(self, gone: list[tuple[str, int, int, int]]) -> Iterator[pd.DataFrame]:
        if gone:
            yield pd.DataFrame(gone, columns=["image", "opened", "evicted", "uses"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        images, timer = self._held()
        by: dict[str, list] = {}
        for df in rows:
            for image, *event in zip(*(df[c].tolist() for c in ("image", "at", "seq", "kind")), strict=True):
                by.setdefault(image, []).append(event)
        gone = []
        for image, events in by.items():
            events.sort(key=itemgetter(0, 1))
            state, ended = replay(images.pop(image, None), [(t, kind) for t, _, kind in events], self.idle)
            if state:
                images[image] = state
            gone += [(image, *g) for g in ended]
        self._hold(images, timer)
        yield from self._rows(gone)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        images, _ = self._held()
        now = timerValues.getCurrentWatermarkInMs()
        idle = [image for image, state in images.items() if 0 < self._due(state) <= now]
        ended = [(image, images.pop(image)) for image in idle]
        self._hold(images, 0)  # a timer that fired is gone
        yield from self._rows([(image, opened, last + self.idle, uses) for image, (opened, last, _, uses) in ended])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Streams that are started inside keep their state in the store that timers need."""
    old = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE[0], old)


def evictions(uses: DataFrame, idle_ms: int, late: str = "1 minute", groups: int = 4096) -> DataFrame:
    """Spans (image, opened, evicted, uses; times in milliseconds) of a stream of (image, ts, seq, kind), each when it ends. Start it inside ``state_store``.

    An event without a time has no place in the order. ``groups``: about one for every 64 images that are mounted at once; it is part of the state, so a stream keeps it.
    """
    marked = uses.where("ts IS NOT NULL").withWatermark("ts", late).select(F.pmod(F.xxhash64("image"), F.lit(groups)).alias("part"), "image", "ts", "seq", "kind", F.unix_millis("ts").alias("at"))
    return marked.groupBy("part").transformWithStateInPandas(IdleImages(idle_ms), SPANS, "Append", "EventTime")
