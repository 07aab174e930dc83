"""Idle images against a replay moment by moment."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigmaspark.streaming import idle


def slow(events, limit, end):
    """Looks for idle images at every tick, as a clean-up that runs all the time would."""
    opened = last = uses = refs = None
    gone, todo = [], list(events)
    for now in range(end + 1):
        if opened is not None and refs <= 0 and now - last > limit:
            gone.append((opened, max(last + limit, closed), uses))
            opened = None
        while todo and todo[0][0] == now:
            _, kind = todo.pop(0)
            if kind == "close":
                if opened is not None:
                    if refs == 1:
                        closed = now
                    refs = max(refs - 1, 0)
                    if refs == 0 and closed == now and now - last > limit:
                        gone.append((opened, now, uses))
                        opened = None
                continue
            if opened is None:
                opened, refs, uses, closed = now, 0, 0, 0
            refs += kind == "open"
            last, uses = now, uses + 1
    return gone


@pytest.mark.parametrize("seed", range(5))
def test_replay_equals_constant_watching(seed):
    rng = random.Random(seed)
    for _ in range(60):
        events = sorted((rng.randrange(200), rng.choice(["open", "use", "use", "close", "close"])) for _ in range(rng.randrange(30)))
        state, gone, at = None, [], 0
        while at < len(events):  # in pieces, as batches come
            n = rng.randint(1, 6)
            state, more = idle.replay(state, events[at : at + n], 20)
            gone += more
            at += n
        if state and state[2] <= 0:
            gone.append((state[0], state[1] + 20, state[3]))
        assert gone == slow(events, 20, 500)


def test_a_stream_with_pins_and_timers(spark, tmp_path):
    minute = 60_000
    batches = [
        [("a", 0, "use"), ("b", 0, "open"), ("c", 1, "use")],
        [("a", 3, "use"), ("c", 20, "use")],
        [("d", 60, "use")],  # the watermark moves past a's and c's timers; b is pinned
        [("b", 70, "close"), ("d", 61, "use")],
        [("e", 300, "use")],
        [("e", 301, "use")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, (m + 1000) * minute, n, kind) for n, (k, m, kind) in enumerate(rows)], "image string, ms long, seq int, kind string").coalesce(1)
        df.select("image", F.timestamp_millis("ms").alias("ts"), "seq", "kind").write.mode("append").parquet(str(tmp_path / "in"))
    with idle.state_store(spark):
        s = spark.readStream.schema("image string, ts timestamp, seq int, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = idle.evictions(s, 5 * minute).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.image, r.opened // minute - 1000, r.evicted // minute - 1000, r.uses) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 8, 2), ("b", 0, 70, 1), ("c", 1, 6, 1), ("c", 20, 25, 1), ("d", 60, 66, 2)]


def test_the_query_equals_the_replay_of_the_table(spark, sf):
    from sigmaspark.plans import media

    by, last = {}, 0
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).collect():
        by.setdefault(str(r.user_id), []).append((r.at, r.event_id, media.KINDS[r.event_id % 4]))
        last = max(last, r.at)
    want = []
    for image, events in by.items():
        state, gone = idle.replay(None, [(t, k) for t, _, k in sorted(events)], media.IDLE)
        if state and state[2] <= 0 and state[1] + media.IDLE + 1 <= last - 60_000:
            gone.append((state[0], state[1] + media.IDLE, state[3]))
        want += [(image, *g) for g in gone]
    got = sorted(tuple(r) for r in media.idle_evictions(spark, sf).collect())
    assert got == sorted(want) and len(got) > 10


class Store:
    """A state store with one value, a timer's times, and the calls made."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)


class Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_group_of_images_takes_few_calls_of_the_store():
    rng = random.Random(3)
    events = sorted((rng.randrange(4000), n, f"i{rng.randrange(200)}", rng.choice(["open", "use", "use", "close", "close"])) for n in range(3000))
    store, got = Store(), []
    images = idle.IdleImages(20)
    images.init(store)
    for since in range(0, 4000, 400):
        batch = [(image, at, n, kind) for at, n, image, kind in events if since <= at < since + 400]
        rng.shuffle(batch)
        parts = [pd.DataFrame(batch[i::3], columns=["image", "at", "seq", "kind"]) for i in range(3)]
        before = store.calls
        got += images.handleInputRows((0,), iter(parts), Now(since))
        if store.timers and min(store.timers) <= since + 399:
            store.timers.discard(min(store.timers))
            got += images.handleExpiredTimer((0,), Now(since + 399), None)
        assert store.calls - before <= 8 and len(store.timers) <= 1
    want = []
    for image in {e[2] for e in events}:
        state, gone = idle.replay(None, [(at, kind) for at, _, who, kind in events if who == image], 20)
        if state and state[2] <= 0 and state[1] + 21 <= 3999:
            gone.append((state[0], state[1] + 20, state[3]))
        want += [(image, *g) for g in gone]
    assert sorted(tuple(r) for df in got for r in df.itertuples(index=False)) == sorted(want) and len(want) > 500


def test_one_group_or_many_give_the_same_spans(spark, tmp_path):
    rng, minute = random.Random(4), 60_000
    for b in range(3):
        rows = [(f"i{rng.randrange(30)}", (1000 + b * 100) * minute + rng.randrange(100 * minute), n, rng.choice(["open", "use", "close", "close"])) for n in range(b * 300, b * 300 + 300)]
        df = spark.createDataFrame([*rows, (None, (1000 + b * 100) * minute, 0, "use"), ("i1", None, 0, "use")], "image string, ms long, seq int, kind string").coalesce(1)
        df.select("image", F.timestamp_millis("ms").alias("ts"), "seq", "kind").write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    for groups in (1, 1000):
        with idle.state_store(spark):
            s = spark.readStream.schema("image string, ts timestamp, seq int, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = str(tmp_path / f"out{groups}")
            idle.evictions(s, 5 * minute, groups=groups).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_state").trigger(availableNow=True).start().awaitTermination()
        got[groups] = sorted((r.image or "", *r[1:]) for r in spark.read.parquet(out).collect())
    assert got[1] == got[1000] and len(got[1]) > 100 and ("", 1000 * minute, 1005 * minute, 1) in got[1]
