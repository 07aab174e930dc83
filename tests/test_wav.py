"""WAV files read in blocks and shares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.sinks import audio
from sigmaspark.sources import wav
from sigmaspark.sources.files import Span


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_blocks_of_all_shares_are_the_file(tmp_path, bits):
    x = np.random.default_rng(bits).uniform(-1, 1, 2 * (wav.BLOCK * 2 + 77))
    path = f"{tmp_path}/a.wav"
    audio.write_wav(path, iter([x]), 2, 88200, bits, {"INAM": "Title"})
    rows = [r for i in range(3) for b in wav.Reader(path).read(Span(path, i, 3)) for r in b.to_pylist()]
    assert [r["at"] for r in rows] == [wav.BLOCK * i for i in range(5)] and max(len(r["samples"]) for r in rows) == wav.BLOCK
    assert {(r["channels"], r["rate"], r["bits"]) for r in rows} == {(2, 88200, bits)}
    top = 2 ** (bits - 1) - 1
    assert np.array_equal(np.concatenate([r["samples"] for r in rows]), np.trunc(x * top).astype(np.int64))


def test_a_file_that_is_cut_is_an_error(tmp_path):
    path = tmp_path / "a.wav"
    audio.write_wav(str(path), iter([np.zeros(100)]), 2, 88200, 16)
    path.write_bytes(path.read_bytes()[:-10])
    with pytest.raises(ValueError, match="longer than the file"):
        list(wav.Reader(str(path)).read(Span(str(path))))


def test_a_track_is_written_by_one_task(spark, tmp_path):
    """Totals that turn out small are broadcast in the middle of the job, and the samples' shuffle may then be read map by map."""
    x = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((F.col("id") * 64 + i) % 1000 - 500) / 512)
    rows = spark.range(0, 4000, numPartitions=8).select((F.col("id") % 3).alias("track"), F.col("id").alias("frame_no"), F.lit(2).alias("channels"), F.lit(88200).alias("rate"), x.cast("array<double>").alias("pcm"))
    rows.write.parquet(f"{tmp_path}/rows")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        done = audio.write_wavs(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/out", 16).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(r.track for r in done) == ["0", "1", "2"]
    for track in range(3):
        path = f"{tmp_path}/out/{track}.wav"
        got = np.concatenate([r["samples"] for b in wav.Reader(path).read(Span(path)) for r in b.to_pylist()])
        want = np.concatenate([(np.arange(i * 64, i * 64 + 64) % 1000 - 500) / 512 for i in range(track, 4000, 3)])
        assert np.array_equal(got, np.trunc(want * 32767).astype(np.int64))
