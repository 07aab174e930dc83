"""Streams of growing files: nothing twice, nothing lost, bounded batches; and plain images cut out in spans."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sigmaspark.sinks import audio, extract
from sigmaspark.sources import sacd
from sigmaspark.streaming import folder as grown

RATE = 2822400


def whole_file(tmp_path, kind, count=50):
    frames = [bytes((i * 7 + k) % 251 for k in range(9408)) for i in range(count)]
    path = f"{tmp_path}/whole.{kind}"
    (audio.write_dsf if kind == "dsf" else audio.write_dsdiff)(path, iter(frames), 2, RATE)
    with open(path, "rb") as f:
        return frames, f.read()


@pytest.mark.parametrize("kind", ["dsf", "dff"])
def test_offsets_while_a_file_grows(tmp_path, kind):
    frames, raw = whole_file(tmp_path, kind)
    folder = tmp_path / "in"
    folder.mkdir()
    reader, at, got = grown.FolderStream({"path": str(folder), "frames_per_batch": "7"}), None, []
    at = reader.initialOffset()
    for share in (0, 0.0001, 0.1, 0.33, 0.9999, 1):
        (folder / f"x.{kind}").write_bytes(raw[: int(len(raw) * share)])
        while True:
            rows, end = reader.read(at)
            rows = list(rows)
            assert rows == list(grown.FolderStream({"path": str(folder)}).readBetweenOffsets(at, end))
            if not rows:
                break
            assert sum(r[3] for r in rows) <= 7
            got += [(r[0], i) for r in rows for i in range(r[2], r[2] + r[3])]
            at = json.loads(json.dumps(end))
        assert len(got) <= int(50 * share) + 1
    assert [i for _, i in got] == list(range(50))


def test_a_restart_in_mid_file(spark, tmp_path):
    spark.dataSource.register(grown.FolderSource)
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}
    for kind in ("dsf", "dff"):
        frames, raw = whole_file(tmp_path, kind)
        want |= {(f"x.{kind}", i): x for i, x in enumerate(frames)}
        (folder / f"x.{kind}").write_bytes(raw[: len(raw) // 2])
        (tmp_path / f"raw.{kind}").write_bytes(raw)
    counts = []
    for turn in range(3):
        s = grown.read_ranges(spark.readStream.format("audio_folder").option("frames_per_batch", 20).load(str(folder)))
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        q.processAllAvailable()
        q.stop()
        counts.append(spark.read.parquet(f"{tmp_path}/out").count())
        for kind in ("dsf", "dff"):
            (folder / f"x.{kind}").write_bytes((tmp_path / f"raw.{kind}").read_bytes())
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert 40 <= counts[0] < 60 and counts[1:] == [100, 100]
    assert {(r.path.rsplit("/", 1)[1], r.frame_no): bytes(r.payload) for r in rows} == want and len(rows) == 100
    assert sorted((r.path[-3:], r.frame_no) for r in rows if r.is_last) == [("dff", 49), ("dsf", 49)]


def test_bad_limit():
    with pytest.raises(ValueError):
        grown.FolderStream({"path": "x", "frames_per_batch": "0"})


@pytest.mark.parametrize(("size", "skip"), [(2048, 0), (2054, 6), (2064, 12)])
def test_images_are_cut_out(spark, tmp_path, size, skip):
    plain = bytearray(hashlib.sha256(b"x").digest() * (64 * 700))
    plain[sacd.LSN * 2048 : sacd.LSN * 2048 + 8] = b"SACDMTOC"
    plain = bytes(plain)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my disc.iso").write_bytes(b"".join(bytes(skip) + plain[i : i + 2048] + bytes(size - 2048 - skip) for i in range(0, len(plain), 2048)))
    out = extract.extract(spark, str(tmp_path / "in"), str(tmp_path / "out"), 64).collect()
    assert len(out) == 1 and (out[0].sectors, out[0].spans, out[0].bytes) == (700, 11, len(plain))
    assert (tmp_path / "out" / "my disc.iso").read_bytes() == plain and out[0].md5 == hashlib.md5(plain).hexdigest()
    assert out[0].span_md5 == [hashlib.md5(plain[i : i + 64 * 2048]).hexdigest() for i in range(0, len(plain), 64 * 2048)]
    spans = extract.manifest(spark, str(tmp_path / "in"), 64)
    assert spans.agg(F.sum("count")).first()[0] == 700 and {r.sector_size for r in spans.collect()} == {size}
