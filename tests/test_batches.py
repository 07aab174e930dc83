"""Batches of large rows are bounded in bytes."""

from sigmaspark.operators import virtual
from sigmaspark.sources import shared


def test_views_take_pieces_in_small_batches(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    seen.mkdir()
    tracks = virtual._tracks

    def watched(batches, seen=str(seen)):
        import os
        import uuid

        def noted():
            for b in batches:
                os.mkdir(f"{seen}/{b.num_rows}-{uuid.uuid4().hex}")
                yield b

        yield from tracks(noted())

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(64).selectExpr("'d' path", "'a' area", "1L track", "id * 1048576 begin", "cast(repeat('x', 1048576) as binary) data")
    monkeypatch.setattr(virtual, "_tracks", watched)
    assert [r["bytes"] for r in virtual.write_views(rows, f"{tmp_path}/out").collect()] == [64 << 20]
    assert max(int(p.name.split("-")[0]) for p in seen.iterdir()) << 20 <= 2 * shared.BATCH_BYTES
