"""Runs of frames filtered at once, by several chains in one pass."""

import numpy as np
import pytest

from sigmaspark.operators import fir


@pytest.mark.parametrize("quality", ["fast", "normal", "high"])
@pytest.mark.parametrize("lengths", [[16] * 9, [16, 32, 48, 16], [5, 16, 7]])
def test_runs_equal_frames_one_by_one(quality, lengths):
    stages = [(np.asarray(h), k) for h, k in fir.stages(2822400, 88200, quality)]
    rng, need = np.random.default_rng(3), -(-fir.history_bits(stages) // 8)
    runs = [(rng.bytes(n), [rng.bytes(k) for k in lengths]) for n in (0, 16, need, need + 40)]
    for (past, frames), got in zip(runs, fir.runs_to_pcm(runs, stages), strict=True):
        for p, x in zip(frames, got, strict=True):
            assert np.allclose(x, fir.chain_to_pcm(p, past[-need:], stages), atol=1e-12)
            past += p


def test_chains_share_one_window_and_one_pass(spark):
    rows = [(u, i, bytes([u * 16 + i % 16]) * 16 if i != 29 else None) for u in range(3) for i in range(30)]
    f = spark.createDataFrame(rows, "u int, frame_no long, payload binary")
    chains = [fir.stages(2822400, 88200, q) for q in ("fast", "normal", "high")]
    both = fir.decimate_chains(f, ["u"], chains, frame_bytes=16)
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("ArrowEvalPython") == 1
    got = {(r["u"], r["frame_no"]): r["pcm"] for r in both.collect()}
    assert got[1, 29] is None and len(got) == 90
    for i, c in enumerate(chains):
        stages = [(np.asarray(h), k) for h, k in c]
        for u in range(3):
            past = b""
            for _, n, p in [r for r in rows if r[0] == u]:
                if p is not None:
                    assert np.allclose(got[u, n][i], fir.chain_to_pcm(p, past, stages), atol=1e-12)
                past += p or b""
