"""Findings in good and broken files."""

import struct

import pytest

from sigmaspark.operators import validate
from sigmaspark.sinks import audio
from sigmaspark.sources import dsdiff, dsf

RATE = 2822400


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    spark.dataSource.register(dsf.DsfSource)
    spark.dataSource.register(dsdiff.DsdiffSource)


def found(spark, path):
    out = {}
    for r in validate.findings(spark, str(path)).collect():
        out.setdefault(r.path.rsplit("/", 1)[1], set()).add(r.rule)
    return out


def test_dsf(spark, tmp_path):
    audio.write_dsf(f"{tmp_path}/good.dsf", iter([bytes(9408)] * 10), 2, RATE, b"tag")
    raw = (tmp_path / "good.dsf").read_bytes()

    def put(name, changes):
        b = bytearray(raw)
        for at, fmt, v in changes:
            struct.pack_into(fmt, b, at, v)
        (tmp_path / f"{name}.dsf").write_bytes(b)

    put("size", [(4, "<Q", 29), (32, "<Q", 40)])
    put("version", [(40, "<I", 2)])
    put("rate", [(56, "<I", 44101)])
    put("bits", [(60, "<I", 4)])
    put("meta", [(20, "<Q", 10**9)])
    put("block", [(72, "<I", 512)])
    (tmp_path / "longer.dsf").write_bytes(raw + bytes(5000))
    (tmp_path / "short.dsf").write_bytes(raw[:50])
    (tmp_path / "empty.dsf").write_bytes(b"")
    got = found(spark, tmp_path)
    assert "good.dsf" not in got
    assert got["size.dsf"] == {"wrong size of the first chunk", "wrong size of the format"}
    assert got["version.dsf"] == {"unknown version or format"} and got["rate.dsf"] == {"bad rate"}
    assert "bad bits or blocks" in got["bits.dsf"] and got["block.dsf"] == {"bad bits or blocks"}
    assert got["meta.dsf"] == {"metadata lies past the end"} and got["longer.dsf"] == {"file is much longer than it says"}
    assert "file too small" in got["short.dsf"] and {"file too small", "wrong chunk"} <= got["empty.dsf"]


def form(*chunks):
    body = b"DSD " + b"".join(chunks)
    return b"FRM8" + struct.pack(">Q", len(body)) + body


def test_dsdiff(spark, tmp_path):
    c = audio.chunk
    version = c(b"FVER", bytes([1, 5, 0, 0]))
    rate, channels, kind = c(b"FS  ", struct.pack(">I", RATE)), c(b"CHNL", struct.pack(">H", 2) + b"SLFTSRGT"), c(b"CMPR", b"DSD \x0enot compressed")
    prop, sound = c(b"PROP", b"SND " + rate + channels + kind), c(b"DSD ", bytes(9408))
    dst = c(b"DST ", c(b"FRTE", struct.pack(">IH", 1, 75)) + c(b"DSTF", b"abc"))
    files = {
        "good": form(version, prop, sound),
        "dst": form(version, prop, dst, c(b"DSTI", bytes(12))),
        "order": form(prop, version, sound),
        "late": form(version, sound, prop),
        "twice": form(version, prop, prop, sound),
        "both": form(version, prop, sound, dst),
        "none": form(version),
        "empty prop": form(version, c(b"PROP", b"SND "), sound),
        "time": form(version, c(b"PROP", b"SND " + rate + channels + kind + c(b"ABSS", struct.pack(">HBBI", 24, 0, 0, 0)) + c(b"LSCO", b"\0\x09")), sound),
        "index": form(version, prop, sound, c(b"DSTI", bytes(13))),
        "headless": form(version, prop, c(b"DST ", c(b"DSTF", b"abc"))),
        "odd": form(version, prop, sound, c(b"WHAT", b"x")),
        "other": b"RIFF" + bytes(40),
        "inner": form(version, c(b"PROP", b"SND " + rate + channels + b"CMPR" + struct.pack(">Q", 900) + b"DSD "), sound),
        "tail": form(version, prop, sound) + bytes(100),
    }
    for k, v in files.items():
        (tmp_path / f"{k}.dff").write_bytes(v)
    got = {k.split(".")[0]: v for k, v in found(spark, tmp_path).items()}
    assert got == {
        "order": {"version is not the first chunk"},
        "late": {"properties come after the sound"},
        "twice": {"chunk comes twice"},
        "both": {"both kinds of sound"},
        "none": {"no properties", "no sound"},
        "empty prop": {"no rate", "no channels", "no compression"},
        "time": {"bad start time", "bad loudspeakers"},
        "index": {"index is no list of places", "index without frames"},
        "headless": {"frames have no head"},
        "odd": {"unknown chunk"},
        "other": {"not a form of this kind", "file is longer than its form", "no version", "no properties", "no sound"},
        "inner": {"chunk ends past its parent"},
        "tail": {"file is longer than its form"},
    }


def test_places_and_severities(spark, tmp_path):
    (tmp_path / "x.dff").write_bytes(form(audio.chunk(b"FVER", bytes([9, 0, 0, 0])), audio.chunk(b"WHAT", b"x")))
    got = {r.rule: (r.severity, r.offset, r.kind) for r in validate.findings(spark, str(tmp_path)).collect()}
    assert got["unknown version"] == ("error", 28, "FVER") and got["unknown chunk"] == ("warning", 44, "WHAT") and got["no sound"] == ("error", None, None)
