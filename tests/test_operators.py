"""Column functions and track operators, by their own cases."""

import pytest
from pyspark.sql import functions as F

from sigmaspark.functions import audio, id3, tags, text
from sigmaspark.operators import lookup, tracks


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("spec", "want"), [("all", list(range(1, 13))), ("1", [1]), ("1,3,5", [1, 3, 5]), ("1-5", [1, 2, 3, 4, 5]), ("5-1", [5, 4, 3, 2, 1]), ("1-3,5,7-9", [1, 2, 3, 5, 7, 8, 9]), (" 2 , 2 ", [2])])
def test_selection(spec, want):
    assert tracks.parse_selection(spec, 12) == want


@pytest.mark.parametrize(("spec", "kind"), [("", "empty"), ("0", "not_found"), ("99", "not_found"), ("1-", "invalid"), ("a", "invalid"), ("1;2", "invalid"), ("all,1", "invalid")])
def test_bad_selection(spec, kind):
    with pytest.raises(tracks.SelectionError) as e:
        tracks.parse_selection(spec, 12)
    assert e.value.kind == kind


@pytest.mark.parametrize(("raw", "want"), [(" .a/b?. ", "a_b_"), ("...", "untitled"), ("", "untitled"), ("ok\x1f", "ok_"), ("\x7f", "\x7f"), (None, None)])
def test_sanitize(spark, raw, want):
    assert one(spark, raw, "string", text.sanitize_filename) == want


def test_cut_bytes(spark):
    assert one(spark, "aéé", "string", lambda c: text.cut_bytes(c, 4)) == "aé"
    assert one(spark, "日本", "string", lambda c: text.cut_bytes(c, 5)) == "日"


@pytest.mark.parametrize(("raw", "want"), [("A; B", "A"), ("A/B", "A"), ("A , B", "A"), ("A - B", "A"), ("A-B", "A-B"), ("", "")])
def test_first_token(spark, raw, want):
    assert one(spark, raw, "string", text.first_token) == want


@pytest.mark.parametrize(("raw", "want"), [("2001-02-03", [2001, 2, 3]), ("2001-02", [2001, 2, 0]), ("2001", [2001, 0, 0]), ("x", [0, 0, 0])])
def test_dates(spark, raw, want):
    assert one(spark, raw, "string", lambda c: F.array(*text.parse_date(c))) == want


@pytest.mark.parametrize(("raw", "want"), [("host.example:2002", "network"), ("host:2002", "sacd"), ("/dev/sr0", "device"), ("a/B.DSF", "dsf"), ("x.dff", "dsdiff"), ("x.iso", "sacd")])
def test_input_type(spark, raw, want):
    assert one(spark, raw, "string", text.input_type) == want


def test_layout_golden(spark):
    d = spark.createDataFrame([(75, 2, 256)], "f long, c int, t int").select(*(c.alias(k) for k, c in audio.dsf_layout(F.col("f"), F.col("c"), F.col("t")).items())).first()
    assert (d.audio_bytes, d.padding, d.metadata_offset, d.total) == (712704, 7104, 712796, 713052)


def test_markers(spark):
    rows = [("a", 0, 10, 0, 99), ("a", 1, 20, 1, 99), ("a", 2, 15, 1, 99), ("a", 3, 30, 0, 99), ("a", 4, 30, 1, 99), ("a", 5, 5, 1, 99), ("b", 0, 7, 1, 50), ("c", 0, 3, 0, 40)]
    m = spark.createDataFrame(rows, "f string, idx int, pos long, kind int, total long")
    out = sorted((r.f, r.track, r.start, r.end) for r in tracks.pair_markers(m, ["f"]).collect())
    assert out == [("a", 1, 10, 30), ("a", 2, 30, 99), ("b", 1, 0, 50), ("c", 1, 3, 40)]


def test_tags(spark):
    d = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "x map<string,string>, y map<string,string>")
    r = d.select(tags.merge(F.col("x"), F.col("y")).alias("o"), tags.merge(F.col("x"), F.col("y"), False).alias("k"), tags.put(F.col("x"), "a", F.lit("9")).alias("p"), tags.put(F.col("x"), "a", F.lit(None).cast("string")).alias("d")).first()
    assert r.o == {"a": "1", "b": "3", "c": "4"} and r.k == {"a": "1", "b": "2", "c": "4"} and r.p == {"a": "9", "b": "2"} and r.d == {"b": "2"}


def test_id3():
    t = {"TIT2": "Tïtle", "TXXX:Key": "v", "COMM": "note", "WOAR": "http://x"}
    assert id3.parse(id3.render(t)) == t and id3.parse(b"nothing here") is None and id3.render({}) is None
    v23 = b"ID3\3\0\0" + bytes([0, 0, 0, 17]) + b"TPE1" + (7).to_bytes(4, "big") + b"\0\0" + b"\1\xff\xfeA\0B\0"
    assert id3.parse(v23) == {"TPE1": "AB"}


def test_overlay_edits(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    edits = spark.createDataFrame([(1, "x")], "k int, v string")
    assert sorted((r.k, r.v, r.edited) for r in lookup.overlay(base, edits, ["k"], "v").collect()) == [(1, "x", True), (2, "b", False)]
    edits = lookup.upsert_overlay(edits, spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string"), ["k"])
    assert sorted(r.v for r in edits.collect()) == ["y", "z"] and lookup.clear_overlay(edits, edits, ["k"]).count() == 0


def test_mounts(spark):
    p = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a",), ("/x",)], "path string")
    m = spark.createDataFrame([("/a",), ("/a/b",)], "mount string")
    assert sorted((r.path, r.mount) for r in lookup.mount_of(p, m).collect()) == [("/a", "/a"), ("/a/b/c", "/a/b"), ("/a/bc", "/a")]


@pytest.mark.parametrize(("spec", "want"), [("1,2,", [1, 2]), ("4 - 6 ,2", [4, 5, 6, 2]), ("\t3\n", [3]), (" all ", list(range(1, 13)))])
def test_selection_of_odd_forms(spec, want):
    assert tracks.parse_selection(spec, 12) == want


@pytest.mark.parametrize(("spec", "kind"), [("1 2", "invalid"), ("ALL", "invalid"), ("1-2-3", "invalid"), (",1", "invalid"), ("1,,2", "invalid"), ("13 x", "not_found"), ("1-99 x", "not_found"), ("-1", "invalid"), ("  ", "empty")])
def test_selection_errors_of_odd_forms(spec, kind):
    with pytest.raises(tracks.SelectionError) as e:
        tracks.parse_selection(spec, 12)
    assert e.value.kind == kind


def test_mounts_keep_repeated_rows(spark):
    p = spark.createDataFrame([("/a/b/c",), ("/a/b/c",), ("/x",)], "path string")
    m = spark.createDataFrame([("/a",), ("/a",), ("/a/b",)], "mount string")
    assert [(r.path, r.mount) for r in lookup.mount_of(p, m).collect()] == [("/a/b/c", "/a/b")] * 2


def test_labels(spark):
    from sigmaspark.functions import labels

    d = spark.createDataFrame([("DFF", "best", "TITLE", 6, "TIT2x"), ("nope", "x", "num", 9, "ABCD"), (None, None, None, None, None)], "o string, q string, t string, c int, f string")
    r = d.select(labels.output_name(labels.parse_output(F.col("o"))), labels.extension(labels.parse_output(F.col("o"))), labels.parse_quality(F.col("q")), labels.parse_track_format(F.col("t")), labels.speakers(F.col("c")), labels.tag_frame_name(F.col("f"))).collect()
    assert [tuple(x) for x in r] == [("DSDIFF", ".dff", "high", "title", "5.1ch", "Title"), ("Unknown", "", None, "number", "Unknown", "ABCD"), ("Unknown", "", None, None, "Unknown", "Unknown")]
    a = spark.createDataFrame([(2, 0, 2), (5, 3, 0), (6, 3, 9)], "n int, c int, f int").select(labels.area_speakers(F.col("n"), F.col("c")), labels.area_format(F.col("f")), labels.frame_format(F.lit("dst"))).collect()
    assert [tuple(x) for x in a] == [("2.0 Stereo", "DSD (3-in-14)", "Lossless DST"), ("5.0 Surround", "DST", "Lossless DST"), ("Unknown", "Unknown", "Lossless DST")]


@pytest.mark.parametrize(("name", "names", "want"), [("wav", "dsf,WAV", True), ("wav", "dsf,-wav,ALL", False), ("x", "ALL", True), ("x", "all", False), ("wa", "wav", False), ("dsf", "-ALL,dsf", False), ("", "a", False), (None, "a", False)])
def test_name_lists(spark, name, names, want):
    from sigmaspark.functions import labels

    assert spark.createDataFrame([(name, names)], "a string, b string").select(labels.in_name_list(F.col("a"), F.col("b"))).first()[0] is want


def test_lists_that_meet(spark):
    from sigmaspark.functions import labels

    d = spark.createDataFrame([("a,b", "c,b"), ("a", "ab"), ("", ""), ("a,,b", "x,,y"), (None, "a")], "a string, b string")
    assert [r[0] for r in d.select(labels.lists_meet(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


def test_index_points(spark):
    from sigmaspark.operators import summary

    t = spark.createDataFrame([(1, [0, 150, 400], 1000), (2, [50], 70), (3, [], 9)], "track int, starts array<int>, length int")
    assert sorted(map(tuple, summary.index_intervals(t, ["track"]).collect())) == [(1, 0, 0, 149), (1, 1, 150, 399), (1, 2, 400, 1399), (2, 0, 50, 119)]
    assert sorted(map(tuple, summary.pauses(t, ["track"]).collect())) == [(1, 150), (2, 70), (3, 1)]


def test_list_edits(spark):
    from sigmaspark.operators import summary

    m = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("f", 2, "c"), ("g", 0, "d")], "path string, idx int, text string")
    gone = spark.createDataFrame([("f", 1), ("f", 9), ("h", 0)], "path string, idx int")
    left = summary.delete_index(m, ["path"], "idx", gone)
    assert sorted(map(tuple, left.collect())) == [("f", 0, "a"), ("f", 1, "c"), ("g", 0, "d")]
    new = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y")], "path string, idx int, text string")
    assert sorted(map(tuple, summary.append_index(left, ["path"], "idx", new).collect())) == [("f", 0, "a"), ("f", 1, "c"), ("f", 2, "x"), ("f", 3, "y"), ("g", 0, "d")]


def test_typed_tags(spark):
    t = {"TIT2": "T", "TPE1": "P", "TRCK": "3/12", "TPOS": "1", "TDRC": "2001-02", "TXXX:Arranger": "A", "COMM": ""}
    r = spark.createDataFrame([(t,), ({"TYER": "1999"},)], "m map<string,string>").select(*(c.alias(k) for k, c in id3.typed(F.col("m")).items())).collect()
    assert (r[0].title, r[0].performer, r[0].track, r[0].tracks, r[0].disc, r[0].discs, r[0].year, r[0].month, r[0].arranger, r[0].message) == ("T", "P", 3, 12, 1, 0, 2001, 2, "A", None)
    assert (r[1].year, r[1].title, r[1].track) == (1999, None, 0)


def test_dates_and_numbers_as_the_tags_give_them(spark):
    rows = ["2003", "2003-4", "2003-04", "2003-04-05", "2003-04-5", "2003/04/05", "200", "", "20 3-04", "abcd-12", None]
    df = spark.createDataFrame([(x,) for x in rows], "s string")
    got = [tuple(r) for r in df.select(*text.parse_date(F.col("s"))).collect()]
    assert got == [(2003, 0, 0), (2003, 0, 0), (2003, 4, 0), (2003, 4, 5), (2003, 4, 0), (2003, 0, 0), (0, 0, 0), (0, 0, 0), (20, 4, 0), (0, 12, 0), (0, 0, 0)]
    of = spark.createDataFrame([(x,) for x in ("3/12", "/12", "5abc/10", "7", " 7/ 9", "x", "3/", "1/2/3", "", None)], "s string")
    assert [tuple(r) for r in of.select(*text.parse_of(F.col("s"))).collect()] == [(3, 12), (0, 12), (5, 10), (7, 0), (7, 9), (0, 0), (3, 0), (1, 2), (0, 0), (0, 0)]


def test_a_cut_keeps_real_replacement_characters(spark):
    df = spark.createDataFrame([("ab\ufffdcd",), ("ab\ufffd",), ("aé😀b",), ("",), (None,)], "s string")
    for n in range(1, 9):
        want = []
        for (s,) in (tuple(r) for r in df.collect()):
            want.append(None if s is None else max((s[:k] for k in range(len(s) + 1) if len(s[:k].encode()) <= n), key=len))
        assert [r[0] for r in df.select(text.cut_bytes(F.col("s"), n)).collect()] == want


@pytest.mark.parametrize(("n", "want"), [(16_383, "00007f7f"), (16_384, "00010000"), (899_999, "0036771f"), (2_097_152, "01000000"), (268_435_455, "7f7f7f7f")])
def test_synchsafe_of_more_than_two_bytes(spark, n, want):
    assert one(spark, n, "long", text.synchsafe) == int(want, 16)
    assert one(spark, int(want, 16), "long", text.from_synchsafe) == n == id3._safe(bytes.fromhex(want))
