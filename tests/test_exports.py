"""Exports of albums are made from one reading of the tables."""

from sigmaspark.plans import media
from sigmaspark.sinks import text


def test_exports_read_each_table_once(spark, sf):
    out = media.album_exports(spark, sf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1
    assert out.count() == spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()


def test_cue_lines_are_numbered_before_they_are_told_apart(spark):
    albums = spark.createDataFrame([(1, 'A "x"', "T", "", 1999, " C ", None), (2, None, "", None, 0, None, "f.dff")], "album_id long, artist string, title string, genre string, year int, catalog string, file string")
    numbered = spark.createDataFrame([(1, 2, "b\\", "", "ISRC1", 150, 10), (1, 1, None, "P", None, 0, 100), (3, 100, "c", None, "", 449_999, 5)], "album_id long, track int, title string, performer string, isrc string, start_frame long, frames long")
    head = ["REM Generated by sigmaspark", "REM DATE 1999", 'PERFORMER "A \\"x\\""', 'TITLE "T"', 'CATALOG " C"', 'FILE "audio.dff" WAVE']
    first = ["  TRACK 01 AUDIO", '      PERFORMER "P"', "      INDEX 01 00:00:00"]
    second = ["  TRACK 02 AUDIO", '      TITLE "b\\\\"', "      ISRC ISRC1", "      INDEX 00 00:01:25", "      INDEX 01 00:02:00"]
    alone = ["  TRACK 100 AUDIO", '      TITLE "c"', "      INDEX 00 00:00:00", "      INDEX 01 99:59:74"]
    want = {1: head + first + second, 2: [head[0], 'FILE "f.dff" WAVE'], 3: alone}
    for empty in (True, False):
        sheet = text.cue_sheet(albums, numbered, empty=empty)
        got = {}
        for r in sorted(sheet.collect()):
            assert r.line_no == len(got.setdefault(r.album_id, []))
            got[r.album_id].append(r.line)
        assert got == {k: v for k, v in want.items() if empty or k != 2}
        plan = sheet._jdf.queryExecution().sparkPlan().toString()  # from the last step on
        above = plan[: plan.index("- Generate ")]
        assert "Sort" not in above and "Window" not in above and plan.count("- Generate ") == 1
