"""Container operators as queries: files are made from the harness tables, edited, and read back through the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmaspark.functions import audio, dst, genre, id3, labels
from sigmaspark.operators import fir, lookup, summary, validate, virtual
from sigmaspark.sinks import audio as audio_sink
from sigmaspark.sinks import edit, extract, image
from sigmaspark.sinks import flac as flac_sink
from sigmaspark.sinks import text as text_sink
from sigmaspark.sinks import writer
from sigmaspark.sources import dsdiff, dsf, sacd, sidecar, wav
from sigmaspark.sources import flac as flac_source
from sigmaspark.sources.files import Bytes, put
from sigmaspark.sources.pushdown import open_source
from sigmaspark.sources.shared import shared_dir, stored
from sigmaspark.streaming import folder as grown
from sigmaspark.streaming import frames, idle

from .catalog import QUERIES, SQL, query, table

RATE = 2822400


def vector_sound():
    """A vector's id over and over, as a stereo frame."""
    return F.rpad(F.lit(""), 9408, F.concat(F.col("vec_id").cast("string"), F.lit(":"))).cast("binary")


def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as the stereo frames of a track: the vector's id over and over."""
    e = table(spark, sf_dir, "embeddings")
    no = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return e.select(F.col("label").alias("track"), "vec_id", no.alias("frame_no"), F.lit(2).alias("channels"), F.lit(RATE).alias("rate"), vector_sound().alias("payload"))


FRAMES = """f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS no, count(*) OVER (PARTITION BY label) AS n, left(repeat(vec_id || ':', 9408), 9408) AS payload FROM embeddings)"""


def made(df: DataFrame, folder: str) -> None:
    """Run a writer once; its rows are kept beside the files."""
    df.write.mode("overwrite").parquet(f"{folder}/written")


def little_endian(data: str, at: int, n: int):
    """The integer in ``n`` bytes from the ``at``-th on, the lowest first."""
    digits = F.hex(F.substring(data, at, n))
    return F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))), 16, 10).cast("long")


def stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]*)\.\w+$", 1)


def sql_list(names) -> str:
    return "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "]"


# ---- discs


def discs(spark, sf_dir, kind):
    """Images of one disc a label, with ten tracks (fewer on short ones); their folder."""
    f = label_frames(spark, sf_dir).withColumnRenamed("track", "disc")
    n = f.groupBy("disc").agg(F.count("*").alias("n"))
    k = F.sequence(F.lit(0), F.least(F.lit(10), F.col("n")).cast("int") - 1)
    start = lambda i: F.floor(i * F.col("n") / F.least(F.lit(10), F.col("n")))
    tracks = F.transform(k, lambda i: F.struct(start(i).cast("long").alias("start"), (start(i + 1) - start(i)).cast("long").alias("frames"), F.concat(F.lit("Part "), (i + 1).cast("string")).alias("title")))
    album = n.select("disc", tracks.alias("tracks"), F.concat(F.lit("Label "), F.col("disc").cast("string")).alias("title"), F.lit("Künstler").alias("artist"), F.concat(F.lit("L-"), F.col("disc").cast("string")).alias("catalog"))
    if kind == 0:
        f = f.withColumn("payload", F.substring("payload", 1, (F.col("vec_id") % 5000 + 1).cast("int")))
    folder = shared_dir(spark)
    spark.dataSource.register(sacd.SacdSource)
    made(image.write_images(f.join(album, "disc"), folder, kind), folder)
    return folder


def load(spark, kind, folder, what):
    return spark.read.format(kind).option("table", what).load(folder)


@query(f"""WITH {FRAMES}, t AS (SELECT label, n, least(10, n) AS k, unnest(range(0, least(10, n))) AS i FROM (SELECT label, max(n) AS n FROM f GROUP BY label)),
u AS (SELECT label, i + 1 AS track, (i * n) // k AS a, ((i + 1) * n) // k AS b FROM t)
SELECT f.label::VARCHAR AS disc, no::BIGINT AS frame_no, u.track::BIGINT AS track, md5(payload) AS md5 FROM f JOIN u ON u.label = f.label AND no >= a AND no < b""")
def sacd_round_trip(spark, sf_dir):
    """Frames written to disc images (three to 14 sectors), read back and joined to their tracks."""
    folder = discs(spark, sf_dir, 2)
    out = sacd.join_tracks(load(spark, "sacd", folder, "frames"), load(spark, "sacd", folder, "tracks"))
    return out.select(stem().alias("disc"), "frame_no", F.col("track").cast("long").alias("track"), F.md5("payload").alias("md5"))


@query(f"""WITH {FRAMES}, t AS (SELECT label, n, least(10, n) AS k, unnest(range(0, least(10, n))) AS i FROM (SELECT label, max(n) AS n FROM f GROUP BY label)),
u AS (SELECT label, n, i + 1 AS track, (i * n) // k AS a, ((i + 1) * n) // k AS b, i + 1 = k AS last FROM t)
SELECT label::VARCHAR AS disc, 'Label ' || label AS album, 'Künstler' AS artist, 'L-' || label AS catalog, 'DSD (3-in-16)' AS format, '2.0 Stereo' AS speakers, n::BIGINT AS play_frames, track::BIGINT AS track, 'Part ' || track AS title,
a::BIGINT AS start_frame, (b - a)::BIGINT AS frames, (600 + a // 3 * 16)::BIGINT AS start_lsn, (CASE WHEN last THEN 600 + ((n + 2) // 3) * 16 - 1 ELSE 600 + b // 3 * 16 END - (600 + a // 3 * 16) + 1)::BIGINT AS sectors FROM u""")
def sacd_tables(spark, sf_dir):
    """What the tables of contents of disc images say: disc, area and tracks."""
    folder = discs(spark, sf_dir, 3)
    d, a, t = (load(spark, "sacd", folder, x) for x in ("disc", "areas", "tracks"))
    out = t.join(a.drop("start_lsn"), ["path", "area"]).join(d, "path")
    code = F.when(F.col("frame_format") == "DSD 3 in 16", 3).otherwise(9)
    return out.select(
        stem().alias("disc"), F.col("album_title").alias("album"), F.col("album_artist").alias("artist"), F.col("album_catalog").alias("catalog"), labels.area_format(code).alias("format"), labels.area_speakers(F.col("channels"), F.lit(0)).alias("speakers"), "play_frames",
        F.col("track").cast("long").alias("track"), "title", "start_frame", "frames", "start_lsn", "sectors",
    )


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS disc, no::BIGINT AS frame_no, no::BIGINT AS timecode, (vec_id % 5000 + 1)::BIGINT AS bytes, md5(left(payload, (vec_id % 5000 + 1)::BIGINT)) AS md5 FROM f""")
def sacd_packets(spark, sf_dir):
    """Frames of many sizes, put together from the packets of disc images."""
    out = sacd.frames_from_packets(load(spark, "sacd", discs(spark, sf_dir, 0), "packets"))
    return out.select(stem().alias("disc"), "frame_no", "timecode", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("md5"))


CHARSETS = [3, 4, 5, 6, 1]  # of the second text channel, by label


def full_discs(spark, sf_dir):
    """Images with two areas of DST sound, index points, codes, genres and texts in two channels; their folder."""
    f = label_frames(spark, sf_dir).withColumnRenamed("track", "disc")
    size = lambda m: F.substring("payload", 1, (F.col("vec_id") % m + 1).cast("int"))
    f = f.select("disc", "frame_no", F.explode(F.array(F.struct(F.lit("stereo").alias("area"), F.lit(2).alias("channels"), size(5000).alias("payload")), F.struct(F.lit("multichannel").alias("area"), F.lit(6).alias("channels"), F.concat(F.lit(b"m"), size(3000)).alias("payload")))).alias("x")).select("disc", "frame_no", "x.*")
    n = f.where("area = 'stereo'").groupBy("disc").agg(F.count("*").alias("n"))
    start = lambda i: F.floor(i * F.col("n") / 4).cast("long")
    name = lambda head, i: F.concat(F.lit(head), (i + 1).cast("string"))
    second = F.when(F.col("disc") % 5 == 4, "Part ").otherwise("日本 ")

    def track(i):
        texts = F.array(F.create_map(F.lit("title"), name("Teil für ", i), F.lit("performer"), F.lit("Künstler")), F.create_map(F.lit("title"), F.concat(second, (i + 1).cast("string")), F.lit("composer"), F.when(i % 2 == 0, "C")))
        indexes = F.when(i % 2 == 1, F.array(start(i) + 2, start(i) + 5)).otherwise(F.array().cast("array<bigint>"))
        return F.struct(start(i).alias("start"), (start(i + 1) - start(i)).alias("frames"), name("DEA00000000", i).alias("isrc"), F.when((i < 3) & (F.col("disc") + i < F.when(i % 2 == 0, len(genre.GENERAL)).otherwise(len(genre.JAPANESE))), F.struct((i % 2 + 1).alias("table"), (F.col("disc") + i).cast("int").alias("index"))).alias("genre"), indexes.alias("indexes"), texts.alias("texts"))

    sets = F.array(F.lit(2), F.get(F.array(*map(F.lit, CHARSETS)), (F.col("disc") % 5).cast("int")))
    album = n.select("disc", F.transform(F.sequence(F.lit(0), F.lit(3)), track).alias("tracks"), sets.alias("charsets"), name("Label ", F.col("disc") - 1).alias("title"), F.lit("Various").alias("artist"), F.lit("C-1").alias("catalog"), F.array(F.struct(F.lit(1).alias("table"), F.lit(14).alias("index"))).alias("genres"))
    folder = shared_dir(spark)
    spark.dataSource.register(sacd.SacdSource)
    made(image.write_images(f.join(album, "disc"), folder, 0), folder)
    return folder


DISC_TRACKS = f"""WITH {FRAMES}, n AS (SELECT label, max(n) AS n FROM f GROUP BY label),
t AS (SELECT label, unnest(['stereo', 'multichannel']) AS area, n FROM n), k AS (SELECT *, unnest(range(4)) AS i FROM t),
u AS (SELECT *, i * n // 4 AS a, (i + 1) * n // 4 AS b FROM k)"""


@query(f"""{DISC_TRACKS}, g AS (SELECT *, CASE WHEN i < 3 THEN CASE WHEN i % 2 = 0 THEN ({sql_list(genre.GENERAL)})[label + i + 1] ELSE ({sql_list(genre.JAPANESE)})[label + i + 1] END END AS genre FROM u)
SELECT label::VARCHAR AS disc, area, (i + 1)::BIGINT AS track, 'Teil für ' || (i + 1) AS title, 'Künstler' AS performer, 'DEA00000000' || (i + 1) AS isrc, genre, a::BIGINT AS start_frame, (b - a)::BIGINT AS frames, i % 2 = 1 AS indexed FROM g""")
def disc_tracks(spark, sf_dir):
    """Tracks of both areas of discs, with codes, genres by name and titles of the first text channel."""
    t = load(spark, "sacd", full_discs(spark, sf_dir), "tracks")
    return t.select(
        stem().alias("disc"), "area", F.col("track").cast("long").alias("track"), "title", "performer", "isrc", genre.genre_name(F.col("genre.table"), F.col("genre.index")).alias("genre"),
        "start_frame", "frames", (F.col("flags").bitwiseAND(F.lit(16)) > 0).alias("indexed"),
    )


@query(f"""{DISC_TRACKS}, s AS (SELECT *, CASE WHEN i % 2 = 1 THEN [coalesce(lag(b) OVER (PARTITION BY label, area ORDER BY i), 0), a, a + 2, a + 5] ELSE [coalesce(lag(b) OVER (PARTITION BY label, area ORDER BY i), 0), a] END AS starts FROM u),
x AS (SELECT *, unnest(range(len(starts))) AS k FROM s)
SELECT label::VARCHAR AS disc, area, (i + 1)::BIGINT AS track, k::BIGINT AS "index", starts[k + 1]::BIGINT AS start, coalesce(starts[k + 2] - 1, starts[k + 1] + b - a - 1)::BIGINT AS "end" FROM x""")
def disc_index_points(spark, sf_dir):
    """Index points of tracks, read from discs' index lists, as intervals."""
    t = load(spark, "sacd", full_discs(spark, sf_dir), "tracks")
    out = summary.index_intervals(t, ["path", "area", "track"], "index_starts", "frames")
    return out.select(stem().alias("disc"), "area", F.col("track").cast("long").alias("track"), F.col("index").cast("long").alias("index"), "start", "end")


@query(f"""{DISC_TRACKS}, x AS (SELECT *, {CHARSETS}[label % 5 + 1] AS cs FROM u), y AS (
SELECT label, area, i, 1 AS channel, 2 AS cs, 'title' AS kind, 'Teil für ' || (i + 1) AS value FROM x UNION ALL SELECT label, area, i, 1, 2, 'performer', 'Künstler' FROM x
UNION ALL SELECT label, area, i, 2, cs, 'title', CASE WHEN label % 5 = 4 THEN 'Part ' ELSE '日本 ' END || (i + 1) FROM x UNION ALL SELECT label, area, i, 2, cs, 'composer', 'C' FROM x WHERE i % 2 = 0)
SELECT label::VARCHAR AS disc, area, (i + 1)::BIGINT AS track, channel::BIGINT AS channel, cs::BIGINT AS charset, kind, value FROM y""")
def disc_texts(spark, sf_dir):
    """Texts of tracks in all text channels of discs, whose character sets differ."""
    t = load(spark, "sacd", full_discs(spark, sf_dir), "texts")
    return t.select(stem().alias("disc"), "area", *(F.col(c).cast("long").alias(c) for c in ("track", "channel", "charset")), "kind", "value")


DISC_LSN = f"""WITH {FRAMES}, s AS (SELECT label, no, ceil((vec_id % 5000 + 1) / 2000.0)::BIGINT AS parts FROM f), l AS (SELECT *, 640 + sum(parts) OVER (PARTITION BY label ORDER BY no) - parts AS lsn FROM s)"""


@query(f"""{DISC_LSN} SELECT label::VARCHAR AS disc, (no // 10)::BIGINT AS entry, lsn::BIGINT AS lsn FROM l WHERE no % 10 = 0""")
def disc_access(spark, sf_dir):
    """The access lists of discs."""
    a = load(spark, "sacd", full_discs(spark, sf_dir), "access").where("area = 'stereo'")
    return a.select(stem().alias("disc"), F.col("entry").cast("long").alias("entry"), "lsn")


@query(f"""{DISC_LSN}, b AS (SELECT label, max(lsn + parts) - 1 AS area_end FROM l GROUP BY label), e AS (SELECT label, no // 10 AS entry, lsn AS upto FROM l WHERE no % 10 = 0)
SELECT label::VARCHAR AS disc, no::BIGINT AS frame_no, coalesce(e.upto, area_end)::BIGINT AS to_lsn, true AS early FROM l JOIN b USING (label) LEFT JOIN e USING (label) WHERE e.entry IS NULL OR e.entry = no // 10 + 1
UNION ALL SELECT label::VARCHAR, no::BIGINT, area_end::BIGINT, true FROM l JOIN b USING (label) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.label = l.label AND e.entry = no // 10 + 1) AND EXISTS (SELECT 1 FROM e WHERE e.label = l.label)""")
def disc_seek_ranges(spark, sf_dir):
    """For every frame of a disc, the sectors in which the access list says it starts, and whether its packet does start there."""
    folder = full_discs(spark, sf_dir)
    access = load(spark, "sacd", folder, "access").where("area = 'stereo'")
    areas = load(spark, "sacd", folder, "areas").where("area = 'stereo'").select("path", "start_lsn", "end_lsn", "play_frames", F.col("access_step").alias("step"))
    packets = load(spark, "sacd", folder, "packets").where("data_type = 2 AND frame_start").select("path", F.col("timecode").alias("frame"), F.col("lsn").alias("found"))
    out = lookup.access_spans(packets, access, areas, ["path"])
    return out.select(stem().alias("disc"), F.col("frame").alias("frame_no"), "to_lsn", ((F.col("from_lsn") <= F.col("found")) & (F.col("found") <= F.col("to_lsn"))).alias("early"))


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS disc, no::BIGINT AS frame_no, (vec_id % 5000 + 1)::BIGINT AS bytes, md5(left(payload, (vec_id % 5000 + 1)::BIGINT)) AS md5 FROM f WHERE no BETWEEN 20 AND 29""")
def disc_seek(spark, sf_dir):
    """Ten frames from the middle of every disc: the filter is pushed down and looked up in the access lists."""
    f = open_source(spark, "sacd", full_discs(spark, sf_dir)).where("frame_no BETWEEN 20 AND 29")
    return f.select(stem().alias("disc"), "frame_no", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("md5"))


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS disc, no::BIGINT AS frame_no, 6::BIGINT AS channels, md5('m' || left(payload, (vec_id % 3000 + 1)::BIGINT)) AS md5 FROM f""")
def disc_multichannel(spark, sf_dir):
    """All frames of the discs' multichannel areas."""
    f = spark.read.format("sacd").option("area", "multichannel").load(full_discs(spark, sf_dir))
    return f.select(stem().alias("disc"), "frame_no", F.col("channels").cast("long").alias("channels"), F.md5("payload").alias("md5"))


# ---- files with tags, markers and edits


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, 'Vectors of ' || label AS title, label::INTEGER + 1 AS number, 10 AS total, 2003 AS year, max(n)::BIGINT AS frames FROM f GROUP BY label""")
def dsf_tags(spark, sf_dir):
    """DSF files with a metadata block each, read back as typed tags beside the header's frames."""
    f = label_frames(spark, sf_dir)
    tag = id3.render_tag(F.create_map(F.lit("TIT2"), F.concat(F.lit("Vectors of "), F.col("track").cast("string")), F.lit("TRCK"), F.concat((F.col("track") + 1).cast("string"), F.lit("/10")), F.lit("TDRC"), F.lit("2003-04")))
    tags = f.select("track").distinct().withColumn("tag", tag)
    folder = shared_dir(spark)
    spark.dataSource.register(dsf.DsfSource)
    made(audio_sink.write_tracks(f.join(tags, "track"), folder, audio_sink.write_dsf, ".dsf", more=["tag"]), folder)
    typed = id3.typed(F.col("t"))
    back = load(spark, "dsf", folder, "tags").withColumn("t", id3.parse_tag("tag")).select("path", *(typed[k].alias(n) for k, n in (("title", "title"), ("track", "number"), ("tracks", "total"), ("year", "year"))))
    info = load(spark, "dsf", folder, "info").select("path", audio.quotient(F.col("samples"), 37632).alias("frames"))
    return back.join(info, "path").select(stem().alias("track"), "title", "number", "total", "year", "frames")


EDIT_MASTER_SQL = f"""WITH {FRAMES}, t AS (SELECT label % 2 AS album, label, max(n) AS n FROM f GROUP BY label),
s AS (SELECT *, (sum(n) OVER w - n) * 37632 AS start, sum(n) OVER w * 37632 AS stop, row_number() OVER w AS number FROM t WINDOW w AS (PARTITION BY album ORDER BY label DESC)),
m AS (SELECT album, number * 2 - 1 AS idx, 0 AS mark, 'Track ' || label AS text, start AS pos FROM s UNION ALL SELECT album, number * 2, 1, NULL, stop FROM s UNION ALL SELECT DISTINCT album, 0, 2, NULL, 0 FROM t)
SELECT 'album' || album AS album, idx::BIGINT AS idx, mark::BIGINT AS mark, text, pos::BIGINT AS pos FROM m"""


def edit_masters(spark, sf_dir):
    f = label_frames(spark, sf_dir).withColumn("album", F.concat(F.lit("album"), (F.col("track") % 2).cast("string")))
    per = Window.partitionBy("album")
    t = f.select("album", "track").distinct().withColumn("number", F.row_number().over(per.orderBy(F.desc("track")))).withColumn("of", F.count("*").over(per))
    title = F.concat(F.lit("Track "), F.col("track").cast("string"))
    tag = id3.render_tag(F.create_map(F.lit("TIT2"), title, F.lit("TRCK"), F.concat_ws("/", F.col("number").cast("string"), F.col("of").cast("string"))))
    t = t.select("album", "track", F.col("number").alias("position"), title.alias("title"), tag.alias("tag"))
    folder = shared_dir(spark)
    spark.dataSource.register(dsdiff.DsdiffSource)
    made(audio_sink.write_edit_masters(f.join(t, ["album", "track"]), folder), folder)
    return folder


@query(EDIT_MASTER_SQL)
def edit_master_markers(spark, sf_dir):
    """One file per album with all its tracks, last first; the markers that it has."""
    m = load(spark, "dsdiff", edit_masters(spark, sf_dir), "markers")
    return m.select(stem().alias("album"), F.col("idx").cast("long").alias("idx"), F.col("mark_type").cast("long").alias("mark"), "text", "pos")


@query(f"""WITH {FRAMES}, t AS (SELECT label % 2 AS album, label, max(n) AS n FROM f GROUP BY label), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY album ORDER BY label DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM t)
SELECT 'album' || album AS album, (base + no)::BIGINT AS frame_no, md5(payload) AS md5 FROM f JOIN s USING (label)""")
def edit_master_frames(spark, sf_dir):
    """The sound of the same files, frame by frame."""
    f = load(spark, "dsdiff", edit_masters(spark, sf_dir), "frames")
    return f.select(stem().alias("album"), "frame_no", F.md5("payload").alias("md5"))


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, 'New artist' AS artist, CASE WHEN label % 2 = 0 THEN 'Edited ' || label ELSE 'Old' END AS title, 'E' || label AS emid, 'ACME' || label AS manufacturer, 'tag ' || label AS tag, 'first ' || label AS tag0, CASE WHEN label % 3 = 0 THEN 'second' END AS tag1,
CASE WHEN label % 2 = 0 THEN 'C,LFE' ELSE 'SLFT,SRGT' END AS channels, max(n)::BIGINT AS frames FROM f GROUP BY label""")
def dsdiff_edits(spark, sf_dir):
    """DSDIFF files, edited by copying and read back: names, ids, channels, tags of file and tracks; the sound stays."""
    f = label_frames(spark, sf_dir)
    folder = shared_dir(spark)
    spark.dataSource.register(dsdiff.DsdiffSource)
    title = f.select("track").distinct().withColumn("title", F.lit("Old"))
    made(audio_sink.write_tracks(f.join(title, "track"), folder, audio_sink.write_dsdiff, ".dff", more=["title"]), folder)
    k = F.regexp_extract("path", r"([^/]*)\.dff$", 1)
    even, name = k.cast("int") % 2 == 0, k.cast("string")
    files = spark.read.parquet(f"{folder}/written").select("path")
    edits = files.select(
        "path", F.lit("New artist").alias("artist"), F.when(even, F.concat(F.lit("Edited "), name)).alias("title"), F.concat(F.lit("E"), name).alias("emid"), F.array(F.lit(b"ACME"), name.cast("binary")).alias("manufacturer"),
        F.concat(F.lit("tag "), name).cast("binary").alias("tag"), F.when(even, F.array(F.lit("C"), F.lit("LFE"))).alias("channel_ids"),
        F.array(F.concat(F.lit("first "), name).cast("binary"), F.when(k.cast("int") % 3 == 0, F.lit(b"second"))).alias("track_tags"),
    )

    def change(path, track_tags, **more):
        edit.edit_dsdiff(path, track_tags=dict(enumerate(track_tags)), **more)

    edit.edit_all(edits, change).write.mode("overwrite").parquet(f"{folder}/edited")
    tags = load(spark, "dsdiff", folder, "tags").groupBy("path").agg(*(F.max(F.when(F.col("idx").eqNullSafe(F.lit(i)), F.col("tag").cast("string"))).alias(n) for i, n in ((None, "tag"), (0, "tag0"), (1, "tag1"))))
    info = load(spark, "dsdiff", folder, "info").where("error is null")
    return info.join(tags, "path").select(stem().alias("track"), "artist", "title", "emid", F.col("manufacturer").cast("string").alias("manufacturer"), "tag", "tag0", "tag1", F.array_join("channel_ids", ",").alias("channels"), "frames")


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, no::BIGINT AS frame_no, (vec_id % 3000 + 1)::BIGINT AS bytes, md5(left(payload, (vec_id % 3000 + 1)::BIGINT)) AS md5 FROM f""")
def dst_container(spark, sf_dir):
    """DST frames of many sizes in DSDIFF files with an index, read back by it."""
    f = label_frames(spark, sf_dir).withColumn("payload", F.substring("payload", 1, (F.col("vec_id") % 3000 + 1).cast("int")))
    folder = shared_dir(spark)
    spark.dataSource.register(dsdiff.DsdiffSource)
    made(audio_sink.write_tracks(f, folder, audio_sink.write_dsdiff_dst, ".dff"), folder)
    back = load(spark, "dsdiff", folder, "frames")
    return back.select(stem().alias("track"), "frame_no", F.octet_length("payload").cast("long").alias("bytes"), F.md5("payload").alias("md5"))


@query(f"""WITH {FRAMES} SELECT vec_id, md5(payload) AS md5 FROM f""")
def dst_stored(spark, sf_dir):
    """Frames that DST stores as they are, decoded."""
    f = label_frames(spark, sf_dir).withColumn("stored", F.concat(F.lit(b"\0"), "payload"))
    return f.select("vec_id", F.md5(dst.decode_dst("stored", "channels", "rate")).alias("md5"))


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, no::BIGINT AS frame_no, md5(payload) AS md5 FROM f""")
def dst_coded(spark, sf_dir):
    """Frames coded as DST in DSDIFF files, read back by the index and decoded."""
    n = table(spark, sf_dir, "embeddings").count()
    f = dst.dealt(label_frames(spark, sf_dir), n, "track", "frame_no")  # few bytes, but much work
    f = f.withColumn("payload", dst.encode_dst("payload", "channels", "rate"))
    folder = shared_dir(spark)
    spark.dataSource.register(dsdiff.DsdiffSource)
    made(audio_sink.write_tracks(stored(f, f"{folder}/coded"), folder, audio_sink.write_dsdiff_dst, ".dff"), folder)
    back = dst.dealt(load(spark, "dsdiff", folder, "frames"), n, "path", "frame_no")  # a file may hold many
    return back.select(stem().alias("track"), "frame_no", F.md5(dst.decode_dst("payload", "channels", "rate")).alias("md5"))


@query("""WITH f AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS no, left(repeat(vec_id || ':', 294), 294) AS payload FROM embeddings),
e AS (SELECT *, no // 16 AS batch, CASE vec_id % 50 WHEN 7 THEN 'segmentation is not supported' WHEN 11 THEN 'bad plain frame' WHEN 13 THEN 'empty frame' END AS own FROM f),
b AS (SELECT *, first_value(own IGNORE NULLS) OVER (PARTITION BY label, batch ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS error FROM e)
SELECT label AS track, no::BIGINT AS frame_no, batch::BIGINT AS batch, error, CASE WHEN error IS NULL THEN md5(payload) END AS md5 FROM b""")
def dst_batches(spark, sf_dir):
    """Coded frames in batches of sixteen, some of them broken: a batch ends with its first error."""
    f = label_frames(spark, sf_dir).withColumns({"rate": F.lit(88200), "payload": F.substring("payload", 1, 294)})
    broken = F.when(F.col("vec_id") % 50 == 7, F.lit(b"\x80\0\0")).when(F.col("vec_id") % 50 == 11, F.lit(b"\x21\0\0")).when(F.col("vec_id") % 50 == 13, F.lit(b"\0"))
    f = f.withColumn("payload", F.coalesce(broken, dst.encode_dst("payload", "channels", "rate")))
    out = dst.decode_batches(f, ["track"])
    return out.select("track", "frame_no", "batch", "error", F.md5("payload").alias("md5"))


def with_headers(path: str, target: str, size: int, skip: int) -> None:
    """An image of larger sectors: each with ``skip`` bytes before its data, up to ``size``."""
    with Bytes(path) as f:
        raw = f.at(0, f.size)
    put(target, (b"h" * skip + raw[i : i + 2048] + b"t" * (size - 2048 - skip) for i in range(0, len(raw), 2048)))


@query(f"""WITH {FRAMES}, n AS (SELECT label, max(n) AS n FROM f GROUP BY label), s AS (SELECT label, 600 + (n + 2) // 3 * 14 AS sectors FROM n)
SELECT label::VARCHAR AS disc, sectors::BIGINT AS sectors, (sectors * 2048)::BIGINT AS bytes, ((sectors + 99) // 100)::BIGINT AS spans, true AS same FROM s""")
def image_extract(spark, sf_dir):
    """Images of 2064 and 2054 bytes a sector, cut to plain ones in spans: the same bytes as the images that they were made from."""
    plain, folder = discs(spark, sf_dir, 2), shared_dir(spark)

    @F.udf("string")
    def widened(path):
        with_headers(path, f"{folder}/raw/" + path.rpartition("/")[2], *((2064, 12) if path.rpartition("/")[2] < "5" else (2054, 6)))
        return path

    files = spark.read.parquet(f"{plain}/written").select("path")
    files.select(widened("path").alias("path")).write.format("noop").mode("overwrite").save()
    done = stored(extract.extract(spark, f"{folder}/raw", f"{folder}/plain", 100), f"{folder}/done")
    was = spark.read.format("binaryFile").option("pathGlobFilter", "*.iso").load(plain).select(stem().alias("disc"), F.md5("content").alias("was"))
    return done.select(stem().alias("disc"), "sectors", "bytes", "spans", "md5").join(was, "disc").select("disc", "sectors", "bytes", "spans", (F.col("md5") == F.col("was")).alias("same"))


# ---- damaged files


def damage(path: str, how: int) -> None:
    """Breaks a file in one of a few ways."""
    with Bytes(path) as f:
        raw = bytearray(f.at(0, f.size))
    if path.endswith(".dsf"):
        if how == 1:
            del raw[-5000:]
        elif how == 2:
            raw[20:28] = (50).to_bytes(8, "little")
        elif how == 3:
            raw[52:56] = (9).to_bytes(4, "little")
        elif how == 4:
            raw[64:72] = (8).to_bytes(8, "little")
    elif how == 1:
        del raw[-5000:]
    elif how == 2:
        at = raw.index(b"CMPR")
        raw[at : at + 4] = b"CHNL"
    elif how == 3:
        at = raw.index(b"FVER")
        raw[at + 12] = 2
    elif how == 4:
        at = raw.index(b"FS  ")
        raw[at + 12 : at + 16] = (44000).to_bytes(4, "big")
    put(path, [bytes(raw)])


@query("""WITH l AS (SELECT DISTINCT label FROM embeddings), d AS (SELECT label, unnest(CASE label % 5 WHEN 0 THEN [] WHEN 1 THEN ['file is shorter than it says', 'sound lies past the end'] WHEN 2 THEN ['metadata lies in the head', 'metadata lies in the sound'] WHEN 3 THEN ['bad channels', 'sound has another size than its samples'] ELSE ['sound has another size than its samples'] END) AS rule FROM l),
f AS (SELECT label, unnest(CASE label % 5 WHEN 0 THEN [] WHEN 1 THEN ['FRM8:chunk ends past its parent'] WHEN 2 THEN ['CHNL:channels and their number differ', 'CHNL:chunk comes twice', 'no compression'] WHEN 3 THEN ['FVER:unknown version'] ELSE ['FS  :bad rate'] END) AS rule FROM l)
SELECT label || '.dsf' AS file, rule FROM d UNION ALL SELECT label || '.dff', rule FROM f""")
def file_findings(spark, sf_dir):
    """What is wrong with files that were written well and broken in some ways then."""
    f = label_frames(spark, sf_dir)
    folder = shared_dir(spark)
    for s in (dsf.DsfSource, dsdiff.DsdiffSource):
        spark.dataSource.register(s)
    writer.fan_out(f, [writer.Sink("dsf", folder), writer.Sink("dsdiff", folder)])
    names = f.select("track").distinct().select("track", F.explode(F.array(F.lit(".dsf"), F.lit(".dff"))).alias("ending"))

    @F.udf("string")
    def broken(track, ending):
        damage(f"{folder}/{track}{ending}", track % 5)
        return ending

    names.select("track", broken("track", "ending").alias("done")).write.format("noop").mode("overwrite").save()
    out = validate.findings(spark, folder)
    file = F.regexp_extract("path", r"([^/]*)$", 1)
    return out.select(file.alias("file"), F.when(file.endswith(".dff"), F.concat_ws(":", "kind", "rule")).otherwise(F.col("rule")).alias("rule"))


# ---- samples


@query("""SELECT label::VARCHAR AS track, (row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1)::BIGINT AS at, trunc(least(greatest(embedding[i + 1]::DOUBLE * 32767, -32768), 32767))::BIGINT AS sample
FROM embeddings, range(0, 64) r(i)""")
def wav_samples(spark, sf_dir):
    """Vectors written as the samples of one WAV file per label, and the samples that the files hold."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), F.col("vec_id").alias("frame_no"), F.lit(2).alias("channels"), F.lit(88200).alias("rate"), F.col("embedding").cast("array<double>").alias("pcm"))
    folder = shared_dir(spark)
    made(audio_sink.write_wavs(e, folder, 16), folder)
    spark.dataSource.register(wav.WavSource)
    out = spark.read.format("wav").load(folder).select(stem().alias("track"), F.col("at").alias("begin"), F.posexplode("samples").alias("i", "sample"))
    return out.select("track", (F.col("begin") + F.col("i")).alias("at"), F.col("sample").cast("long").alias("sample"))


def flac_files(spark, sf_dir, bits, level):
    """One FLAC file a label, its vectors as stereo samples, sixteen vectors a block."""
    e = table(spark, sf_dir, "embeddings")
    no = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    e = e.select(F.col("label").alias("track"), no.alias("frame_no"), F.lit(2).alias("channels"), F.lit(RATE).alias("rate"), F.col("embedding").cast("array<double>").alias("pcm"))
    k = F.col("track")
    tags = flac_sink.vorbis_comments({"title": F.lit("Vectors"), "artist": F.lit("Künstler"), "genre": F.when(k % 2 == 0, "Jazz"), "year": F.lit(2003)}, {"title": F.concat(F.lit("Label "), k.cast("string")), "number": k + 1, "total": F.lit(10)})
    folder = shared_dir(spark)
    spark.dataSource.register(flac_source.FlacSource)
    made(flac_sink.write_flacs(e, folder, bits, level, 16, tags=e.select("track").distinct().withColumn("comments", tags), scratch=f"{folder}/scratch"), folder)
    return folder


@query("""SELECT label::VARCHAR AS track, (i % 2)::BIGINT AS channel, ((row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1) // 2)::BIGINT AS at, trunc(least(greatest(embedding[i + 1]::DOUBLE * 8388607, -8388608), 8388607))::BIGINT AS sample
FROM embeddings, range(0, 64) r(i)""")
def flac_samples(spark, sf_dir):
    """Vectors coded as FLAC files of 24 bits, and the samples that the files decode to."""
    b = load(spark, "flac", flac_files(spark, sf_dir, 24, 8), "blocks")
    ch = b.select(stem().alias("track"), "sample_offset", F.posexplode("pcm").alias("channel", "x"))
    out = ch.select("track", "channel", "sample_offset", F.posexplode("x").alias("i", "sample"))
    return out.select("track", F.col("channel").cast("long").alias("channel"), (F.col("sample_offset") + F.col("i")).alias("at"), F.col("sample").cast("long").alias("sample"))


@query("""WITH s AS (SELECT label, vec_id, i, trunc(least(greatest(embedding[i + 1]::DOUBLE * 32767, -32768), 32767))::BIGINT & 65535 AS w FROM embeddings, range(0, 64) r(i)),
d AS (SELECT label, md5(unhex(string_agg(printf('%02x%02x', w & 255, w >> 8), '' ORDER BY vec_id, i))) AS md5, count(*) // 2 AS samples FROM s GROUP BY label)
SELECT label::VARCHAR AS track, 88200::BIGINT AS rate, 2::BIGINT AS channels, 16::BIGINT AS bits, samples::BIGINT AS samples, md5,
'ALBUM=Vectors,ALBUMARTIST=Künstler,' || CASE WHEN label % 2 = 0 THEN 'GENRE=Jazz,' ELSE '' END || 'DATE=2003,TITLE=Label ' || label || ',TRACKNUMBER=' || (label + 1) || '/10' AS comments FROM d""")
def flac_info(spark, sf_dir):
    """Properties, comments and the digest of all samples of FLAC files of 16 bits."""
    folder = flac_files(spark, sf_dir, 16, 5)
    tags = load(spark, "flac", folder, "comments").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", F.concat_ws("=", "key", "value").alias("x")))).alias("t"))
    out = load(spark, "flac", folder, "info").join(tags, "path")
    return out.select(stem().alias("track"), *(F.col(c).cast("long").alias(c) for c in ("rate", "channels", "bits", "samples")), "md5", F.array_join(F.transform("t", lambda x: x["x"]), ",").alias("comments"))


BIT_TAPS = fir.windowed_sinc(40, 1 / 20)
CHAIN = [(fir.windowed_sinc(24, 1 / 20), 8), (fir.windowed_sinc(12, 0.22), 2)]


def bits_sql(taps: list[float], step: int) -> str:
    """SQL of a filter of at most 128 taps over the bits of digests: each frame with the one before it, or silence."""
    return f"""WITH f AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS h FROM events),
x AS (SELECT user_id, event_id, list_transform(range(0, 128), lambda i: CASE WHEN (('0x' || substr(h, (i // 4 + 1)::BIGINT, 1))::INTEGER >> (3 - i % 4)::INTEGER) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM f),
p AS (SELECT user_id, event_id, list_concat(coalesce(lag(x) OVER (PARTITION BY user_id ORDER BY event_id), list_transform(range(0, 128), lambda i: 0.0::DOUBLE)), x) AS x FROM x)
SELECT user_id, event_id, n::BIGINT AS n, round(list_inner_product({[float(t) for t in reversed(taps)]!r}::DOUBLE[], x[{129 - len(taps)} + n * {step} + 1:129 + n * {step}]), 6) + 0.0::DOUBLE AS y FROM p, range(0, {128 // step}) r(n)"""


def digest_bits(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("payload"))


@query(bits_sql(BIT_TAPS, 8))
def fir_bits(spark, sf_dir):
    """1-bit frames (the digests of a user's events) through a filter that looks back into the frame before."""
    y = fir.decimate_frames(digest_bits(spark, sf_dir), ["user_id"], BIT_TAPS, 8, "event_id", frame_bytes=16).select("user_id", "event_id", F.posexplode("pcm").alias("n", "y"))
    return y.select("user_id", "event_id", F.col("n").cast("long").alias("n"), (F.round("y", 6) + 0.0).alias("y"))


@query(bits_sql(fir.combined(CHAIN), 16))
def fir_chain(spark, sf_dir):
    """The same through two filters, one after the other; the SQL has the one filter that they come to."""
    y = fir.decimate_chain(digest_bits(spark, sf_dir), ["user_id"], CHAIN, "event_id", frame_bytes=16).select("user_id", "event_id", F.posexplode("pcm").alias("n", "y"))
    return y.select("user_id", "event_id", F.col("n").cast("long").alias("n"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"""WITH {FRAMES}, w AS (SELECT label, no, i, trunc(ascii(substr(payload, i, 1)) / 256.0::DOUBLE * 32767)::BIGINT AS w FROM f, range(1, 295) r(i)),
m AS (SELECT label, count(*) // 2 AS n, md5(unhex(string_agg(printf('%02x%02x', w & 255, w >> 8), '' ORDER BY no, i))) AS md5 FROM w GROUP BY label)
SELECT label::VARCHAR AS track, kind, no::BIGINT AS at, md5(payload) AS md5 FROM f, (SELECT unnest(['dsf', 'dff']) AS kind) UNION ALL SELECT label::VARCHAR, 'flac', n::BIGINT, md5 FROM m""")
def sink_fan_out(spark, sf_dir):
    """Frames written to three formats in one pass: 1-bit sound twice, and samples made from it; the files' frames, and the number and digest of the samples."""
    f = label_frames(spark, sf_dir)
    bytes_of = F.transform(F.sequence(F.lit(1), F.lit(294)), lambda i: F.ascii(F.substring("payload", i, F.lit(1))) / 256.0)
    f = f.withColumn("pcm", bytes_of)
    folder = shared_dir(spark)
    for s in (dsf.DsfSource, dsdiff.DsdiffSource, flac_source.FlacSource):
        spark.dataSource.register(s)
    writer.fan_out(f, [writer.Sink("dsf", f"{folder}/a"), writer.Sink("dsdiff", f"{folder}/b"), writer.Sink("flac", f"{folder}/c", 16, 2)])
    ends = lambda kind, t: load(spark, t, f"{folder}/{kind}", "frames").select(stem().alias("track"), F.lit("dff" if t == "dsdiff" else t).alias("kind"), F.col("frame_no").alias("at"), F.md5("payload").alias("md5"))
    samples = load(spark, "flac", f"{folder}/c", "info").select(stem().alias("track"), F.lit("flac").alias("kind"), F.col("samples").alias("at"), "md5")
    return ends("a", "dsf").unionByName(ends("b", "dsdiff")).unionByName(samples)


HISTORY_BITS = 1280  # what the longest chain looks back on, in whole digests
CONVERSIONS = [(pcm, quality) for pcm in (88200, 176400) for quality in ("fast", "normal", "high")]


def conversion_sql() -> str:
    """Each conversion as the one filter that its chain comes to, over a user's last digests as bits, silence before the first."""
    parts = []
    for pcm, quality in CONVERSIONS:
        step, taps = RATE // pcm, fir.combined(fir.stages(RATE, pcm, quality))
        parts.append(f"""SELECT user_id, event_id, {pcm}::BIGINT AS pcm_rate, '{quality}' AS quality, n::BIGINT AS n,
round(list_inner_product({[float(t) for t in reversed(taps)]!r}::DOUBLE[], x[{HISTORY_BITS + 1 - len(taps)} + n * {step} + 1:{HISTORY_BITS + 1} + n * {step}]), 6) + 0.0::DOUBLE AS y FROM p, range(0, {128 // step}) r(n)""")
    return f"""WITH f AS (SELECT user_id, event_id, md5(event_id::VARCHAR) AS h FROM events),
x AS (SELECT user_id, event_id, list_transform(range(0, 128), lambda i: CASE WHEN (('0x' || substr(h, (i // 4 + 1)::BIGINT, 1))::INTEGER >> (3 - i % 4)::INTEGER) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM f),
g AS (SELECT user_id, event_id, flatten(list(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN {HISTORY_BITS // 128} PRECEDING AND CURRENT ROW)) AS x FROM x),
p AS (SELECT user_id, event_id, list_concat(list_transform(range(0, {HISTORY_BITS + 128} - len(x)), lambda i: 0.0::DOUBLE), x) AS x FROM g)
{" UNION ALL ".join(parts)}"""


@query(conversion_sql())
def pcm_conversions(spark, sf_dir):
    """1-bit frames as samples at two rates, by one filter and by chains, in one pass; the first filter of each looks up bytes."""
    y = fir.decimate_chains(digest_bits(spark, sf_dir), ["user_id"], [fir.stages(RATE, *c) for c in CONVERSIONS], "event_id", frame_bytes=16)
    named = F.array(*(F.struct(F.lit(pcm).cast("long").alias("pcm_rate"), F.lit(quality).alias("quality"), F.get("pcm", F.lit(i)).alias("y")) for i, (pcm, quality) in enumerate(CONVERSIONS)))
    out = y.select("user_id", "event_id", F.inline(named)).select("user_id", "event_id", "pcm_rate", "quality", F.posexplode("y").alias("n", "y"))
    return out.select("user_id", "event_id", "pcm_rate", "quality", F.col("n").cast("long").alias("n"), (F.round("y", 6) + 0.0).alias("y"))


# ---- names, index points, virtual files


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN ({sql_list(genre.GENERAL)})[n_chars % 35 + 1] WHEN 2 THEN ({sql_list(genre.JAPANESE)})[n_chars % 35 + 1] END AS genre FROM documents""")
def genre_names(spark, sf_dir):
    """Names of genres from two tables; numbers past their ends have none."""
    return table(spark, sf_dir, "documents").select("doc_id", genre.genre_name(F.col("doc_id") % 3, (F.col("n_chars") % 35).cast("int")).alias("genre"))


@query("""SELECT page_id, o AS asked, CASE lower(o) WHEN 'dff' THEN 'DSDIFF' WHEN 'edit-master' THEN 'DSDIFF Edit Master' WHEN 'wave' THEN 'WAV' WHEN 'cuesheet' THEN 'CUE Sheet' WHEN 'txt' THEN 'Text Metadata' ELSE 'Unknown' END AS output,
CASE lower(o) WHEN 'dff' THEN '.dff' WHEN 'edit-master' THEN '.dff' WHEN 'wave' THEN '.wav' WHEN 'cuesheet' THEN '.cue' WHEN 'txt' THEN '.txt' ELSE '' END AS ext, CASE page_id % 7 WHEN 1 THEN 'Mono' WHEN 2 THEN 'Stereo' WHEN 3 THEN '3ch' WHEN 4 THEN '4ch' WHEN 5 THEN '5ch' WHEN 6 THEN '5.1ch' ELSE 'Unknown' END AS speakers,
lower(o) IN ('dff', 'wave') AS listed FROM (SELECT page_id, ['DFF', 'edit-master', 'Wave', 'cuesheet', 'TXT', 'mp3'][length(url) % 6 + 1] AS o FROM pages)""")
def format_labels(spark, sf_dir):
    """Output formats by any of their names, what they are called, and whether a list of names takes them."""
    names = F.array(*map(F.lit, ("DFF", "edit-master", "Wave", "cuesheet", "TXT", "mp3")))
    p = table(spark, sf_dir, "pages").select("page_id", F.get(names, (F.length("url") % 6).cast("int")).alias("asked"))
    out = labels.parse_output(F.col("asked"))
    return p.select("page_id", "asked", labels.output_name(out).alias("output"), labels.extension(out).alias("ext"), labels.speakers(F.col("page_id") % 7).alias("speakers"), labels.in_name_list(F.col("asked"), F.lit("dff,-txt,WAVE")).alias("listed"))


@query("""WITH l AS (SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS index, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS start FROM lineitem),
t AS (SELECT track, max(start) AS length FROM l GROUP BY track), i AS (SELECT track, index::BIGINT AS index, start, coalesce(lead(start) OVER (PARTITION BY track ORDER BY index) - 1, start + length - 1)::BIGINT AS "end" FROM l JOIN t USING (track))
SELECT i.*, p."end" + 1 - p.start AS pause FROM i JOIN i p ON p.track = i.track AND p.index = 0""")
def index_points(spark, sf_dir):
    """Index intervals within tracks and the pause before each."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.sum(F.col("l_quantity").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    t = li.groupBy("track").agg(F.array_sort(F.collect_list("start")).alias("starts"), F.max("start").alias("length"))
    out = summary.index_intervals(t, ["track"]).join(summary.pauses(t, ["track"]), "track")
    return out.select("track", F.col("index").cast("long").alias("index"), "start", "end", "pause")


@query("""WITH m AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)
SELECT user_id, event_id, event_type, (row_number() OVER (PARTITION BY user_id ORDER BY idx) - 1)::INTEGER AS idx FROM m WHERE NOT (event_type = 'error')""")
def marker_delete(spark, sf_dir):
    """Marker lists without the entries at some of their indices, numbered anew; indices past the end do nothing."""
    no = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int")
    m = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", no.alias("idx"))
    gone = m.where("event_type = 'error'").select("user_id", "idx")
    gone = gone.unionByName(m.select("user_id", (F.col("idx") + 1_000_000).alias("idx")))
    return summary.delete_index(m, ["user_id"], "idx", gone)


@query("""WITH t AS (SELECT s_suppkey, s_nationkey, s_suppkey % 90 + 1 AS f, CASE WHEN s_suppkey % 3 = 0 THEN 6 ELSE 2 END AS ch, s_suppkey % 400 AS tag FROM supplier),
a AS (SELECT *, ((f * 4704 + 4095) // 4096) * 4096 * ch AS audio FROM t), r AS (SELECT *, unnest(['header', 'audio', 'tag']) AS region, unnest([0, 92, 92 + audio]) AS b, unnest([92, 92 + audio, 92 + audio + tag]) AS e FROM a)
SELECT s_suppkey::VARCHAR AS path, region, (greatest(b, 80) - b)::BIGINT AS "from", (least(e, 713100) - greatest(b, 80))::BIGINT AS bytes FROM r WHERE e > b AND b < 713100 AND e > 80""")
def virtual_reads(spark, sf_dir):
    """Which bytes of virtual track files a read touches: header, sound and tag."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), F.when(k % 3 == 0, "multichannel").otherwise("stereo").alias("area"), F.lit(1).alias("track"), (k % 90 + 1).alias("frames"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("performer"), (k % 400).alias("tag_bytes"))
    areas = s.select("path", "area", F.when(F.col("area") == "stereo", 2).otherwise(6).alias("channels"))
    return virtual.read_ranges(virtual.regions(virtual.entries(s, areas)), 80, 713_020).select("path", "region", "from", "bytes")


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, no::BIGINT AS frame_no, md5(payload) AS md5, 'tag of ' || label AS tag FROM f""")
def virtual_files(spark, sf_dir):
    """Tracks as the bytes of virtual DSF files, put together from pieces and read back as real ones."""
    f = label_frames(spark, sf_dir).select(F.lit("disc").alias("path"), F.lit("stereo").alias("area"), "track", "frame_no", "payload")
    tag = F.concat(F.lit("tag of "), F.col("track").cast("string"))
    t = f.groupBy("path", "area", "track").agg(F.count("*").alias("frames")).withColumn("tag", tag.cast("binary"))
    t = t.withColumns({"title": F.lit("t"), "performer": F.lit(None).cast("string"), "tag_bytes": F.octet_length("tag")})
    areas = spark.createDataFrame([("disc", "stereo", 2)], "path string, area string, channels int")
    files = virtual.entries(t, areas).join(t.select("path", "area", "track", "tag"), ["path", "area", "track"])
    folder = shared_dir(spark)
    spark.dataSource.register(dsf.DsfSource)
    made(virtual.write_views(virtual.file_bytes(files, f), folder), folder)
    tags = load(spark, "dsf", folder, "tags")
    back = load(spark, "dsf", folder, "frames").join(tags, "path")
    return back.select(F.regexp_extract("path", r"-(\d+)\.dsf$", 1).alias("track"), "frame_no", F.md5("payload").alias("md5"), F.col("tag").cast("string").alias("tag"))


@query(f"""WITH {FRAMES}, n AS (SELECT label, max(n) AS n FROM f GROUP BY label), s AS (SELECT label, n, n * 2 // 3 AS kept FROM n), x AS (SELECT *, ((n * 4704 + 4095) // 4096) * 8192 AS audio, ((kept * 4704 + 4095) // 4096) * 8192 AS sound FROM s)
SELECT label::VARCHAR AS track, (92 + audio)::BIGINT AS bytes, (92 + audio)::BIGINT AS tag_begin, (audio - sound)::BIGINT AS silent FROM x""")
def virtual_silence(spark, sf_dir):
    """Virtual files of discs whose sound ends after two thirds of what their contents say: header, size, and the bytes of silence at the end."""
    f = label_frames(spark, sf_dir).withColumn("payload", vector_sound())  # made once the vectors are in order, so that only their ids are sorted
    t = f.groupBy("track").agg(F.count("*").alias("frames")).select(F.lit("disc").alias("path"), F.lit("stereo").alias("area"), "track", "frames", F.lit("t").alias("title"), F.lit(None).cast("string").alias("performer"))
    kept = f.join(t.select("track", "frames"), "track").where(F.col("frame_no") < F.floor(F.col("frames") * 2 / 3)).select(F.lit("disc").alias("path"), F.lit("stereo").alias("area"), "track", "frame_no", F.translate(F.col("payload").cast("string"), "i", "j").cast("binary").alias("payload"))
    files = virtual.entries(t, spark.createDataFrame([("disc", "stereo", 2)], "path string, area string, channels int")).withColumn("tag", F.lit(None).cast("binary"))
    pieces = virtual.file_bytes(files, kept)
    tail = F.length(F.regexp_extract(F.hex("data"), "((?:96)*)$", 1)) / 2
    at = little_endian("data", 21, 8)
    sizes = pieces.groupBy("track").agg(F.sum(F.octet_length("data")).cast("long").alias("bytes"), F.max(F.when(F.col("begin") == 0, at)).alias("tag_begin"), F.sum(F.when(F.col("begin") > 0, tail)).cast("long").alias("silent"))
    return sizes.select(F.col("track").cast("string").alias("track"), "bytes", "tag_begin", "silent")


@query("""WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_id::VARCHAR AS data FROM events),
t AS (SELECT user_id, sum(length(data))::BIGINT AS accepted, string_agg(CASE WHEN seq > 3 THEN data END, '' ORDER BY seq) AS tag FROM w GROUP BY user_id) SELECT user_id, accepted, tag FROM t""")
def overlay_writes(spark, sf_dir):
    """Writes to virtual files, one after another: those before the place of the tag are accepted and dropped, the others make up the tag."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    w = table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("seq"), F.col("event_id").cast("string").cast("binary").alias("data"))
    upto = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("offset", F.sum(F.octet_length("data").cast("long")).over(upto) - F.octet_length("data"))
    begin = F.coalesce(F.max(F.when(F.col("seq") <= 3, F.col("offset") + F.octet_length("data"))), F.lit(0))
    out = virtual.apply_writes(w, w.groupBy("user_id").agg(begin.alias("tag_begin")), ["user_id"])
    return out.select("user_id", "accepted", F.col("tag").cast("string").alias("tag"))


@query("""SELECT n_name AS area, (row_number() OVER (PARTITION BY n_name ORDER BY c_custkey))::INTEGER AS track, c_name AS tag FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def tag_sidecar(spark, sf_dir):
    """Edited tags written to XML files beside images and read back."""
    no = F.row_number().over(Window.partitionBy("n_name").orderBy("c_custkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    folder = f"{shared_dir(spark)}/tags.xml"
    sidecar.save(c.select(F.col("n_name").alias("area"), no.alias("track"), F.col("c_name").cast("binary").alias("tag")), folder)
    return sidecar.load(spark, folder).select("area", "track", F.col("tag").cast("string").alias("tag"))


ALBUM_SQL = """l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS track, 'P' || l_partkey AS title, CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey END AS performer, l_quantity::BIGINT AS frames FROM lineitem),
a AS (SELECT l_orderkey AS album_id, string_agg(printf('  %02d. ', track) || coalesce(performer, '?') || ' - ' || title || printf(' (%02d:%02d:%02d)', frames // 75 // 60, frames // 75 % 60, frames % 75), chr(10) ORDER BY track) AS lines, sum(frames)::BIGINT AS n, count(*) AS k, max_by(title, track) AS last FROM l GROUP BY 1)"""


def albums(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    none = F.lit(None).cast("string")
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("album_id"), F.row_number().over(order).alias("track"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("title"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("performer"), none.alias("isrc"), F.lit(0).alias("start_frame"), F.col("l_quantity").cast("long").alias("frames"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_orderpriority").alias("artist"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"))
    return text_sink.album_documents(o, t).where("tracks is not null")


@query(f"""WITH {ALBUM_SQL} SELECT album_id, o_orderpriority || ': Order ' || o_orderkey || chr(10) || lines || chr(10) || 'Total ' || printf('%02d:%02d:%02d', n // 75 // 60, n // 75 % 60, n % 75) AS value FROM a JOIN orders ON o_orderkey = album_id""")
def album_reports(spark, sf_dir):
    """A readable report of every order as an album."""
    return text_sink.report(albums(spark, sf_dir))


@query(f"""WITH {ALBUM_SQL} SELECT album_id, 'Order ' || album_id AS title, n AS total_frames, k::BIGINT AS tracks, last, n / 75.0::DOUBLE AS seconds FROM a JOIN orders ON o_orderkey = album_id""")
def album_exports(spark, sf_dir):
    """The same as XML and JSON documents, parsed again: both must say the same."""
    d = albums(spark, sf_dir)
    shape = "album_id long, title string, total_frames long, seconds double, tracks array<struct<track:int,title:string>>"
    parsed = d.select(F.from_xml(text_sink.xml_of(F.struct("*")), shape, {"rowTag": "Album"}).alias("x"), F.from_json(text_sink.json_of(F.struct("*")), shape).alias("j"))
    row = F.struct(F.col("x.album_id").alias("album_id"), F.col("j.title").alias("title"), F.col("x.total_frames").alias("total_frames"), F.size("x.tracks").cast("long").alias("tracks"), F.element_at("j.tracks", -1)["title"].alias("last"), F.col("j.seconds").alias("seconds"))
    # As rows of an array, so that the comparison doesn't have the documents parsed once more.
    return parsed.select(F.inline(F.when(F.col("x.album_id") == F.col("j.album_id"), F.array(row))))


@query(f"""WITH {FRAMES} SELECT label::VARCHAR AS track, kind, no::BIGINT AS frame_no, md5(payload) AS md5, no = n - 1 AS is_last FROM f, (SELECT unnest(['dsf', 'dff']) AS kind)""")
def growing_folder(spark, sf_dir):
    """Files read as a stream while they grow: once when three fifths of each are there, and by a query started again when they are whole."""
    f = label_frames(spark, sf_dir)
    folder = shared_dir(spark)
    writer.fan_out(f, [writer.Sink("dsf", f"{folder}/whole"), writer.Sink("dsdiff", f"{folder}/whole")])
    names = f.select("track").distinct().select(F.explode(F.array(F.concat("track", F.lit(".dsf")), F.concat("track", F.lit(".dff")))).alias("name"))
    spark.dataSource.register(grown.FolderSource)
    for share in (0.6, 1.0):

        @F.udf("string")
        def copied(name, share=share):
            with Bytes(f"{folder}/whole/{name}") as b:
                put(f"{folder}/in/{name}", [b.at(0, int(b.size * share))])
            return name

        names.select(copied("name").alias("name")).write.format("noop").mode("overwrite").save()
        stream = grown.read_ranges(spark.readStream.format("audio_folder").option("frames_per_batch", 1000).load(f"{folder}/in"))
        run = stream.withColumn("md5", F.md5("payload")).drop("payload").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="0 seconds").start()
        run.processAllAvailable()
        run.stop()
    kind = F.regexp_extract("path", r"\.(\w+)$", 1)
    return spark.read.parquet(f"{folder}/out").select(stem().alias("track"), kind.alias("kind"), "frame_no", "md5", "is_last")


@query(SQL["fir_bits"])
def fir_stream(spark, sf_dir):
    """``fir_bits`` over a stream of files: what a user's next frame looks back on is kept as state."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("frame_no"), F.unhex(F.md5(F.col("event_id").cast("string").cast("binary"))).alias("payload"))
    folder = shared_dir(spark)
    part = F.floor(F.col("frame_no") * 3 / (e.agg(F.max("frame_no")).scalar() + 1))
    for i in range(3):  # three batches of files, in the order of frames
        e.where(part == i).repartition(4, "user_id").write.mode("append").parquet(f"{folder}/in")
    stream = frames.frame_stream(spark, f"{folder}/in", "user_id long, frame_no long, payload binary", 4)
    out = frames.decimate_stream(stream, ["user_id"], BIT_TAPS, 8)
    run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    y = spark.read.parquet(f"{folder}/out").select("user_id", F.col("frame_no").alias("event_id"), F.posexplode("pcm").alias("n", "y"))
    return y.select("user_id", "event_id", F.col("n").cast("long").alias("n"), (F.round("y", 6) + 0.0).alias("y"))


KINDS = (idle.OPEN, idle.USE, idle.USE, idle.CLOSE)  # of an event, by its number
IDLE = 30 * 60_000


def idle_evictions(spark, sf_dir):
    """Users as images with uses, openings and closings: when each is dropped for being idle. Pins make it a fold of state, which SQL can't say; tests replay it."""
    at = F.col("ts").cast("timestamp")
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 4).cast("int"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("image"), at.alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.approx_count_distinct("image").alias("images")).first()
    folder = shared_dir(spark)
    part = F.floor((F.unix_millis("ts") - int(ends["a"].timestamp() * 1000)) * 3 / (int(ends["b"].timestamp() * 1000) - int(ends["a"].timestamp() * 1000) + 1000)) if ends["a"] else F.lit(0)
    for i in range(3):  # three batches, in the order of time
        e.where(part == i).repartition(4, "image").write.mode("append").parquet(f"{folder}/in")
    with idle.state_store(spark):
        stream = frames.frame_stream(spark, f"{folder}/in", e.schema.simpleString()[7:-1].replace(":", " "), 4)
        run = idle.evictions(stream, IDLE, groups=ends["images"] // 64 + 1).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(idle.SPANS).parquet(f"{folder}/out")


QUERIES["idle_evictions"] = idle_evictions
