"""The reference operators on the harness tables, each with SQL that gives the same rows.

The tables hold no audio, so other columns stand in: events of a user for markers of a file,
order lines for frames, and so on. Every query reads its whole tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmaspark.functions import audio, id3, tags, text
from sigmaspark.functions import labels as label_names
from sigmaspark.operators import fir, lookup, summary, tracks
from sigmaspark.sinks import audio as audio_sink
from sigmaspark.sinks import text as text_sink
from sigmaspark.sources import dsdiff, dsf
from sigmaspark.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(col):
    """Microseconds since 1970 of a zoneless time stamp, whatever the session's zone."""
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", epoch, col.cast("timestamp_ntz"))


MARKERS = """m AS (SELECT user_id, event_id, epoch_us(ts)::BIGINT AS pos,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS kind,
  (max(epoch_us(ts)) OVER (PARTITION BY user_id) + 1)::BIGINT AS total FROM events)"""


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros(F.col("ts")).alias("pos"), "event_type")
    kind = F.when(F.col("event_type") == "signup", tracks.START).when(F.col("event_type") == "purchase", tracks.STOP).otherwise(2)
    return e.select("user_id", "event_id", "pos", kind.alias("kind"), (F.max("pos").over(Window.partitionBy("user_id")) + 1).alias("total"))


@query(f"""WITH {MARKERS},
s AS (SELECT user_id, pos AS start, total, row_number() OVER (PARTITION BY user_id ORDER BY pos, event_id) AS track,
      lead(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) AS next FROM m WHERE kind = 0),
x AS (SELECT s.user_id, s.track, arg_max(m.pos, m.event_id) AS stop FROM s JOIN m ON m.user_id = s.user_id AND m.kind = 1
      AND m.pos > s.start AND (s.next IS NULL OR m.pos <= s.next) GROUP BY 1, 2)
SELECT s.user_id, s.track::BIGINT AS track, s.start, coalesce(x.stop, s.total)::BIGINT AS "end" FROM s LEFT JOIN x USING (user_id, track)
UNION ALL SELECT user_id, 1, 0, max(total) FROM m GROUP BY user_id HAVING count(*) FILTER (kind = 0) = 0""")
def marker_tracks(spark, sf_dir):
    return tracks.pair_markers(markers(spark, sf_dir), ["user_id"], idx="event_id")


@query(f"""WITH {MARKERS}
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY pos // 1000000, CASE WHEN kind = 0 THEN 0 ELSE 1 END, event_id)::BIGINT AS place FROM m""")
def marker_sort(spark, sf_dir):
    m = markers(spark, sf_dir).withColumn("second", audio.quotient(F.col("pos"), 1_000_000))
    return tracks.sort_markers(m, ["user_id"], "second", "kind", "event_id").select("user_id", "event_id", "place")


SPECS = {"5-3, 1,1,7-9": [5, 4, 3, 1, 7, 8, 9], "2": [2], "4 - 6 ,2,": [4, 5, 6, 2], "all": list(range(1, 100)), "9-1": list(range(9, 0, -1))}


@query(" UNION ALL ".join(f"SELECT '{s}' AS spec, conv_id, turn, list_position({v}, turn)::BIGINT AS sel_pos FROM conversations WHERE list_contains({v}, turn)" for s, v in SPECS.items()))
def track_selections(spark, sf_dir):
    """Several selections of the turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    out = [tracks.select_tracks(c, s, 99, "turn").select(F.lit(s).alias("spec"), "conv_id", "turn", F.col("sel_pos").cast("long").alias("sel_pos")) for s in SPECS]
    return functools.reduce(DataFrame.unionByName, out)


@query("""SELECT conv_id, turn, list_position([5, 4, 3, 1, 7, 8, 9], turn)::BIGINT AS sel_pos FROM conversations WHERE turn IN (5, 4, 3, 1, 7, 8, 9)""")
def track_select(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return tracks.select_tracks(c, "5-3, 1,1,7-9", 99, "turn").withColumn("sel_pos", F.col("sel_pos").cast("long"))


@query("""SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT * 44100 + (event_id % 44100) AS samples FROM events""")
def timecode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", audio.timecode_to_samples(F.hour("ts"), F.minute("ts"), F.second("ts"), F.col("event_id") % 44100, 44100).alias("samples"))


@query("""SELECT event_id, p // (44100::BIGINT * 3600) AS hours, (p // (44100 * 60)) % 60 AS minutes, (p // 44100) % 60 AS seconds, p % 44100 AS samples
FROM (SELECT event_id, (epoch_us(ts) % 100000000000)::BIGINT AS p FROM events)""")
def timecode_inverse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (micros(F.col("ts")) % 100_000_000_000).alias("p"))
    return e.select("event_id", *(c.alias(k) for k, c in audio.samples_to_timecode(F.col("p"), 44100).items()))


LINES = """l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS frames, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem)"""


def lines(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("frames"), F.row_number().over(w).cast("long").alias("line"))


@query(f"""WITH {LINES}, t AS (SELECT *, (line * 60 + (l_partkey % 3) * 5)::BIGINT AS start FROM l),
g AS (SELECT *, coalesce(lag(start + frames) OVER (PARTITION BY l_orderkey ORDER BY line), 0)::BIGINT AS pe FROM t)
SELECT l_orderkey, line, CASE WHEN start > pe THEN printf('%02d:%02d:%02d', pe // 75 // 60, pe // 75 % 60, pe % 75) END AS index00,
       printf('%02d:%02d:%02d', start // 75 // 60, start // 75 % 60, start % 75) AS index01 FROM g""")
def cue_index(spark, sf_dir):
    t = lines(spark, sf_dir).withColumn("start", F.col("line") * 60 + (F.col("l_partkey") % 3) * 5)
    g = tracks.gaps(t, ["l_orderkey"], ["line"], "start", "frames")
    return g.select("l_orderkey", "line", F.when(F.col("gap"), audio.frames_to_msf(F.col("previous_end"))).alias("index00"), audio.frames_to_msf(F.col("start")).alias("index01"))


ACCESS = """a AS (SELECT event_id AS entry, (event_id * 7 + 100)::BIGINT AS lsn, (event_id % 13)::BIGINT AS margin FROM events),
c AS (SELECT count(*) AS n, max(lsn) AS hi FROM a)"""


def access(spark, sf_dir):
    """Every event as an entry of an access list, with the number of entries and the last sector as scalar subqueries."""
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("entry"), (F.col("event_id") * 7 + 100).alias("lsn"), (F.col("event_id") % 13).alias("margin"))
    return a, a.agg(F.count("*").alias("n")).scalar(), a.agg(F.max("lsn").alias("hi")).scalar()


@query(f"""WITH {ACCESS} SELECT o_orderkey, least(a.lsn, c.hi - 50)::BIGINT AS lsn FROM orders, c JOIN a ON a.entry = least(o_orderkey // 4, c.n - 1)""")
def access_list(spark, sf_dir):
    a, n, hi = access(spark, sf_dir)
    return lookup.access_lsn(table(spark, sf_dir, "orders").select(F.col("o_orderkey")), a, 4, n, hi - 50, "o_orderkey").select("o_orderkey", "lsn")


@query(f"""WITH {ACCESS}, e AS (SELECT *, lead(lsn) OVER (ORDER BY entry) AS nx FROM a),
f AS (SELECT o_orderkey AS f, o_orderkey % 4 AS off, e.*, c.n, c.hi FROM orders, c JOIN e ON e.entry = least(o_orderkey // 4, c.n - 1)),
g AS (SELECT *, CASE WHEN nx IS NULL THEN hi + 500 - lsn ELSE nx - lsn END AS room, CASE WHEN nx IS NULL THEN (n * 4 + 2) - entry * 4 ELSE 4 END AS over FROM f),
h AS (SELECT *, CASE WHEN over > 0 THEN lsn + (off * room) // over ELSE lsn END AS guess FROM g)
SELECT f AS o_orderkey, greatest(CASE WHEN over > 0 AND guess > margin THEN greatest(guess - margin, lsn) ELSE lsn END, 120)::BIGINT AS from_lsn,
       least(coalesce(nx, hi + 500), hi + 500)::BIGINT AS to_lsn FROM h""")
def access_range(spark, sf_dir):
    a, n, hi = access(spark, sf_dir)
    return lookup.access_range(table(spark, sf_dir, "orders").select("o_orderkey"), a, 4, n, n * 4 + 2, (120, hi + 500), "o_orderkey")


@query("""SELECT o_orderkey, (coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), (SELECT max(o_orderkey) FROM orders)) - o_orderkey + 1)::BIGINT AS length FROM orders""")
def contiguous_len(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tracks.contiguous_length(o, ["o_custkey"], "o_orderkey", o.agg(F.max("o_orderkey")).scalar()).select("o_orderkey", "length")


@query(f"""WITH {LINES} SELECT l_orderkey, line AS number, (sum(frames) OVER w - frames)::BIGINT AS start, (sum(frames) OVER w)::BIGINT AS stop
FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)""")
def edit_master(spark, sf_dir):
    return tracks.edit_master(lines(spark, sf_dir), ["l_orderkey"], ["line"], "frames").select("l_orderkey", "number", "start", "stop")


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, line, (l_orderkey * 37) % 1009 + 10 AS total, frames, sum(frames) OVER (PARTITION BY l_orderkey) AS whole FROM l),
q AS (SELECT *, (total * frames) // whole AS part, lead(1) OVER (PARTITION BY l_orderkey ORDER BY line) IS NULL AS last FROM p)
SELECT l_orderkey, line, (CASE WHEN last THEN total - coalesce(sum(part) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE part END)::BIGINT AS share FROM q""")
def redistribute(spark, sf_dir):
    return tracks.redistribute(lines(spark, sf_dir), ["l_orderkey"], ["line"], "frames", (F.col("l_orderkey") * 37) % 1009 + 10).select("l_orderkey", "line", "share")


SINKS = [("dsf", lookup.DSD), ("dsdiff", lookup.DSD | lookup.DST), ("wav", lookup.PCM), ("print", 7)]


@query("""SELECT event_id, sink FROM (SELECT event_id, 1 << (event_id % 3) AS f FROM events) e,
(VALUES ('dsf', 1), ('dsdiff', 3), ('wav', 4), ('print', 7)) s(sink, caps) WHERE f & caps <> 0""")
def routing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("shiftleft(1, cast(event_id % 3 as int))").alias("format"))
    return lookup.routes(e, SINKS).select("event_id", "sink")


CLEAN = r"""coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({x}, '[\x01-\x1F/\\:*?"<>|]', '_', 'g'), '^[ .]+', ''), '[ .]+$', ''), ''), 'untitled')"""


@query(f"""SELECT p_partkey, {CLEAN.format(x="p")} AS file_name, regexp_replace(regexp_replace(regexp_replace(p, '[\\x01-\\x1F\\x7F"*<>?|]', '_', 'g'), '^[. \\t\\r\\n]+', ''), '[. \\t\\r\\n]+$', '') AS file_path
FROM (SELECT p_partkey, ' .' || p_name || ': a/b*' || chr(9) || p_type || '?. ' AS p FROM part)""")
def sanitize(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" ."), "p_name", F.lit(": a/b*\t"), "p_type", F.lit("?. ")).alias("p"))
    return p.select("p_partkey", text.sanitize_filename(F.col("p")).alias("file_name"), text.sanitize_filepath(F.col("p")).alias("file_path"))


@query("""SELECT doc_id, CASE WHEN strlen(t) <= 60 THEN t ELSE left(t, list_max(list_filter(range(0, 61), lambda k: strlen(left(t, k)) <= 60))::BIGINT) END AS token
FROM (SELECT doc_id, rtrim(regexp_extract(translate(text, chr(10), '/'), '^(.*?)(?:;|/|,| - |$)', 1, 's'), ' ') AS t FROM documents)""")
def first_token(spark, sf_dir):
    """The first name in each whole text, cut to 60 bytes between characters."""
    return table(spark, sf_dir, "documents").select("doc_id", text.first_token(F.translate("text", "\n", "/")).alias("token"))


@query(f"""WITH t AS (SELECT p_partkey, p_partkey % 20 + 1 AS n, nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END, '') AS title,
  coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END, ''), nullif(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END, '')) AS who FROM part)
SELECT p_partkey, who AS artist, printf('%02d', n) || ' - ' || CASE WHEN title IS NOT NULL AND who IS NOT NULL THEN {CLEAN.format(x="rtrim(regexp_extract(who, '^(.*?)(?:;|/|,| - |$)', 1), ' ')")} || ' - ' || {CLEAN.format(x="title")}
  WHEN title IS NOT NULL THEN {CLEAN.format(x="title")} WHEN who IS NOT NULL THEN {CLEAN.format(x="rtrim(regexp_extract(who, '^(.*?)(?:;|/|,| - |$)', 1), ' ')")} ELSE 'Track ' || n END AS name,
  printf('%02d', n) || ' - ' || coalesce(CASE WHEN title IS NOT NULL THEN {CLEAN.format(x="title")} END, 'Track ' || n) AS short FROM t""")
def track_name(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(
        k, (k % 20 + 1).alias("n"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("title"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("performer"), F.when(k % 7 == 0, "").otherwise(F.col("p_type")).alias("album_artist")
    )
    return p.select(
        "p_partkey",
        text.best_artist(F.col("performer"), F.col("album_artist")).alias("artist"),
        text.track_filename(F.col("n"), F.col("title"), F.col("performer"), F.col("album_artist")).alias("name"),
        text.track_filename(F.col("n"), F.col("title")).alias("short"),
    )


@query(f"""WITH t AS (SELECT s_suppkey, nullif(CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END, '') AS title, nullif(CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END, '') AS artist, s_suppkey % 3 AS disc, s_suppkey % 4 AS discs
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT *, CASE WHEN artist IS NOT NULL AND title IS NOT NULL THEN {CLEAN.format(x="artist")} || ' - ' || {CLEAN.format(x="title")} WHEN title IS NOT NULL THEN {CLEAN.format(x="title")} WHEN artist IS NOT NULL THEN {CLEAN.format(x="artist")} ELSE 'Unknown Album' END AS base FROM t)
SELECT s_suppkey, CASE WHEN discs > 1 AND disc > 0 THEN base || ' (disc ' || disc || '-' || discs || ')' ELSE base END AS dir, CASE WHEN discs > 1 AND disc > 0 THEN base || '/Disc ' || disc ELSE base END AS path FROM b""")
def album_dir(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    s = s.select(k, F.when(k % 4 == 0, "").otherwise(F.col("s_name")).alias("title"), F.when(k % 3 == 0, "").otherwise(F.col("n_name")).alias("artist"), (k % 3).alias("disc"), (k % 4).alias("discs"))
    args = F.col("title"), F.col("artist"), F.col("disc"), F.col("discs")
    return s.select("s_suppkey", text.album_dir(*args).alias("dir"), text.album_path(*args).alias("path"))


@query("""WITH t AS (SELECT doc_id, n_chars AS f, CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 6 ELSE 1 END AS ch, doc_id % 300 AS tag FROM documents),
a AS (SELECT *, ((f * 4704 + 4095) // 4096) * 4096 * ch AS audio FROM t)
SELECT doc_id, audio::BIGINT AS audio_bytes, (audio - f * 4704 * ch)::BIGINT AS padding, (CASE WHEN tag > 0 THEN audio + 92 ELSE 0 END)::BIGINT AS metadata_offset, (audio + 92 + tag)::BIGINT AS total, (audio + 92)::BIGINT AS tag_begin, f / 75.0::DOUBLE AS seconds FROM a""")
def layout(spark, sf_dir):
    ch = F.when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 6).otherwise(1)
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", ch.alias("ch"), (F.col("doc_id") % 300).alias("tag"))
    return d.select("doc_id", *(c.alias(k) for k, c in audio.dsf_layout(F.col("n_chars"), F.col("ch"), F.col("tag")).items()), audio.dsf_layout(F.col("n_chars"), F.col("ch"), F.col("tag"), virtual=True)["metadata_offset"].alias("tag_begin"), (F.col("n_chars") / F.lit(75.0)).alias("seconds"))


@query("""SELECT event_id, trunc(least(greatest(value / 100 * 32767.0, -32768.0), 32767.0))::INTEGER AS s16, trunc(least(greatest(value / 100 * 8388607.0, -8388607.0), 8388607.0))::INTEGER AS s24,
(trunc(least(greatest(value / 100 * 8388607.0, -8388607.0), 8388607.0))::INTEGER // 256)::INTEGER AS narrow FROM events""")
def quantize(spark, sf_dir):
    v = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", audio.quantize(v, 16).alias("s16"), audio.quantize(v, 24).alias("s24"), audio.widen(audio.quantize(v, 24), 24, 16).alias("narrow"))


TAPS = fir.windowed_sinc(24, 1 / 32)


@query(f"""SELECT vec_id, n::BIGINT AS n, round(sum(h.c * embedding[n * 8 - h.k + 1]::DOUBLE), 6) AS y
FROM embeddings, range(0, 8) r(n), (SELECT unnest({TAPS!r}) AS c, unnest(range(0, {len(TAPS)})) AS k) h
WHERE n * 8 - h.k >= 0 AND n * 8 < len(embedding) GROUP BY vec_id, n""")
def fir_decimate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    y = e.select("vec_id", F.posexplode(fir.decimate_array(F.col("embedding"), TAPS, 8)).alias("n", "y"))
    return y.select("vec_id", F.col("n").cast("long").alias("n"), F.round("y", 6).alias("y"))


@query("""SELECT vec_id, (i % 2)::BIGINT AS channel, (i // 2)::BIGINT AS at, embedding[i + 1]::DOUBLE AS sample FROM embeddings, range(0, 64) r(i)""")
def deinterleave(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.inline(audio.deinterleave(F.col("embedding"), 2)))
    return e.withColumn("sample", F.col("sample").cast("double"))


@query("""WITH t AS (SELECT d.doc_id, lang, source, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce('toxic=' || toxic, '') || '' AS edited, 'lang=' || lang || CASE WHEN quality IS NULL THEN ';source=' || source ELSE ';quality=' || quality || ';source=label' END AS merged,
 'lang=' || lang || CASE WHEN quality IS NULL THEN '' ELSE ';quality=' || quality END || ';source=' || source AS filled, 'source=' || source AS rest FROM t""")
def tag_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("own"))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("source"), F.lit("label")).alias("user"), "toxic")
    t = d.join(lab, "doc_id", "left").withColumn("user", F.coalesce("user", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))

    def shown(m):
        return F.array_join(F.transform(tags.in_order(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return t.select("doc_id", shown(tags.put(none, "toxic", F.col("toxic").cast("string"))).alias("edited"), shown(tags.merge(F.col("own"), F.col("user"))).alias("merged"), shown(tags.merge(F.col("own"), F.col("user"), overwrite=False)).alias("filled"), shown(tags.remove(F.col("own"), "lang")).alias("rest"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'q' || quality END AS tag, l.doc_id IS NOT NULL AS edited FROM documents d LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l USING (doc_id)""")
def overlay(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tag"))
    lab = table(spark, sf_dir, "labels")
    edits = lab.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("tag"))
    edits = lookup.clear_overlay(edits, lab.where("toxic <> 0"), ["doc_id"])
    return lookup.overlay(base, edits, ["doc_id"], "tag")


@query("""SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def genre_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # 5 regions, 25 nations
    return table(spark, sf_dir, "customer").join(F.broadcast(dim), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' (' || n || ')' END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def name_collision(spark, sf_dir):
    return tracks.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [], "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '^[^/]*\\.[^/]*:[0-9]+$') THEN 'network' WHEN starts_with(p, '/dev/') THEN 'device' WHEN lower(p) LIKE '%.dsf' THEN 'dsf' WHEN regexp_matches(lower(p), '\\.(dff|dsdiff)$') THEN 'dsdiff' ELSE 'sacd' END AS kind,
regexp_extract(p, '([^/]*)$', 1) AS base, regexp_extract(p, '^(.*)/[^/]*$', 1) AS folder
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'host' || page_id || '.example:2002' WHEN 1 THEN '/dev/cd' || page_id WHEN 2 THEN url || '.DSF' WHEN 3 THEN url || '.dff' ELSE url END AS p FROM pages)""")
def input_type(spark, sf_dir):
    k, u = F.col("page_id"), F.col("url")
    p = F.when(k % 5 == 0, F.concat(F.lit("host"), k.cast("string"), F.lit(".example:2002"))).when(k % 5 == 1, F.concat(F.lit("/dev/cd"), k.cast("string"))).when(k % 5 == 2, F.concat(u, F.lit(".DSF"))).when(k % 5 == 3, F.concat(u, F.lit(".dff"))).otherwise(u)
    t = table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    return t.select("page_id", text.input_type(F.col("p")).alias("kind"), text.basename(F.col("p")).alias("base"), text.dirname(F.col("p")).alias("folder"))


@query(f"""WITH {LINES} SELECT l_orderkey, line, sum(frames) OVER (PARTITION BY l_orderkey ORDER BY line)::BIGINT AS done, round(100.0::DOUBLE * sum(frames) OVER (PARTITION BY l_orderkey ORDER BY line) / sum(frames) OVER (PARTITION BY l_orderkey), 4) AS percent FROM l""")
def progress(spark, sf_dir):
    return summary.progress(lines(spark, sf_dir), ["l_orderkey"], ["line"], "frames").select("l_orderkey", "line", "done", "percent")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS tracks, count(DISTINCT l_orderkey) AS albums, sum(l_quantity::BIGINT)::BIGINT AS frames, round(sum(l_quantity::BIGINT) / 75.0::DOUBLE, 4) AS seconds FROM lineitem GROUP BY 1, 2""")
def totals(spark, sf_dir):
    return summary.totals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", F.col("l_quantity").cast("long"))


@query("""WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders),
s AS (SELECT k, CASE k % 8 WHEN 0 THEN x WHEN 1 THEN left(x, 7) WHEN 2 THEN left(x, 4) WHEN 3 THEN left(x, 5) || '4' WHEN 4 THEN left(x, 3) WHEN 5 THEN left(x, 5) || '4-12' WHEN 6 THEN replace(x, '-', '/') ELSE 'year ' || x END AS s,
CASE k % 6 WHEN 0 THEN (k % 30)::VARCHAR WHEN 1 THEN '/12' WHEN 2 THEN '5abc/10' WHEN 3 THEN ' 7/ 9' WHEN 4 THEN 'x/' ELSE (k % 30) || '/' || (k % 40) END AS f FROM o)
SELECT k AS o_orderkey, CASE WHEN length(s) >= 4 THEN coalesce(try_cast(regexp_extract(s, '^\\d+') AS INTEGER), 0) ELSE 0 END AS y,
CASE WHEN length(s) >= 7 AND s[5] = '-' THEN coalesce(try_cast(regexp_extract(substr(s, 6), '^\\d+') AS INTEGER), 0) ELSE 0 END AS m,
CASE WHEN length(s) >= 10 AND s[5] = '-' AND s[8] = '-' THEN coalesce(try_cast(regexp_extract(substr(s, 9), '^\\d+') AS INTEGER), 0) ELSE 0 END AS d,
coalesce(try_cast(regexp_extract(f, '^ *(\\d+)', 1) AS INTEGER), 0) AS n, CASE WHEN strpos(f, '/') > 0 THEN coalesce(try_cast(regexp_extract(substr(f, strpos(f, '/') + 1), '^ *(\\d+)', 1) AS INTEGER), 0) ELSE 0 END AS total FROM s""")
def date_parse(spark, sf_dir):
    k, x = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    dates = [x, F.left(x, F.lit(7)), F.left(x, F.lit(4)), F.concat(F.left(x, F.lit(5)), F.lit("4")), F.left(x, F.lit(3)), F.concat(F.left(x, F.lit(5)), F.lit("4-12")), F.replace(x, F.lit("-"), F.lit("/")), F.concat(F.lit("year "), x)]
    numbers = [(k % 30).cast("string"), F.lit("/12"), F.lit("5abc/10"), F.lit(" 7/ 9"), F.lit("x/"), F.concat_ws("/", (k % 30).cast("string"), (k % 40).cast("string"))]
    o = table(spark, sf_dir, "orders").select(k, F.get(F.array(*dates), (k % 8).cast("int")).alias("s"), F.get(F.array(*numbers), (k % 6).cast("int")).alias("of"))
    y, m, d = text.parse_date(F.col("s"))
    n, total = text.parse_of(F.col("of"))
    return o.select("o_orderkey", y.alias("y"), m.alias("m"), d.alias("d"), n.alias("n"), total.alias("total"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE left(n_name, 2) || rpad(left(c_mktsegment, 3), 3, ' ') || lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey % 100000)::VARCHAR, 5, '0') END AS isrc,
to_base64(encode(c_name)) AS b64, c_name AS back, (((c_custkey >> 21) & 127) << 24 | ((c_custkey >> 14) & 127) << 16 | ((c_custkey >> 7) & 127) << 8 | (c_custkey & 127))::BIGINT AS safe, (c_custkey & 268435455)::BIGINT AS unsafe, bit_count(c_custkey)::INTEGER AS bits
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def codes(spark, sf_dir):
    k = F.col("c_custkey")
    none = k % 6 == 0
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    made = text.isrc(F.when(none, "").otherwise(F.left("n_name", F.lit(2))), F.when(none, "").otherwise(F.left("c_mktsegment", F.lit(3))), (k % 100).cast("string"), (k % 100000).cast("string"))
    b64 = F.base64(F.encode("c_name", "utf-8"))
    return c.select(k, made.alias("isrc"), b64.alias("b64"), F.decode(F.unbase64(b64), "utf-8").alias("back"), text.synchsafe(k).alias("safe"), text.from_synchsafe(text.synchsafe(k)).alias("unsafe"), F.bit_count(k).alias("bits"))


@query("""SELECT s_suppkey, 'REM "' || replace(replace(s_name || '\\' || '"x"', '\\', '\\\\'), '"', '\\"') || '"' AS cue, '{"key":' || s_suppkey || ',"name":"' || s_name || '"}' AS json FROM supplier""")
def json_info(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", F.concat(F.lit('REM "'), text.cue_escape(F.concat("s_name", F.lit('\\"x"'))), F.lit('"')).alias("cue"), text_sink.json_of(F.struct(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))).alias("json"))


@query("""WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 7 WHEN event_type = 'view' THEN 3 ELSE 2 END AS kind, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS first, event_id % 2048 AS size FROM events),
f AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY event_id) AS frame FROM p WHERE kind = 2)
SELECT user_id, frame::BIGINT AS frame, count(*) AS packets, sum(size)::BIGINT AS bytes FROM f WHERE frame > 0 GROUP BY 1, 2""")
def packet_frames(spark, sf_dir):
    t = F.col("event_type")
    p = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(t == "error", lookup.PADDING).when(t == "view", lookup.SUPPLEMENTARY).otherwise(lookup.AUDIO).alias("data_type"), (t == "signup").cast("int").alias("frame_start"), (F.col("event_id") % 2048).alias("size"))
    return lookup.frames_from_packets(p, ["user_id"], ["event_id"])


@query("""SELECT o_orderkey, (500 + (o_orderkey // 3) * 14 + (o_orderkey % 3 * 9408) // 2016)::BIGINT AS lsn14, (32 + (o_orderkey % 3 * 9408) % 2016)::BIGINT AS skip14, (500 + (o_orderkey // 3) * 16 + (o_orderkey % 3 * 9408) // 1764)::BIGINT AS lsn16, (284 + (o_orderkey % 3 * 9408) % 1764)::BIGINT AS skip16 FROM orders""")
def sector_layout(spark, sf_dir):
    o = lookup.fixed_sectors(table(spark, sf_dir, "orders").select("o_orderkey"), 14, 500, "o_orderkey").withColumnsRenamed({"lsn": "lsn14", "skip": "skip14"}).drop("sectors")
    return lookup.fixed_sectors(o, 16, 500, "o_orderkey").withColumnsRenamed({"lsn": "lsn16", "skip": "skip16"}).drop("sectors")


@query("""WITH m AS (SELECT DISTINCT 'http://' || split_part(split_part(url, '://', 2), '/', 1) AS mount FROM pages WHERE url LIKE 'http://%' UNION SELECT DISTINCT 'http://' || split_part(split_part(url, '://', 2), '/', 1) || '/en' FROM pages WHERE url LIKE 'http://%')
SELECT page_id, url, max_by(mount, length(mount)) AS mount FROM pages JOIN m ON url = mount OR starts_with(url, mount || '/') GROUP BY 1, 2""")
def mount_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.concat(F.lit("http://"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    hosts = p.where(F.col("url").startswith("http://")).select(host.alias("mount"))
    mounts = hosts.union(hosts.select(F.concat("mount", F.lit("/en")))).distinct()
    return lookup.mount_of(p, mounts, "url")


@query(f"""WITH {LINES} SELECT l_orderkey, line, coalesce(sum(frames * 37632) OVER (PARTITION BY l_orderkey ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sample_offset,
line = 1 AS is_first, lead(1) OVER (PARTITION BY l_orderkey ORDER BY line) IS NULL AS is_last FROM l""")
def frame_offsets(spark, sf_dir):
    return tracks.frame_offsets(lines(spark, sf_dir), ["l_orderkey"], ["line"], F.col("frames") * 37632).select("l_orderkey", "line", "sample_offset", "is_first", "is_last")


@query(f"""WITH {LINES} SELECT l_orderkey, line, (sum(frames + 12 + frames % 2) OVER (PARTITION BY l_orderkey ORDER BY line) - (frames + frames % 2))::BIGINT AS at, (2 * ((2822400 // (frames + 74)) // 8) + 1)::BIGINT AS most FROM l""")
def dst_index(spark, sf_dir):
    """Where each frame's payload lies: 12 bytes of header before each, padded to even sizes."""
    t = tracks.chunk_offsets(lines(spark, sf_dir), ["l_orderkey"], ["line"], "frames")
    return t.select("l_orderkey", "line", "at", audio.dst_max_frame(F.lit(2), F.lit(2822400), F.col("frames") + 74).cast("long").alias("most"))


@query("""SELECT user_id, min(epoch_us(ts))::BIGINT AS opened, max(epoch_us(ts))::BIGINT AS used, count(*) AS uses FROM (
SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def idle_sessions(spark, sf_dir):
    """Spans in which an image stays mounted: it goes after 30 idle minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", micros(F.col("ts")).alias("us"))
    return summary.spans_of_use(e, ["user_id"], "ts", "us", "30 minutes")


@query("""WITH f AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_type, event_id, place::BIGINT AS place, 'start' AS origin FROM f WHERE place >= 3 AND place < 13 UNION ALL SELECT user_id, event_type, event_id, place, 'end' FROM f WHERE place >= greatest(n - 5, 0) AND place < greatest(n - 5, 0) + 4""")
def area_seek(spark, sf_dir):
    """Bounded reads of every area: ten frames from the fourth on, and four from the fifth but last on."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    reads = [summary.read_from(e, ["user_id", "event_type"], ["event_id"], offset, count, origin).withColumn("origin", F.lit(origin)) for offset, count, origin in ((3, 10, "start"), (5, 4, "end"))]
    return reads[0].unionByName(reads[1])


@query("""SELECT DISTINCT p_brand, p_type FROM part""")
def distinct_names(spark, sf_dir):
    return summary.distinct_names(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""SELECT DISTINCT l_orderkey AS k, g::BIGINT AS line, coalesce(q, 150)::BIGINT AS payload FROM (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) o, range(1, 9) r(g)
LEFT JOIN (SELECT l_orderkey AS ok, l_linenumber AS ln, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2) l ON ok = l_orderkey AND ln = g WHERE g <= n + 1""")
def silence_fill(spark, sf_dir):
    """Frames that are missing up to one past the last are filled with the silence byte."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("line")).agg(F.max("l_quantity").cast("long").alias("payload"))
    upto = li.groupBy("k").agg((F.max("line") + 1).alias("last"))
    return summary.fill_silence(li, ["k"], "line", "payload", upto, F.lit(audio.SILENCE).cast("long")).select("k", "line", "payload")


def vector_frames(spark, sf_dir):
    """Each label's vectors as the frames of a stereo track."""
    e = table(spark, sf_dir, "embeddings")
    no = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return e.select(F.col("label").alias("track"), no.alias("frame_no"), F.lit(2).alias("channels"), F.lit(2822400).alias("rate"), F.rpad(F.lit(""), 9408, F.concat(F.col("vec_id").cast("string"), F.lit(":"))).cast("binary").alias("payload"))


FRAME_SQL = """SELECT label::VARCHAR AS track, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame_no,
  ((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 37632)::BIGINT AS sample_offset, md5(left(repeat(vec_id || ':', 9408), 9408)) AS md5 FROM embeddings"""


def _round_trip(spark, sf_dir, kind, source, write, ending):
    folder = shared_dir(spark)
    spark.dataSource.register(source)
    audio_sink.write_tracks(vector_frames(spark, sf_dir), folder, write, ending).write.mode("overwrite").parquet(f"{folder}/written")
    back = spark.read.format(kind).load(folder)
    return back.select(F.regexp_extract("path", r"([^/]*)\.\w+$", 1).alias("track"), "frame_no", "sample_offset", F.md5("payload").alias("md5"))


@query(FRAME_SQL)
def dsf_round_trip(spark, sf_dir):
    """Frames written to one DSF file per track and read back through the data source."""
    return _round_trip(spark, sf_dir, "dsf", dsf.DsfSource, audio_sink.write_dsf, ".dsf")


@query(FRAME_SQL)
def dsdiff_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "dsdiff", dsdiff.DsdiffSource, audio_sink.write_dsdiff, ".dff")


@query("""SELECT p_partkey, p_name AS title, p_brand AS brand, p_type AS kind FROM part""")
def id3_round_trip(spark, sf_dir):
    """Tags rendered to binary and parsed back."""
    p = table(spark, sf_dir, "part").select("p_partkey", id3.render_tag(F.create_map(F.lit("TIT2"), "p_name", F.lit("TXXX:Brand"), "p_brand", F.lit("COMM"), "p_type")).alias("tag"))
    t = p.select("p_partkey", id3.parse_tag("tag").alias("t"))
    return t.select("p_partkey", F.col("t")["TIT2"].alias("title"), F.col("t")["TXXX:Brand"].alias("brand"), F.col("t")["COMM"].alias("kind"))


@query(f"""WITH {LINES}, t AS (SELECT l_orderkey, line, frames, (line * 60 + (l_partkey % 3) * 5)::BIGINT AS s, 'P' || l_partkey AS title FROM l),
g AS (SELECT *, coalesce(lag(s + frames) OVER (PARTITION BY l_orderkey ORDER BY line), 0)::BIGINT AS pe FROM t),
x AS (SELECT l_orderkey, line AS track, unnest(list_filter([printf('  TRACK %02d AUDIO', line), '      TITLE "' || title || '"', CASE WHEN s > pe THEN '      INDEX 00 ' || printf('%02d:%02d:%02d', pe // 75 // 60, pe // 75 % 60, pe % 75) END,
  '      INDEX 01 ' || printf('%02d:%02d:%02d', s // 75 // 60, s // 75 % 60, s % 75)], lambda v: v IS NOT NULL)) AS line, unnest(range(0, CASE WHEN s > pe THEN 4 ELSE 3 END)) AS k FROM g
UNION ALL SELECT o_orderkey, 0, unnest(['REM Generated by sigmaspark', 'REM DATE ' || year(o_orderdate), 'PERFORMER "' || o_orderpriority || '"', 'TITLE "Order ' || o_orderkey || '"', 'FILE "audio.dff" WAVE']), unnest(range(0, 5)) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT l_orderkey AS album_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY track, k) - 1)::BIGINT AS line_no, line FROM x""")
def cue_sheet(spark, sf_dir):
    """A CUE sheet for each order."""
    none = F.lit(None).cast("string")
    t = lines(spark, sf_dir).select(F.col("l_orderkey").alias("album_id"), F.col("line").alias("track"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("title"), none.alias("performer"), none.alias("isrc"), (F.col("line") * 60 + (F.col("l_partkey") % 3) * 5).alias("start_frame"), "frames")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("album_id"), F.col("o_orderpriority").alias("artist"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), none.alias("genre"), F.year("o_orderdate").alias("year"), none.alias("catalog"), none.alias("file"))
    return text_sink.cue_sheet(o, t, empty=False)


FLAG_SQL = "CASE event_type WHEN 'click' THEN 'Stereo' WHEN 'view' THEN 'Multi-channel' WHEN 'purchase' THEN 'DST' ELSE 'Unknown' END"


@query(f"SELECT event_id, {FLAG_SQL} AS label FROM events")
def labels(spark, sf_dir):
    names = {"click": "Stereo", "view": "Multi-channel", "purchase": "DST"}
    return table(spark, sf_dir, "events").select("event_id", label_names.named(F.col("event_type"), names).alias("label"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker tracks of a selection, named and timed."""
    t = tracks.select_tracks(marker_tracks(spark, sf_dir), "1-12", 99)
    return t.select("user_id", "track", "sel_pos", text.track_filename(F.col("track"), F.lit(None).cast("string")).alias("name"), ((F.col("end") - F.col("start")) / F.lit(1e6)).alias("seconds"))
