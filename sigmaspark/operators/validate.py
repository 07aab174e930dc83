"""Structural validation of DSF and DSDIFF files: one row for each finding.

The sources' table ``chunks`` walks a file's whole tree, whatever is wrong with it, and reads heads
only. Rules are data: a name, a severity and a condition over a chunk with what is known of its
file and its parent. Rules on a chunk are one projection; those on what must be there, or only
once, are one aggregation by file. No file is looked at by more than one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    name: str
    broken: str  # SQL condition over a chunk's columns
    severity: str = ERROR


def unsigned(at: int, n: int, little: bool = False) -> str:
    """SQL of the integer in ``n`` bytes of a chunk's data from the ``at``-th on (from 0)."""
    parts = [f"substring(hex(head), {2 * (at + i) + 1}, 2)" for i in (reversed(range(n)) if little else range(n))]
    return f"cast(conv(concat({', '.join(parts)}), 16, 10) AS decimal(20, 0))"


# Fixed values of the formats: sizes of heads, ranges of fields, and what a file must have.
FMT = {k: unsigned(at, n, True) for k, at, n in (("version", 0, 4), ("id", 4, 4), ("type", 8, 4), ("channels", 12, 4), ("rate", 16, 4), ("bits", 20, 4), ("samples", 24, 8), ("block", 32, 4))}
TOTAL, METADATA = unsigned(0, 8, True), unsigned(8, 8, True)
DSF_RULES = [
    Rule("file too small", "seq = 0 AND file_size < 92"),
    Rule("wrong chunk", "kind <> get(array('DSD ', 'fmt ', 'data'), seq)"),
    Rule("wrong size of the first chunk", "kind = 'DSD ' AND size <> 28"),
    Rule("file is shorter than it says", f"kind = 'DSD ' AND {TOTAL} > file_size"),
    Rule("file is much longer than it says", f"kind = 'DSD ' AND file_size - {TOTAL} > 4096"),
    Rule("metadata lies past the end", f"kind = 'DSD ' AND {METADATA} > 0 AND {METADATA} >= file_size"),
    Rule("metadata lies in the head", f"kind = 'DSD ' AND {METADATA} > 0 AND {METADATA} < 92"),
    Rule("wrong size of the format", "kind = 'fmt ' AND size <> 52"),
    Rule("unknown version or format", f"kind = 'fmt ' AND ({FMT['version']} <> 1 OR {FMT['id']} <> 0)"),
    Rule("bad channels", f"kind = 'fmt ' AND ({FMT['type']} NOT BETWEEN 1 AND 7 OR {FMT['channels']} NOT BETWEEN 1 AND 6)"),
    Rule("bad rate", f"kind = 'fmt ' AND ({FMT['rate']} < 44100 OR {FMT['rate']} % 600 <> 0)"),
    Rule("bad bits or blocks", f"kind = 'fmt ' AND ({FMT['bits']} NOT IN (1, 8) OR {FMT['block']} <> 4096)"),
    Rule("sound lies past the end", "kind = 'data' AND offset + size - 12 > file_size"),
]
DSF_FILE = [
    ("metadata lies in the sound", "metadata > 0 AND metadata < 80 + data_size"),
    ("file is shorter than its sound", "total < 80 + data_size"),
    ("sound has another size than its samples", "abs(ceil(samples * bits / 8) * channels - (data_size - 12)) > 4096 * channels"),
]
SINGLE = ("FVER", "PROP", "DSD ", "DST ", "DSTI", "COMT", "DIIN", "MANF", "FS  ", "CHNL", "CMPR", "ABSS", "LSCO", "FRTE", "EMID", "DIAR", "DITI")
DSDIFF_RULES = [
    Rule("not a form of this kind", "depth = 0 AND (kind <> 'FRM8' OR substring(hex(head), 1, 8) <> '44534420')"),
    Rule("chunk ends past its parent", "stop > parent_stop"),
    Rule("file is longer than its form", "depth = 0 AND file_size > stop + 1", WARNING),
    Rule("version is not the first chunk", "depth = 1 AND kind = 'FVER' AND nth <> 1"),
    Rule("unknown version", f"kind = 'FVER' AND {unsigned(0, 1)} <> 1"),
    Rule("properties are not of sound", "depth = 1 AND kind = 'PROP' AND substring(hex(head), 1, 8) <> '534E4420'"),
    Rule("bad rate", f"kind = 'FS  ' AND (size <> 4 OR {unsigned(0, 4)} = 0 OR {unsigned(0, 4)} % 44100 <> 0)"),
    Rule("channels and their number differ", f"kind = 'CHNL' AND ({unsigned(0, 2)} NOT BETWEEN 1 AND 6 OR size <> 2 + 4 * {unsigned(0, 2)})"),
    Rule("unknown compression", "kind = 'CMPR' AND substring(hex(head), 1, 8) NOT IN ('44534420', '44535420')"),
    Rule("bad start time", f"kind = 'ABSS' AND (size <> 8 OR {unsigned(0, 2)} > 23 OR {unsigned(2, 1)} > 59 OR {unsigned(3, 1)} > 59)"),
    Rule("bad loudspeakers", f"kind = 'LSCO' AND (size <> 2 OR {unsigned(0, 2)} NOT IN (0, 3, 4, 65535))", WARNING),
    Rule("index is no list of places", "kind = 'DSTI' AND size % 12 <> 0"),
    Rule("frames have no head", "depth = 2 AND parent_kind = 'DST ' AND nth = 1 AND kind <> 'FRTE'"),
    Rule("unknown chunk", "depth = 1 AND kind NOT IN ('FVER', 'PROP', 'DSD ', 'DST ', 'DSTI', 'COMT', 'DIIN', 'MANF', 'ID3 ')", WARNING),
]
DSDIFF_FILE = [
    ("no version", "NOT array_contains(kinds, 'FVER')"),
    ("no properties", "NOT array_contains(kinds, 'PROP')"),
    ("no rate", "array_contains(kinds, 'PROP') AND NOT array_contains(kinds, 'FS  ')"),
    ("no channels", "array_contains(kinds, 'PROP') AND NOT array_contains(kinds, 'CHNL')"),
    ("no compression", "array_contains(kinds, 'PROP') AND NOT array_contains(kinds, 'CMPR')"),
    ("no sound", "NOT array_contains(kinds, 'DSD ') AND NOT array_contains(kinds, 'DST ')"),
    ("both kinds of sound", "array_contains(kinds, 'DSD ') AND array_contains(kinds, 'DST ')"),
    ("properties come after the sound", "prop > sound"),
    ("index without frames", "array_contains(kinds, 'DSTI') AND NOT array_contains(kinds, 'DST ')"),
]
FOUND = ["path", "severity", "rule", "offset", "kind"]


def _by_chunk(chunks: DataFrame, rules: list[Rule]) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.expr(r.broken), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.name).alias("rule"))) for r in rules)))
    return chunks.withColumn("hit", F.explode(hits)).select("path", "hit.severity", "hit.rule", "offset", "kind")


def _by_file(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.expr(broken), F.lit(name)) for name, broken in rules)))
    return files.withColumn("rule", F.explode(hits)).select("path", F.lit(ERROR).alias("severity"), "rule", F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("kind"))


def dsf_findings(chunks: DataFrame) -> DataFrame:
    """Findings in table ``chunks`` of DSF files."""

    def of(kind: str, value: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.expr(value).cast("decimal(20,0)")))

    files = chunks.groupBy("path").agg(of("DSD ", TOTAL).alias("total"), of("DSD ", METADATA).alias("metadata"), of("data", "size").alias("data_size"), of("fmt ", FMT["samples"]).alias("samples"), of("fmt ", FMT["bits"]).alias("bits"), of("fmt ", FMT["channels"]).alias("channels"))
    return _by_chunk(chunks, DSF_RULES).unionByName(_by_file(files, DSF_FILE))


def dsdiff_findings(chunks: DataFrame) -> DataFrame:
    """Findings in table ``chunks`` of DSDIFF files."""
    siblings = Window.partitionBy("path", "parent").orderBy("seq")
    same = Window.partitionBy("path", "parent", "kind").orderBy("seq")
    c = chunks.withColumns({"stop": F.col("offset") + F.col("size"), "nth": F.row_number().over(siblings), "again": F.row_number().over(same)})
    up = c.select("path", F.col("seq").alias("parent"), F.col("kind").alias("parent_kind"), F.col("stop").alias("parent_stop"))
    c = c.join(up, ["path", "parent"], "left").withColumn("parent_stop", F.coalesce("parent_stop", "file_size"))
    twice = c.where(F.col("kind").isin(*SINGLE) & (F.col("again") > 1)).select("path", F.lit(ERROR).alias("severity"), F.lit("chunk comes twice").alias("rule"), "offset", "kind")
    first = lambda *kinds: F.min(F.when((F.col("depth") == 1) & F.col("kind").isin(*kinds), F.col("offset")))
    files = chunks.groupBy("path").agg(F.collect_set("kind").alias("kinds"), first("PROP").alias("prop"), first("DSD ", "DST ").alias("sound"))
    return _by_chunk(c, DSDIFF_RULES).unionByName(twice).unionByName(_by_file(files, DSDIFF_FILE))


def findings(spark: SparkSession, path: str) -> DataFrame:
    """All findings in the DSF and DSDIFF files under ``path``: path, severity, rule, offset and kind of the chunk (null for those on the file)."""
    load = lambda kind: spark.read.format(kind).option("table", "chunks").load(path)
    return dsf_findings(load("dsf")).unionByName(dsdiff_findings(load("dsdiff"))).select(FOUND)
