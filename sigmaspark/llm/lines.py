"""Cross-site line removal by the distinct-site spread of each line.

For each line hash a HyperLogLog sketch of the sites it stands on is merged by aggregation, so
no line's sites are ever gathered in one place. A sketch can only mislead near the threshold:
lines whose estimate lies within ``band`` of it get an exact distinct count. Lines on at least
``min_sites`` sites are boilerplate. Their first copy (that of the smallest document id) stays,
so that the corpus loses no content; every other copy is removed.

A line may stand in a third of all documents. Sketches, counts and distinct pairs of line and
site are put together in each task before they are shuffled, and the joins on a line broadcast
their small side while it has at most ``SMALL`` rows, else spread their hot lines.

Defined results: lines end at a line feed and are compared after trimming ASCII white space at
both ends, carriage returns included; blank lines are never removed. A null text stays null; a
text that loses all its lines becomes empty. A null site counts as one site of its own, a null
document id as larger than any other. Repeated rows of one document id are treated alike. Extra
columns are passed on unchanged, whatever their names; columns named ``n_lines`` and
``n_removed`` are replaced by ``remove``'s own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, stored

MIN_SITES = 5
BAND = 0.25
SMALL = 200_000  # boilerplate lines (16 bytes each) up to which they are broadcast
BLANK = " \t\r\x0b\x0c"


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _hash(line: Column) -> Column:
    return F.xxhash64(_trim(line))


def _lines(df: DataFrame, text: str, *cols: Column) -> DataFrame:
    """Each document's distinct non-blank lines, as hashes."""
    hashes = F.array_distinct(F.transform(F.filter(F.split(F.col(text), "\n"), lambda x: _trim(x) != ""), _hash))
    return df.select(*cols, F.explode(hashes).alias("line"))


def spread(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, text: str = "text", site: str = "source", path: str | None = None) -> DataFrame:
    """Boilerplate lines, stored: ``line`` (hash), ``sites`` (exact near the threshold, else estimated) and ``first`` (document id of the copy that stays)."""
    path = path or shared_dir(df.sparkSession)
    where = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("-")))
    lines = _lines(df, text, F.col("doc_id"), where.alias("site"))
    # Sketches are merged by the aggregation: a task gives one for each line it has seen, however many copies and sites that has.
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(10))).alias("estimate"), F.min("doc_id").alias("first"))
    low, high = min_sites * (1 - band), min_sites * (1 + band)
    sketched = stored(sketched.where(F.col("estimate") >= low), f"{path}/sketched")
    near = sketched.where(F.col("estimate") <= high).select("line")
    if near.count() <= SMALL:
        close = lines.join(F.broadcast(near), "line").select("line", "site").distinct()
    else:
        close = spread_join(stored(lines.select("line", "site"), f"{path}/pairs"), near, "line").distinct()
    exact = close.groupBy("line").agg(F.count("*").alias("exact"))
    found = sketched.join(exact, "line", "left").select("line", F.coalesce("exact", "estimate").alias("sites"), "first")
    return stored(found.where(F.col("sites") >= min_sites), f"{path}/found")


def _cleaned(df: DataFrame, min_sites: int, band: float, text: str, site: str) -> DataFrame:
    """``row`` (a struct of all columns), ``clean``, ``n_lines`` and ``n_removed``."""
    path = shared_dir(df.sparkSession)
    plain = df.select(F.col("doc_id"), F.col(text).alias("text"), F.col(site).alias("source"))
    found = spread(plain, min_sites, band, path=path)
    lines, found = _lines(plain, "text", F.col("doc_id")), found.select("line", "first")
    small = found.count() <= SMALL
    drops = (
        (lines.join(F.broadcast(found), "line") if small else spread_join(stored(lines, f"{path}/lines"), found, "line"))
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.collect_set("line").alias("drop"))
    )
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text).alias("text"), F.col("doc_id").alias("id"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("key")), "left")
    split = F.split("text", "\n")
    stays = F.filter(split, lambda x: (_trim(x) == "") | ~F.array_contains("drop", _hash(x)))
    joined = joined.select("row", "text", split.alias("split"), F.when(F.col("drop").isNotNull(), stays).alias("stays"))
    n = F.coalesce(F.size("split"), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(n)
    gone = F.when(F.col("stays").isNotNull(), n - F.size("stays")).otherwise(F.lit(0)).cast("long")
    return joined.select("row", F.when(F.col("stays").isNull(), F.col("text")).otherwise(F.array_join("stays", "\n")).alias("clean"), n.alias("n_lines"), gone.alias("n_removed"))


def remove(df: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, text: str = "text", site: str = "source") -> DataFrame:
    """``df`` with boilerplate lines cut from ``text``, and ``n_lines`` and ``n_removed``."""
    out = _cleaned(df, min_sites, band, text, site)
    kept = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    return out.select(*(F.col("clean").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept), "n_lines", "n_removed")


def cleaned_rows(df: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", chars: str = "n_chars") -> DataFrame:
    """The columns of ``df`` with lines cut and ``chars`` (if there is such a column) counted anew where any was; documents left without text go."""
    out = _cleaned(df, min_sites, BAND, text, site)
    out = out.where((F.col("n_removed") == 0) | (F.trim("clean", F.lit(BLANK + "\n")) != ""))

    def column(c: str) -> Column:
        if c == text:
            return F.col("clean").alias(c)
        old = F.col(f"row.`{c}`")
        return F.when(F.col("n_removed") > 0, F.length("clean")).otherwise(old).cast(df.schema[c].dataType).alias(c) if c == chars else old.alias(c)

    return out.select(*map(column, df.columns))


def report(df: DataFrame) -> DataFrame:
    return remove(df).select("doc_id", "n_lines", "n_removed", "text")


_SPACE = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
SQL = f"""
WITH l AS (
  SELECT DISTINCT doc_id, coalesce('s' || source, '-') AS site, trim(x, {_SPACE}) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents)
  WHERE trim(x, {_SPACE}) <> ''
), b AS (
  SELECT line, min(doc_id) AS first FROM l GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), x AS (
  SELECT d.doc_id, d.pos, d.x, b.line IS NOT NULL AND b.first <> d.doc_id AS gone
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) d
  LEFT JOIN b ON trim(d.x, {_SPACE}) = b.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM x GROUP BY doc_id
"""
