"""Fill-in-middle transformation by counted-quantifier regular expressions.

A text of n units (code points) is cut at two places a <= b. ``regexp_count`` gives n. Each row
then gets a pattern of its own, with possessive groups ``(.{a}+)``, ``(.{b-a}+)`` and ``(.*+)``
over the whole text; one match captures prefix, middle and suffix, and the replacement puts them
behind their markers in the order of the row's form. Possessive groups take their units once and
give none back, so a match is one pass whatever the places.

``regexp_count`` keeps what it counts, so units are counted ``BLOCK`` at a time and the rest one
by one: a text of many millions of units needs a few copies of itself, not an object a unit.

Forms: ``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``,
``plain`` the text itself. A text that is empty or holds a marker stays plain, so the markers in
an output are the only ones, and ``restore`` finds the parts again by them. All of it is
expressions of a row: nothing is shuffled, and a lost task is run again by itself.

Defined results: a null text counts as empty; a null id as an empty text in the hash, so rows
without an id share one draw; repeated rows are cut alike, as the id alone decides. Every unit
counts, line feeds and marks included. Extra columns are passed on whatever their names, but for
those the functions add, which replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SPM_SHARE = 10, 20  # per cent of all texts that stay plain, and of the rest that are spm
BLOCK = 1024
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def units(text: Column) -> Column:
    """Code points of ``text``, as long."""
    rest = F.regexp_replace(text, rf"(?s)\A(?:.{{{BLOCK}}}+)*+", "")
    return F.regexp_count(text, F.lit(f"(?s).{{{BLOCK}}}+")).cast("long") * BLOCK + F.regexp_count(rest, F.lit("(?s)."))


def draws(key: Column, seed: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_pattern(a: Column, b: Column) -> Column:
    """A row's pattern: exactly ``a`` units, exactly ``b - a`` units, and what is left."""
    return F.concat(F.lit(r"(?s)\A(.{"), a, F.lit(r"}+)(.{"), b - a, F.lit(r"}+)(.*+)\z"))


def transform(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", plain: int = PLAIN_SHARE, spm: int = SPM_SHARE) -> DataFrame:
    """``df`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{key}`"), seed)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), whole.alias("whole"), units(whole).alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.contains("whole", F.lit(PREFIX)) | F.contains("whole", F.lit(SUFFIX)) | F.contains("whole", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= 100 - plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.select("row", "whole", "n", form.alias("form"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    plain_row = F.col("form") == "plain"
    return rows.select(
        *(F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in ADDED),
        "n",
        "form",
        F.when(~plain_row, F.col("a")).alias("prefix_chars"),
        F.when(~plain_row, F.col("b") - F.col("a")).alias("middle_chars"),
        F.when(plain_row, F.col("whole")).otherwise(F.regexp_replace("whole", cut_pattern(F.col("a"), F.col("b")), order)).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` got, from its output and form alone. A null form is plain."""

    def parts(*marks: str) -> Column:
        return F.lit(r"(?s)\A" + marks[0] + "(.*?)" + marks[1] + "(.*?)" + marks[2] + r"(.*+)\z")

    psm = F.regexp_replace(output, parts(PREFIX, SUFFIX, MIDDLE), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, parts(SUFFIX, PREFIX, MIDDLE), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""
    out = transform(df.select("doc_id", "text"))
    return out.select(
        "doc_id",
        *ADDED[:4],
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_PART = "(('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {}, 8))::BIGINT)"
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
         {_PART.format(1)} AS h1, {_PART.format(9)} AS h2, {_PART.format(17)} AS h3, {_PART.format(25)} AS h4
  FROM documents
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN_SHARE} THEN 'plain'
              WHEN h4 % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y ELSE '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
