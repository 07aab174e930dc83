"""Benchmark decontamination with a distributed positional inverted index; DataFrame functions only.

1. The documents' words are stored once, a row's words joined by spaces (the token store).
2. How often each benchmark term occurs in the corpus is counted. A window with a term that
   never occurs can't occur. Every other window gets the positions of its two rarest terms.
3. Postings (term, row, position) of those terms are stored. Each list, shifted by the term's
   place in the item, gives alignments (row, item, shift); intersecting the lists of a window's
   two rarest terms leaves the alignments worth a look.
4. A window of at most two words is matched by those lists alone. The alignments of longer ones
   are gathered for each row, which reads its line from the token store once and compares the
   windows word by word, so matches are exact and a text costs no more than its alignments.

All windows of an item at one shift share one alignment, so a passage costs a few rows, however
long it is. The tables on the benchmark's side are broadcast only while the benchmark has at
most ``SMALL`` words; beyond that the joins shuffle, and rows of hot terms or items stay where
they are.

Proximity matches are a result of their own (``proximity``): an item is near in a row if, for
one of its windows, some stretch of one word more than the window holds all but at most one of
the window's distinct terms, in any order; windows of fewer than ``FEW`` distinct terms must be
there whole. One of a window's two rarest terms is in every such stretch, so only the
surroundings of those are looked at. ``near`` finds terms of an index within a distance.

Defined results: null and empty texts have no words and are hit by nothing, a null text of an
item likewise; rows that repeat a document id stay apart, items that repeat an id count once; a
null item id takes no part. Extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, spread_join, stored

WINDOW = 10
SMALL = 200_000
FEW = 5
OTHERS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), OTHERS), lambda w: w != "")


def token_store(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """row (a number of its own for each row), doc_id, n_words and line, the words joined by spaces; written once."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col(text)).alias("words"))
    return stored(split.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("line")), path)


def _stored_words() -> Column:
    return F.split("line", " ")


def windows(bench: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct items as item_id, words and starts of windows, with the windows' length."""
    items = bench.where("item_id is not null").select("item_id", words(F.col(text)).alias("words")).where(F.size("words") > 0).distinct()
    size = F.size("words")
    return items.select("item_id", "words", F.least(size, F.lit(window)).alias("length"), F.sequence(F.lit(0), F.greatest(size - window, F.lit(0))).alias("starts"))


def postings(tokens: DataFrame, terms: DataFrame, path: str, small: bool = True) -> DataFrame:
    """Stored positional postings (term, row, pos) of the given distinct terms."""
    found = tokens.where("n_words > 0").select("row", F.posexplode(_stored_words()).alias("pos", "term"))
    found = found.join(F.broadcast(terms), "term") if small else spread_join(found, terms, "term")
    return stored(found.select("term", "row", "pos"), path)


def near(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Rows (row, pos) of the first term with every other term at most ``within`` words away; the index must hold them all."""
    held = {r["term"] for r in index.where(F.col("term").isin(terms)).select("term").distinct().collect()}
    if missing := [t for t in terms if t not in held]:
        raise ValueError(f"terms without postings in this index: {missing}")
    found = index.where(F.col("term") == terms[0]).select("row", "pos")
    for t in dict.fromkeys(terms[1:]):
        block = F.floor(F.col("pos") / (within + 1))
        left = found.select("row", "pos", F.explode(F.array(block - 1, block, block + 1)).alias("block"))
        right = index.where(F.col("term") == t).select("row", F.col("pos").alias("other"), F.floor(F.col("pos") / (within + 1)).alias("block"))
        close = (F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other"))
        found = left.join(right, ["row", "block"]).where(close).select("row", "pos").distinct()
    return found


def _often(tokens: DataFrame, items: DataFrame, path: str, small: bool) -> DataFrame:
    """How often each term of the items occurs in the corpus; terms that don't are not in it."""
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    terms = tokens.where("n_words > 0").select(F.explode(_stored_words()).alias("term"))
    # Beyond SMALL the words are counted before they meet the vocabulary, so a hot word is one row a task.
    often = terms.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n")) if small else terms.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term")
    return stored(often, f"{path}/often")


def matches(tokens: DataFrame, items: DataFrame, path: str) -> DataFrame:
    """Exact occurrences: row, item_id, and ``places``, positions that the item hits."""
    items = stored(items.select(F.monotonically_increasing_id().alias("item"), "*"), f"{path}/items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    small = total <= SMALL

    def met(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:  # right has one row a key
        return left.join(F.broadcast(right), key) if small else spread_join(stored(left, f"{path}/{name}"), right, key)

    often = _often(tokens, items, path, small)

    placed = items.select("item", "length", F.explode("starts").alias("start"), "words")
    placed = placed.select("item", "length", "start", F.posexplode(F.slice("words", F.col("start") + 1, F.col("length"))).alias("k", "term"))
    placed = met(placed, often, "term", "placed").select("item", "start", "length", "n", (F.col("start") + F.col("k")).alias("at"), "term")
    rarest = placed.groupBy("item", "start", "length").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("by"))
    rarest = rarest.where(F.size("by") == F.col("length"))  # else a term never occurs
    rarest = stored(rarest.select("item", "start", "length", F.slice("by", 1, 2).alias("by")), f"{path}/rarest")

    anchors = rarest.select("item", F.explode("by").alias("x")).select("item", F.col("x.at").alias("at"), F.col("x.term").alias("term")).distinct()
    index = postings(tokens, anchors.select("term").distinct(), f"{path}/postings", small)
    aligned = (index.join(F.broadcast(anchors), "term") if small else spread_join(index, anchors, "term", many=True)).select("row", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")
    aligned = aligned.groupBy("row", "item", "shift").agg(F.collect_set("at").alias("got"))

    tests = rarest.groupBy("item").agg(F.collect_list(F.struct("start", "length", F.transform("by", lambda x: x["at"]).alias("ats"))).alias("tests"))
    passed = F.filter("tests", lambda t: F.size(F.array_except(t["ats"], F.col("got"))) == 0)
    aligned = met(aligned, tests, "item", "aligned").select("row", "item", "shift", F.transform(passed, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("tests"))

    def places(shift: Column, hits: Column) -> Column:
        return F.flatten(F.transform(hits, lambda t: F.sequence(shift + t["start"], shift + t["start"] + t["length"] - 1)))

    # Alignments are dealt by row once; the items' words join them there.
    by_item = aligned.where(F.size("tests") > 0).repartition("row").groupBy("row", "item").agg(F.collect_list(F.struct("shift", "tests")).alias("at"))
    named = items.select("item", "item_id", F.col("words").alias("item_words"))
    worded = by_item.join(F.broadcast(named), "item") if small else spread_join(stored(by_item, f"{path}/by_item"), named, "item", salt="row")
    by_row = worded.groupBy("row").agg(F.collect_list(F.struct("item_id", "item_words", "at")).alias("items"))
    # Dealt by row whatever the sizes, so that the plan is the same for small and large inputs.
    looked = tokens.where("n_words > 0").select("row", "line").hint("merge").join(by_row, "row").select("row", "items", _stored_words().alias("words"))

    def hits(item: Column, alignment: Column) -> Column:
        """The alignment's windows that are there: both words of short ones are where the lists say, in others single words are fetched, as a slice would copy the text."""

        def there(t: Column) -> Column:
            at = alignment["shift"] + t["start"]
            inside = (at >= 0) & (at + t["length"] <= F.size("words"))
            return (t["length"] <= 2) | inside & F.forall(F.sequence(F.lit(0), t["length"] - 1), lambda k: F.get("words", at + k) == F.get(item["item_words"], t["start"] + k))

        return F.filter(alignment["tests"], there)

    found = F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), F.array_distinct(F.flatten(F.transform(i["at"], lambda a: places(a["shift"], hits(i, a))))).alias("places")))
    return looked.select("row", F.explode(F.filter(found, lambda x: F.size(x["places"]) > 0)).alias("x")).select("row", "x.item_id", "x.places")


def report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    path = shared_dir(docs.sparkSession)
    tokens = token_store(docs, f"{path}/tokens")
    hits = matches(tokens, windows(bench), path)
    by_row = hits.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = tokens.select("row", "doc_id", "n_words").join(by_row, "row", "left")
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def proximity(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_near and near_items (ids joined by commas) of every document: its proximity matches."""
    path = shared_dir(docs.sparkSession)
    tokens = token_store(docs, f"{path}/tokens")
    items = stored(windows(bench).select(F.monotonically_increasing_id().alias("item"), "*"), f"{path}/items")
    small = (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= SMALL
    kept = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    placed = items.select("item", "length", F.explode("starts").alias("start"), "words")
    placed = placed.select("item", "length", "start", F.explode(F.slice("words", F.col("start") + 1, F.col("length"))).alias("term"))
    placed = placed.join(kept(_often(tokens, items, path, small)), "term", "left").select("item", "length", "start", F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "term").alias("x"))
    tests = placed.groupBy("item", "start", "length").agg(F.array_sort(F.collect_set("x")).alias("by"))
    spare = F.when(F.size("by") >= FEW, 1).otherwise(0)
    tests = tests.select("item", "length", F.transform("by", lambda x: x["term"]).alias("terms"), (F.size("by") - spare).alias("need"), F.explode(F.filter(F.slice("by", F.lit(1), spare + 1), lambda x: x["n"] > 0)).alias("x"))
    tests = tests.groupBy(F.col("x.term").alias("term"), "item").agg(F.collect_set(F.struct("length", "need", "terms")).alias("tests"), F.min("need").alias("least"))
    tests = tests.join(items.select("item", "item_id", F.array_distinct("words").alias("item_words")), "item")
    tests = stored(tests, f"{path}/tests")

    texts = tokens.where("n_words > 0").select("row", _stored_words().alias("words"))
    around = F.slice("words", F.greatest(F.col("pos") - WINDOW, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(WINDOW)) + WINDOW + 1)
    if small:
        found = texts.select("row", "words", F.posexplode("words").alias("pos", "term"))
        found = found.select("row", "term", "pos", "words").join(F.broadcast(tests.drop("tests")), "term").withColumn("around", around)
    else:  # places first, and the words around each are cut out where the text is, so that no text is dealt by its words
        found = texts.join(postings(tokens, tests.select("term").distinct(), f"{path}/postings", small), "row")
        found = stored(found.select("row", "term", "pos", around.alias("around")), f"{path}/around")
        found = spread_join(found, tests.drop("tests"), "term", salt="row")
    found = found.where(F.size(F.array_intersect("around", "item_words")) >= F.col("least")).select("row", "term", "item", "item_id", "around")
    # The windows come with a second join: a condition of lambdas is evaluated outside of generated code, where whole texts would be copied for each word.
    tried = tests.select("term", "item", "tests")
    found = found.join(F.broadcast(tried), ["term", "item"]) if small else spread_join(stored(found, f"{path}/found"), tried, ["term", "item"], salt="row")

    def holds(stretch: Column, t: Column) -> Column:
        return F.size(F.array_intersect(stretch, t["terms"])) >= t["need"]

    def close(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("around") - t["length"], F.lit(1)))
        return holds(F.col("around"), t) & F.exists(starts, lambda i: holds(F.slice("around", i, t["length"] + 1), t))

    found = found.where(F.exists("tests", close))
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    out = tokens.select("row", "doc_id").join(by_row, "row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select("doc_id", F.size("items").cast("long").alias("n_near"), F.array_join("items", ",").alias("near_items"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), p AS (
  SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS words
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)
), h AS (
  SELECT rid, item_id, i, p.k FROM p JOIN g ON p.k = g.k AND p.words = g.words
), n AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM h) GROUP BY rid
), s AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""
