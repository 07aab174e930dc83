"""Near-duplicate groups by an inverted join over signature coordinates.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Two documents are linked if
their sets' Jaccard similarity is at least ``PERCENT`` / 100, checked on the full sets; groups
are the connected components of the links.

1. *Classes.* Documents of equal sets collapse into one class, told by the digest of the set.
2. *Postings.* 96 minima, taken three by three, form the 32 coordinates of a signature; each
   class is posted under every coordinate-value pair. Two sets of similarity 0.75 agree in a
   coordinate with a chance of 0.42, so they agree in fewer than ``MATCHES`` of them with a
   chance of 6.5e-7. Each class also has a 256-byte sketch of its set.
3. *Collisions.* Links are wanted up to connectivity, so work shrinks as groups grow together:
   first every class is checked against the smallest one of its lists that it meets most often,
   then against its closest mate in other groups, and at last all pairs of different groups
   that remain are checked. A list whose members are all in one group is skipped. In a list
   that one group dominates, only the classes outside of it are compared with all. A list with
   more than ``CROSS`` pairs between groups is split by the values of a second coordinate that
   its members share, as a pair must agree in two: members that meet nobody a second time drop
   out without being compared. A pair counts in the first coordinates it shares (its prefix) and
   is retained if it agrees in ``MATCHES`` of them and its sketches, and for short texts the sets
   themselves, agree well enough. Lists are dealt in blocks of ``BLOCK`` classes, so no task
   holds a whole long list, and pairs are only emitted above the threshold.
4. *Links.* Retained pairs are confirmed on the full sets, which are worked out again for the
   classes concerned only.

Lists, groups and classes that hold more than a thousandth of all rows are joined spread out.

Defined results: a null or empty text, or one of white space only, has an empty set and is
linked with nothing; a text of fewer than five words has its whole sequence as one shingle.
Rows that repeat a document id count as one document, which is linked as each of its texts is.
A row with a null id is linked with nothing, has a null component and is kept. Extra columns are
not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, shared_dir, small_batches, spread_join, stored

WIDTH = 5
PERCENT = 75
MINIMA, COORDS, SKETCH = 96, 32, 256
MATCHES = 2
AGREE = 0.62  # of sketch bins; 0.75 less 4.8 standard deviations
BLOCK = 2048
LIST = 256  # classes up to which a list is compared as one
CROSS = 2_000_000  # pairs of different groups up to which a list is not split by a second coordinate
SHORT = 512  # shingles up to which a set is compared whole before its pairs are retained; of two groups joined so, a task retains no more pairs
_RNG = np.random.default_rng(20)
MULT = _RNG.integers(1, 1 << 32, MINIMA, dtype=np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
TRIPLES = np.arange(MINIMA).reshape(COORDS, 3)
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(h))
    with np.errstate(over="ignore"):
        m = h[: len(h) - width + 1] * GOLD + np.uint64(width)
        for k in range(1, width):
            m = (m ^ h[k : len(h) - width + 1 + k]) * MIX
            m ^= m >> np.uint64(29)
        m *= GOLD
        m ^= m >> np.uint64(32)
    return np.unique(m)


def signature(m: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Coordinate values (64-bit) and the sketch: in each of 256 ranges of the hash space one byte of the least hash, 0 where empty."""
    x = (m ^ (m >> np.uint64(17))).astype(np.uint32)
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            np.minimum(low, ((x[i : i + 1024, None] ^ ADD) * MULT).min(axis=0), out=low)
        t = low[TRIPLES].astype(np.uint64)
        keys = ((t[:, 0] * GOLD ^ t[:, 1]) * MIX ^ t[:, 2]) * GOLD
        keys ^= keys >> np.uint64(31)
    bins = (m >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    sketch = np.zeros(SKETCH, np.uint8)
    sketch[bins[first]] = (m[first] >> np.uint64(20)) % np.uint64(255) + np.uint64(1)
    return keys.view(np.int64), sketch.tobytes()


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n (set size), digest (of the set; null if empty), keys, sketch and h (a hash of the text)."""

    def run(batches):
        for b in batches:
            n, digest, keys, sketch = [], [], [], []
            for x in b.column(1).to_pylist():
                m = shingles(x)
                n.append(len(m))
                k, s = signature(m) if len(m) else (None, None)
                digest.append(hashlib.blake2b(m.tobytes(), digest_size=16).digest() if len(m) else None)
                keys.append(k)
                sketch.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), b.column(2)], names=["doc_id", "n", "digest", "keys", "sketch", "h"])

    return small_batches(docs).select("doc_id", F.col(text), F.xxhash64(text)).mapInArrow(run, "doc_id long, n long, digest binary, keys array<long>, sketch binary, h long")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those filled in either sketch, for all rows of a against all of b."""
    fa, fb = (a > 0).astype(np.float32), (b > 0).astype(np.float32)
    either = fa.sum(1)[:, None] + fb.sum(1)[None, :] - fa @ fb.T
    same = np.empty((len(a), len(b)), np.float32)
    for i in range(len(a)):
        same[i] = ((b == a[i]) & (a[i] > 0)).sum(1)
    return same / np.maximum(either, 1)


def _agreeing(sk: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sketches of each a and its b agree well enough."""
    ok = np.zeros(len(a), bool)
    for s in range(0, len(a), 4096):
        x, y = sk[a[s : s + 4096]], sk[b[s : s + 4096]]
        either = ((x > 0) | (y > 0)).sum(1)
        ok[s : s + 4096] = ((x == y) & (x > 0)).sum(1).astype(np.float32) / np.maximum(either, 1).astype(np.float32) >= AGREE
    return ok


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two whole sets are similar enough."""
    both = len(a) + len(b) - len(np.union1d(a, b)) if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) else 0
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _found(group: dict[int, int], x: int) -> int:
    """The group that ``x`` has come to belong to."""
    while (up := group.get(x, x)) != x:
        group[x] = group.get(up, up)
        x = up
    return x


def _compare(cols: dict[str, np.ndarray], nearest: bool) -> list[tuple[int, int, float]]:
    """Pairs of one list (or pair of blocks) whose groups differ: each row's closest mate, or all that may be linked."""
    rep, comp, n, own = cols["rep"], cols["comp"], cols["n"], cols["own"]
    first, second = np.flatnonzero(own == cols["i"][0]), np.flatnonzero(own == cols["j"][0])
    sk = np.frombuffer(b"".join(cols["sketch"]), np.uint8).reshape(-1, SKETCH)
    out = []
    if nearest:
        best = np.zeros(len(rep), np.float32)
        mate = np.full(len(rep), -1)
    else:
        kf = np.frombuffer(b"".join(cols["keys"]), np.uint32).reshape(-1, COORDS)
        short, joined = [np.frombuffer(x, np.uint64) for x in cols["short"]], {}
    for at in range(0, len(first), 256):
        f = first[at : at + 256]
        ok = (comp[f][:, None] != comp[second][None, :]) & (4 * np.minimum(n[f][:, None], n[second][None, :]) >= 3 * np.maximum(n[f][:, None], n[second][None, :]))
        rows = np.flatnonzero(ok.any(1))
        if not len(rows):
            continue
        f, ok = f[rows], ok[rows]
        if nearest:
            est = np.where(ok, _agreement(sk[f], sk[second]), 0)
            for side, other, e in ((f, second, est), (second, f, est.T)):
                k = e.argmax(1)
                v = e[np.arange(len(side)), k]
                better = v > best[side]
                best[side[better]], mate[side[better]] = v[better], other[k[better]]
        else:
            # Coordinates first: a pair counts in one of the lists it shares, so sketches are compared once, not in each.
            p, q = np.nonzero(ok)
            p, q = f[p], second[q]
            if cols["i"][0] == cols["j"][0]:
                p, q = p[p < q], q[p < q]
            for s in range(0, len(p), 65536):
                a, b = p[s : s + 65536], q[s : s + 65536]
                same = kf[a] == kf[b]
                prefix = (same.argmax(1) == cols["c"][0]) & (same.sum(1) >= MATCHES)
                if cols["c2"][0] >= 0:
                    same[:, cols["c"][0]] = False
                    prefix &= same.argmax(1) == cols["c2"][0]
                a, b = a[prefix], b[prefix]
                ok = _agreeing(sk, a, b)
                for u, v in zip(a[ok].tolist(), b[ok].tolist()):
                    x, y = _found(joined, int(comp[u])), _found(joined, int(comp[v]))
                    if x == y:  # groups that a link found here joins
                        continue
                    if len(short[u]) and len(short[v]):
                        if not _linked(short[u], short[v]):
                            continue
                        joined[max(x, y)] = min(x, y)
                    out.append((int(rep[u]), int(rep[v]), 1.0))
    if nearest:
        hit = np.flatnonzero((mate >= 0) & (best >= AGREE))
        out = list(zip(rep[hit].tolist(), rep[mate[hit]].tolist(), best[hit].tolist()))
    return out


def _pairs_in_lists(rows: DataFrame, nearest: bool) -> DataFrame:
    """Run ``_compare`` over each (c, c2, key, i, j) of rows dealt and sorted by it."""
    key = ["c", "c2", "key", "i", "j"]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            cols = {k: t.column(k).to_numpy() if k not in ("sketch", "keys", "short") else t.column(k).to_pylist() for k in t.column_names}
            change = np.zeros(t.num_rows, bool)
            for k in key:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            out: list = []
            edges = [0, *np.flatnonzero(change).tolist(), t.num_rows]
            for a, b in zip(edges, edges[1:]):
                if b - a > 1:
                    out += _compare({k: v[a:b] for k, v in cols.items()}, nearest)
            lo = [min(x[0], x[1]) for x in out] if not nearest else [x[0] for x in out]
            hi = [max(x[0], x[1]) for x in out] if not nearest else [x[1] for x in out]
            return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array([x[2] for x in out], pa.float32())], names=["a", "b", "est"])

        for b in batches:
            if not b.num_rows:
                continue
            last = np.zeros(b.num_rows, bool)
            last[:] = True
            for k in key:
                v = b.column(b.schema.get_field_index(k)).to_numpy()
                last &= v == v[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if (~last).any() else 0
            same = held and all(held[-1].column(held[-1].schema.get_field_index(k))[-1] == b.column(b.schema.get_field_index(k))[0] for k in key)
            if held and not same:
                yield flush(pa.Table.from_batches(held))
                held = []
            if cut:
                yield flush(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield flush(pa.Table.from_batches(held))

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long, est float")


def _deal(rows: DataFrame, reps: DataFrame, path: str, c2: bool = False) -> DataFrame:
    """Rows (rep, comp, c, c2, key, own, i, j) of the lists in ``rows`` (rep, comp, c, c2, key) whose members are in several groups.

    Within (c, c2, key, i, j) those with own = i are to be compared with those with own = j.
    """
    key = ["c", "c2", "key"]
    rows = stored(rows.select("rep", "comp", *key), f"{path}-rows")
    per = rows.groupBy(*key, "comp").agg(F.count("*").alias("k"))
    lists = per.groupBy(*key).agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("sq"), F.max("k").alias("most"), F.max_by("comp", F.struct("k", "comp")).alias("major"))
    lists = lists.where(F.col("m") > F.col("most")).select(*key, "m", "most", "major", ((F.col("m") * F.col("m") - F.col("sq")) / 2 > CROSS).alias("wide"))
    lists = stored(lists, f"{path}-lists")
    met = spread_join(rows, lists, key, weight="m")

    # The largest group of a list is dealt in blocks, and all others (few, as pairs between groups are few) go to each.
    near = met.where(~F.col("wide"))
    short, minor = F.col("m") <= LIST, F.col("comp") != F.col("major")
    blocks = F.ceil(F.col("most") / BLOCK).cast("int")
    own = F.when(short | minor, 0).otherwise(F.pmod(F.xxhash64("rep"), blocks).cast("int") + 1)
    near = near.withColumn("own", own).withColumn("i", F.lit(0))
    near = near.withColumn("j", F.explode(F.when(short, F.array(F.lit(0))).when(minor, F.sequence(F.lit(0), blocks)).otherwise(F.array("own"))))
    shape = ["rep", "comp", *key, "own", "i", "j"]
    if lists.where("wide").isEmpty():
        return near.select(*shape)
    wide = met.where("wide")
    if not c2:
        again = wide.select("rep", "comp", "c", "key").join(reps.select("rep", "keys"), "rep").select("rep", "comp", "c", "key", F.posexplode("keys").alias("c2", "key2"))
        again = again.where("c2 > c").select("rep", "comp", "c", "c2", F.xxhash64("key", "key2").alias("key"))
        return near.select(*shape).unionByName(_deal(again, reps, f"{path}-2", True))
    # Sets that share much without being near duplicates: block against block.
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    wide = wide.withColumn("own", F.pmod(F.xxhash64("rep"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    wide = wide.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return near.select(*shape).unionByName(wide.select(*shape))


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    every = stored(described(docs, text).withColumn("row", F.monotonically_increasing_id()), f"{path}/described")
    full = every.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min(F.struct("row", "doc_id", "h")).alias("r"), F.min("doc_id").alias("id"), F.count("*").alias("m"))
    classes = stored(classes.select("digest", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"), "id", "m"), f"{path}/classes")
    reps = stored(every.select("row", "n", "keys", "sketch").join(classes.select(F.col("rep").alias("row")), "row").withColumnRenamed("row", "rep"), f"{path}/reps")
    posted = reps.select("rep", F.posexplode("keys").alias("c", "key"))
    lists = stored(posted.groupBy("c", "key").agg(F.min("rep").alias("lead"), F.count("*").alias("m")).where("m > 1"), f"{path}/lists")
    met = stored(spread_join(posted, lists, ["c", "key"], weight="m").select("rep", "c", "key", "lead"), f"{path}/met")

    # Texts of one document are linked, whatever they say.
    repeated = stored(full.groupBy("doc_id").agg(F.count("*").alias("times"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("times > 1"), f"{path}/repeated")
    once = repeated.isEmpty()

    texts: DataFrame | None = None
    comp: DataFrame | None = None
    tested: DataFrame | None = None

    def sets() -> DataFrame:
        """Full sets of the classes that meet others."""
        nonlocal texts
        if texts is None:
            wanted = classes.join(met.select("rep").distinct(), "rep", "left_semi").select("doc_id", "h", "rep", "digest")

            def run(batches):
                for b in batches:
                    every = [shingles(x) for x in b.column(2).to_pylist()]
                    mine = [hashlib.blake2b(m.tobytes(), digest_size=16).digest() == d for m, d in zip(every, b.column(1).to_pylist())]
                    short = [m.tobytes() if len(m) <= SHORT else b"" for m in every]
                    out = pa.RecordBatch.from_arrays([b.column(0), pa.array([m.tobytes() for m in every], pa.binary()), pa.array(short, pa.binary())], names=["node", "set", "short"])
                    yield out.filter(pa.array(mine, pa.bool_()))

            found = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("h")).join(wanted, ["doc_id", "h"]).select("rep", "digest", "text")
            found = found if once else found.dropDuplicates(["rep"])
            texts = stored(small_batches(found).mapInArrow(run, "node long, set binary, short binary"), f"{path}/sets")
        return texts

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        """Those pairs (a, b) whose full sets are similar enough."""

        def run(batches):
            for b in batches:
                x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
                ok = [_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_())), b.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

        s = sets().select("node", "set")
        both = spread_join(pairs.select("a", "b"), s.withColumnsRenamed({"node": "a", "set": "x"}), "a", salt="b")
        both = both.join(s.withColumnsRenamed({"node": "b", "set": "y"}), "b").select("a", "b", "x", "y")
        return stored(small_batches(both, 256).mapInArrow(run, "a long, b long").distinct(), f"{path}/links-{name}")

    def merge(new: DataFrame, name: str) -> None:
        """Join groups along new links."""
        nonlocal comp
        edges = new if comp is None else comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)
        comp = stored(components(edges, f"{path}/cc-{name}"), f"{path}/comp-{name}")

    def absorb(pairs: DataFrame, name: str) -> None:
        """Confirm new pairs and merge their groups."""
        nonlocal tested
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, f"{path}/pairs-{name}")
        tested = pairs if tested is None else tested.union(pairs)
        if pairs.isEmpty():
            return
        new = confirm(pairs, name)
        if not new.isEmpty():
            merge(new, name)

    def in_lists(nearest: bool, name: str) -> DataFrame:
        rows = met.select("rep", "c", "key")
        if comp is None:
            rows = rows.withColumn("comp", F.col("rep"))
        else:
            rows = rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        rows = _deal(rows.withColumn("c2", F.lit(-1)), reps, f"{path}/deal-{name}")
        shown = reps.select("rep", "n", "sketch", *([] if nearest else ["keys"]))
        if not nearest:
            shown = _short_keys(shown).join(sets().select(F.col("node").alias("rep"), "short"), "rep")
        return stored(_pairs_in_lists(rows.join(shown, "rep"), nearest), f"{path}/near-{name}")

    # The smallest class of the lists a class is in, that which it meets most often.
    leads = met.where("lead <> rep").groupBy("rep", "lead").agg(F.count("*").alias("k")).where(F.col("k") >= MATCHES)
    leads = leads.groupBy("rep").agg(F.max_by("lead", F.struct("k", -F.col("lead"))).alias("lead"))
    absorb(leads.select(F.col("lead").alias("a"), F.col("rep").alias("b")), "lead")
    absorb(in_lists(True, "mate").groupBy("a").agg(F.max_by("b", F.struct("est", -F.col("b"))).alias("b")), "mate")
    absorb(in_lists(False, "all"), "all")
    if not once:
        several = repeated.where("lo <> hi").select("doc_id")
        node = spread_join(full.select("doc_id", "digest"), several, "doc_id").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
        node = stored(node, f"{path}/several")
        same = spread_join(node, node.groupBy("doc_id").agg(F.min("rep").alias("first"), F.count("*").alias("times")), "doc_id", weight="times")
        same = same.where(F.col("first") != F.col("rep")).select(F.col("first").alias("a"), F.col("rep").alias("b"))
        if not same.isEmpty():
            merge(same, "same")

    named = classes.select("digest", "rep", "id", "m")
    if comp is not None:
        least = comp.join(named, comp["node"] == named["rep"]).groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("size"))
        least = spread_join(comp, stored(least, f"{path}/least"), "component", weight="size").select(F.col("node").alias("rep"), "least")
        named = named.join(least, "rep", "left").withColumn("id", F.coalesce("least", "id"))
    named = stored(named.select("digest", "id", "m"), f"{path}/named")
    out = spread_join(full.select("doc_id", "n", "digest"), named, "digest", weight="m").select("doc_id", "n", F.col("id").alias("component_id"))
    alone = every.where("digest is null or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _short_keys(rows: DataFrame) -> DataFrame:
    """Coordinate values cut to 32 bits, packed."""

    def run(batches):
        for b in batches:
            k = b.column(b.schema.get_field_index("keys"))
            packed = [np.asarray(x, np.int64).view(np.uint64).astype(np.uint32).tobytes() for x in k.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("rep", "n", "sketch")] + [pa.array(packed, pa.binary())], names=["rep", "n", "sketch", "keys"])

    return rows.mapInArrow(run, "rep long, n long, sketch binary, keys binary")
