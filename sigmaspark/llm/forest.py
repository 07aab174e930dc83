"""Nearest neighbours by largest inner product with a hash-prefix forest.

Each of ``TREES`` trees gives every vector a string of ``BITS`` signs of random projections.
Inner products become angles by one more coordinate, which fills a vector up to the greatest
length; a query has 0 there. A tree is the sorted array of its strings, so the vectors whose
strings share a prefix with a query's are one range of it.

1. *Directory.* The vectors under each prefix of up to ``bits`` (about log2 of the table's size,
   at most ``DIRECTORY``) are counted; the counts are one small table a tree.
2. *Descent.* A query whose range is still longer than wanted at the directory's end goes on in
   the trees' sorted arrays themselves, dealt by directory prefix: binary searches give the
   length of its range at every prefix length down to its longest match.
3. *Ascent.* All trees go up together, one bit at a time, until their ranges hold the wanted
   number of vectors between them. That is the query's prefix length.
4. *Comparison.* The arrays are dealt by tree and a short prefix; each query meets its ranges,
   every vector in them is compared, and the nearest of all trees are merged.

How many vectors are wanted is measured, not set: the ``SAMPLE`` queries that a hash puts first
are compared with every vector, and the smallest number is taken at which the forest finds
``TARGET`` of their true neighbours. Vectors that cluster need few; vectors that are noise have
no near neighbours to tell apart and need a large share of the table, which the forest then
searches. A query that still finds fewer than ``k`` neighbours searches whole trees.

Of equal vectors the 3 * (k + 1) with the smallest ids take part, more of them can't be among the
nearest ``k``. So a vector that a third of all rows share is neither a long range nor many
queries: each distinct query is searched once and its result joined to all its ids. Prefixes
that hold more than ``PART`` vectors are split into parts and their queries into blocks.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, neither do rows without an id. Rows that repeat an id count
as one neighbour, at their best score, and as one query. Scores are sums of products in double
precision, always in the same order, so equal vectors have equal scores; ties go to the smaller
id. Extra columns are not touched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, spread_join, stored

TREES = 32
BITS = 48
DIRECTORY = 14
PART = 4096
SPLIT = 512  # strings of a directory prefix that are searched in one task
SAMPLE = 64
TARGET = 0.96
SEED = 11
SPARE = 3  # times k + 1: what is kept of each range before the exact order is known


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim + 1, TREES * BITS)).astype(np.float32)


def _codes(x: np.ndarray, last: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(row, tree) sign strings, the first sign being the highest bit."""
    signs = (x.astype(np.float32) @ planes[:-1] + last.astype(np.float32)[:, None] * planes[-1]) > 0
    packed = np.packbits(signs.reshape(len(x), TREES, BITS), axis=2)
    out = np.zeros((len(x), TREES), np.int64)
    for k in range(BITS // 8):
        out = out << 8 | packed[:, :, k]
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of two strings."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]  # exact, as strings are shorter than a double's fraction


def _reader(wide: bool, dim: int):
    """Reads stored vectors, which keep their table's own precision."""
    return lambda data: np.frombuffer(b"".join(data), np.float64 if wide else np.float32).reshape(-1, dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in an order that depends on nothing but their length."""
    return (a.astype(np.float64) * b.astype(np.float64)).sum(1)


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, row of x, score) of the ``keep`` nearest different ids of each query; ids are sorted."""
    out = []
    first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
    once = len(first) == len(ids)
    for a in range(0, len(q), 256):
        part = q[a : a + 256].astype(np.float64)
        s = part @ x.T.astype(np.float64)
        if not once:  # rows that repeat an id: its best row
            best = np.maximum.reduceat(s, first, axis=1)
        m = min(keep, len(first))
        values = s if once else best
        cut = np.partition(values, len(first) - m, axis=1)[:, len(first) - m]
        p, c = np.nonzero(values >= cut[:, None] - 1e-9 * np.abs(s).max())  # what rounding may have put below
        if not once:
            last = np.append(first[1:], len(ids))
            c = np.array([first[j] + int(s[i, first[j] : last[j]].argmax()) for i, j in zip(p, c)], np.int64)
        v = dots(part[p], x[c])
        order = np.lexsort((ids[c], -v, p))
        p, c, v = p[order], c[order], v[order]
        rank = np.arange(len(p)) - np.searchsorted(p, p)
        ok = rank < keep
        out.append((p[ok] + a, c[ok], v[ok]))
    return out


class Forest:
    """The coded table with its directory; ``search`` builds and asks it."""

    def __init__(self, vectors: DataFrame, every: int, k: int, vec_id: str, embedding: str):
        self.spark, self.path, self.k, self.every = vectors.sparkSession, shared_dir(vectors.sparkSession), k, every
        self.wide = "double" in vectors.schema[embedding].dataType.simpleString()
        raw = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
        fine = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
        raw = raw.where(fine)
        size = raw.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d").first()
        self.dim = int(size["d"]) if size else 0
        if not self.dim:
            return
        self.numbers = _reader(self.wide, self.dim)
        raw = raw.where(F.size("v") == self.dim)
        square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        self.longest = float(raw.agg(F.max(square)).first()[0])
        self._code(raw)
        self._count()

    def _code(self, raw: DataFrame) -> None:
        dim, longest, every, kind = self.dim, self.longest, self.every, np.float64 if self.wide else np.float32

        def code(batches):
            planes = _planes(dim)
            for b in batches:
                x = b.column(1).flatten().to_numpy().reshape(-1, dim)
                ids = b.column(0).to_numpy()
                c = _codes(x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0)), planes)
                mine = ids % every == 0
                qc = np.zeros_like(c)
                qc[mine] = _codes(x[mine], np.zeros(int(mine.sum())), planes)
                flat = lambda y: pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * TREES), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mine), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), flat(c), flat(qc)], names=["id", "is_query", "v", "codes", "query_codes"])

        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        coded = raw.mapInArrow(code, "id long, is_query boolean, v binary, codes array<long>, query_codes array<long>")
        self.coded = stored(coded.withColumn("key", F.sha1("v")), f"{self.path}/codes")
        same = Window.partitionBy("key").orderBy("id", "n")
        light = self.coded.select("key", "id", F.monotonically_increasing_id().alias("n"))
        light = light.withColumn("r", F.row_number().over(same)).where(F.col("r") <= SPARE * (self.k + 1)).groupBy("key").agg(F.collect_set("id").alias("ids"))
        self.classes = stored(light, f"{self.path}/classes")
        vectors = self.coded.groupBy("key").agg(F.first("v").alias("v"), F.first("codes").alias("codes"))
        self.index = stored(vectors.join(self.classes, "key").select(F.explode("ids").alias("id"), "v", "codes"), f"{self.path}/index")
        self.n = self.index.count()
        asks = self.coded.where("is_query").groupBy("key").agg(F.first("v").alias("v"), F.first("query_codes").alias("codes"))
        self.asks = stored(asks.select(F.monotonically_increasing_id().alias("q"), "key", "v", "codes"), f"{self.path}/asks")

    def _count(self) -> None:
        self.bits = bits = int(np.clip(np.ceil(np.log2(max(self.n, 2))), 2, DIRECTORY))

        def count(batches):
            for b in batches:
                c = b.column(0).flatten().to_numpy().reshape(-1, TREES) >> (BITS - bits)
                u, m = np.unique(c + (np.arange(TREES, dtype=np.int64) << bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(m.astype(np.int64))], names=["at", "m"])

        got = self.index.select("codes").mapInArrow(count, "at long, m long").groupBy("at").agg(F.sum("m").alias("m")).toArrow()  # at most TREES * 2**bits rows
        counts = [np.zeros(TREES << bits, np.int64)]
        counts[0][got.column("at").to_numpy()] = got.column("m").to_numpy()
        for _ in range(bits):
            counts.append(counts[-1].reshape(-1, 2).sum(1))
        counts.reverse()  # counts[d]: of prefixes of d bits, tree after tree
        self.sent = self.spark.sparkContext.broadcast(counts)

    def measure(self) -> int:
        """The number of vectors to gather, from SAMPLE queries that are compared with all vectors."""
        k, numbers = self.k, self.numbers
        least = TREES * (k + 1)
        sample = self.asks.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("key", "v", "codes").toArrow()
        if not sample.num_rows or self.n <= k + 1:
            return max(least, TREES * self.n)
        q = numbers(sample.column("v").to_pylist()).astype(np.float64)
        codes = np.array(sample.column("codes").to_pylist(), np.int64)
        sent = self.spark.sparkContext.broadcast((q, codes))

        def look(batches):
            q, codes = sent.value
            held = np.zeros((len(q), BITS + 1), np.int64)
            for b in batches:
                x = numbers(b.column(1).to_pylist())
                c = b.column(2).flatten().to_numpy().reshape(-1, TREES)
                near = np.zeros((len(q), len(x)), np.int64)
                for i in range(len(q)):
                    both = _shared(c, codes[i])
                    held[i] += np.bincount(both.ravel(), minlength=BITS + 1)
                    near[i] = both.max(1)
                s = q @ x.T.astype(np.float64)
                m = min(k + 1, len(x))
                for i in range(len(q)):
                    s[i, (x == q[i]).all(1)] = -np.inf  # the query itself
                p, at = np.nonzero((s >= np.partition(s, len(x) - m, axis=1)[:, len(x) - m][:, None]) & (s > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(s[p, at]), pa.array(near[p, at]), pa.array(np.zeros(len(p), np.int64))], names=["q", "score", "depth", "held"])
            p, d = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(np.full(len(p), -np.inf)), pa.array(d), pa.array(held[p, d])], names=["q", "score", "depth", "held"])

        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        seen = stored(self.index.mapInArrow(look, "q long, score double, depth long, held long"), f"{self.path}/measured")
        held = np.zeros((len(q), BITS + 2), np.int64)
        for r in seen.where("held > 0").groupBy("q", "depth").agg(F.sum("held").alias("m")).collect():  # SAMPLE * BITS rows
            held[r["q"], r["depth"]] = r["m"]
        held = held[:, ::-1].cumsum(1)[:, ::-1]  # vectors, over all trees, that share at least d bits
        order = Window.partitionBy("q").orderBy(F.desc("score"))
        true = seen.where("held = 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "depth").toPandas()  # SAMPLE * k rows
        who, depth = true["q"].to_numpy(), true["depth"].to_numpy()
        if not len(who):
            return least
        need = held[who, depth]  # how many are gathered before this neighbour's range is among them
        for want in np.unique(np.append(need[need > least], least)):
            reached = np.array([np.flatnonzero(held[i] >= want).max(initial=0) for i in range(len(q))])
            if (depth >= reached[who]).mean() >= TARGET:
                return int(want)
        return TREES * self.n

    def depths(self, want: int) -> DataFrame:
        """q, key, v, codes and depth: the longest prefix length at which the ranges of all trees hold enough."""
        bits, sent, spark = self.bits, self.sent, self.spark

        def directory(batches):
            for b in batches:
                c = b.column(3).flatten().to_numpy().reshape(-1, TREES)
                depth = np.full(len(c), -1)
                for d in range(bits, -1, -1):  # ascend in all trees at once
                    m = sent.value[d][(c >> (BITS - d)) + (np.arange(TREES, dtype=np.int64) << d)].sum(1)
                    depth[(depth < 0) & (m >= want)] = d
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.maximum(depth, 0).astype(np.int32))], names=["q", "key", "v", "codes", "depth"])

        shape = "q long, key string, v binary, codes array<long>, depth int"
        asks = stored(self.asks.mapInArrow(directory, shape), f"{self.path}/depths-{want}")
        deep = asks.where(F.col("depth") == bits)
        if bits == BITS or deep.isEmpty():
            return asks

        # Queries in ranges that are long even at the directory's end descend in the sorted arrays.
        def dealt(df, column, is_query):
            at = df.select(F.col(column).alias("who"), F.posexplode("codes").alias("tree", "code"))
            prefix = F.shiftright("code", BITS - bits) + F.shiftleft(F.col("tree").cast("long"), bits)
            return at.select(prefix.alias("at"), "who", "code", F.lit(is_query).alias("asks"))

        asked = dealt(deep, "q", True)
        held = asked.select("at").distinct()
        data = dealt(self.index, "id", False).join(held, "at", "left_semi")

        @F.pandas_udf("int")
        def parts(at: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(-(-sent.value[bits][at.to_numpy()] // SPLIT), 1))

        data = data.withColumn("part", F.pmod(F.xxhash64("who"), parts("at")).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts("at") - 1)))

        def descend(group: pd.DataFrame) -> pd.DataFrame:
            codes, asks = group["code"].to_numpy(), group["asks"].to_numpy()
            array, q = np.sort(codes[~asks]), np.flatnonzero(asks)
            steps = np.arange(bits + 1, BITS + 1)
            low = codes[q][:, None] >> (BITS - steps)[None, :]
            m = np.searchsorted(array, (low + 1) << (BITS - steps)) - np.searchsorted(array, low << (BITS - steps))
            return pd.DataFrame({"q": group["who"].to_numpy()[q], "m": list(m)})

        found = data.unionByName(asked).groupBy("at", "part").applyInPandas(descend, "q long, m array<long>")
        sums = found.groupBy("q").agg(*(F.sum(F.get("m", F.lit(i))).alias(f"m{i}") for i in range(BITS - bits)))
        deeper = sums.select("q", F.greatest(*(F.when(F.col(f"m{i}") >= want, bits + 1 + i).otherwise(bits) for i in range(BITS - bits)), F.lit(bits)).cast("int").alias("deeper"))
        out = asks.join(deeper, "q", "left").withColumn("depth", F.coalesce("deeper", "depth")).select("q", "key", "v", "codes", "depth")
        return stored(out, f"{self.path}/deeper-{want}")

    def near(self, asks: DataFrame, want: int) -> DataFrame:
        """key (of the query's vector), id and score: the nearest found in the ranges of each of ``asks``."""
        bits, sent, every, dim, numbers, keep = self.bits, self.sent, self.every, self.dim, self.numbers, SPARE * (self.k + 1)
        # The length at which most queries stop; arrays are dealt by prefixes of that many bits, or fewer.
        short = int(np.clip(np.floor(np.log2(max(TREES * self.n / max(want, 1), 1))) - 1, 0, bits))

        def parts_of(at: np.ndarray) -> np.ndarray:
            return np.maximum(-(-sent.value[short][at] // PART), 1)

        def blocks_of(at: np.ndarray) -> np.ndarray:
            return np.maximum(-(-sent.value[short][at] // (PART * every)), 1)

        def mixed(ids: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

        shape = "at long, part long, block long, code long, depth int, id long, v binary"  # depth: 0 for a vector, one more than its prefix for a query
        names = ["at", "part", "block", "code", "depth", "id", "v"]

        def deal(batches):
            for b in batches:
                c = b.column(2).flatten().to_numpy().reshape(-1, TREES)
                at = (c >> (BITS - short)) + (np.arange(TREES, dtype=np.int64) << short)
                ids = b.column(0).to_numpy()
                part = mixed(ids)[:, None] % parts_of(at)
                times = blocks_of(at).ravel()
                block = np.concatenate([np.arange(t) for t in times]) if times.max() > 1 else np.zeros(len(times), np.int64)
                who = np.repeat(np.repeat(np.arange(len(ids)), TREES), times)
                cols = [np.repeat(x.ravel(), times) for x in (at, part)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(block), pa.array(np.repeat(c.ravel(), times)), pa.array(np.zeros(len(who), np.int32)), pa.array(ids[who]), b.column(1).take(pa.array(who))], names=names)

        def ask(batches):
            for b in batches:
                c = b.column(2).flatten().to_numpy().reshape(-1, TREES)
                depth, mine = b.column(3).to_numpy(), mixed(b.column(0).to_numpy())
                cols: list[list] = [[], [], [], [], [], []]
                for i, d in enumerate(depth):
                    top = min(int(d), short)
                    below = np.arange(1 << (short - top), dtype=np.int64)
                    at = (((c[i] >> (BITS - top)) + (np.arange(TREES, dtype=np.int64) << top))[:, None] << (short - top)) + below[None, :]
                    tree, at = np.repeat(np.arange(TREES), len(below)), at.ravel()
                    full = sent.value[short][at] > 0
                    tree, at = tree[full], at[full]
                    times = parts_of(at)
                    cols[0].append(np.repeat(at, times))
                    cols[1].append(np.concatenate([np.arange(t) for t in times]) if len(times) else times)
                    cols[2].append(np.repeat(c[i][tree], times))
                    cols[3].append(np.full(int(times.sum()), d + 1, np.int32))
                    cols[4].append(np.full(int(times.sum()), i))
                    cols[5].append(np.repeat(mine[i] % blocks_of(at), times))
                if not cols[0]:
                    continue
                who = np.concatenate(cols[4])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(cols[k])) for k in (0, 1, 5, 2, 3)), b.column(0).take(pa.array(who)), b.column(1).take(pa.array(who))], names=names)

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            ids, code, depth = group["id"].to_numpy(), group["code"].to_numpy(), group["depth"].to_numpy()
            x = numbers(group["v"])
            data = np.flatnonzero(depth == 0)
            data = data[np.argsort(code[data], kind="stable")]
            asks, out = np.flatnonzero(depth > 0), []
            if len(asks) and len(data):
                d = depth[asks].astype(np.int64) - 1
                prefix = code[asks] >> (BITS - d)
                for key in np.unique(np.stack([d, prefix], 1), axis=0):
                    q = asks[(d == key[0]) & (prefix == key[1])]
                    lo, hi = key[1] << (BITS - key[0]), (key[1] + 1) << (BITS - key[0])
                    span = data[np.searchsorted(code[data], lo) : np.searchsorted(code[data], hi)]
                    if len(span):
                        span = span[np.argsort(ids[span], kind="stable")]
                        out += [(ids[q][p], ids[span][c], v) for p, c, v in _best(x[q], ids[span], x[span], keep)]
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pd.DataFrame({"q": cols[0], "id": cols[1], "score": cols[2]})

        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
        dealt = self.index.select("id", "v", "codes").mapInArrow(deal, shape)
        asked = asks.select("q", "v", "codes", "depth").mapInArrow(ask, shape)
        found = dealt.unionAll(asked).groupBy("at", "part", "block").applyInPandas(compare, "q long, id long, score double")
        best = found.groupBy("q", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.k + 1)
        return asks.select("q", "key").join(best.select("q", "id", "score"), "q", "left").select("key", "id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, a row whose id is divisible by ``every``."""
    forest = Forest(vectors, every, k, vec_id, embedding)
    if not forest.dim:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    want = forest.measure()
    asks = forest.depths(want)
    near = stored(forest.near(asks, want), f"{forest.path}/near")
    enough = min(k + 1, forest.index.select("id").distinct().count())
    thin = near.groupBy("key").agg(F.count("id").alias("m")).where(F.col("m") < enough).select("key")
    if not thin.isEmpty():  # whole trees for queries that found too few
        again = asks.join(thin, "key", "left_semi").withColumn("depth", F.lit(0))
        near = near.join(thin, "key", "left_anti").unionByName(stored(forest.near(again, TREES * forest.n), f"{forest.path}/whole"))
    ids = stored(forest.coded.where("is_query").select(F.col("id").alias("query_id"), "key").distinct(), f"{forest.path}/query-ids")
    out = spread_join(ids, near.where("id is not null"), "key").where(F.col("query_id") != F.col("id"))
    out = out.groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
