"""Fill-in-middle, sharding and run detection against brute force, with the cases their docstrings define."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmaspark.llm import fim, runs, shards

SCHEMA = "doc_id long, text string, row int, `words` string, n int, shard string, size string, runs int, `a.b` int"
LONG = " ".join(f"w{i * 7919 % 1000}" for i in range(60_000))
TEXTS = [None, "", "a", "é😀\n\r\n x", "say <P> now", "<S>", "a <M", "<" * 40, "x" * 3000, "😀" * 1024, "y" * 1025 + "\n", LONG, " \t\n ", "$1 \\2 $0 \\", "a b c " * 9]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w", 2, "s", "z", 3, 4) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, [*enumerate(TEXTS), (None, "no id at all"), (None, None), (3, TEXTS[3]), (3, TEXTS[3]), (3, "another text of that id")])


@pytest.fixture(scope="module")
def nothing(spark):
    return rows(spark, [])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11: fill-in-middle


def brute_fim(doc_id, text):
    t = text or ""
    hx = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(hx[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    x, y, z = t[:a], t[a:b], t[b:]
    return len(t), *(("spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"))


def test_fim_equals_brute_force(spark, odd, nothing):
    rng = random.Random(2)
    more = rows(spark, [(i, "".join(rng.choice("<P>SM$\\é😀\n ab") for _ in range(rng.randrange(60)))) for i in range(100, 600)])
    df = odd.union(more)
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "row", "words", "shard", "size", "runs", "a.b", *fim.ADDED]
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.digests(nothing).count() == 0 and fim.digests(odd).count() == odd.count()


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 2048, 5000])
def test_units_are_counted_by_blocks(spark, n):
    df = spark.createDataFrame([("é" * n,), ("😀" * n,), ("\n" * n,)], "t string")
    assert [r[0] for r in df.select(fim.units(F.col("t"))).collect()] == [n] * 3


def test_fim_draws_its_own_share(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    form = {r.form: r["count"] for r in fim.transform(df, plain=0, spm=50).groupBy("form").count().collect()}
    assert set(form) == {"psm", "spm"} and abs(form["psm"] - 2000) < 200


def test_very_long_text(spark):
    text = "ab\n😀" * 500_000
    r = fim.digests(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert r.n == 2_000_000 and r.output_sha256 == sha(brute_fim(7, text)[4]) and r.restored_sha256 == sha(text)


# ---- 12: sharding


def check_shards(got, texts, n):
    assert len(got) == len(texts)
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < n for s in by)
    for s, x in by.items():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.text_crc32, -1 if r.doc_id is None else r.doc_id) for r in order]
    assert keys == sorted(keys)
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    assert all(abs(sum(r.size for r in by.get(s, [])) - total / n) <= most for s in range(n))
    return by


def test_shards_are_contiguous_and_balanced(spark, odd, nothing):
    got = shards.report(odd).collect()
    check_shards(got, [r.text for r in odd.collect()], 24)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert shards.report(nothing).count() == 0
    whole = shards.place(shards.sized(odd))
    assert whole.columns == ["doc_id", "text", "row", "words", "n", "runs", "a.b", "size", "text_crc32", "shard", "slot"] and whole.count() == odd.count()
    assert shards.report(rows(spark, [(1, "one row")])).count() == 1


def test_shards_equal_the_sums(spark):
    rng = random.Random(4)
    texts = ["the same text"] * 700 + ["t" * int(rng.paretovariate(1.2) * 10) for _ in range(1300)]
    df = rows(spark, [(i % 1500, t) for i, t in enumerate(texts)])  # ids repeat too
    got = shards.report(df, 7).collect()
    by = check_shards(got, texts, 7)
    assert len(by) == 7
    order = sorted(got, key=lambda r: (r.text_crc32, r.doc_id, r.shard, r.slot))
    upto, total = 0, sum(r.size for r in got)
    for r in order:
        upto += r.size
        assert r.shard == (2 * upto - r.size) * 7 // (2 * total)
    same = {r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text")}
    assert max(same) - min(same) == len(same) - 1


def test_one_row_repeated_is_spread(spark):
    df = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again").alias("text"))
    got = {r.shard: r["count"] for r in shards.report(df).groupBy("shard").count().collect()}
    assert len(got) == 24 and max(got.values()) - min(got.values()) <= 1


def test_shard_plan_is_native(spark, sf):
    plan = shards.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_shards_are_written_as_folders(spark, tmp_path):
    df = rows(spark, [(i, f"text {i}" * (i % 9)) for i in range(200)])
    shards.write(df.select("doc_id", "text"), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


@pytest.mark.parametrize("module", [fim, shards])
def test_sql_gives_the_same_rows(spark, sf, module):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(module.SQL)
    names = want.columns
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = module.digests(df) if module is fim else module.report(df)
    assert sorted(out.columns) == sorted(names)
    assert sorted((tuple(r) for r in out.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)


# ---- 13: runs


def brute_runs(w, least=12):
    n, out = len(w), {}
    for p in range(1, n // 2 + 1):
        j = 0
        while j < n - p:
            if w[j] != w[j + p]:
                j += 1
                continue
            s = j
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - s >= max(least, 2 * p):
                out.setdefault((s, j + p), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def found(docs, least=12):
    counts, every, _ = runs._batch([" ".join(w).encode() for w in docs], least)
    triples = list(zip(*(x.tolist() for x in every), strict=True))
    ends = np.cumsum(counts).tolist()
    return [triples[b - c : b] for b, c in zip(ends, counts.tolist(), strict=True)]


def random_words(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 20])
    w = [str(rng.randrange(kinds)) for _ in range(rng.choice([0, 5, 12, 13, 30, 60, 150]))]
    for _ in range(rng.randrange(3)):
        if w:
            a, q = rng.randrange(len(w)), rng.randint(1, 20)
            w = w[:a] + w[a : a + q] * rng.randint(2, 6) + w[a:]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [random_words(rng) for _ in range(rng.randint(1, 12))]
        assert found(docs) == [brute_runs(w) for w in docs]


def test_words_of_many_runs():
    a, b = "a", "ab"
    while len(b) < 2000:
        a, b = b, b + a
    tm = "a"
    while len(tm) < 2048:
        tm += tm.translate(str.maketrans("ab", "ba"))
    for w in (list(b), list(tm), ["x"] * 1000, list("ab" * 500), [f"w{i % 250}" for i in range(1000)], [f"w{i}" for i in range(1000)]):
        assert found([w]) == [brute_runs(w)]


def test_exact_comparison_finds_the_same():
    rng = random.Random(9)
    for _ in range(30):
        w = np.array([rng.randrange(3) for _ in range(200)] + [7, 8] * 20, np.int64)
        a, b = runs.find(w, 9, np.zeros(1, np.int64)), runs.find(w, 9, np.zeros(1, np.int64), exact=True)
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_a_lying_hash_is_noticed(monkeypatch):
    monkeypatch.setattr(runs, "mixed", lambda x: np.zeros(len(x), np.uint64))
    rng = random.Random(3)
    for _ in range(20):
        w = random_words(rng)
        assert found([w]) == [brute_runs(w)]


def test_repair_leaves_no_pair_twice():
    rng = random.Random(1)
    for _ in range(50):
        w = np.array([rng.randrange(4) for _ in range(300)], np.int64)
        g = runs.Grammar(w.copy(), 4)
        pairs = list(zip(g.seq.tolist(), g.seq.tolist()[1:], strict=False))
        assert all(pairs.count(x) == 1 for x in pairs)

        def spell(s, g=g):
            return [s] if s < 4 else spell(g.left[s - 4]) + spell(g.right[s - 4])

        assert sum(map(spell, g.seq.tolist()), []) == w.tolist()
        assert len(set(zip(g.left.tolist(), g.right.tolist(), strict=True))) == len(g.left)


def test_runs_grow_linearly():
    import time

    def took(n):
        began = time.process_time()
        for w in (["x"] * n, [f"w{i % 999}" for i in range(n)], [f"w{i * i % 1009}" for i in range(n)]):
            found([w])
        return time.process_time() - began

    took(1000)
    assert took(160_000) < 8 * took(40_000) + 1


def brute_report(doc_id, text):
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    r = brute_runs(w)
    drop = {i for s, k, q in r for i in range(s + q, s + k)}
    best = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else None
    return (len(r), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in r)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_report_equals_brute_force(spark, odd, nothing):
    rng = random.Random(8)
    more = rows(spark, [(i, " ".join(random_words(rng))) for i in range(100, 700)] + [(i, " \t".join(f"v{rng.randrange(40)}" for _ in range(rng.randrange(200)))) for i in range(700, 900)])
    short = odd.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    df = short.union(more)
    cols = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    text = {}
    for r in df.collect():
        text.setdefault(r.doc_id, []).append(brute_report(r.doc_id, r.text))
    got = runs.report(df)
    assert got.columns == ["doc_id", *cols]
    have = {}
    for r in got.collect():
        have.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert {k: sorted(v, key=str) for k, v in have.items()} == {k: sorted(v, key=str) for k, v in text.items()}
    assert runs.report(nothing).count() == 0 and runs.report(odd).count() == odd.count()


def test_detect_keeps_columns(spark, odd):
    out = runs.detect(odd.where("doc_id = 14"))
    assert out.columns == [c for c in odd.columns if c != "runs"] + ["runs", "collapsed"]
    r = out.first()
    assert [tuple(x) for x in r.runs] == [(0, 27, 3)] and r.collapsed == "a b c" and r["a.b"] == 4


def test_report_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in runs.report(docs).collect()}
    some = [r for r in docs.collect() if len((r.text or "").split()) < 400]
    assert len(got) == docs.count() and len(some) > 50
    for r in some:
        assert tuple(got[r.doc_id])[1:] == brute_report(r.doc_id, r.text)
