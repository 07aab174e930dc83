"""The pipeline's stages on a small corpus with planted cases."""

import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars > 300").limit(40).collect()
    rows = [(i, r.text, r.lang, r.source, r.n_chars) for i, r in enumerate(real)]
    passage = " ".join(f"{rng.choice(['ba', 'ko', 'ri'])}{rng.choice(['lu', 'men', 'ta'])}{i}" for i in range(40))
    rows += [
        (1000, rows[0][1], "en", "src1", 1),
        (1001, rows[3][1].rsplit(" ", 2)[0], "en", "src2", 1),
        (1002, " ".join(rows[5][1].split()[:60]) + " " + passage, "en", "src3", 1),
        (1003, "1234 5678 !!", None, "src4", 1),
        (1004, None, None, "src4", None),
    ]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs.columns


def test_stages(spark, corpus):
    path, columns = corpus
    docs, ids = spark.read.parquet(f"{path}/documents.parquet"), {}
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "encoding"]
    for i, (name, f) in enumerate(cp.STAGES):
        out = f(spark, docs, path)
        assert out.columns == columns or i == len(cp.STAGES) - 1
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {1003, 1004}.isdisjoint(ids["language_id"]) and {1000, 1001, 1002} <= ids["language_id"]
    assert ids["line_dedup"] >= {1001, 1002}
    assert {1000, 1001}.isdisjoint(ids["near_dedup"]) and {0, 3, 1002} <= ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {1002} == ids["encoding"]


def test_run_gives_the_last_stage(spark, corpus):
    path, _ = corpus
    out = cp.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 30


def test_run_equals_brute_force(spark, corpus):
    """All stages after language identification, worked out in plain Python on what that one kept."""
    import hashlib
    import re

    import public_tokenizers
    from tokenizers import Tokenizer

    from test_llm import brute_lines, expected_groups

    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = [tuple(r) for r in cp.language_id(spark, docs, path).select("doc_id", "text", "lang", "source").collect()]
    cut = [(i, t) for i, n, gone, t in brute_lines(kept) if not gone or t.strip()]
    group = expected_groups(cut)
    one = [(i, t) for i, t in cut if group[i][1] == i]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [split(r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    grams = {tuple(u[s : s + 10]) for u in items for s in range(max(len(u) - 9, 1)) if u}
    clean = [(i, t) for i, t in one if not any(tuple(w[a : a + len(g)]) == g for w in [split(t)] for g in grams for a in range(len(w) - len(g) + 1))]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in clean:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, cp.run(spark, path).collect())) == sorted(want) and len(want) > 30


def test_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, extra columns with names that the operators use, rows that repeat."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, row long, digest string, words string, score double, lang_pred string, ids string, kept boolean"
    text = "the quick brown fox jumps over the lazy dog and runs far away from here today because it was there " * 3
    some = [(i, t, "en", "s", 5, 1, 2, "d", "w", 0.5, "x", "y", True) for i, t in ((1, text), (1, text), (2, None), (3, text + "\r\nend"), (None, text))]
    for rows in ([], some):
        path = str(tmp_path / str(len(rows)))
        spark.createDataFrame(rows, shape).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == [c.split()[0] for c in shape.split(", ")], name
        assert cp.run(spark, path).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if rows:
            assert {r.doc_id for r in docs.collect()} >= {1} and docs.where("n_lines = 1 and score = 0.5 and lang_pred = 'x' and kept").count() == docs.count()
