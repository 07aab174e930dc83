"""What must hold at any size: plans beyond the broadcast sizes, linear time, components to the end, folders that go; and pages in odd wrappers."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sigmaspark.llm import common, decontam, html, pii

STORY = "A long paragraph of the story follows here, with several marks, and it goes on. It has two sentences at least. "
BODY = "".join(f"<p>{STORY}{i}.</p>" for i in range(4))
TALK = "".join(f'<div class="comment"><p>{STORY}</p></div>' for _ in range(30))


@pytest.mark.parametrize(
    "page",
    [
        '<body><form action=x><div class="nav"><a href=#>Home</a></div>{}<footer>Foot. Text.</footer></form></body>',
        "<body><form action=x><main><article>{}</article></main></form></body>",
        "<body><form action=x><input><article>{}</article></form></body>",
        '<article class="overflow-hidden">{}</article>',
        '<div class="article-hidden-xs">{}</div>',
        '<div id="subscriber-content">{}</div>',
        '<div class="navy-text">{}</div>',
        '<div class="sharepoint">{}</div>',
        '<div class="skipper-content">{}</div>',
        '<article><p>x</p><section id="discussion">{}</section></article>',
        '<main><p>x</p><section id="related-work">{}</section></main>',
        "<body><form><input><div>{}</div></body>",
        "<body><header><form><input type=text></header><div id=c>{}</div></body>",
        "<body><header>{}</header></body>",
        "<body><nav><a href=#>x</a></nav><aside>{}</aside></body>",
    ],
)
def test_pages_in_odd_wrappers_keep_their_text(page):
    assert html.extract(page.format(BODY)).count("A long paragraph") == 4


@pytest.mark.parametrize(
    ("page", "n"),
    [
        (f'<article><p>{STORY}</p></article><section id="comments">{TALK}</section>', 1),
        (f'<div class="content"><p>{STORY}</p><p>{STORY}</p></div><div id="comments">{TALK}</div>', 2),
        (f'<div class="text"><p>{STORY}</p></div><aside><article><a href=#>More to read now.</a></article></aside>', 1),
        (f'<article>{BODY}</article><div class="related"><p>{STORY}</p></div>', 4),
        (f"<article>{BODY}</article><form><p>{STORY}</p></form>", 4),
        (f'<article>{BODY}<p class="visually-hidden">{STORY}</p></article>', 4),
    ],
)
def test_what_surrounds_the_text_stays_out(page, n):
    assert html.extract(page).count("A long paragraph") == n


@pytest.mark.parametrize("text", [lambda n: "1" * n, lambda n: "one " * n, lambda n: "one-" * n + "x", lambda n: "1." * n, lambda n: "dot " * n, lambda n: "1O" * n, lambda n: "(at) " * n])
def test_personal_data_is_found_in_linear_time(text):
    def took(n):
        began = time.process_time()
        pii.spans(text(n))
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 2.5 * 4 * max(took(50_000), 0.05)


def test_spelled_digits_in_other_letters():
    for x in ("call ſeven ſix five five five one two three four five", "seven SİX five, five, five-one two three four five"):
        assert pii.hinted(x)


def test_components_of_long_chains(spark, tmp_path):
    n = 3000
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges, f"file://{tmp_path}").collect()}
    assert got == dict.fromkeys(range(n), 0) | {n + 1: n + 1, n + 2: n + 1}
    assert len(list(tmp_path.iterdir())) == 1  # the last round's folder


def test_hot_keys_with_many_rows_on_both_sides(spark, tmp_path, monkeypatch):
    left = common.stored(spark.range(6000).select((F.col("id") % 3 * F.col("id")).alias("k"), F.col("id").alias("x")), f"file://{tmp_path}/l")
    right = spark.range(300).select((F.col("id") % 2 * F.col("id")).alias("k"), F.col("id").alias("y"))
    want = sorted(map(tuple, left.join(right, "k").collect()))
    for rows in (100_000, 10):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        out = common.spread_join(left, right, "k", many=True)
        assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_no_text_is_dealt_by_its_words(spark, sf, monkeypatch):
    monkeypatch.setattr(decontam, "SMALL", 0)
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    seen = []
    plain = common.stored

    def spy(df, path):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, path)

    monkeypatch.setattr(decontam, "stored", spy)
    out = decontam.proximity(docs, bench)
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    for plan in seen:
        for line in plan.split("\n"):
            assert not ("hashpartitioning(term" in line and "words#" in line.split("hashpartitioning")[0])
    monkeypatch.undo()
    want = decontam.proximity(docs, bench)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_item_beyond_the_broadcast_size(spark, monkeypatch):
    passage = " ".join(f"word{i}" for i in range(14))
    docs = spark.createDataFrame([(i, f"x{i} {passage} y{i % 7}") for i in range(1500)] + [(9999, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage), (2, "some other text of many words that stands nowhere at all here")], "item_id long, text string")
    want = sorted(map(tuple, decontam.report(docs, bench).collect()))
    near = sorted(map(tuple, decontam.proximity(docs, bench).collect()))
    monkeypatch.setattr(decontam, "SMALL", 0)
    monkeypatch.setattr(common, "HOT_LEAST", 100)
    assert sorted(map(tuple, decontam.report(docs, bench).collect())) == want
    assert sorted(map(tuple, decontam.proximity(docs, bench).collect())) == near
    assert sum(r[5] for r in want) == 1500


def test_a_run_keeps_its_last_input_only(spark, sf):
    before = len(common.made_dirs(spark))
    assert cp.run(spark, sf).count() > 20
    made = [Path(d.removeprefix("file:").replace("///", "/")) for d in common.made_dirs(spark)[before:]]
    assert [p.name for d in made if d.exists() for p in d.iterdir()] == ["3-decontamination"]


def test_groups_are_joined_once_in_a_list():
    """Between groups that a link joins, a list retains no further pairs; a link between two others is not lost."""
    import numpy as np

    from sigmaspark.llm import neardup as nd

    base = np.arange(1, 200, dtype=np.uint64) * nd.GOLD
    far = np.arange(1000, 1200, dtype=np.uint64) * nd.GOLD
    sets = [np.unique(np.append(base, np.uint64(7 + i))) for i in range(60)] + [np.unique(np.append(far, np.uint64(9 + i))) for i in range(2)]
    made = [nd.signature(m) for m in sets]
    keys = [k.view(np.uint64).astype(np.uint32) for k, _ in made]
    near, n = {}, len(sets)
    for c in range(nd.COORDS):
        cols = {
            "rep": np.arange(n), "comp": np.array([i // 15 for i in range(60)] + [8, 9]), "n": np.array(list(map(len, sets))), "own": np.zeros(n, int), "i": np.zeros(n, int), "j": np.zeros(n, int), "c": np.full(n, c), "c2": np.full(n, -1),
            "sketch": [s for _, s in made], "keys": [k.tobytes() for k in keys], "short": [m.tobytes() for m in sets],
        }
        for a, b, _ in nd._compare(cols, False):
            near.setdefault(c, []).append((int(cols["comp"][a]), int(cols["comp"][b])))
    assert all(len(x) <= 4 for x in near.values())
    group: dict[int, int] = {}
    for a, b in (p for x in near.values() for p in x):
        a, b = nd._found(group, a), nd._found(group, b)
        group[max(a, b)] = min(a, b)
    assert [nd._found(group, x) for x in (0, 1, 2, 3, 8, 9)] == [0, 0, 0, 0, 8, 8]
